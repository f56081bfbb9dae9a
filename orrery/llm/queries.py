"""Driver queries of the ten operators and the pipeline, at production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, chat_format, decontaminate, langid, line_dedup, mixing, token_files, toxicity, url_trust
from .ngram_join import jaccard_classes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Seeds of the link graph: sites known to be good and bad.
TRUSTED = ("tionsh.example.net", "ththth.example.org", "thther.example.org", "ththon.example.com", "ththan.example.net")
BLOCKED = tuple(f"{name}.example.{tld}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.filter_urls(table(spark, sf_dir, "pages"), TRUSTED, BLOCKED)


def _op1() -> str:
    host = lambda c: f"nullif(rtrim(lower(regexp_extract(trim({c}), '{url_trust.HOST}', 1)), '.'), '')"
    parts = [
        "s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{h}' AS host" for k, hs in (("trust", TRUSTED), ("distrust", BLOCKED)) for h in hs) + ")",
        f"p AS (SELECT page_id, url, {host('url')} AS host, html FROM pages)",
        "l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '" + url_trust.HREF.replace("'", "''") + f"', 1), lambda x: {host('x')}))) AS dst FROM p WHERE host IS NOT NULL)",
        "k AS (SELECT src, dst, count(*) AS n FROM l WHERE dst IS NOT NULL AND dst <> src GROUP BY ALL)",
        "nodes AS (SELECT host FROM p WHERE host IS NOT NULL UNION SELECT dst FROM k UNION SELECT host FROM s)",
        r"up AS (SELECT host AS src, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS dst, 1 AS n FROM nodes)",
        "e AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM k UNION ALL SELECT * FROM up WHERE dst IN (SELECT host FROM nodes)) GROUP BY ALL)",
        "b AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e)",
        "w AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM b)",
        # what each round adds, until it is below the rounding
        f"r AS (SELECT kind, host, 1.0::DOUBLE AS v, 0 AS i FROM s UNION ALL SELECT kind, dst, sum({url_trust.DAMPING} * v * w), i + 1 FROM w JOIN r USING (kind) WHERE w.src = r.host AND i < 140 GROUP BY kind, dst, i)",
        "t AS (SELECT kind, host, sum(v) AS v FROM r GROUP BY ALL)",
    ]
    score = lambda k: f"round(coalesce((SELECT v FROM t WHERE kind = '{k}' AND host = p.host), 0), 6)"
    return f"WITH RECURSIVE {', '.join(parts)}, o AS (SELECT page_id, url, host, {score('trust')} AS trust, {score('distrust')} AS distrust FROM p) SELECT *, NOT (distrust >= 0.05 AND distrust > trust) AS keep FROM o"


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "links")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_tokens(table(spark, sf_dir, "documents"), corpus_pipeline.TOKENIZER)


_OP7 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score
FROM s QUALIFY rank <= 10
"""

_OP8 = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), w AS (
  SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[\p{L}\p{N}_]+'))) AS ws FROM l
), f AS (
  SELECT ws, len(ws) AS size, min((doc_id, line_no)) AS f, row_number() OVER (ORDER BY min((doc_id, line_no))) AS s
  FROM w WHERE len(ws) > 0 GROUP BY ws
), t AS (SELECT s, size, unnest(ws) AS word FROM f),
near AS (
  SELECT a.s AS a, b.s AS b, count(*) / (a.size + b.size - count(*)) AS jaccard
  FROM t a JOIN t b ON a.word = b.word AND a.s < b.s AND a.size >= 0.8 * b.size - 1e-9 AND b.size >= 0.8 * a.size - 1e-9
  GROUP BY a.s, b.s, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.8 - 1e-9
), best AS (SELECT b, min(a) AS a, arg_min(jaccard, a) AS jaccard FROM near GROUP BY b),
m AS (
  SELECT f.ws, coalesce(g.f, f.f) AS m, coalesce(best.jaccard, 1.0) AS jaccard
  FROM f LEFT JOIN best ON best.b = f.s LEFT JOIN f g ON g.s = best.a
)
SELECT DISTINCT w.doc_id, w.line_no, m.m[1] AS kept_doc_id, m.m[2] AS kept_line_no, round(m.jaccard, 6) AS jaccard
FROM w JOIN m ON w.ws = m.ws WHERE m.m < (w.doc_id, w.line_no)
"""

_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents
), g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS grams
  FROM w WHERE len(ws) > 0
), reps AS (SELECT grams, min(doc_id) AS rep, count(*) AS copies, len(grams) AS size FROM g GROUP BY grams),
t AS (SELECT rep, size, unnest(grams) AS gram FROM reps),
near AS (
  SELECT a.rep AS x, b.rep AS y FROM t a JOIN t b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.6 - 1e-9
), reach AS (
  SELECT rep AS x, rep AS root FROM reps UNION SELECT near.y, reach.root FROM reach JOIN near ON near.x = reach.x
), cl AS (SELECT x, min(root) AS root FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS links FROM near GROUP BY x)
SELECT d.doc_id, coalesce(cl.root, d.doc_id) AS class_id, coalesce(r.copies, 0) AS copies, coalesce(deg.links, 0) AS links
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN reps r ON r.grams = g.grams LEFT JOIN cl ON cl.x = r.rep LEFT JOIN deg ON deg.x = r.rep
"""

QUERIES = {
    "op1_url_trust": op1_url_trust,
    "op7_ann": op7_ann,
    "op9_chat_format": op9_chat_format,
    "op2_mixing": op2_mixing,
    "op4_language_id": op4_language_id,
    "op6_decontamination": op6_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op10_token_files": op10_token_files,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_url_trust": _op1(), "op3_ngram_jaccard_join": _OP3, "op7_ann": _OP7, "op8_line_dedup": _OP8}
