"""Driver queries over the library's operators, with their DuckDB oracles.

Every query reads whole tables; limits are those of top-k searches. Scores rank
unrounded and are rounded on output; ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..functions import vectors as V
from ..functions.embed import embed, hash_embedder
from ..operators import graph, ivf, log, lookup, metrics, search, walk
from ..operators.filters import field, on_struct, on_variant
from ..operators.store import Store
from ..session import new_path, spread, table
from ..sources.documents import accepted
from ..streaming.ingest import ingest, metric_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _zero(rows: DataFrame) -> list[float]:
    """Vector 0, the query of the single searches."""
    return lookup.get_embedding(rows.withColumnRenamed("vec_id", "key"), 0).first()[0]


def _score(name: str = "score", digits: int = 6) -> Column:
    return F.round("score", digits).alias(name)


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_ONE = f"SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0"
_ALL = f"SELECT q.vec_id AS query_id, e.vec_id AS key, {_COS} AS s FROM embeddings e, embeddings q"


# -- search


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE}) ORDER BY s DESC, vec_id LIMIT 10")
def exact_topk(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return search.exact_topk(rows, _zero(rows), key="vec_id", content=False).select("vec_id", _score())


@query(f"SELECT vec_id, label, round(s, 6) AS score FROM ({_ONE}) WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10")
def filtered_topk(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return search.exact_topk(rows, _zero(rows), where=on_struct(field("label") == 3, rows.schema), key="vec_id").select("vec_id", "label", _score())


@query(f"SELECT vec_id, label, round(s, 6) AS score FROM ({_ONE}) WHERE label = 3 OR label = 5 ORDER BY s DESC, vec_id LIMIT 10")
def filtered_topk_or(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    where = on_struct((field("label") == 3) | (field("label") == 5.0), rows.schema)
    return search.exact_topk(rows, _zero(rows), where=where, key="vec_id").select("vec_id", "label", _score())


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE}) JOIN documents d ON d.doc_id = vec_id WHERE label = 3 AND d.lang = 'en' ORDER BY s DESC, vec_id LIMIT 10")
def filtered_topk_and(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    q = _zero(rows)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.struct("lang", "source").alias("meta"))
    rows = rows.join(docs, "vec_id")
    where = on_struct((field("label") == 3) & (field("meta.lang") == "en"), rows.schema)
    return search.exact_topk(rows, q, where=where, key="vec_id").select("vec_id", _score())


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT * FROM ({_ONE}) ORDER BY s DESC, vec_id LIMIT 20) WHERE s >= 0.25")
def min_score_after_topk(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return search.exact_topk(rows, _zero(rows), 20, min_score=0.25, key="vec_id").select("vec_id", _score())


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE}) ORDER BY s DESC, vec_id LIMIT 15")
def no_content_hits(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return search.exact_topk(rows, _zero(rows), 15, key="vec_id", content=False).drop("embedding").withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, (row_number() OVER w)::INT AS rank, key, round(s, 6) AS score FROM ({_ALL}) WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, key) QUALIFY rank <= 10")
def batch_topk(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return search.batch_topk(rows, rows, key="vec_id", qid="vec_id").withColumn("score", F.round("score", 6))


@query(f"SELECT label::VARCHAR AS collection, vec_id, round(s, 6) AS score FROM (SELECT * FROM ({_ONE}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 5)")
def multi_collection_topk(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumn("collection", F.col("label").cast("string"))
    names = [r[0] for r in lookup.collections(rows).collect()]
    hits = search.multi_collection_topk(rows, [*names, " ", f" {names[0]} "], _zero(rows), 5, key="vec_id")
    return hits.select("collection", "vec_id", _score())


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE.replace('q.vec_id = 0', 'q.vec_id = 7')}) ORDER BY s DESC, vec_id LIMIT 10")
def more_like_this(spark, sf_dir):
    return search.more_like_this(_embeddings(spark, sf_dir), 7, key="vec_id").select("vec_id", _score())


_SQ8 = "list_transform(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))), lambda x: round_even(greatest(least(x, 1), -1) * 127, 0))"


@query(
    f"WITH q8 AS (SELECT vec_id, list_transform({_SQ8}, lambda x: x / 127) AS embedding FROM embeddings), "
    f"a AS ({_ALL} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) <= 10), "
    f"b AS ({_ALL.replace('embeddings e', 'q8 e')} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) <= 10) "
    "SELECT round(avg(n / 10), 6) AS recall FROM (SELECT a.query_id, count(b.key) AS n FROM a LEFT JOIN b USING (query_id, key) GROUP BY 1)"
)
def recall_at_k(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    rough = rows.select("vec_id", V.sq8_restore(V.sq8(V.l2_normalize(F.col("embedding")))).alias("embedding"))
    exact, found = (search.batch_topk(r, rows, key="vec_id", qid="vec_id") for r in (rows, rough))
    return search.recall_at_k(found, exact, 10).select(F.round("recall", 6).alias("recall"))


@query(f"SELECT vec_id, array_to_string(list_transform({_SQ8}, lambda x: x::INT), ',') AS codes FROM embeddings")
def sq8_quantize(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.array_join(V.sq8(V.l2_normalize(F.col("embedding"))).cast("array<string>"), ",").alias("codes"))


@query(
    f"WITH q8 AS (SELECT vec_id, embedding, {_SQ8} AS code FROM embeddings), "
    "c AS (SELECT e.* FROM q8 e, embeddings q WHERE q.vec_id = 0 ORDER BY list_dot_product(e.code, q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 64) "
    f"SELECT e.vec_id, round({_COS}, 6) AS score FROM c e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10"
)
def sq8_rerank(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return search.sq8_rerank(rows, _zero(rows), key="vec_id").select("vec_id", _score())


@query("SELECT vec_id, unnest(range(1, len(embedding) + 1))::INT AS i, round(unnest(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))), 6) AS v FROM embeddings")
def l2_normalize(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("i", "v"))
    return rows.select("vec_id", (F.col("i") + 1).alias("i"), F.round("v", 6).alias("v"))


@query(f"SELECT vec_id, round(1 - s, 6) AS distance FROM ({_ONE})")
def cosine_distance(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    q = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return rows.crossJoin(q).select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.col("q"), strict=True), 6).alias("distance"))


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE}) ORDER BY s DESC, vec_id LIMIT 10")
def ann_ivf_full_probe(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    index = ivf.build(rows, 16)
    return ivf.probe(index, _zero(rows), n_probe=len(index.centers), key="vec_id").select("vec_id", _score())


@query(f"SELECT vec_id, label, round(s, 6) AS score FROM ({_ONE}) WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10")
def ann_ivf_filtered(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    index = ivf.build(rows, 32)
    return ivf.nearest(index, _zero(rows), where=F.col("label") == 3, key="vec_id").select("vec_id", "label", _score())


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE}) ORDER BY s DESC, vec_id LIMIT 10")
def ann_ivf_nearest(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return ivf.nearest(ivf.build(rows, 32), _zero(rows), key="vec_id").select("vec_id", _score())


@query("SELECT true AS recall_is_090")
def ann_ivf_recall(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    found = ivf.probe_batch(ivf.build(rows, 16), rows, n_probe=12, key="vec_id", qid="vec_id")
    exact = search.batch_topk(rows, rows, key="vec_id", qid="vec_id")
    return search.recall_at_k(found, exact, 10).select((F.col("recall") >= 0.9).alias("recall_is_090"))


@query("SELECT count(*) AS live, sum(len(embedding) * 4)::BIGINT AS bytes, count(*) / 16 AS mean_size FROM embeddings")
def ann_index_info(spark, sf_dir):
    return ivf.index_info(ivf.build(_embeddings(spark, sf_dir), 16)).select("live", "bytes", "mean_size")


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE}) ORDER BY s DESC, vec_id LIMIT 10")
def lazy_search(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return ivf.LazySearch(rows, threshold=100, key="vec_id").search(_zero(rows)).select("vec_id", _score())


# -- graph


@query(f"SELECT query_id AS src, key AS dst, round(s, 6) AS score FROM ({_ALL}) WHERE query_id <> key QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) <= 8")
def knn_graph(spark, sf_dir):
    return graph.knn_edges(_embeddings(spark, sf_dir), 8, key="vec_id").select("src", "dst", _score())


@query(
    f"WITH k AS (SELECT query_id AS src, key AS dst FROM ({_ALL}) WHERE query_id <> key QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) <= 8), "
    "u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k) "
    "SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM (SELECT src FROM u UNION ALL SELECT dst FROM u) GROUP BY 1) GROUP BY 1"
)
def graph_degrees(spark, sf_dir):
    return graph.degree_histogram(graph.undirected(graph.knn_edges(_embeddings(spark, sf_dir), 8, key="vec_id")))


@query(
    f"WITH k AS (SELECT query_id AS src, key AS dst FROM ({_ALL}) WHERE query_id <> key QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) <= 8), "
    "u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k) "
    "SELECT vec_id AS key, to_base64(encode(vec_id::VARCHAR)) AS key_base64, count(n) AS degree FROM embeddings LEFT JOIN (SELECT src AS n FROM u UNION ALL SELECT dst FROM u) ON n = vec_id GROUP BY 1"
)
def graph_snapshot(spark, sf_dir):
    """Of all nodes of a small collection."""
    return graph.snapshot(_embeddings(spark, sf_dir), graph.NODES, key="vec_id")[0].drop("coords")


@query("SELECT count(*) AS n, 1.0::DOUBLE AS most_1, 1.0::DOUBLE AS most_2, 1.0::DOUBLE AS most_3, 0.0::DOUBLE AS corr_12, 0.0::DOUBLE AS corr_13, 0.0::DOUBLE AS corr_23 FROM embeddings")
def pca_projection(spark, sf_dir):
    """Axes are scaled to 1 and uncorrelated."""
    c = [F.col("coords")[i] for i in range(3)]
    most = [F.round(F.max(F.abs(c[i])), 6).alias(f"most_{i + 1}") for i in range(3)]
    corr = [F.abs(F.round(F.corr(c[i], c[j]), 6)).alias(f"corr_{i + 1}{j + 1}") for i, j in ((0, 1), (0, 2), (1, 2))]
    return graph.pca(_embeddings(spark, sf_dir), 3, key="vec_id").agg(F.count("*").alias("n"), *most, *corr)


# -- filters


@query("SELECT doc_id, lang, source, 0.0::DOUBLE AS score FROM documents WHERE lang = 'fr' AND (source = 'src1' OR source = 'src2')")
def filter_only_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    where = on_struct((field("lang") == "fr") & ((field("source") == "src1") | (field("source") == "src2")), docs.schema)
    return search.filter_only(docs, where).select("doc_id", "lang", "source", "score")


@query("SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND (props->>'$.k')::BIGINT = 5")
def json_path_equals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("content", F.parse_json("props"))
    return search.scan(rows, on_variant(field("k") == 5)).select("event_id")


@query("SELECT event_id FROM events WHERE (props->>'$.k')::BIGINT % 10 = 0")
def custom_filter(spark, sf_dir):
    from ..operators.filters import Custom

    rows = table(spark, sf_dir, "events").withColumn("content", F.parse_json("props"))
    return search.scan(rows, on_variant(Custom(lambda d: d["k"] % 10 == 0))).select("event_id")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING list_contains(list(role), 'system')")
def collection_any(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return convs.where(on_struct(field("roles").any("system"), convs.schema)).select("conv_id")


# -- lookups and statistics


@query("SELECT text AS content FROM documents WHERE doc_id = 7")
def get_by_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lookup.get_content(docs.withColumnsRenamed({"doc_id": "key", "text": "content"}), 7)


@query("SELECT array_to_string(list_transform(embedding::DOUBLE[], lambda x: round(x, 5)::DECIMAL(9, 5)), ',') AS embedding FROM embeddings WHERE vec_id = 7")
def get_embedding(spark, sf_dir):
    row = lookup.get_embedding(_embeddings(spark, sf_dir).withColumnRenamed("vec_id", "key"), 7)
    return row.select(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 5).cast("decimal(9,5)").cast("string")), ",").alias("embedding"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def contains_keys(spark, sf_dir):
    return lookup.contains_keys(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT (rn // 100)::BIGINT AS chunk, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS keys FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) GROUP BY 1")
def keys_chunked(spark, sf_dir):
    return lookup.keys_chunked(table(spark, sf_dir, "documents"), 100, "doc_id").select("chunk", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query("SELECT doc_id AS key, text AS content FROM documents")
def values(spark, sf_dir):
    return lookup.values(table(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "key", "text": "content"}))


@query("SELECT doc_id AS key FROM documents")
def keys(spark, sf_dir):
    return lookup.keys(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key"))


@query("SELECT DISTINCT source AS collection FROM documents")
def list_collections(spark, sf_dir):
    return lookup.collections(table(spark, sf_dir, "documents").withColumnRenamed("source", "collection"))


@query("SELECT source AS collection, count(*) AS n FROM documents GROUP BY 1")
def count_per_collection(spark, sf_dir):
    return lookup.count(table(spark, sf_dir, "documents").withColumnRenamed("source", "collection"))


def _entries(spark, sf_dir) -> DataFrame:
    """Documents by source and language, and vectors by label."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("database"), F.concat_ws("_", "source", "lang").alias("collection"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    vecs = _embeddings(spark, sf_dir).select(F.lit("vectors").alias("database"), F.concat(F.lit("label"), F.col("label")).alias("collection"), F.lit(None).cast("string").alias("content"), "embedding")
    return docs.unionByName(vecs)


_INFOS = (
    "SELECT lang AS database, source || '_' || lang AS collection, count(*) AS vectors, 0 AS dimensions, sum(strlen(text))::BIGINT AS content_size, 0::BIGINT AS vector_size FROM documents GROUP BY 1, 2 "
    "UNION ALL SELECT 'vectors', 'label' || label, count(*), max(len(embedding))::INT, 0, sum(len(embedding) * 4)::BIGINT FROM embeddings GROUP BY 1, 2"
)


@query(f"SELECT collection, vectors, dimensions, content_size, vector_size FROM ({_INFOS})")
def collection_info(spark, sf_dir):
    return lookup.collection_info(_entries(spark, sf_dir))


def _infos(spark, sf_dir) -> DataFrame:
    entries = _entries(spark, sf_dir)
    databases = entries.select("collection", "database").distinct()
    return lookup.collection_info(entries).join(databases, "collection")


@query(f"SELECT database, sum(vectors)::BIGINT AS vectors, sum(content_size + vector_size)::BIGINT AS size, count(*) AS n_collections, string_agg(collection, ',' ORDER BY collection) AS collections FROM ({_INFOS}) GROUP BY 1")
def database_info(spark, sf_dir):
    return lookup.database_info(_infos(spark, sf_dir), ["database"]).withColumn("collections", F.array_join("collections", ","))


@query(f"SELECT database, sum(vectors)::BIGINT AS vectors, sum(content_size + vector_size)::BIGINT AS size, string_agg(collection || ':' || vectors, ',' ORDER BY collection) AS collections FROM ({_INFOS}) GROUP BY 1")
def status_sample(spark, sf_dir):
    each = F.transform("collections", lambda c: F.concat(c["collection"], F.lit(":"), c["vectors"]))
    return metrics.status_sample(_infos(spark, sf_dir)).withColumn("collections", F.array_join(each, ","))


# -- mutation log


def _log(spark, sf_dir, tx: bool = False) -> DataFrame:
    """Events as a log: errors delete, the rest set; with ``tx``, purchases commit ten-minute transactions that all but clicks belong to."""
    e = table(spark, sf_dir, "events")
    minutes = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600).cast("string")
    kind = F.when(F.col("event_type") == "error", "delete")
    return e.select(
        F.when(F.col("value") >= 20, "large").otherwise("small").alias("collection"), F.col("user_id").cast("string").cast("binary").alias("key"),
        F.lit(0).cast("long").alias("batch"), F.col("event_id").alias("ord"),
        (F.when(F.col("event_type") != "click", minutes) if tx else F.lit(None)).cast("string").alias("tx"),
        (kind.when(F.col("event_type") == "purchase", "commit") if tx else kind).otherwise("set").alias("op"),
        F.col("props").alias("content"), F.lit(None).cast("array<float>").alias("embedding"),
    )


_LOG = "l AS (SELECT CASE WHEN value >= 20 THEN 'large' ELSE 'small' END AS collection, user_id::VARCHAR AS key, event_id AS ord, floor(epoch(ts) / 600) AS slot, event_type, props AS content, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op FROM events)"
_LAST = "QUALIFY row_number() OVER (PARTITION BY collection, key ORDER BY ord DESC) = 1"


def _shown(live: DataFrame) -> DataFrame:
    return live.select("collection", F.decode("key", "UTF-8").alias("key"), "ord", "content")


@query(f"WITH {_LOG} SELECT collection, key, ord, content FROM (SELECT * FROM l {_LAST}) WHERE op = 'set'")
def latest_live(spark, sf_dir):
    return _shown(log.latest_live(_log(spark, sf_dir)))


@query(
    f"WITH {_LOG}, done AS (SELECT DISTINCT slot FROM l WHERE event_type = 'purchase'), "
    "c AS (SELECT * FROM l WHERE event_type <> 'purchase' AND (event_type = 'click' OR slot IN (SELECT slot FROM done))) "
    f"SELECT collection, key, ord, content FROM (SELECT * FROM c {_LAST}) WHERE op = 'set'"
)
def tx_replay(spark, sf_dir):
    return _shown(log.latest_live(_log(spark, sf_dir, tx=True)))


@query(
    f"WITH {_LOG}, live AS (SELECT ord FROM (SELECT * FROM l {_LAST}) WHERE op = 'set'), "
    "s AS (SELECT collection, sum(strlen(content))::BIGINT AS total_bytes, coalesce(sum(strlen(content)) FILTER (ord NOT IN (SELECT ord FROM live)), 0)::BIGINT AS dead_bytes FROM l WHERE op = 'set' GROUP BY 1) "
    "SELECT collection, total_bytes, dead_bytes, round(dead_bytes / total_bytes, 6) AS fragmentation, dead_bytes >= 67108864 AND dead_bytes / total_bytes >= 0.4 AS needs_shrink FROM s"
)
def dead_space(spark, sf_dir):
    return log.dead_space(_log(spark, sf_dir)).withColumn("fragmentation", F.round("fragmentation", 6))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append_only_insert(spark, sf_dir):
    return log.only_new(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def append_conflicts(spark, sf_dir):
    return log.conflicts(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def reconcile_missing(spark, sf_dir):
    return log.missing_from_index(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id)")
def reconcile_ghosts(spark, sf_dir):
    return log.ghosts_of_index(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), _embeddings(spark, sf_dir).select("vec_id"), ["vec_id"])


@query(f"WITH {_LOG} SELECT collection, key, ord, content FROM (SELECT * FROM l {_LAST}) WHERE op = 'set'")
def store_round_trip(spark, sf_dir):
    """The log written to a store, compacted, and read."""
    store = Store(spark, new_path(spark, "store"))
    store._append(_log(spark, sf_dir))
    store.compact()
    return _shown(store.entries())


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE}) WHERE vec_id NOT BETWEEN 1 AND 3 ORDER BY s DESC, vec_id LIMIT 10")
def store_ingest_delete(spark, sf_dir):
    """A store filled, indexed, changed, reopened and searched."""
    store = Store(spark, new_path(spark, "store"))
    rows = _embeddings(spark, sf_dir)
    key = F.format_string("%012d", "vec_id")
    store.append(rows.select(F.lit("v").alias("collection"), F.encode(key, "UTF-8").alias("key"), F.lit(None).cast("string").alias("content"), "embedding"))
    first = store.vectors("v", threshold=100)
    query = _zero(rows)
    first.nearest(query).count()  # builds the index
    for i in (1, 2, 3):
        store.delete("v", f"{i:012d}")
    again = Store(spark, store.path).vectors("v")
    assert [r["key"] for r in again.nearest(query).collect()] == [r["key"] for r in first.nearest(query).collect()]
    return first.nearest(query).select(F.decode("key", "UTF-8").cast("long").alias("vec_id"), _score())


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE vec_id % 2 = 0) AS rejected FROM embeddings")
def store_insert_new(spark, sf_dir):
    """Even vectors are there; all are inserted if new."""
    store = Store(spark, new_path(spark, "store"))
    rows = _embeddings(spark, sf_dir).select(F.lit("v").alias("collection"), F.encode(F.format_string("%012d", "vec_id"), "UTF-8").alias("key"), F.lit(None).cast("string").alias("content"), "embedding", "vec_id")
    store.append(rows.where("vec_id % 2 = 0").drop("vec_id"))
    rejected = store.insert_new(rows.drop("vec_id"))
    return store.entries().agg(F.count("*").alias("entries")).crossJoin(rejected.agg(F.count("*").alias("rejected")))  # one row each


# -- streams and metrics


def _stream(spark, sf_dir, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("SELECT user_id::VARCHAR AS key, event_id AS ord, props AS content FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_ingest(spark, sf_dir):
    """Events ingested into a store by Structured Streaming, newest per user."""
    path = new_path(spark, "ingest")
    store = Store(spark, f"{path}/store")
    rows = _stream(spark, sf_dir, "events").select(F.lit("users").alias("collection"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_id").alias("ord"), F.col("props").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    ingest(rows, store, f"{path}/checkpoint").awaitTermination()
    return _shown(store.entries()).drop("collection")


_WINDOWS = "SELECT strftime(time_bucket(INTERVAL '{0}', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS name, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2"


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).withColumn("total", F.round("total", 6))


@query(_WINDOWS.format("10 seconds"))
def metric_window(spark, sf_dir):
    return _timed(metrics.metric_windows(table(spark, sf_dir, "events"), name="event_type", order="event_id"))


@query(_WINDOWS.format("1 hour").replace(", arg_max(value, (ts, event_id)) AS last", ""))
def metric_window_stream(spark, sf_dir):
    """The streaming plan run to the end of its input."""
    path = new_path(spark, "metrics")
    out = metric_stream(_stream(spark, sf_dir, "events"), every="1 hour", name="event_type").drop("last")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
    out.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return _timed(spark.read.parquet(f"{path}/out"))


@query("SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def history_window(spark, sf_dir):
    return metrics.history(table(spark, sf_dir, "events").select("event_id", "value", "ts"), "1h").drop("ts")


@query("SELECT event_id, user_id, round(greatest(0, least(100, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))), 6) AS delta FROM events")
def cpu_delta_lag(spark, sf_dir):
    return log.previous(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", F.round("delta", 6).alias("delta"))


# -- text and keys

_TOKENS = r"t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ts FROM documents)"


@query(
    f"WITH {_TOKENS}, c AS (SELECT doc_id, ts, unnest(range(0, greatest(0, ceil((len(ts) - 320) / 256))::BIGINT + 1)) AS c FROM t WHERE len(ts) > 0) "
    "SELECT doc_id, c::INT AS chunk_no, len(ts[c * 256 + 1 : c * 256 + 320])::INT AS n_tokens, array_to_string(ts[c * 256 + 1 : c * 256 + 320], ' ') AS text FROM c"
)
def chunk_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.chunks(T.split_tokens(F.col("text")))).alias("chunk_no", "ts"))
    return docs.select("doc_id", "chunk_no", F.size("ts").alias("n_tokens"), F.array_join("ts", " ").alias("text"))


@query(f"WITH {_TOKENS} SELECT doc_id, array_to_string(CASE WHEN len(ts) > 384 THEN ts[1:256] || ts[len(ts) - 127 : len(ts)] ELSE ts END, ' ') AS text FROM t")
def head_tail(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join(T.head_tail(T.split_tokens(F.col("text"))), " ").alias("text"))


@query("SELECT label, i::INT AS i, round(sum(v * vec_id) / sum(vec_id), 6) AS v FROM (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY 1, 2")
def weighted_mean(spark, sf_dir):
    mean = T.weighted_mean(_embeddings(spark, sf_dir), ["label"], weight="vec_id")
    return mean.select("label", F.posexplode("embedding").alias("i", "v")).select("label", (F.col("i") + 1).alias("i"), F.round("v", 6).alias("v"))


@query("SELECT doc_id, CASE WHEN trim(source) = '' THEN text ELSE source || ': ' || text END AS text FROM documents")
def task_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.task_prefixed(F.col("source"), F.col("text")).alias("text"))


@query()
def embed_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", embed(F.col("text"), hash_embedder(64)).alias("embedding"))


_REVERSED = " || ".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8))


@query(f"SELECT doc_id, {_REVERSED} AS key_hex, base64(encode(source)) AS key_base64, sha256(source) AS digest FROM (SELECT doc_id, source, lpad(hex(doc_id), 16, '0') AS h FROM documents)")
def key_codecs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(K.key_bytes(F.col("doc_id"), "long")).alias("key_hex"), K.key_base64(F.col("source").cast("binary")).alias("key_base64"), K.collection_digest(F.col("source")).alias("digest"))


@query("SELECT source AS collection, count(*) AS accepted FROM documents WHERE trim(source) <> '' GROUP BY 1")
def bulk_accepted(spark, sf_dir):
    rows = accepted(table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("source").alias("key")))
    return rows.groupBy("collection").agg(F.count("*").alias("accepted"))


# -- graph walks


@query(f"SELECT query_id AS src, key AS dst, round(s, 6) AS score FROM ({_ALL}) WHERE query_id <> key QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) <= 8")
def graph_nearest_neighbours(spark, sf_dir):
    return walk.nearest_neighbours(graph.knn_edges(_embeddings(spark, sf_dir), 16, key="vec_id"), 8).select("src", "dst", _score())


@query("SELECT true AS within_m, true AS nearest_kept")
def graph_spread_neighbours(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    near = search.stored(graph.knn_edges(rows, 16, key="vec_id"), "near")  # read twice
    kept = walk.spread_neighbours(near, rows, 8, key="vec_id").groupBy("src").agg(F.count("*").alias("n"), F.max("score").alias("s"))
    best = near.groupBy("src").agg(F.max("score").alias("best"))
    return kept.join(best, "src", "right").agg(F.bool_and(F.col("n") == 8).alias("within_m"), F.bool_and(F.col("s") == F.col("best")).alias("nearest_kept"))


@query("SELECT true AS recall_is_090")
def graph_beam_search(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    edges = graph.knn_edges(rows, 16, key="vec_id")
    found = walk.beam_search(edges, rows, rows, beam=128, key="vec_id", qid="vec_id")
    exact = search.batch_topk(rows, rows, key="vec_id", qid="vec_id")
    return search.recall_at_k(found, exact, 10).select((F.col("recall") >= 0.9).alias("recall_is_090"))


@query("SELECT count(*) AS n FROM embeddings")
def graph_level_histogram(spark, sf_dir):
    return walk.level_histogram(_embeddings(spark, sf_dir), key="vec_id").agg(F.sum("n").alias("n"))
