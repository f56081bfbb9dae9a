"""Operator 8: line deduplication by an exact set-similarity join.

A line is the set of its words. All lines of the corpus are counted into word
frequencies (``_sketch``), words are ordered rare before frequent, and each
distinct set indexes its prefix under that order, long enough for similar sets
to share a word of it (``ngram_join``). Pairs that pass the prefix, length
and positional filters, and whose parities of words in hashed cells don't show
that they differ in too many, are verified on whole lines. Equal sets are one entry of
the index however many lines they have. A line goes where an earlier line, by
(doc_id, line number), has Jaccard >= threshold with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import _sketch
from ._store import dropped, staged
from ._text import gram_blocks, set_ids
from .ngram_join import candidate_pairs, placed_pairs, sized, verify


PER_BUCKET = 1_000_000


def line_sets(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the word sets of the lines that have words."""
    for _, _, grams, sizes in gram_blocks([line for text in texts for line in text.split("\n")], 1):
        yield grams, sizes[sizes > 0]


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = _sketch.Counter()
    for pdf in batches:
        lines = [text.split("\n") for text in pdf["text"]]
        n = np.array([len(x) for x in lines], np.int64)
        ids = np.repeat(pdf["id"].to_numpy(), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for first, last, grams, sizes in gram_blocks([line for x in lines for line in x], 1):
            counts.add(grams)
            own = np.flatnonzero(sizes)
            yield pd.DataFrame({"id": ids[first:last][own], "line": at[first:last][own].astype(np.int32), "size": sizes[own].astype(np.int32), "sid": set_ids(grams, sizes[own]), "slice": -1, "blob": None})
    rows = list(counts.rows())
    yield pd.DataFrame({"id": 0, "line": 0, "size": 0, "sid": 0, "slice": [r[0] for r in rows], "blob": [r[1] for r in rows]})


def _pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, wanted lines) -> one row per wanted line."""
    for pdf in batches:
        out = []
        for text, wanted in zip(pdf["text"], pdf["wanted"]):
            lines = text.split("\n")
            out += [(w["slot"], w["sid"], lines[w["line"]]) for w in wanted if w["line"] < len(lines)]
        yield pd.DataFrame(out, columns=["slot", "sid", "text"])


def _verify(t: float):
    return lambda pairs, lines: verify(pairs, lines, lambda texts: gram_blocks(texts, 1), t)


def repeated_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to remove: (doc_id, line_no, kept_doc_id, kept_line_no, jaccard).

    Lines are split at line feeds and numbered from 0; a line without words is
    neither removed nor matched. A line is removed if any earlier line, itself
    removed or not, is at least ``threshold`` similar; the earliest such line is
    named. NULL ids and texts take no part; lines of rows that repeat a doc_id
    share positions, and lines at one position do not remove each other. An
    empty table gives no rows; other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    t = float(threshold)
    docs = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).where("id IS NOT NULL AND text IS NOT NULL")
    profile = staged(docs.mapInPandas(_profile, "id long, line int, size int, sid long, slice int, blob binary"), "line-profile")
    lines = profile.where("slice < 0").select("id", "line", "size", "sid")
    levels = _sketch.classes(profile.where("slice >= 0"))
    firsts = staged(lines.groupBy("sid").agg(F.min(F.struct("id", "line")).alias("f"), F.max("size").alias("size"), F.count("*").alias("n")), "line-firsts")
    prefixes = int(firsts.agg(F.sum(F.ceil(F.col("size") * (1 - t)) + 1)).first()[0] or 0)
    pairs = candidate_pairs(docs, line_sets, t, levels, 256, prefixes, 1, bits=True, per_bucket=PER_BUCKET)
    placed = placed_pairs(pairs)
    members = placed.select("slot", F.col("a").alias("sid")).union(placed.select("slot", "b")).distinct()
    wanted = members.join(firsts, "sid").groupBy(F.col("f.id").alias("id")).agg(F.collect_list(F.struct("slot", "sid", F.col("f.line").alias("line"))).alias("wanted"))
    wanted = staged(wanted, "line-wanted")
    texts = docs.join(sized(wanted), "id").select("text", "wanted").mapInPandas(_pick, "slot int, sid long, text string")
    checked = staged(placed.groupBy("slot").cogroup(texts.groupBy("slot")).applyInPandas(_verify(t), "a long, b long, jaccard double"), "line-pairs")
    both = checked.select(F.col("a").alias("sid"), F.col("b").alias("other"), "jaccard").union(checked.select("b", "a", "jaccard"))
    near = both.join(firsts.select(F.col("sid").alias("other"), F.col("f").alias("of")), "other").groupBy("sid").agg(F.min(F.struct("of", "jaccard")).alias("near"))
    best = firsts.join(near, "sid", "left").where("n > 1 OR near IS NOT NULL")
    closer = F.col("near").isNotNull() & (F.col("near.of") < F.col("f"))
    best = best.select("sid", F.when(closer, F.col("near.of")).otherwise(F.col("f")).alias("m"), F.when(closer, F.col("near.jaccard")).otherwise(1.0).alias("jaccard"))
    gone = lines.join(best, "sid").where(F.col("m") < F.struct("id", "line"))
    out = gone.select(F.col("id").alias("doc_id"), F.col("line").alias("line_no"), F.col("m.id").alias("kept_doc_id"), F.col("m.line").alias("kept_line_no"), F.round("jaccard", 6).alias("jaccard")).distinct()
    out = staged(out, "lines-gone")
    dropped(profile, firsts, pairs, placed, wanted, checked)
    return out


def remove_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of ``repeated_lines`` taken out of ``text_col``; columns unchanged.

    A document that loses all its lines keeps an empty text. Rows without
    removals, NULL ids and NULL texts pass as they are.
    """
    own = gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("line_no").alias("lines"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([x if g is None or x is None else "\n".join(y for k, y in enumerate(x.split("\n")) if k not in set(g)) for x, g in zip(texts, lines)], dtype=object)

    joined = docs.alias("l").join(own.alias("r"), F.expr(f"l.`{id_col}` = r.id"), "left")
    return joined.select(*[(cut(F.col(f"l.`{c}`"), F.col("r.lines")).alias(c) if c == text_col else F.col(f"l.`{c}`")) for c in docs.columns])
