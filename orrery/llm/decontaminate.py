"""Operator 6: benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased words joined by single spaces, with a space at
either end: an item is looked for as whole words. One of m characters has an error
budget of k = floor(``rate`` * m) edits, those of its bounds included, and is cut into
k + 1 pieces: an occurrence with at most k edits holds one of them unchanged.
One Aho-Corasick pass over the whole of every text finds all piece hits; each
hit fixes a window, and Myers' bit-parallel algorithm decides whether the item
occurs there within its budget.

Documents are read once per chunk of items and never shuffled; a chunk is what
one automaton may hold (``CHUNK_CHARS``), so the broadcast has a fixed limit and
a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._store import released
from ._text import words

CHUNK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Words between single spaces, a space at either end; empty without words."""
    ws = words(text)
    return f" {' '.join(ws)} " if ws else ""


def budget(item: str, rate: float) -> int:
    """Edits allowed to a normalised item; its outer spaces are not characters of it."""
    return int(rate * (len(item) - 2) + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` cut into k + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = np.linspace(0, len(item), k + 2).astype(int)
    return [(int(a), item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def best_distance(eq: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between the pattern and any substring of ``text`` (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    """All occurrences of ``items`` (id, normalised text) within their budgets."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, budget(t, rate), masks(t)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first: bool = False) -> dict[int, int]:
        """item id -> least distance; with ``first``, one item is enough."""
        out: dict[int, int] = {}
        text = normal(text)
        if not self.items or not text:
            return out
        tried: dict[int, int] = {}
        for end, (length, at) in self.automaton.iter(text):
            for n, offset in at:
                i, item, k, eq = self.items[n]
                if out.get(i) == 0:
                    continue
                start = end - length + 1 - offset
                if start >= 0 and text.startswith(item, start):
                    out[i] = 0
                elif k:
                    # a window that was tried covers starts within k of its own
                    if tried.get(n) == start:
                        continue
                    tried[n] = start
                    d = best_distance(eq, len(item), text[max(0, start - k) : start + len(item) + k])
                    if d <= k and d < out.get(i, k + 1):
                        out[i] = d
                if first and out:
                    return out
        return out


def _chunks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if size <= CHUNK_CHARS else -(-2 * size // CHUNK_CHARS)  # hashed, so half full on the whole
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    held = ((rows if n == 1 else rows.where(part == p)).collect() for p in range(n))
    return [[(r[0], normal(r[1])) for r in sorted(own)] for own in held if own or n == 1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance) of every item found in every document.

    ``distance`` is the least number of character edits between the item and a
    passage of the document, both normalised and between spaces; it is at most
    ``floor(rate * length)``. A word that goes on beyond the item, as "cathedral" does
    beyond "the cat", costs an edit. NULL ids and NULL or wordless texts and items match
    nothing; rows that repeat a doc_id or an item_id count as one, with the least
    distance; other columns are ignored. An item of few characters has a budget
    of 0 and is found as it is.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).where("doc_id IS NOT NULL AND text IS NOT NULL")
    sc, found = docs.sparkSession.sparkContext, None
    for chunk in _chunks(benchmark, item_col, item_text_col):
        shared = sc.broadcast(chunk)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, rate)
            for pdf in batches:
                out = [(d, i, k) for d, text in zip(pdf["doc_id"], pdf["text"]) for i, k in matcher.matches(text).items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance"])
            released()

        part = rows.mapInPandas(run, "doc_id long, item_id long, distance int")
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which ``find_leaks`` would find an item; columns unchanged.

    NULL and wordless texts stay.
    """
    sc, out = docs.sparkSession.sparkContext, spread(docs)
    for chunk in _chunks(benchmark, "item_id", "text"):
        out = out.where(~_holds_item(sc.broadcast(chunk), rate)(F.col(text_col)))
    return out


def _holds_item(shared, rate: float):
    """Function of a text column: whether a text holds an item of the chunk."""
    held: list[Matcher] = []

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Matcher(shared.value, rate))
        return pd.Series([bool(held[0].matches(t, first=True)) for t in texts], dtype=bool)

    return holds
