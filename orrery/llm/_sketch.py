"""Token frequencies of a whole corpus in an array of fixed size.

Every token of every row is counted, in one of ``WIDTH`` hashed buckets. The
counts order tokens by rarity for prefix filters, which are exact under any
total order: a shared bucket costs speed, never a result. The table that is
broadcast has ``WIDTH`` bytes whatever the corpus holds; a task sends only the
buckets it met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._codec import framed, planes, unframed, unplaned
from ._store import released

BITS = 25
WIDTH = 1 << BITS
SLICES = 64
_PER = WIDTH // SLICES
HELD = 1_000_000


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


class Counter:
    """Counts in one task; ``rows`` gives them as (slice, blob)."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n = 0
        self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.held.append(bucket(h).astype(np.int32))
        self.n += len(h)
        if self.n >= max(HELD, len(self.at)):
            self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        at = np.sort(np.concatenate(self.held))
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        at, count = at[first], np.diff(np.append(first, len(at)))
        if len(self.at):
            at, count = np.concatenate([self.at, at]), np.concatenate([self.count, count])
            order = np.argsort(at, kind="stable")
            at, count = at[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            at, count = at[first], np.add.reduceat(count, first)
        self.at, self.count, self.held, self.n = at, count, [], 0

    def rows(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        ends = np.searchsorted(self.at, np.arange(1, SLICES + 1) * _PER)
        for s, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if b > a:
                own = self.at[a:b]
                yield s, framed([planes(np.diff(own, prepend=s * _PER)), planes(self.count[a:b])])


def classes(parts: DataFrame) -> np.ndarray:
    """(slice, blob) of all tasks -> uint8 per bucket, 2 * log2(count + 1) rounded.

    Each reducer streams its slices, so memory doesn't grow with the tasks.
    """

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for s, blob in zip(pdf["slice"], pdf["blob"]):
                gaps, counts = map(unplaned, unframed(blob))
                sums.setdefault(s, np.zeros(_PER, np.int64))[np.cumsum(gaps)] += counts
        if sums:
            levels = [framed([np.round(2 * np.log2(v + 1)).astype(np.uint8).tobytes()]) for v in sums.values()]
            yield pd.DataFrame({"slice": list(sums), "blob": levels})
        sums.clear()
        released()

    out = np.zeros(WIDTH, np.uint8)
    summed = parts.select("slice", "blob").repartition(min(SLICES, 16), F.col("slice"))
    for s, blob in summed.mapInPandas(total, "slice int, blob binary").collect():
        out[s * _PER : (s + 1) * _PER] = np.frombuffer(unframed(blob)[0], np.uint8)
    return out
