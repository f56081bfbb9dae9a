"""Approximate search by inverted lists, and the choice between it and exact search.

Unit vectors are assigned to the nearest of ``n_lists`` centroids (spherical
k-means whose steps are sums over all vectors) once, at the build, and written to
a table that has a folder per list. A search reads the folders of the ``n_probe``
lists nearest to the query, and nothing else, and ranks their entries by exact cosine, so probing
all lists is exact search. A filter applies before probing: lists are added in
order of distance until they hold ``top`` matches, so a selective filter still
fills the result. ``nearest`` needs no ``n_probe``: it leaves out only lists whose
radius shows that they hold no hit, so it is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_to, matrix, unit
from ..session import new_path
from .search import DEFAULT_TOP, exact_topk, meet, ranked

THRESHOLD = 100_001
N_PROBE = 8
STEPS = 6
MOST_LISTS = 1 << 14


class IvfIndex:
    """``table`` is the entries with a column ``list``, by which its files lie below ``path``; ``centers`` is lists x dims."""

    def __init__(self, table: DataFrame, centers: np.ndarray, vec: str, path: str | None = None) -> None:
        self.table, self.centers, self.vec, self.path = table, centers, vec, path
        self._radii: np.ndarray | None = None

    def insert(self, entries: DataFrame) -> None:
        """Adds entries to their lists; the centers stay. A key that is there already is there twice."""
        spark = self.table.sparkSession
        _write(entries.select(*[c for c in self.table.columns if c != "list"]), self.centers, self.vec, self.path)
        self.table, self._radii = spark.read.schema(self.table.schema).parquet(f"{self.path}/entries"), None

    @staticmethod
    def open(spark: SparkSession, path: str, vec: str = "embedding") -> IvfIndex:
        """The index that ``build`` wrote to ``path``."""
        rows = spark.read.parquet(f"{path}/centers").orderBy("list").collect()
        return IvfIndex(spark.read.parquet(f"{path}/entries"), np.array([r["center"] for r in rows], np.float64), vec, path)

    def radii(self) -> np.ndarray:
        """Angle from each center to the farthest entry of its list, found once; pi where the center has no direction."""
        if self._radii is None:
            centers = self.centers

            def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.full(len(centers), np.inf)
                for b in batches:
                    x, rows = matrix(b.column(1), centers.shape[1])
                    at = np.asarray(b.column(0))[rows]
                    np.minimum.at(out, at, (unit(x) * centers[at]).sum(1))
                own = np.flatnonzero(np.isfinite(out))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(out[own])], names=["list", "c"])

            got = np.ones(len(centers))  # one row per list
            for i, c in self.table.select("list", self.vec).mapInArrow(least, "list long, c double").groupBy("list").agg(F.min("c")).collect():
                got[i] = c
            self._radii = np.where(np.linalg.norm(centers, axis=1) > 0.5, np.arccos(np.clip(got, -1, 1)), np.pi)
        return self._radii

    def ranked(self, query: Sequence[float]) -> list[int]:
        """Lists from the nearest to the farthest."""
        q = unit(np.asarray(query, np.float64)[None])[0]
        return [int(i) for i in np.argsort(-(self.centers @ q), kind="stable")]


def _nearest(spark: SparkSession, centers: np.ndarray):
    shared = spark.sparkContext.broadcast(centers)  # MOST_LISTS rows at most

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        x, rows = matrix(v, shared.value.shape[1])
        x = unit(x)
        fine = ~np.isnan(x).any(1)
        out, mask = np.zeros(len(v), np.int32), np.ones(len(v), bool)
        out[rows[fine]] = (x[fine] @ shared.value.T).argmax(1)
        mask[rows[fine]] = False
        return pa.array(out, mask=mask)

    return nearest


def _write(rows: DataFrame, centers: np.ndarray, vec: str, path: str) -> None:
    """Appends ``rows`` to the folders of their lists; a list goes to as many tasks as its size asks for."""
    placed = rows.withColumn("list", _nearest(rows.sparkSession, centers)(F.col(vec))).where("list IS NOT NULL")
    placed.hint("rebalance", "list").write.partitionBy("list").mode("append").parquet(f"{path}/entries")


def build(entries: DataFrame, n_lists: int | None = None, *, vec: str = "embedding", seed: int = 42, path: str | None = None) -> IvfIndex:
    """An index of the entries that have a vector of the collection's length and of norm > 0.

    It is written to ``path``, or to a new folder of the shared one, and can be
    opened from there again.
    ``n_lists`` is the square root of the rows by default, at most MOST_LISTS: the
    centroids are the only thing sent to the tasks. Starting centroids are the
    vectors of least hash, so a build is repeatable.
    """
    rows, spark = entries.where(F.size(vec) > 0), entries.sparkSession
    n, dims = rows.agg(F.count("*"), F.max(F.size(vec))).first()
    if not n:
        return IvfIndex(entries.limit(0).withColumn("list", F.lit(None).cast("int")), np.zeros((0, 0)), vec)
    n_lists = max(1, min(n, MOST_LISTS, n_lists or round(math.sqrt(n))))
    first = rows.where(F.size(vec) == dims).select(F.col(vec).alias("v")).orderBy(F.xxhash64("v", F.lit(seed))).limit(n_lists).collect()
    centers = unit(np.array([r[0] for r in first], np.float64))
    centers = centers[~np.isnan(centers).any(1)]
    if not len(centers):
        return IvfIndex(entries.limit(0).withColumn("list", F.lit(None).cast("int")), centers, vec)
    for _ in range(STEPS):

        def sums(batches: Iterator[pa.RecordBatch], shared=spark.sparkContext.broadcast(centers)) -> Iterator[pa.RecordBatch]:
            held = shared.value
            total, count = np.zeros_like(held), np.zeros(len(held))
            for b in batches:
                x = unit(matrix(b.column(0), held.shape[1])[0])
                x = x[~np.isnan(x).any(1)]
                at = (x @ held.T).argmax(1)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(held))
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(total[own]), pa.list_(pa.float64()))], names=["list", "s"])

        # one row of sums per task and list, combined per list and dimension
        parts = rows.select(vec).mapInArrow(sums, "list long, s array<double>").select("list", F.posexplode("s").alias("i", "v"))
        got = parts.groupBy("list", "i").agg(F.sum("v").alias("v")).groupBy("list").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).collect()
        new = centers.copy()
        for r in got:
            new[r["list"]] = [x["v"] for x in r["s"]]
        centers = np.nan_to_num(unit(new))
    path = (path or new_path(spark, "ivf")).rstrip("/")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    _write(rows, centers, vec, path)
    schema = rows.withColumn("list", F.lit(None).cast("int")).schema
    return IvfIndex(spark.read.schema(schema).parquet(f"{path}/entries"), centers, vec, path)


def probe(index: IvfIndex, query: Sequence[float], top: int = DEFAULT_TOP, n_probe: int = N_PROBE, *, where: Column | None = None, min_score: float | None = None, key: str = "key") -> DataFrame:
    """Hits of one query among its nearest lists, as ``search.exact_topk`` returns them."""
    rows = index.table if where is None else index.table.where(where)
    if top <= 0 or not len(query) or not len(index.centers):
        return exact_topk(rows, [], 0, key=key, vec=index.vec).drop("list")
    order = index.ranked(query)
    if where is not None and n_probe < len(order):
        held = {r[0]: r[1] for r in rows.groupBy("list").count().collect()}  # one row per list
        have = np.cumsum([held.get(i, 0) for i in order])
        n_probe = max(n_probe, int(np.searchsorted(have, top)) + 1)
    if n_probe < len(order):
        rows = rows.where(F.col("list").isin(order[:n_probe]))
    hits = rows.drop("list").withColumn("score", cosine_to(list(query))(F.col(index.vec))).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(top)
    return hits if min_score is None else hits.where(F.col("score") >= min_score)


def nearest(index: IvfIndex, query: Sequence[float], top: int = DEFAULT_TOP, *, where: Column | None = None, min_score: float | None = None, key: str = "key") -> DataFrame:
    """As ``probe``, with as many lists as hold any of the ``top`` hits: equal to ``search.exact_topk``.

    A first probe gives a floor for the last hit's score. An entry of a list is no
    nearer to the query than the list's center less the list's radius, so lists
    out of reach of the floor are left out. Without structure in the vectors that
    may be none.
    """
    order = index.ranked(query) if len(query) == index.centers.shape[1] else []
    n_probe = len(order)
    if top > 0 and n_probe > N_PROBE:
        first = [r[0] for r in probe(index, query, top, where=where, key=key).select("score").collect()]
        if len(first) == top:
            q = unit(np.asarray(query, np.float64)[None])[0]
            away = np.arccos(np.clip(index.centers @ q, -1, 1)) - index.radii()
            fine = away <= np.arccos(np.clip(first[-1], -1, 1)) + 1e-6
            n_probe = max(k + 1 for k, i in enumerate(order) if fine[i] or k < N_PROBE)
    return probe(index, query, top, n_probe, where=where, min_score=min_score, key=key)


def probe_batch(index: IvfIndex, queries: DataFrame, top: int = DEFAULT_TOP, n_probe: int = 8, *, key: str = "key", qid: str = "query_id", qvec: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) of every query, which meets the entries of its lists, block by block."""
    centers, n_probe = index.centers, max(1, n_probe)
    kind, qkind = index.table.schema[key].dataType.simpleString(), queries.schema[qid].dataType.simpleString()

    @F.arrow_udf("array<int>")
    def lists(v: pa.Array) -> pa.Array:
        x, rows = matrix(v, centers.shape[1])
        x = unit(x)
        fine = ~np.isnan(x).any(1)
        near = np.argsort(-(x[fine] @ centers.T), axis=1, kind="stable")[:, :n_probe].astype(np.int32)
        count = np.zeros(len(v), np.int64)
        count[rows[fine]] = near.shape[1]
        mask = np.append(count == 0, False)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32), mask=mask), pa.array(near.ravel()))

    spark = index.table.sparkSession
    if top <= 0 or not len(centers):
        return spark.createDataFrame([], f"query_id {qkind}, rank int, key {kind}, score double")
    asked = queries.select(F.col(qid).alias("key"), F.col(qvec).alias("vec")).where("vec IS NOT NULL").withColumn("lists", lists("vec")).where("lists IS NOT NULL")
    own = index.table.select(F.col(key).alias("key"), F.col(index.vec).alias("vec"), F.col("list").alias("lists")).where(F.size("vec") == centers.shape[1])
    return ranked(meet(own, asked, queries.count(), top, f"query_id {qkind}, key {kind}, score double", kind, qkind, listed=True), top)


class LazySearch:
    """Exact search until ``threshold`` entries are held, then an index, built once; it does not go back.

    All entries count, those without a vector too. The count is taken at a search.
    Hits are the exact ones on both sides of the threshold, unless a search names
    the ``n_probe`` lists to read.
    """

    def __init__(self, entries: DataFrame, threshold: int = THRESHOLD, *, key: str = "key", vec: str = "embedding", n_lists: int | None = None) -> None:
        self.entries, self.threshold, self.key, self.vec, self.n_lists = entries, threshold, key, vec, n_lists
        self.index: IvfIndex | None = None

    def search(self, query: Sequence[float], top: int = DEFAULT_TOP, n_probe: int | None = None, *, where: Column | None = None, min_score: float | None = None) -> DataFrame:
        if self.index is None and self.entries.count() >= self.threshold:
            self.index = build(self.entries, self.n_lists, vec=self.vec)
        if self.index is None:
            return exact_topk(self.entries, query, top, where=where, min_score=min_score, key=self.key, vec=self.vec)
        if n_probe is None:
            return nearest(self.index, query, top, where=where, min_score=min_score, key=self.key)
        return probe(self.index, query, top, n_probe, where=where, min_score=min_score, key=self.key)


def list_histogram(index: IvfIndex) -> DataFrame:
    """(list, n) of the lists that hold entries."""
    return index.table.groupBy("list").agg(F.count("*").alias("n"))


def index_info(index: IvfIndex) -> DataFrame:
    """One row: lists, live entries, the size of the smallest and largest list, mean size, bytes of vectors."""
    per = index.table.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size(index.vec) * 4).alias("b"))
    return per.agg(F.count("*").alias("n_lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("live"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 2).alias("mean_size"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
