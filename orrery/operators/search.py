"""Vector search: exact, filtered, batched, over several collections.

Hits are ordered by score, ties by key. Entries without a vector, of another
length or of norm 0 have no score and are never hits. A filter applies before
the ranking, ``min_score`` after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine_to, matrix, unit
from ..session import new_path, spread

DEFAULT_TOP = 10
QUERY_BLOCK = 4096
BLOCK_BYTES = 8 << 20
QUERY_TILE, ENTRY_TILE, RESCORED = 256, 1024, 1 << 18


def scan(entries: DataFrame, where: Column | None = None) -> DataFrame:
    """The entries of a filter-only search, unordered."""
    return entries if where is None else entries.where(where)


def exact_topk(entries: DataFrame, query: Sequence[float], top: int = DEFAULT_TOP, *, where: Column | None = None, min_score: float | None = None, key: str = "key", vec: str = "embedding", content: bool = True) -> DataFrame:
    """The ``top`` entries nearest to ``query`` by cosine, with ``score``.

    ``top`` <= 0 or an empty query give no hits. One scan that keeps ``top`` rows
    per task (TakeOrderedAndProject); wide content is only carried by the winners.
    """
    hits = scan(entries, where)
    if not content:
        hits = hits.select(key, vec)
    if top <= 0 or not len(query):
        return hits.withColumn("score", F.lit(None).cast("double")).where(F.lit(False))
    hits = hits.withColumn("score", cosine_to(list(query))(F.col(vec))).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(top)
    return hits if min_score is None else hits.where(F.col("score") >= min_score)


def filter_only(entries: DataFrame, where: Column | None) -> DataFrame:
    """All matches at score 0."""
    return scan(entries, where).withColumn("score", F.lit(0.0))


class Best:
    """The best ``top`` entries of each query of a block, held while entries go by.

    A tile of queries and entries is multiplied in single precision. What that product
    cannot tell from the last hit so far, by the bound of its error, is scored again in
    double precision, one dimension after another: a score depends on its two vectors
    only, so equal vectors tie. Ties go to the smaller key. ``top`` entries a query are held.
    """

    def __init__(self, q: np.ndarray, top: int) -> None:
        self.top, self.flat, self.near = top, np.ascontiguousarray(q.T), unit(q).astype(np.float32)
        self.squares = _squares(self.flat)
        self.near[np.isnan(self.near).any(1)] = 0
        self.slack = 2.0**-22 * (q.shape[1] + 8)  # twice the error of a product of unit vectors
        self.score, self.slot = np.full((len(q), top), -np.inf), np.zeros((len(q), top), np.int64)
        self.floor = np.where(self.squares > 0, -np.inf, np.inf).astype(np.float32)
        self.keys: pa.Array | None = None

    def add(self, x: np.ndarray, keys: pa.Array, own: np.ndarray | None = None) -> None:
        """Meets the vectors ``x`` of ``keys`` with all queries, or those of the numbers ``own``."""
        flat = np.ascontiguousarray(x.T)
        squares = _squares(flat)
        near = unit(x).astype(np.float32)
        if not (fine := squares > 0).all():
            flat, squares, near, keys = np.ascontiguousarray(flat[:, fine]), squares[fine], near[fine], keys.filter(pa.array(fine))
        own = np.arange(len(self.near)) if own is None else own
        for e in range(0, len(near), ENTRY_TILE):
            part = near[e : e + ENTRY_TILE].T
            ats, hits = [], []
            for a in range(0, len(own), QUERY_TILE):
                at = own[a : a + QUERY_TILE]
                rough, floor = self.near[at] @ part, self.floor[at]
                if (new := np.isneginf(floor)).any() and part.shape[1] > self.top:
                    floor[new] = np.partition(rough[new], part.shape[1] - self.top, axis=1)[:, part.shape[1] - self.top] - self.slack
                hit = np.flatnonzero(rough >= floor[:, None])
                ats.append(at[hit // part.shape[1]])
                hits.append(e + hit % part.shape[1])
            at, hit = np.concatenate(ats or [own]), np.concatenate(hits or [own])
            for a in range(0, len(at), RESCORED):
                self._merge(at[a : a + RESCORED], hit[a : a + RESCORED], flat, squares, keys)

    def _merge(self, at: np.ndarray, hit: np.ndarray, flat: np.ndarray, squares: np.ndarray, keys: pa.Array) -> None:
        score = _cosines(self.flat, self.squares, at, flat, squares, hit)
        good = score >= self.score[at, -1]
        at, hit, score = at[good], hit[good], score[good]
        if not len(at):
            return
        rows, of = np.unique(at, return_inverse=True)
        held = keys.take(pa.array(hit))
        before = 0 if self.keys is None else len(self.keys)
        self.keys = held if self.keys is None else pa.concat_arrays([self.keys, held])
        of = np.concatenate([np.repeat(np.arange(len(rows)), self.top), of])
        score = np.concatenate([self.score[rows].ravel(), score])
        slot = np.concatenate([self.slot[rows].ravel(), before + np.arange(len(held))])
        order = np.lexsort((-score, of))
        s, o = score[order], of[order]
        if ((s[1:] == s[:-1]) & (o[1:] == o[:-1]) & np.isfinite(s[1:])).any():
            by_key = pc.rank(self.keys.take(pa.array(slot)), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            order = np.lexsort((by_key, -score, of))
        count = np.bincount(of, minlength=len(rows))
        best = order[(np.cumsum(count) - count)[:, None] + np.arange(self.top)]
        self.score[rows], self.slot[rows] = score[best], slot[best]
        self.floor[rows] = self.score[rows, -1] - self.slack
        if len(self.keys) > 2 * self.slot.size + RESCORED:
            used, self.slot[:] = np.unique(self.slot, return_inverse=True)
            self.keys = self.keys.take(pa.array(used))

    def found(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(number of the query, key, score) of the hits, some at a time."""
        step = max(1, RESCORED // self.top)
        for a in range(0, len(self.score) if self.keys is not None else 0, step):
            i, j = np.nonzero(np.isfinite(self.score[a : a + step]))
            yield a + i, self.keys.take(pa.array(self.slot[a + i, j])), self.score[a + i, j]


def _squares(flat: np.ndarray) -> np.ndarray:
    """Squared norm of each column, summed from the first dimension to the last."""
    s = np.zeros(flat.shape[1])
    with np.errstate(over="ignore", under="ignore"):
        for v in flat:
            s += v * v
    return s


def _cosines(a: np.ndarray, a2: np.ndarray, i: np.ndarray, b: np.ndarray, b2: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the columns a[:, i] and b[:, j] with squared norms a2 and b2."""
    s = np.zeros(len(i))
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        for u, v in zip(a, b):
            s += u[i] * v[j]
        n = a2[i] * b2[j]
        n = np.where((n > 1e-280) & (n < np.inf), np.sqrt(n), np.sqrt(a2[i]) * np.sqrt(b2[j]))
        return np.clip(s / n, -1, 1)


def _rows_a_block(dims: int) -> int:
    return max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * dims)))


def _few(rows: DataFrame, queries: list, top: int, schema: str, id_type: pa.DataType) -> DataFrame:
    """At most QUERY_BLOCK queries: sent to the tasks, one scan per vector length."""
    by_size: dict[int, list] = {}
    for r in queries:
        by_size.setdefault(len(r[1]), []).append((r[0], r[1]))
    found: DataFrame | None = None
    for dims, asked in sorted(by_size.items()):
        q = np.array([[np.nan if v is None else v for v in r[1]] for r in asked], np.float64).reshape(len(asked), dims)
        fine = np.isfinite(q).all(1)
        shared = rows.sparkSession.sparkContext.broadcast(([r[0] for r, f in zip(asked, fine) if f], q[fine]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(q, top)
            for b in batches:
                x, at = matrix(b.column(1), q.shape[1])
                best.add(x, b.column(0).take(pa.array(at)))
            for i, keys, score in best.found():
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(i)), keys, pa.array(score)], names=["query_id", "key", "score"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if found is None else found


def _packed(rows: DataFrame, kind: str, group: str | None = None) -> DataFrame:
    """(ids, dims, vecs, lists) blocks of vectors of one length, QUERY_BLOCK or BLOCK_BYTES at most, of ``rows`` (key, vec, and lists if any).

    NULL values make no vector. ``group`` is the type of the column ``lists``: a block has the
    vectors of one ``int``, or the lists of all its vectors, of one number each, as ``binary``.
    """

    def block(dims: int, of: int | None, held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([k for k, _, _ in held])
        lists = np.concatenate([n for _, _, n in held]).astype(np.int32).tobytes() if group == "binary" else of
        cols = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([dims], pa.int32()), pa.array([np.concatenate([x for _, x, _ in held]).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, pa.array([lists], pa.binary() if group == "binary" else pa.int32())], names=["ids", "dims", "vecs", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for b in batches:
            sizes = np.unique(np.asarray(b.column(1).value_lengths().fill_null(0)))
            for dims in sizes[sizes > 0].tolist():
                x, at = matrix(b.column(1), dims)
                keys = b.column(0).take(pa.array(at))
                if group == "binary":
                    lists = np.asarray(b.column(2).take(pa.array(at)).flatten()).reshape(len(at), -1)
                else:
                    lists = np.zeros(len(at), np.int32) if group is None else np.asarray(b.column(2))[at]
                for of in np.unique(lists).tolist() if group == "int" else [0]:
                    own = np.flatnonzero(lists == of) if group == "int" else np.arange(len(at))
                    while len(own):
                        had = held.setdefault((dims, of), [])
                        n = _rows_a_block(dims) - sum(len(k) for k, _, _ in had)
                        had.append((keys.take(pa.array(own[:n])), x[own[:n]], lists[own[:n]]))
                        size += 8 * dims * len(own[:n])
                        if len(own) >= n:
                            size -= 8 * dims * _rows_a_block(dims)
                            yield block(dims, of, held.pop((dims, of)))
                        own = own[n:]
            if size > 8 * BLOCK_BYTES:
                yield from (block(*k, had) for k, had in held.items())
                held, size = {}, 0
        yield from (block(*k, had) for k, had in held.items())

    return rows.mapInArrow(run, f"ids array<{kind}>, dims int, vecs binary, lists {'binary' if group == 'binary' else 'int'}")


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df``, written below the shared folder in small row groups, of which a reader holds one; read by ``parts`` tasks at most."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "none").option("parquet.block.size", 4 * BLOCK_BYTES).parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    return df if parts is None else df.coalesce(parts)


def meet(rows: DataFrame, asked: DataFrame, n: int, top: int, schema: str, key_kind: str, id_kind: str, *, listed: bool = False) -> DataFrame:
    """(query_id, key, score): the best ``top`` of ``rows`` (key, vec) for each of the ``n`` rows of ``asked``, or some more.

    A task holds a block of queries and lets the blocks of entries go by, so what is
    shuffled are the queries and ``top`` hits of each; entries are read once a block of queries,
    in parts if there are too few blocks for all cores. Nothing is collected or broadcast.
    ``listed``: both have ``lists``, an entry an int and a query an array of one length, and
    a query meets the entries of its lists.
    """
    spark = rows.sparkSession
    dims = asked.agg(F.max(F.size("vec"))).first()[0] or 1
    blocks = max(1, math.ceil(n / _rows_a_block(max(1, dims))))
    parts = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / blocks))
    entries = stored(_packed(rows, key_kind, "int" if listed else None), "blocks", parts)
    packed = _packed(asked.repartition(blocks), id_kind, "binary" if listed else None).withColumn("q_at", F.monotonically_increasing_id())
    packed = packed.withColumnsRenamed({"ids": "q_ids", "dims": "q_dims", "vecs": "q_vecs", "lists": "q_lists"})
    # Entries are the streamed side of the product; the buffered one is a block of queries.
    pairs = entries.hint("shuffle_replicate_nl").join(packed, F.expr("q_dims - dims = 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for k in range(b.num_rows):
                r = {n: b.column(i)[k] for i, n in enumerate(b.schema.names)}
                at, dims = r["q_at"].as_py(), r["dims"].as_py()
                if at not in held:
                    q = np.frombuffer(r["q_vecs"].as_buffer(), np.float64).reshape(-1, dims)
                    lists = np.frombuffer(r["q_lists"].as_buffer(), np.int32).reshape(len(q), -1).copy() if listed else None
                    held[at] = Best(q, top), pa.concat_arrays([r["q_ids"].values]), lists
                best, _, lists = held[at]
                own = None if lists is None else np.flatnonzero((lists == r["lists"].as_py()).any(1))
                if own is None or len(own):
                    best.add(np.frombuffer(r["vecs"].as_buffer(), np.float64).reshape(-1, dims), r["ids"].values, own)
        for best, ids, _ in held.values():
            for i, keys, score in best.found():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), keys, pa.array(score)], names=["query_id", "key", "score"])

    return pairs.mapInArrow(run, schema)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """(query_id, rank, key, score) of the best ``top`` of each query."""
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("query_id", "rank", "key", "score")


def batch_topk(entries: DataFrame, queries: DataFrame, top: int = DEFAULT_TOP, *, key: str = "key", vec: str = "embedding", qid: str = "query_id", qvec: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) of every query.

    A task holds ``top`` hits per query while entries go by, so only those rows are
    shuffled to the final ranking. Up to QUERY_BLOCK queries are sent to the tasks;
    more of them stay distributed and meet the entries block by block.
    """
    kind, id_kind = entries.schema[key].dataType.simpleString(), queries.schema[qid].dataType.simpleString()
    schema = f"query_id {id_kind}, key {kind}, score double"
    rows = spread(entries.select(F.col(key).alias("key"), F.col(vec).alias("vec"))).where(F.col("vec").isNotNull())
    asked = queries.select(F.col(qid).alias("key"), F.col(qvec).alias("vec")).where(F.col(qvec).isNotNull())
    if top <= 0:
        found = entries.sparkSession.createDataFrame([], schema)
    elif len(few := asked.limit(QUERY_BLOCK + 1).collect()) <= QUERY_BLOCK:
        found = _few(rows, few, top, schema, to_arrow_type(queries.schema[qid].dataType))
    else:
        found = meet(rows, asked, asked.count(), top, schema, kind, id_kind)
    return ranked(found, top)


def distinct_names(names: Sequence[str]) -> list[str]:
    """Collection names without blanks, distinct regardless of case, the first spelling kept."""
    out: dict[str, str] = {}
    for n in names:
        if n and n.strip():
            out.setdefault(n.strip().lower(), n.strip())
    return list(out.values())


def multi_collection_topk(entries: DataFrame, names: Sequence[str], query: Sequence[float], top: int = DEFAULT_TOP, *, collection: str = "collection", key: str = "key", vec: str = "embedding") -> DataFrame:
    """Top hits of each named collection, merged by score; at most ``top`` x collections rows."""
    top = DEFAULT_TOP if top <= 0 else top
    names = distinct_names(names)
    hits = entries.where(F.col(collection).isin(names)).withColumn("score", cosine_to(list(query))(F.col(vec))).where("score IS NOT NULL")
    by = W.partitionBy(collection).orderBy(F.desc("score"), key)
    best = hits.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= top).drop("__rank")
    return best.orderBy(F.desc("score"), collection, key).limit(top * max(1, len(names)))


def more_like_this(entries: DataFrame, of, top: int = DEFAULT_TOP, *, key: str = "key", vec: str = "embedding") -> DataFrame:
    """Search by the vector of the entry ``of`` (which is found too); no hits if it has none."""
    row = entries.where(F.col(key) == F.lit(of)).select(vec).first()
    return exact_topk(entries, row[0] if row and row[0] else [], top, key=key, vec=vec)


def best_per_key(hits: DataFrame, key: str = "key") -> DataFrame:
    """Hits with one row per key, of the greatest score."""
    cols = [c for c in hits.columns if c not in (key, "score")]
    agg = hits.groupBy(key).agg(F.max("score").alias("score"), *[F.max_by(c, "score").alias(c) for c in cols])
    return agg.select(*hits.columns)


def recall_at_k(found: DataFrame, exact: DataFrame, k: int, *, qid: str = "query_id", key: str = "key") -> DataFrame:
    """One row ``recall``: mean share of the exact keys of a query that were found."""
    a = exact.select(qid, key).distinct()
    b = found.select(qid, key).distinct().withColumn("hit", F.lit(1))
    per = a.join(b, [qid, key], "left").groupBy(qid).agg((F.count("hit") / F.lit(k)).alias("r"))
    return per.agg(F.avg("r").alias("recall"))


def sq8_rerank(entries: DataFrame, query: Sequence[float], top: int = DEFAULT_TOP, candidates: int = 64, *, key: str = "key", vec: str = "embedding") -> DataFrame:
    """Candidates by quantised product, ranked by full-precision cosine: (key, score)."""
    from ..functions.vectors import l2_normalize, mixed_dot, sq8

    q = unit(np.asarray(query, np.float64)[None])[0]
    ql = F.array(*[F.lit(float(x)) for x in q])
    rough = entries.where(F.col(vec).isNotNull()).select(key, mixed_dot(ql, sq8(l2_normalize(F.col(vec)))).alias("rough"))
    best = rough.where("rough IS NOT NULL").orderBy(F.desc("rough"), key).limit(candidates).select(key)
    return exact_topk(entries.join(F.broadcast(best), key, "left_semi"), query, top, key=key, vec=vec).select(key, "score")
