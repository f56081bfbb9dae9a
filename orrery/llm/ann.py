"""Operator 7: maximum inner product search with score-aware quantisation.

Vectors are cut into two-dimensional subspaces of 16 codewords each (4 bits).
Codes and codewords minimise the anisotropic loss
``|r|^2 + (eta - 1) * (r . x / |x|)^2`` of the residual r: its part parallel to
the vector, which is what shifts large inner products, costs ``eta`` times the
orthogonal part. Codes are chosen by coordinate descent over the subspaces and
codewords by the weighted least squares of each, from sums over *all* vectors.

A block of queries and a block of vectors are a task's unit: the queries'
tables of 16 products per subspace are scanned over the other block's codes (two
codes a byte, so a scan adds one table row per byte for a slab of queries). The
best ``rerank`` of the block by these sums give a floor for the k-th best exact
product; then every row that its sum and the Cauchy-Schwarz bound of its
residual, ``|q| |r|``, let reach the floor is reranked, however many they are,
so near copies that the codes cannot tell apart are all seen. The blocks' bests
are merged, so the result is that of brute force however rows lie in blocks. Data
have no structure that all of them must have, so no list is skipped: every query
scans every vector, at half a byte per two dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from ._store import dropped, staged

BLOCK = 4096
SLAB = 256
CODES = 16


def _blocks(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vecs: list[np.ndarray] = []

        def row() -> pd.DataFrame:
            x = np.stack(vecs).astype(np.float32)
            return pd.DataFrame([(len(ids), np.array(ids, np.int64).tobytes(), x.tobytes())], columns=["n", "ids", "vecs"])

        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["vec"]):
                v = np.asarray(v, np.float32)
                if len(v) == dims and np.isfinite(v).all():
                    ids.append(i)
                    vecs.append(v)
                if len(ids) == BLOCK:
                    yield row()
                    ids, vecs = [], []
        if ids:
            yield row()

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) of least anisotropic loss; ``books`` is subspaces x 16 x 2."""
    m = len(books)
    p = np.pad(x, ((0, 0), (0, 2 * m - x.shape[1]))).reshape(len(x), m, 2)
    u = np.pad(_unit(x), ((0, 0), (0, 2 * m - x.shape[1]))).reshape(len(x), m, 2)
    r = p[:, :, None] - books[None]  # rows x subspaces x 16 x 2
    plain = (r * r).sum(-1)
    along = np.einsum("nmkd,nmd->nmk", r, u)
    codes = plain.argmin(2)
    at = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[at, j, codes[:, j]]
            codes[:, j] = (plain[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[at, j, codes[:, j]]
    return codes


def _sums(books: np.ndarray, eta: float):
    """Per subspace and codeword the normal equations of a block: count, 2x2 and 2-vector sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = len(books)
        out = np.zeros((m, CODES, 6))
        for pdf in batches:
            for n, blob in zip(pdf["n"], pdf["vecs"]):
                x = np.frombuffer(blob, np.float32).reshape(n, -1)
                codes = encode(x, books, eta)
                p = np.pad(x, ((0, 0), (0, 2 * m - x.shape[1]))).reshape(n, m, 2)
                u = np.pad(_unit(x), ((0, 0), (0, 2 * m - x.shape[1]))).reshape(n, m, 2)
                own = np.stack([books[j][codes[:, j]] for j in range(m)], 1)
                along = ((p - own) * u).sum(2)
                rest = along.sum(1, keepdims=True) - along
                for j in range(m):
                    a, b = u[:, j, 0], u[:, j, 1]
                    s = rest[:, j] + p[:, j, 0] * a + p[:, j, 1] * b
                    cols = (1 + (eta - 1) * a * a, (eta - 1) * a * b, 1 + (eta - 1) * b * b, p[:, j, 0] + (eta - 1) * s * a, p[:, j, 1] + (eta - 1) * s * b, np.ones(n))
                    for c, v in enumerate(cols):
                        out[j, :, c] += np.bincount(codes[:, j], v, CODES)
        yield pd.DataFrame({"at": np.arange(out.size), "v": out.ravel()})

    return run


def train(blocks: DataFrame, dims: int, eta: float, steps: int = 4) -> np.ndarray:
    """Codebooks from all vectors, from a grid at the mean and spread of each dimension."""
    m = -(-dims // 2)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((3, dims))
        for pdf in batches:
            for n, blob in zip(pdf["n"], pdf["vecs"]):
                x = np.frombuffer(blob, np.float32).reshape(n, dims).astype(np.float64)
                s += np.stack([np.full(dims, n), x.sum(0), (x * x).sum(0)])
        yield pd.DataFrame({"at": np.arange(s.size), "v": s.ravel()})

    def summed(f, size: int) -> np.ndarray:
        out = np.zeros(size)
        for r in blocks.select("n", "vecs").mapInPandas(f, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r[0]] = r[1]
        return out

    n, s1, s2 = summed(moments, 3 * dims).reshape(3, dims)
    mean = s1 / n
    spread = np.sqrt(np.maximum(s2 / n - mean * mean, 1e-12))
    mean, spread = (np.pad(v, (0, 2 * m - dims)).reshape(m, 2) for v in (mean, spread))
    grid = np.array([-1.51, -0.453, 0.453, 1.51])  # 4-level quantiser of a normal variable
    cells = np.stack(np.meshgrid(grid, grid, indexing="ij"), -1).reshape(CODES, 2)
    books = (mean[:, None] + spread[:, None] * cells[None]).astype(np.float32)
    for _ in range(steps):
        s = summed(_sums(books, eta), m * CODES * 6).reshape(m, CODES, 6)
        det = s[..., 0] * s[..., 2] - s[..., 1] ** 2
        ok = (s[..., 5] > 0) & (det > 1e-9)
        det = np.where(ok, det, 1)
        new = np.stack([(s[..., 2] * s[..., 3] - s[..., 1] * s[..., 4]) / det, (s[..., 0] * s[..., 4] - s[..., 1] * s[..., 3]) / det], -1)
        # all subspaces move at once, so each goes half its way
        books = np.where(ok[..., None], 0.5 * books + 0.5 * new, books).astype(np.float32)
    return books


def _leading(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that have more than ``k`` equal vectors of smaller ids: no query can have them among its ``k``."""
    same = np.unique((x + np.float32(0)).view(f"V{x.shape[1] * 4}")[:, 0], return_inverse=True)[1]
    order = np.lexsort((ids, same))
    own = same[order]
    return np.sort(order[np.arange(len(own)) - np.searchsorted(own, own) <= k])


def _scan(books: np.ndarray, k: int, rerank: int, dims: int):
    m = len(books)
    pairs = -(-m // 2)

    def tables(q: np.ndarray) -> np.ndarray:
        """bytes x 256 x queries: the products of both codes of a byte."""
        lut = np.einsum("qmd,mkd->mkq", np.pad(q, ((0, 0), (0, 2 * m - dims))).reshape(len(q), m, 2), books)
        if m % 2:
            lut = np.concatenate([lut, np.zeros((1, CODES, len(q)), np.float32)])
        return (lut[0::2][:, :, None] + lut[1::2][:, None, :]).reshape(pairs, 256, len(q)).astype(np.float32)

    def errors(x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, per unit of a query's norm: the most its scanned product and its product in floats are off."""
        both = np.stack([code // CODES, code % CODES], 1).reshape(2 * pairs, -1)[:m]
        own = np.stack([books[j][both[j]] for j in range(m)], 1).reshape(len(x), 2 * m)[:, :dims].astype(np.float64)
        far, size = np.linalg.norm(x - own, axis=1), np.linalg.norm(x.astype(np.float64), axis=1)
        tiny = (dims + 16) * 2.0**-23
        return far * (1 + tiny) + tiny * (size + far), tiny * size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                qi, qx = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_vecs, np.float32).reshape(-1, dims)
                di, dx = np.frombuffer(row.ids, np.int64), np.frombuffer(row.vecs, np.float32).reshape(-1, dims)
                code = np.frombuffer(row.codes, np.uint8).reshape(pairs, len(di))
                some = _leading(di, dx, k)
                di, dx, code = di[some], dx[some], np.ascontiguousarray(code[:, some])
                off, eps = errors(dx, code)
                keep = min(max(rerank, k + 1), len(di))
                for a in range(0, len(qi), SLAB):
                    q, own = qx[a : a + SLAB], qi[a : a + SLAB, None]
                    norm = np.linalg.norm(q.astype(np.float64), axis=1)[:, None]
                    lut = tables(q)
                    acc = lut[0].take(code[0], axis=0)
                    buf = np.empty_like(acc)
                    for b in range(1, pairs):
                        np.take(lut[b], code[b], axis=0, out=buf)
                        acc += buf
                    acc = np.ascontiguousarray(acc.T)
                    best = np.argpartition(-acc, keep - 1, axis=1)[:, :keep] if keep < len(di) else np.tile(np.arange(len(di)), (len(q), 1))
                    least = np.einsum("qrd,qd->qr", dx[best], q) - norm * eps[best]
                    least[di[best] == own] = -np.inf  # a row is not its own neighbour
                    floor = -np.partition(-least, k - 1, axis=1)[:, k - 1 : k] if keep >= k else np.full((len(q), 1), -np.inf)
                    # "not below" keeps what overflowed
                    able = ~(acc + norm * off < floor)
                    if able.sum() > able.size // 32:
                        able &= ~(q @ dx.T + norm * eps < floor)
                    able &= di != own
                    at, r = np.nonzero(able)
                    score = np.empty(len(at))
                    for b in range(0, len(at), step := max(1, (1 << 22) // dims)):
                        score[b : b + step] = np.einsum("rd,rd->r", dx[r[b : b + step]].astype(np.float64), q[at[b : b + step]].astype(np.float64))
                    # by score, ties by id
                    order = np.lexsort((di[r], -score, at))
                    at, r, score = at[order], r[order], score[order]
                    first = np.arange(len(at)) - np.searchsorted(at, at) < k
                    yield pd.DataFrame({"query_id": own[at[first], 0], "vec_id": di[r[first]], "score": score[first]})

    return run


_FOUND = "query_id long, rank int, vec_id long, score double"


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec), one row per id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, v -> v IS NULL)")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    return rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, eta: float = 4.0, rerank: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` of greatest inner product with each row of ``queries``.

    A row is not its own neighbour: one of the query's id is left out. Equal to
    brute force in double precision, whatever the codes miss: ``rerank``
    (rows of a query in each block of at most 4096 that set its floor) only
    decides how many rows need an exact product. Rows with a NULL id, a NULL vector, a value that
    is NULL or not finite, or a length other than the most frequent of ``vectors`` (the greater
    one of a tie) take no part. Rows repeating an id are one, that of the vector
    that sorts first. Ties of score go to the smaller id. Empty tables, or no other
    row than the query's own, give no result; other columns are ignored.
    """
    rows, asked, spark = _vectors(vectors, id_col, vec_col), _vectors(queries, id_col, vec_col), vectors.sparkSession
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if top is None:
        return spark.createDataFrame([], _FOUND)
    dims = top["d"]
    raw = staged(spread(rows).mapInPandas(_blocks(dims), "n int, ids binary, vecs binary"), "ann-raw")
    wanted = asked.repartition(max(1, asked.count() // BLOCK))  # full blocks of queries
    wanted = staged(wanted.mapInPandas(_blocks(dims), "n int, ids binary, vecs binary"), "ann-queries")
    if not raw.limit(1).count() or not wanted.limit(1).count():
        dropped(raw, wanted)
        return spark.createDataFrame([], _FOUND)
    books = train(raw, dims, eta)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, blob in zip(pdf["n"], pdf["vecs"]):
                c = encode(np.frombuffer(blob, np.float32).reshape(n, dims), books, eta).astype(np.uint8)
                if c.shape[1] % 2:
                    c = np.concatenate([c, np.zeros((n, 1), np.uint8)], 1)
                out.append(np.ascontiguousarray((c[:, 0::2] * CODES + c[:, 1::2]).T).tobytes())
            yield pdf.assign(codes=out)

    blocks = staged(raw.mapInPandas(coded, "n int, ids binary, vecs binary, codes binary"), "ann-blocks")
    pairs = blocks.select("ids", "vecs", "codes").hint("shuffle_replicate_nl").crossJoin(wanted.select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")))
    found = pairs.mapInPandas(_scan(books, k, rerank, dims), "query_id long, vec_id long, score double")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # a task sends on its best k of a query
    out = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    out = staged(out.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score")), "ann")
    dropped(raw, wanted, blocks)
    return out
