"""Vector kernels.

Two forms: ``Column`` expressions for composition in plans, and Arrow kernels
(numpy over whole batches) for the scoring hot path. Scores are doubles; where
one is undefined (a zero vector, NULL, unequal lengths) it is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 127


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; NULL for unequal lengths."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, NULL where either norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column, strict: bool = False) -> Column:
    """1 - cosine; ``strict`` fails on unequal lengths instead of giving NULL."""
    d = F.lit(1.0) - cosine(a, b)
    if strict:
        d = F.when(F.assert_true(F.size(a) == F.size(b), F.lit("vector lengths differ")).isNull(), d)
    return d


def unit_distance(a: Column, b: Column) -> Column:
    """1 - dot, for vectors of norm 1."""
    return F.lit(1.0) - dot(a, b)


def l2_normalize(a: Column) -> Column:
    """``a`` over its norm; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sq8(a: Column) -> Column:
    """Bytes round(clamp(x, -1, 1) * 127), halves to even."""
    clamp = lambda x: F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0))
    return F.transform(a, lambda x: F.bround(clamp(x) * SCALE).cast("tinyint"))


def sq8_restore(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / SCALE)


def sq8_dot(a: Column, b: Column) -> Column:
    """Integer products of two quantised vectors, over 127 squared."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total / F.lit(float(SCALE * SCALE)))


def mixed_dot(a: Column, q: Column) -> Column:
    """Product of a full-precision and a quantised vector."""
    return dot(a, q) / F.lit(float(SCALE))


def matrix(arr: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of vectors of ``dims`` finite values, their row numbers) of a list array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    ok = arr.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(ok, np.asarray(arr.value_lengths().fill_null(0)), -1)
    rows = np.flatnonzero(size == dims)
    flat = np.asarray(arr.flatten().cast(pa.float64()).fill_null(np.nan))
    kept = np.where(ok, np.maximum(size, 0), 0)
    starts = np.cumsum(kept) - kept
    x = flat[starts[rows][:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
    fine = np.isfinite(x).all(1)
    return x[fine], rows[fine]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine_to(query: list[float]) -> Callable[[Column], Column]:
    """Cosine to one fixed vector as an Arrow kernel."""
    q = unit(np.asarray(query, np.float64)[None])[0]

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        x, rows = matrix(v, len(q))
        out = np.full(len(v), np.nan)
        out[rows] = unit(x) @ q
        return pa.array(out, mask=np.isnan(out))

    return score
