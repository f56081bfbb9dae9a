"""Image preprocessing and tiling geometry.

Decoded images are ``height x width x 3`` byte arrays in ``binary`` columns, so
nothing here depends on an image library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 224
MEAN = (0.48145466, 0.4578275, 0.40821073)
STD = (0.26862954, 0.26130258, 0.27577711)


def _starts(extent: Column, tile: Column) -> Column:
    """Tile starts along one axis: a stride of one tile, the last one aligned with the edge."""
    full = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((extent - tile) / tile)))
    starts = F.transform(full, lambda i: (i * tile).cast("int"))
    edge = F.greatest(F.lit(0), extent - tile).cast("int")
    return F.array_distinct(F.concat(starts, F.array(edge)))


def tiles(images: DataFrame, tile: int, *, width: str = "width", height: str = "height") -> DataFrame:
    """``images`` with tile_no, x, y, w, h: square tiles by row that cover the image, the whole image last.

    A tile is at most as large as the shorter side. Images without an area have no tiles.
    """
    t = F.least(F.lit(tile), F.col(width), F.col(height))
    xs, ys = _starts(F.col(width), t), _starts(F.col(height), t)
    cells = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y"), t.cast("int").alias("w"), t.cast("int").alias("h")))))
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col(width).cast("int").alias("w"), F.col(height).cast("int").alias("h")))
    return images.where((F.col(width) > 0) & (F.col(height) > 0)).select("*", F.posexplode(F.concat(cells, whole)).alias("tile_no", "__t")).select("*", "__t.*").drop("__t")


def _weights(n: int, side: int) -> np.ndarray:
    """side x n matrix of a cubic (a = -0.5) interpolation, edges clamped."""
    out = np.zeros((side, n))
    at = (np.arange(side) + 0.5) * n / side - 0.5
    base = np.floor(at).astype(int)
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
        np.add.at(out, (np.arange(side), np.clip(base + k, 0, n - 1)), w)
    return out


def prepared(pixels: np.ndarray, side: int = SIDE, mean=MEAN, std=STD) -> np.ndarray:
    """3 x side x side: stretched by cubic interpolation, scaled to [0, 1], standardised."""
    x = _weights(pixels.shape[0], side) @ pixels.astype(np.float64).transpose(2, 0, 1) @ _weights(pixels.shape[1], side).T
    x = np.clip(x, 0, 255) / 255
    return (x - np.array(mean)[:, None, None]) / np.array(std)[:, None, None]


def embed_images(pixels: Column, height: Column, width: Column, model: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> Column:
    """L2-normalised vectors; ``model`` maps a batch n x 3 x side x side to token states
    (the first token is taken) or vectors. NULL or torn pixels give an empty vector."""

    @F.pandas_udf("array<double>")
    def run(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out: list = [[] for _ in range(len(p))]
        fine = [i for i, (b, y, x) in enumerate(zip(p, h, w)) if b is not None and y and x and y == y and x == x and len(b) == int(y) * int(x) * 3]
        for a in range(0, len(fine), 16):
            own = fine[a : a + 16]
            batch = np.stack([prepared(np.frombuffer(p.iloc[i], np.uint8).reshape(int(h.iloc[i]), int(w.iloc[i]), 3), side) for i in own])
            got = np.asarray(model(batch.astype(np.float32)), np.float64)
            got = got[:, 0] if got.ndim == 3 else got
            n = np.linalg.norm(got, axis=1, keepdims=True)
            for i, v in zip(own, np.divide(got, n, out=got, where=n > 0)):
                out[i] = v.tolist()
        return pd.Series(out, dtype=object)

    return run(pixels, height, width)
