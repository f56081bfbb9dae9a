"""Token chunking, truncation and pooling around embedders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 320, 64
HEAD, LONGEST = 256, 384


def task_prefixed(task: Column, text: Column) -> Column:
    """``"{task}: {text}"``, or the text alone where the task is blank."""
    blank = F.coalesce(F.trim(task) == "", F.lit(True))
    return F.when(blank, text).otherwise(F.concat(task, F.lit(": "), text))


def split_tokens(text: Column) -> Column:
    """White-space tokens, none of NULL or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def chunks(tokens: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Runs of ``size`` tokens, each ``overlap`` tokens into the one before; the last may be short.

    The overlap is clamped to 0 .. size - 1. A list that fits is one chunk, an
    empty one has none.
    """
    if size < 1:
        raise ValueError("size must be positive")
    step = size - min(max(overlap, 0), size - 1)
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / step))
    out = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, (i * step + 1).cast("int"), size))
    return F.when(F.size(tokens) > 0, out).otherwise(F.array().cast("array<array<string>>"))


def head_tail(tokens: Column, longest: int = LONGEST, head: int = HEAD) -> Column:
    """First ``head`` and last ``longest - head`` tokens of a list longer than ``longest``."""
    head = min(head, longest)
    cut = F.concat(F.slice(tokens, 1, head), F.slice(tokens, F.size(tokens) - (longest - head) + 1, longest - head)) if longest > head else F.slice(tokens, 1, longest)
    return F.when(F.size(tokens) > longest, cut).otherwise(tokens)


def weighted_mean(chunks_: DataFrame, by: list[str], vec: str = "embedding", weight: str = "n_tokens") -> DataFrame:
    """Per group, the mean of vectors weighted by ``weight``: (by..., embedding)."""
    parts = chunks_.select(*by, weight, F.posexplode(vec).alias("i", "v"))
    mean = F.try_divide(F.sum(F.col("v").cast("double") * F.col(weight)), F.sum(F.col(weight).cast("double")))
    dims = parts.groupBy(*by, "i").agg(mean.alias("v"))
    return dims.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("embedding"))


def masked_mean(states: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0; NULL if none is."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["s"])
    n = F.size(kept)
    total = F.aggregate(F.slice(kept, 2, F.greatest(n, F.lit(1))), F.transform(kept[0], lambda x: x.cast("double")), lambda a, x: F.zip_with(a, x, lambda p, q: p + q.cast("double")))
    return F.when(n > 0, F.transform(total, lambda x: x / n))
