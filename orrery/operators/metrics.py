"""Metric windows, status samples and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = {"1m": 60, "5m": 300, "10m": 600, "1h": 3600}
RETAINED_S, MOST_SAMPLES = 3600, 720


def metric_windows(samples: DataFrame, every: str = "10 seconds", *, ts: str = "ts", name: str = "name", value: str = "value", order: str | None = None) -> DataFrame:
    """(window_start, name, n, total, least, most, last) of each tumbling window.

    ``last`` is the value of the latest sample, ties by ``order``. The same plan
    serves a stream.
    """
    at = F.struct(ts, *([order] if order else []))
    out = samples.groupBy(F.window(F.col(ts), every), F.col(name).alias("name")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, at).alias("last")
    )
    return out.select(F.col("window.start").alias("window_start"), "name", "n", "total", "least", "most", "last")


def history(samples: DataFrame, window: str = "1h", *, ts: str = "ts") -> DataFrame:
    """Samples of the window that ends with the last one; unknown windows are an hour."""
    seconds = WINDOWS.get(window, 3600)
    last = samples.agg(F.max(ts).alias("__to"))
    return samples.join(F.broadcast(last), F.col(ts) >= F.col("__to") - F.expr(f"INTERVAL {seconds} SECONDS")).drop("__to")


def retained(samples: DataFrame, *, ts: str = "ts") -> DataFrame:
    """The samples kept: of the last hour, and the newest MOST_SAMPLES of them."""
    return history(samples, "1h", ts=ts).orderBy(F.desc(ts)).limit(MOST_SAMPLES)


def status_sample(infos: DataFrame) -> DataFrame:
    """(database, vectors, size, collections): sums of a database's collection infos,
    with the collections as structs sorted by name."""
    each = F.struct("collection", "vectors", "content_size", "vector_size")
    return infos.groupBy("database").agg(F.sum("vectors").alias("vectors"), F.sum(F.col("content_size") + F.col("vector_size")).alias("size"), F.sort_array(F.collect_list(each)).alias("collections"))
