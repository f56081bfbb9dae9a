"""Structured Streaming into a store, and streaming metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embed import Embedder, with_embeddings
from ..operators.metrics import metric_windows
from ..operators.store import Store
from ..session import new_path


def ingest(rows: DataFrame, store: Store, checkpoint: str, *, embedder: Embedder | None = None, once: bool = True) -> StreamingQuery:
    """Appends every micro-batch of (collection, key, content, embedding[, sentence]) to ``store``.

    A micro-batch is one log batch, checked as a whole. With ``embedder``, rows
    without a vector get that of their non-blank ``sentence``. Rows of one key keep
    their order within a batch by ``ord`` where it is given. A micro-batch that is
    run again after a failure sets the same entries to the same values.
    """

    def write(batch: DataFrame, _: int) -> None:
        if embedder is not None:
            batch = with_embeddings(batch, embedder)
        if batch.limit(1).count():
            store.append(batch.drop("sentence"))

    out = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(availableNow=True) if once else out).start()


def metric_stream(samples: DataFrame, delay: str = "30 seconds", every: str = "10 seconds", *, ts: str = "ts", name: str = "name", value: str = "value") -> DataFrame:
    """``metric_windows`` of a stream: windows close ``delay`` after their end, later samples are dropped."""
    return metric_windows(samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay), every, ts=ts, name=name, value=value)


def status_sampler(spark: SparkSession, sample: Callable[[], DataFrame], path: str, every: str = "5 seconds") -> StreamingQuery:
    """Appends ``sample()`` with its time, ``ts``, to the Parquet folder ``path`` at every tick.

    The rate source only gives the beat. ``metrics.retained`` of what is there are
    the samples kept.
    """

    def tick(_: DataFrame, batch: int) -> None:
        sample().withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)

    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return beat.writeStream.trigger(processingTime=every).option("checkpointLocation", new_path(spark, "sampler")).foreachBatch(tick).start()
