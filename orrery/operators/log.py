"""Views over an append-only mutation log.

A log row is (collection, key, batch, ord, tx, op, content, embedding). ``op`` is
``set``, ``delete``, ``clear`` (NULL key: all keys of the collection up to
there) or ``commit`` (of the transaction ``tx``). (batch, ord) orders a log and is
given by its writer. A row of a transaction counts only if the log has its
commit. The newest row of a key replaces the entry whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOG = "collection string, key binary, batch bigint, ord bigint, tx string, op string, content string, embedding array<float>"
MIN_DEAD_BYTES, MIN_DEAD_SHARE = 64 << 20, 0.4


def seq() -> Column:
    return F.struct("batch", "ord")


def committed(log: DataFrame) -> DataFrame:
    """Mutations outside transactions or of committed ones; markers are dropped.

    Within a transaction ``clear`` is not allowed: it and what follows are ignored.
    """
    done = log.where("op = 'commit' AND tx IS NOT NULL").select(F.col("tx").alias("__tx")).distinct()
    rows = log.where("op <> 'commit'")
    plain = rows.where("tx IS NULL")
    inside = rows.where("tx IS NOT NULL").join(done, F.col("tx") == F.col("__tx"), "left_semi")
    stop = inside.where("op = 'clear'").groupBy(F.col("tx").alias("__s")).agg(F.min(seq()).alias("__at"))
    inside = inside.join(stop, F.col("tx") == F.col("__s"), "left").where(F.col("__at").isNull() | (seq() < F.col("__at"))).drop("__s", "__at")
    return plain.unionByName(inside)


def latest_live(log: DataFrame) -> DataFrame:
    """(collection, key, batch, ord, content, embedding): the newest row of each key not deleted or cleared.

    One aggregation with map-side combine; clears are one row per collection.
    """
    rows = committed(log)
    newest = rows.where("key IS NOT NULL AND op IN ('set', 'delete')").groupBy("collection", "key").agg(F.max(F.struct("batch", "ord", "op", "content", "embedding")).alias("m"))
    cleared = rows.where("op = 'clear'").groupBy(F.col("collection").alias("__c")).agg(F.max(seq()).alias("__h"))
    live = newest.join(cleared, F.col("collection") == F.col("__c"), "left")
    live = live.where((F.col("m.op") == "set") & (F.col("__h").isNull() | (F.struct("m.batch", "m.ord") > F.col("__h"))))
    return live.select("collection", "key", *[F.col(f"m.{c}").alias(c) for c in ("batch", "ord", "content", "embedding")])


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``; all columns kept."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m"))
    return last.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest]).select(*rows.columns)


def only_new(rows: DataFrame, live: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Append-only insert: rows whose key is not live."""
    return rows.join(live, on or ["collection", "key"], "left_anti")


def conflicts(rows: DataFrame, live: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows an append-only insert rejects."""
    return rows.join(live, on or ["collection", "key"], "left_semi")


def record_bytes() -> Column:
    """Bytes a log row holds: content and four per vector element."""
    dims = F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0))
    return F.coalesce(F.octet_length("content"), F.lit(0)) + 4 * dims


def dead_space(log: DataFrame) -> DataFrame:
    """Per collection: total_bytes, dead_bytes, fragmentation, needs_shrink."""
    live = latest_live(log).select("collection", "batch", "ord", F.lit(True).alias("live"))
    rows = log.where("op = 'set'").select("collection", "batch", "ord", record_bytes().alias("b"))
    sized = rows.join(live, ["collection", "batch", "ord"], "left")
    out = sized.groupBy("collection").agg(F.sum("b").alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("live").isNull(), F.col("b"))), F.lit(0)).cast("long").alias("dead_bytes"))
    out = out.withColumn("fragmentation", F.coalesce(F.try_divide(F.col("dead_bytes").cast("double"), F.col("total_bytes").cast("double")), F.lit(0.0)))
    return out.withColumn("needs_shrink", (F.col("dead_bytes") >= MIN_DEAD_BYTES) & (F.col("fragmentation") >= MIN_DEAD_SHARE))


def missing_from_index(store: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """Store entries that the index lacks."""
    return store.join(index, on, "left_anti")


def ghosts_of_index(store: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """Index entries that the store no longer has."""
    return index.join(store, on, "left_anti")


def previous(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``delta``: the change of ``value`` since the row before, clamped to 0 .. 100, 0 at first."""
    d = F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("delta", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(d, F.lit(0.0)))))
