"""Key lookups, key listings, counts and collection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import new_path


def _of(entries: DataFrame, collection: str | None) -> DataFrame:
    return entries if collection is None else entries.where(F.col("collection") == collection)


def get_content(entries: DataFrame, key, collection: str | None = None) -> DataFrame:
    """``content`` of one key; no row if it is missing."""
    return _of(entries, collection).where(F.col("key") == F.lit(key)).select("content")


def try_get_content(entries: DataFrame, key, collection: str | None = None) -> bytes | str | None:
    """The content, or None where it is missing or empty."""
    row = get_content(entries, key, collection).first()
    return row[0] if row and row[0] is not None and len(row[0]) else None


def get_embedding(entries: DataFrame, key, collection: str | None = None) -> DataFrame:
    """``embedding`` of one key; no row if it is missing or has no vector."""
    return _of(entries, collection).where((F.col("key") == F.lit(key)) & (F.size("embedding") > 0)).select("embedding")


def contains(entries: DataFrame, key, collection: str | None = None) -> bool:
    return bool(_of(entries, collection).where(F.col("key") == F.lit(key)).limit(1).count())


def contains_keys(keys: DataFrame, entries: DataFrame, on: str = "key") -> DataFrame:
    """Those of ``keys`` that the entries have."""
    return keys.join(entries.select(on), on, "left_semi")


def keys(entries: DataFrame, collection: str | None = None) -> DataFrame:
    return _of(entries, collection).select("key")


def keys_chunked(entries: DataFrame, size: int = 1000, key: str = "key") -> DataFrame:
    """(chunk, keys): runs of ``size`` keys in order, the last may be short.

    Ranks come from per-partition counts over a range partitioning, written once to
    the shared folder, so no task sees all keys.
    """
    spark, path = entries.sparkSession, new_path(entries.sparkSession, "keys")
    ordered = entries.select(F.col(key).alias("key")).orderBy("key").withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ordered.write.parquet(path)
    ordered = spark.read.schema(ordered.schema).parquet(path)
    counts = ordered.groupBy("__p").count()
    before = counts.select("__p", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    at = F.col("__b") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.join(F.broadcast(before), "__p").select("key", F.floor(at / size).alias("chunk"))
    return placed.groupBy("chunk").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def values(entries: DataFrame, collection: str | None = None) -> DataFrame:
    return _of(entries, collection).select("key", "content")


def collections(entries: DataFrame) -> DataFrame:
    return entries.select("collection").distinct()


def count(entries: DataFrame) -> DataFrame:
    return entries.groupBy("collection").agg(F.count("*").alias("n"))


def collection_info(entries: DataFrame, collection: str | None = None) -> DataFrame:
    """Per collection: entries, dimensions (0 without vectors), bytes of contents and of vectors.

    A named collection that does not exist raises KeyError.
    """
    dims = F.size("embedding")
    size = F.octet_length("content")
    out = _of(entries, collection).groupBy("collection").agg(
        F.count("*").alias("vectors"),
        F.max(F.when(dims > 0, dims).otherwise(0)).alias("dimensions"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("content_size"),
        F.coalesce(F.sum(F.when(dims > 0, dims * 4)), F.lit(0)).cast("long").alias("vector_size"),
    )
    if collection is not None and out.limit(1).count() == 0:
        raise KeyError(collection)
    return out


def database_info(infos: DataFrame, by: list[Column | str] | None = None) -> DataFrame:
    """Collection infos rolled up: totals and the sorted list of collections."""
    return infos.groupBy(*(by or [])).agg(
        F.sum("vectors").alias("vectors"),
        F.sum(F.col("content_size") + F.col("vector_size")).alias("size"),
        F.count("*").alias("n_collections"),
        F.sort_array(F.collect_list("collection")).alias("collections"),
    )


def visible_databases(catalog: DataFrame, user: str, is_admin: bool = False) -> DataFrame:
    """Catalog rows a user may see: all for an admin, else those owned or shared with them."""
    if is_admin:
        return catalog
    shared = F.coalesce(F.array_contains("users", user), F.lit(False)) if "users" in catalog.columns else F.lit(False)
    return catalog.where((F.col("owner") == user) | shared)


def distinct_users(users: DataFrame) -> DataFrame:
    """Users distinct by id, or by name where the id is missing."""
    return users.withColumn("__k", F.coalesce(F.col("id").cast("string"), F.col("name"))).dropDuplicates(["__k"]).drop("__k")
