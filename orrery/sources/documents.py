"""JSON contents in and out, and bulk rows with textual keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_bytes, resolve_key


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(content, document): the lines of text files that are JSON, as they are and as a VARIANT."""
    lines = spark.read.text(path).select(F.col("value").alias("content"), F.try_parse_json("value").alias("document"))
    return lines.where("document IS NOT NULL")


def as_json(c: Column) -> Column:
    """Content (struct, map, array or VARIANT) as JSON text."""
    return F.to_json(c)


def decoded_if(rows: DataFrame, where: Column, schema: str, content: str = "content") -> DataFrame:
    """Rows that match ``where``, their JSON content decoded to ``schema``; the rest is never decoded."""
    return rows.where(where).withColumn(content, F.from_json(content, schema))


def accepted(rows: DataFrame, key: str = "key", key_type: str | None = None) -> DataFrame:
    """Bulk rows with binary keys; rows whose key cannot be resolved are skipped.

    Without ``key_type`` an integer is a long and other text its bytes; otherwise
    the text must be of that type (int, uint, long, ulong, string).
    """
    text = F.col(key).cast("string")
    if key_type is None:
        k = resolve_key(text)
    elif key_type == "string":
        k = F.when(F.trim(text) != "", key_bytes(text, "string"))
    else:
        k = key_bytes(text.try_cast("bigint"), key_type)
    return rows.withColumn(key, k).where(F.col(key).isNotNull())
