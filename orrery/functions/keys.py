"""Key codecs: typed values as the bytes that identify an entry."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTS = {"int": ("<i", 4), "uint": ("<I", 4), "long": ("<q", 8), "ulong": ("<Q", 8)}


def encode_key(value, kind: str | None = None) -> bytes:
    """Bytes of one key. ``kind`` is int, uint, long, ulong, guid, string or bytes;
    without it a UUID is tried, then a long, then text. An int and a long of the
    same value are different keys. Unknown kinds and unfit values raise ValueError."""
    if isinstance(value, (bytes, bytearray)) and kind in (None, "bytes"):
        return bytes(value)
    if kind is None:
        if isinstance(value, uuid.UUID):
            return value.bytes_le
        if isinstance(value, int):
            return struct.pack("<q", value)
        for attempt in ("guid", "long"):
            try:
                return encode_key(value, attempt)
            except ValueError:
                pass
        return str(value).encode()
    if kind in _INTS:
        try:
            return struct.pack(_INTS[kind][0], int(value))
        except struct.error as e:
            raise ValueError(f"{value!r} is no {kind}") from e
    if kind == "guid":
        return uuid.UUID(str(value)).bytes_le
    if kind == "string":
        return str(value).encode()
    raise ValueError(f"unknown key kind {kind!r}")


def key_bytes(c: Column, kind: str) -> Column:
    """``encode_key`` for a column of an integer or string kind, in the JVM."""
    if kind in ("string", "bytes"):
        return c.cast("binary")
    if kind in _INTS:
        n = _INTS[kind][1]
        big = F.lpad(F.hex(c.cast("long")), 16, "0")
        low = F.substring(big, 17 - 2 * n, 2 * n)
        return F.unhex(F.concat(*[F.substring(low, 2 * n - 1 - 2 * i, 2) for i in range(n)]))
    raise ValueError(f"no column codec for {kind!r}")


def resolve_key(c: Column) -> Column:
    """Text to key bytes: an integer becomes a long, other text its UTF-8 bytes;
    NULL and blank text have no key."""
    as_long = c.try_cast("bigint")
    return F.when(F.trim(c) == "", None).when(as_long.isNotNull(), key_bytes(as_long, "long")).otherwise(c.cast("binary"))


def key_base64(c: Column) -> Column:
    return F.base64(c)


def collection_digest(c: Column) -> Column:
    """Hex SHA-256 of a collection's name (its folder)."""
    return F.sha2(c, 256)


def record_crc(c: Column) -> Column:
    return F.crc32(c)


def shard_collection(base: Column, shard: Column) -> Column:
    """Name of a shard's collection: ``{base}_{shard or "default"}``."""
    return F.concat_ws("_", base, F.coalesce(shard.cast("string"), F.lit("default")))
