"""Flat vector files: fvecs, ivecs and headerless float32 matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 32 << 20


def _slices(spark: SparkSession, path: str, record: int) -> DataFrame:
    """(path, start, n) of runs of whole records; a torn last record is left out."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    per = max(1, SLICE_BYTES // record)
    rows = []
    for f in fs.globStatus(jpath) or []:
        n = f.getLen() // record
        rows += [(f.getPath().toString(), a, min(per, n - a)) for a in range(0, n, per)]
    return spark.createDataFrame(rows, "path string, start long, n long").repartition(max(1, len(rows)))


def _read(path: str, at: int, size: int) -> bytes:
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        fs, name = pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    else:
        fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return f.read(size)


def read_flat(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(id, embedding) of headerless little-endian float32 vectors; ids count records of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.frombuffer(_read(r.path, r.start * dims * 4, r.n * dims * 4), "<f4").reshape(-1, dims)
                yield pd.DataFrame({"id": r.start + np.arange(len(x)), "embedding": list(x)})

    return _slices(spark, path, dims * 4).mapInPandas(run, "id long, embedding array<float>")


def _read_vecs(spark: SparkSession, path: str, column: str, kind: str, dtype: str) -> DataFrame:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for f in fs.globStatus(jpath) or [] if f.getLen() >= 4]
    if not found:
        return spark.createDataFrame([], f"id long, {column} array<{kind}>")
    stream = fs.open(found[0].getPath())
    dims = int.from_bytes(bytes(stream.read() & 0xFF for _ in range(4)), "little")
    stream.close()
    record = 4 * (dims + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                raw = np.frombuffer(_read(r.path, r.start * record, r.n * record), np.uint8).reshape(-1, record)
                if (np.ascontiguousarray(raw[:, :4]).view("<i4") != dims).any():
                    raise ValueError(f"{r.path}: vectors of unequal length")
                yield pd.DataFrame({"id": r.start + np.arange(len(raw)), column: list(np.ascontiguousarray(raw[:, 4:]).view(dtype))})

    return _slices(spark, path, record).mapInPandas(run, f"id long, {column} array<{kind}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of files whose records are a length and that many float32."""
    return _read_vecs(spark, path, "embedding", "float", "<f4")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(id, neighbours) of files whose records are a length and that many int32."""
    return _read_vecs(spark, path, "neighbours", "int", "<i4")
