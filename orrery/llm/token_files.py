"""Operator 10: token ids as flat binary files with 64-bit document offsets.

Each task tokenises its rows and appends their ids, in one little-endian
unsigned integer type, to a file of its own in the shared output folder; the
rows it returns carry the file's name, so a repeated or speculative attempt
writes another file and only the committed one is ever named. Per-file totals
then give every file's base by an exclusive prefix sum, and each file gets a
companion of ``documents + 1`` uint64 *global* token offsets. Text is read once
and never shuffled; only the index rows (ids and counts) are.

    tokens-<run>-<shard>-<attempt>.bin    token ids, back to back
    tokens-<run>-<shard>-<attempt>.off    global offsets: document i has [off[i], off[i + 1])
    manifest/                             Parquet: file, token_base, doc_base, n_tokens, n_docs, dtype

``TokenFiles`` memory-maps them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from ._store import dropped, new_path, released, staged

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The splitter's look-ahead takes stack for every character of a run of white space; longer ones go around it.
RUN = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a ``.tiktoken`` file: base64 piece and rank by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("orrery", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long = regex.compile(r"\p{White_Space}{%d,}+" % RUN)

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; decoding them gives it back."""
        text = text.encode("utf-8", "replace").decode("utf-8")
        out, at = [], 0
        if len(text) >= RUN:
            for m in self.long.finditer(text):
                out += self.encoding.encode_ordinary(text[at : m.start()])
                # the splitter takes a run whole, but for the last character before a word
                at = m.end() - (m.end() < len(text))
                out += self.encoding._encode_single_piece(text[m.start() : at])
        return out + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids) -> str:
        return self.encoding.decode([int(i) for i in ids])


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of ``docs`` and returns their index.

    Columns: doc_id, file, doc_index (place in the whole), token_offset (global),
    n_tokens. One row per input row in file order, repeats and NULL ids included;
    NULL and empty texts have no ids (but ``end_id`` if given). An empty table
    gives no rows. ``tokenizer`` is the path of a ``.tiktoken`` vocabulary on the
    driver; ``out`` a folder (URI) all executors can write, by default a new one
    in the shared folder. Ids are uint16 where all fit, else uint32. Files that
    another run left in ``out`` stay, but its manifest must not be there.
    """
    spark = docs.sparkSession
    ranks = load_ranks(tokenizer)
    most = max([*ranks.values(), end_id or 0])
    dtype = "<u2" if most < 1 << 16 else "<u4"
    out = (out or new_path(spark, "tokens")).rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    hadoop = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop.mkdirs(path)
    uri = out if "://" in out or out.startswith("file:") else "file://" + out
    uri = uri.replace("file:///", "file:/").replace("file:/", "file:///")
    shared, run = spark.sparkContext.broadcast(ranks), uuid.uuid4().hex[:12]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"tokens-{run}-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, at = _opened(uri)
        tok, row, offset, sink = Tokenizer(shared.value), 0, 0, None
        try:
            for pdf in batches:
                counts = []
                for text in pdf["text"]:
                    ids = tok.encode(text) if text else []
                    if end_id is not None:
                        ids.append(end_id)
                    if sink is None:
                        sink = fs.open_output_stream(f"{at}/{name}")
                    sink.write(np.array(ids, dtype).tobytes())
                    counts.append(len(ids))
                n = np.array(counts, np.int64)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "file": name, "shard": task.partitionId(), "row": row + np.arange(len(n)), "local": offset + np.cumsum(n) - n, "n_tokens": n})
                row, offset = row + len(n), offset + int(n.sum())
        finally:
            if sink is not None:
                sink.close()
            released()

    rows = spread(docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")))  # a NULL would make pandas' integers floats
    index = staged(rows.mapInPandas(encode, "doc_id string, file string, shard int, row long, local long, n_tokens long"), "token-index")
    totals = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    based = totals.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"), F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"), "n_tokens", "n_docs", F.lit(dtype).alias("dtype"))
    based.write.parquet(f"{out}/manifest")
    bases = spark.read.schema(based.schema).parquet(f"{out}/manifest")
    placed = index.join(bases.select("file", "token_base", "doc_base"), "file").select("doc_id", "file", (F.col("doc_base") + F.col("row")).alias("doc_index"), (F.col("token_base") + F.col("local")).alias("token_offset"), "n_tokens")

    def offsets(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_index")
        starts = pdf["token_offset"].to_numpy().astype("<u8")
        last = starts[-1:] + pdf["n_tokens"].to_numpy()[-1:].astype("<u8")
        fs, at = _opened(uri)
        name = pdf["file"].iloc[0][:-4] + ".off"
        with fs.open_output_stream(f"{at}/{name}.{TaskContext.get().taskAttemptId()}") as sink:
            sink.write(np.concatenate([starts, last]).tobytes())
        fs.move(f"{at}/{name}.{TaskContext.get().taskAttemptId()}", f"{at}/{name}")
        return pdf

    written = placed.groupBy("file").applyInPandas(offsets, placed.schema)
    done = staged(written.withColumn("doc_id", F.col("doc_id").cast("long")), "token-offsets")
    named = {r[0] for r in bases.select("file").collect()}
    for status in hadoop.listStatus(path):
        name = status.getPath().getName()
        if name.startswith(f"tokens-{run}-") and name.endswith(".bin") and name not in named:
            hadoop.delete(status.getPath(), False)  # of an attempt that was not committed
    dropped(index)
    return done


class TokenFiles:
    """Memory-mapped reader of a local output folder."""

    def __init__(self, folder: str) -> None:
        import pyarrow.parquet as pq

        folder = folder.removeprefix("file://").removeprefix("file:")
        self.parts = sorted(pq.read_table(f"{folder}/manifest").to_pylist(), key=lambda r: (r["doc_base"], r["n_docs"]))
        self.parts = [p for p in self.parts if p["n_docs"]]
        self.starts = np.array([p["doc_base"] for p in self.parts], np.int64)
        self.offsets = [np.memmap(f"{folder}/{p['file'][:-4]}.off", "<u8", "r") for p in self.parts]
        self.tokens = [np.memmap(f"{folder}/{p['file']}", p["dtype"], "r") if p["n_tokens"] else np.zeros(0, p["dtype"]) for p in self.parts]

    def __len__(self) -> int:
        return int(self.starts[-1] + self.parts[-1]["n_docs"]) if self.parts else 0

    def __getitem__(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the whole."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        p = int(np.searchsorted(self.starts, i, "right")) - 1
        off, base = self.offsets[p], np.uint64(self.parts[p]["token_base"])
        a, b = off[i - self.starts[p]] - base, off[i - self.starts[p] + 1] - base
        return self.tokens[p][int(a) : int(b)]
