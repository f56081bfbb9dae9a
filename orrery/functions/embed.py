"""Embedders as Arrow kernels.

An embedder is a function from a list of token lists to vectors; it is loaded
once per Python worker. ``hash_embedder`` needs no model; ``onnx_embedder`` runs a
model file. Long texts are cut into overlapping chunks whose vectors are averaged
by their token counts, or truncated to head and tail.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CHUNK, HEAD, LONGEST, OVERLAP, task_prefixed

BATCH = 64
SLICE = 1 << 20
Embedder = Callable[[list[list[str]]], np.ndarray]
TOKEN = re.compile(r"\S+")


def hash_embedder(dims: int = 64) -> Embedder:
    """Signed feature hashing of tokens, normalised; equal texts have equal vectors everywhere."""

    def run(batch: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(batch), dims))
        for i, tokens in enumerate(batch):
            for t in tokens:
                h = int.from_bytes(hashlib.blake2b(t.lower().encode("utf-8", "replace"), digest_size=8).digest(), "little")
                out[i, h % dims] += 1.0 if (h >> 40) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return run


def select_output(outputs: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
    """Sentence vectors of a model's outputs: ``sentence_embedding``, else any matrix,
    else the masked mean of token vectors, else the flat output of a batch of one, else none."""
    if "sentence_embedding" in outputs:
        return outputs["sentence_embedding"]
    for v in outputs.values():
        if v.ndim == 2 and len(v) == len(mask):
            return v
    for v in outputs.values():
        if v.ndim == 3 and v.shape[:2] == mask.shape:
            return masked_mean_batch(v, mask)
    if len(mask) == 1 and outputs:
        return next(iter(outputs.values())).reshape(1, -1)
    return np.zeros((len(mask), 0))


def masked_mean_batch(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean token vector of each row over the tokens whose mask is not 0; zeros if there is none."""
    m = (mask != 0).astype(np.float64)[:, :, None]
    return (states * m).sum(1) / np.maximum(m.sum(1), 1)


def onnx_embedder(path: str, encode: Callable[[list[str]], list[int]], providers: Sequence[str] = ("CPUExecutionProvider",)) -> Embedder:
    """A model on all executors' disks at ``path``; ``encode`` gives the ids of a token list.

    Providers that the runtime lacks are left out, the CPU is always tried last.
    """
    held: list = []

    def run(batch: list[list[str]]) -> np.ndarray:
        if not held:
            import onnxruntime as ort

            there = [p for p in providers if p in ort.get_available_providers()]
            options = ort.SessionOptions()
            options.intra_op_num_threads = int(os.environ.get("OMP_NUM_THREADS", "1"))
            held.append(ort.InferenceSession(path, options, providers=list(dict.fromkeys([*there, "CPUExecutionProvider"]))))
        session = held[0]
        ids = [encode(t) for t in batch]
        width = max(1, max(map(len, ids), default=1))
        table, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
        for i, x in enumerate(ids):
            table[i, : len(x)], mask[i, : len(x)] = x, 1
        given = {"input_ids": table, "attention_mask": mask, "token_type_ids": np.zeros_like(table)}
        got = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})
        return select_output({o.name: v for o, v in zip(session.get_outputs(), got)}, mask)

    return run


def cut(tokens: list[str], chunked: bool, size: int, overlap: int, longest: int, head: int) -> list[list[str]]:
    """The token runs of one text that are embedded."""
    if not tokens:
        return []
    if not chunked:
        if len(tokens) <= longest:
            return [tokens]
        return [tokens[:head] + tokens[len(tokens) - (longest - head) :]]
    step = size - min(max(overlap, 0), size - 1)
    return [tokens[a : a + size] for a in range(0, max(len(tokens) - size, 0) + step, step) if a == 0 or a + size - step < len(tokens)]


def embed(text: Column, embedder: Embedder, *, chunked: bool = True, size: int = CHUNK, overlap: int = OVERLAP, longest: int = LONGEST, head: int = HEAD) -> Column:
    """Vectors of a text column; NULL and blank texts give an empty one.

    Texts are taken SLICE characters at a time, however many a batch has. Their runs are embedded
    from the longest to the shortest, BATCH at a time, so that padding is small.
    """

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield vectors(texts, embedder, lambda t: cut(t, chunked, size, overlap, longest, head))

    return run(text)


def vectors(texts: pa.Array, embedder: Embedder, runs_of: Callable[[list[str]], list[list[str]]]) -> pa.Array:
    """The vector of each text, the mean of its runs by their token counts; tokens of a slice of the texts are held."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE, prepend=-1)).tolist() if len(texts) else []
    found: list = []
    for first, last in zip(starts, [*starts[1:], len(texts)]):
        runs, owner = [], []
        for i, t in enumerate(texts.slice(first, last - first).to_pylist()):
            for r in runs_of(TOKEN.findall(t) if t else []):
                runs.append(r)
                owner.append(i)
        order = sorted(range(len(runs)), key=lambda k: (-len(runs[k]), k))
        got: list = [None] * len(runs)
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            for k, v in zip(own, embedder([runs[k] for k in own])):
                got[k] = v
        total: dict[int, np.ndarray] = {}
        weight: dict[int, float] = {}
        for i, r, v in zip(owner, runs, got):
            total[i] = total.get(i, 0) + np.asarray(v, np.float64) * len(r)
            weight[i] = weight.get(i, 0) + len(r)
        found.append(pa.array([total[i] / weight[i] if i in total else [] for i in range(last - first)], pa.list_(pa.float64())))
    return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float64()))


def with_embeddings(rows: DataFrame, embedder: Embedder, *, sentence: str = "sentence", vec: str = "embedding", task: str = "", **how) -> DataFrame:
    """Rows whose missing vectors are those of their sentences; blank sentences leave NULL."""
    text = F.when(F.trim(F.col(sentence)) != "", task_prefixed(F.lit(task), F.col(sentence)))
    made = F.when(text.isNotNull(), embed(text, embedder, **how)).cast("array<float>")
    old = F.col(vec) if vec in rows.columns else F.lit(None).cast("array<float>")
    return rows.withColumn(vec, F.coalesce(old.cast("array<float>"), F.when(F.size(made) > 0, made)))
