"""Operator 4: language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a logistic
classifier over hashed byte bigrams and trigrams says which half of the
languages a text belongs to. Decoding sums, for each codeword, the logistic
losses of its bits, weighted by the bits' training accuracy, and takes the
codeword of least loss. A text is *ambiguous* where the runner-up is nearly as
close, or where even the nearest codeword is far.

The classifier is fitted on a bounded sample of labelled rows
(``per_language``, chosen by hash of the id); scoring is one map over the whole
of every text, without a shuffle. What the tasks get is a table of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from ._store import released

BITS = 12
WIDTH = 2 << BITS
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SPACES = np.uint32(0x202020)


def features(text: str | None, out: np.ndarray) -> int:
    """Adds sqrt of n-gram shares of the whole text to ``out``; returns the number of n-grams."""
    if not text:
        return 0
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_KEEP), np.uint8).astype(np.uint32)
    tri = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    tri = tri[tri != _SPACES]
    two = tri >> np.uint32(8)
    two = two[two != np.uint32(0x2020)]
    if not len(two):
        return 0
    k = np.uint32(2654435761)
    counts = np.bincount((two * k) >> np.uint32(32 - BITS), minlength=WIDTH // 2), np.bincount((tri * k) >> np.uint32(32 - BITS), minlength=WIDTH // 2)
    out[: WIDTH // 2] = np.sqrt(counts[0] / len(two))
    out[WIDTH // 2 :] = np.sqrt(counts[1] / len(tri))
    return len(tri)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: all splits of the languages for 2 to 5 of them, beyond
    that the draw, of 200, with the greatest least distance between rows."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        cols = [[1 if (k >> r) & 1 else -1 for r in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(cols, np.int8).T
    rng, bits = np.random.default_rng(seed), 10 * math.ceil(math.log2(n))
    best, most = None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        c = c[:, np.abs(c.sum(0)) < n]
        gap = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        if gap > most:
            best, most = c, gap
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of the bits, of mean 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """rows x languages, mean weighted loss of the codeword's bits."""
        if not self.code.shape[1]:
            return np.zeros((len(x), len(self.languages)))
        f = x @ self.weights + self.bias
        return (np.logaddexp(0, -self.code[None] * f[:, None, :]) * self.trust).mean(2)


def fit_arrays(x: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 80, l2: float = 1e-4) -> LanguageModel:
    code = codewords(len(languages))
    if not code.shape[1]:
        return LanguageModel(languages, code, np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    y = code[labels].astype(np.float32)
    per = 1 / np.bincount(labels, minlength=len(languages))[labels]
    share = np.stack([np.where(y[:, b] > 0, per / per[y[:, b] > 0].sum(), per / per[y[:, b] < 0].sum()) / 2 for b in range(y.shape[1])], 1).astype(np.float32)
    w, bias = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)
    for step in range(1, steps + 1):
        g = -y * share / (1 + np.exp(y * (x @ w + bias)))
        gw, gb = x.T @ g + l2 * w, g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr, c1, c2 = 0.5, 1 - 0.9**step, 1 - 0.99**step
        w -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        bias -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    accuracy = (share * ((x @ w + bias) * y > 0)).sum(0)
    trust = np.clip(accuracy - 0.5, 1e-3, None)
    return LanguageModel(languages, code, w, bias, trust / trust.mean())


def fit(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from at most ``per_language`` rows of each value of ``lang_col``.

    NULL ids and languages and rows without letters teach nothing. The rows are those
    with the smallest hash of their id; rows that repeat an id and its language are
    one, that of the features that sort first, so no more than ``per_language`` a
    language ever reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    near = rows.select("id", "lang").where("id IS NOT NULL").distinct().withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")))
    chosen = near.where(F.col("r") <= per_language).select("id", "lang")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, lang, text in zip(pdf["id"], pdf["lang"], pdf["text"]):
                x = np.zeros(WIDTH, np.float32)
                if features(text, x):
                    out.append((i, lang, x.astype(np.float16).tobytes()))
            yield pd.DataFrame(out, columns=["id", "lang", "x"])

    own = rows.join(F.broadcast(chosen), ["id", "lang"]).select(F.col("id").cast("string").alias("id"), "lang", "text")
    got = own.mapInPandas(vectors, "id string, lang string, x binary").groupBy("id", "lang").agg(F.min("x")).select("lang", "min(x)").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    languages = sorted({r[0] for r in got})
    x = np.stack([np.frombuffer(r[1], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, WIDTH), np.float32)
    return fit_arrays(x, np.array([languages.index(r[0]) for r in got], np.int64), languages)


def identify_texts(model: LanguageModel, texts, margin: float, far: float) -> pd.DataFrame:
    """predicted, loss, gap, ambiguous of each text."""
    x = np.zeros((len(texts), WIDTH), np.float32)
    any_ = np.array([features(t, x[i]) > 0 for i, t in enumerate(texts)], bool)
    if not model.languages:
        any_[:] = False
    out = pd.DataFrame({"predicted": pd.Series([None] * len(texts), dtype=object), "loss": np.nan, "gap": np.nan, "ambiguous": True})
    if any_.any():
        loss = model.losses(x[any_])
        order = np.argsort(loss, 1, kind="stable")
        best = loss[np.arange(len(loss)), order[:, 0]]
        gap = loss[np.arange(len(loss)), order[:, 1]] - best if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        out.loc[any_, "predicted"] = np.array(model.languages, object)[order[:, 0]]
        out.loc[any_, "loss"] = best
        out.loc[any_, "gap"] = gap
        out.loc[any_, "ambiguous"] = (gap < margin) | (best > far)
    return out


def identify(docs: DataFrame, model: LanguageModel, margin: float = 0.15, far: float = 0.69, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, predicted, loss, gap, ambiguous) of every row of ``docs``.

    ``gap`` is the runner-up's loss less the best; a row is ambiguous where it
    is below ``margin`` or where the best loss exceeds ``far`` (ln 2 is the loss
    of a bit that says nothing). NULL, empty and letterless texts have NULL
    ``predicted`` and ``loss`` and are ambiguous. One row per input row, repeats
    and NULL ids included; ties of loss go to the language that sorts first.
    A model of one language is never ambiguous on a text with letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                out = identify_texts(shared.value, part["text"].tolist(), margin, far)
                yield pd.concat([part[["doc_id"]].reset_index(drop=True), out], axis=1)
        released()

    rows = spread(docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text")))  # a NULL would make pandas' integers floats
    out = rows.mapInPandas(run, "doc_id string, predicted string, loss double, gap double, ambiguous boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def is_rejected(model: LanguageModel, spark, margin: float = 0.15, far: float = 0.69):
    """A function of a text column: true where ``identify`` finds it ambiguous."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        parts = [identify_texts(shared.value, texts.iloc[k : k + 256].tolist(), margin, far)["ambiguous"].astype(bool) for k in range(0, len(texts), 256)]
        return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=bool)

    return rejected


def drop_ambiguous(docs: DataFrame, per_language: int = 400, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language cannot be told; columns unchanged."""
    model = fit(docs, per_language)
    rejected: Column = is_rejected(model, docs.sparkSession)(F.col(text_col))
    return spread(docs).where(~rejected)
