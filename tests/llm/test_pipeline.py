"""Each stage of the pipeline against a brute-force version, on its own input."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash

import corpus_pipeline as pipeline
from orrery.llm import langid, mixing, token_files
from orrery.llm._store import staged


def _rows(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    """What each stage read, and the result of the last."""
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        seen.append(docs)
        docs = staged(stage(spark, docs, sf_dir), name)
    return seen + [docs]


def test_stages_keep_the_columns(inputs):
    assert all(x.columns == ["doc_id", "text", "lang", "source", "n_chars"] for x in inputs[:-1])


def test_language_stage(inputs):
    before, after = inputs[0], inputs[1]
    model, want = langid.fit(before), []
    for r in before.collect():
        x = np.zeros(langid.WIDTH, np.float32)
        if langid.features(r["text"], x):
            f = x.astype(np.float64) @ model.weights + model.bias
            loss = sorted(float(np.mean([t * math.log1p(math.exp(-float(c) * v)) for c, v, t in zip(word, f, model.trust)])) for word in model.code)
            if loss[1] - loss[0] >= 0.15 and loss[0] <= 0.69:
                want.append((str(r["doc_id"]), str(r["text"])))
    assert _rows(after) == sorted(want)
    with_words = [r for r in before.collect() if r["text"] and len(re.findall(r"\w+", r["text"])) >= 20]
    kept = {r["doc_id"] for r in after.collect()}
    assert sum(r["doc_id"] in kept for r in with_words) >= 0.97 * len(with_words)


def test_near_duplicate_stage(inputs):
    rows = [(r["doc_id"], r["text"]) for r in inputs[1].collect()]
    sets = {}
    for i, t in rows:
        ws = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(ws[k : k + 2]) for k in range(max(1, len(ws) - 1))} if ws else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 - 1e-9:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert sorted(r["doc_id"] for r in inputs[2].collect()) == [i for i in ids if root(i) == i]


def leaks(text, items):
    """Whether any item is within its budget of edits of a passage, by the table of all distances, a column a character."""
    longest = max(len(t) for t in items)
    table = np.array([[ord(c) for c in t.ljust(longest, "\0")] for t in items])
    size = np.array([len(t) for t in items])
    at = np.arange(longest + 1)
    row = np.tile(at, (len(items), 1))
    best = np.full(len(items), longest)
    for c in text:
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (table != ord(c)))
        new = np.concatenate([np.zeros((len(items), 1), int), new], 1)
        row = np.minimum.accumulate(new - at, 1) + at
        best = np.minimum(best, row[np.arange(len(items)), size])
    return (best <= np.floor(0.06 * (size - 2) + 1e-9)).any()


def test_decontamination_stage(spark, sf_dir, inputs):
    items = [f" {' '.join(re.findall(r'\w+', r['text'].lower()))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [(str(r["doc_id"]), str(r["text"])) for r in inputs[2].collect() if not leaks(f" {' '.join(re.findall(r'\w+', (r['text'] or '').lower()))} ", items)]
    assert _rows(inputs[3]) == sorted(want) and len(want) < inputs[2].count()


def _draw(doc_id):
    first = xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", 11), seed=first).intdigest() % (1 << 30) / (1 << 30)


def test_mixing_stage(spark, sf_dir, inputs):
    """Rates by plain gradient steps on the dual over all rows."""
    before, after = inputs[3].collect(), inputs[4]
    model = mixing.fit(inputs[3], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = [next(iter(mixing.features([r["text"]]))) for r in before]
    p = model.posterior([g[0] for g in got], np.stack([g[1] for g in got]))
    n = np.array([g[2] for g in got], float)
    w = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    targets = w * mixing.HEADROOM * (n @ p)[0] / w[0]
    x = np.zeros(3)
    step = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
    for _ in range(200_000):
        slope = (np.maximum(0, 1 + p @ x) * n) @ p - targets
        if np.abs(slope).max() < 1e-6 * targets.sum():
            break
        x -= step * slope
    rate = np.maximum(0, 1 + p @ x)
    want, unsure = {}, set()
    for r, v in zip(before, rate):
        copies = math.floor(v) + (_draw(r["doc_id"]) < v - math.floor(v))
        want[str(r["doc_id"]), str(r["text"])] = copies
        if abs(_draw(r["doc_id"]) - (v - math.floor(v))) < 2e-3 or abs(v - round(v)) < 2e-3:
            unsure.add((str(r["doc_id"]), str(r["text"])))  # within the tolerance of the totals
    counted = Counter(_rows(after))
    assert len(unsure) <= 0.05 * len(before)
    assert all(counted.get(k, 0) == c for k, c in want.items() if k not in unsure) and set(counted) <= set(want)


def test_token_stage(inputs):
    plain = tiktoken.Encoding("plain", pat_str=token_files.PATTERN, mergeable_ranks=token_files.load_ranks(pipeline.TOKENIZER), special_tokens={})
    texts = {}
    for i, t in _rows(inputs[4]):
        texts.setdefault(i, t)
    index = inputs[5].orderBy("doc_index").collect()
    assert len(index) == inputs[4].count() and [r["doc_index"] for r in index] == list(range(len(index)))
    at = 0
    for r in index:
        assert r["token_offset"] == at and r["n_tokens"] == len(plain.encode_ordinary(texts[str(r["doc_id"])]))
        at += r["n_tokens"]


def test_odd_rows_pass_through(spark, tmp_path):
    """NULLs, repeats, other columns and empty tables, in every stage."""
    rng = random.Random(3)
    words = {"en": "the and that with this from have were which their", "de": "der und nicht mit sich auf ist eine werden"}
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=60)), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(None, rows[0][1], "en", None, 0), (50, None, "en", "s", None), (51, "", None, "s", 0), (3, rows[3][1], "de", "s", 0), (52, rows[5][1], "de", "s", 0), (53, "zz " + "long words here too " * 9000, "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, group_id string")
    for name, df in (("benchmark", spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string")), ("labels", spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1)], "doc_id long, quality int, toxic int"))):
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    out = pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"] for r in out} <= {i for i, *_ in rows} - {50, 51, 52} and len(out) > 10
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert pipeline.identify_language(spark, docs, "").columns == docs.columns
    stages = dict(pipeline.STAGES)
    assert stages["ngram_jaccard_join"](spark, docs, "").columns == docs.columns
    assert stages["mixing"](spark, docs, f"{tmp_path}/none").columns == docs.columns
    assert stages["decontamination"](spark, docs, f"{tmp_path}/none").count() == docs.count()
