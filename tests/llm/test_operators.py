"""Edge cases of the ten operators, each against a brute-force version."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, chat_format, decontaminate, langid, line_dedup, mixing, ngram_join, token_files, toxicity, url_trust
from orrery.llm import _text as T

DOCS = "doc_id long, text string, size int, sid string, a string"  # the rest clash with internal names
VOCAB = [f"w{i}" for i in range(60)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(VOCAB, k=rng.randint(1, 50))) for _ in range(n // 3)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n // 3, n - 4):
        ws = rng.choice(base).split()
        for _ in range(rng.randint(0, 1 + len(ws) // 8)):
            ws[rng.randrange(len(ws))] = rng.choice(VOCAB)
        rows.append((i, " ".join(ws)))
    rows += [(n, None), (None, base[0]), (n + 1, ""), (n + 2, " ,.\n"), (n + 3, base[1]), (n + 3, base[1]), (n + 4, "Über ÉTÉ Σας İstanbul " * 5), (n + 5, "über été σας i̇stanbul " * 5), (n + 6, "z" * 3000)]
    return rows


# -- hashing


def test_word_blocks_equal_the_pattern(monkeypatch):
    texts = [t for _, t in corpus()] + ["_a__b c-d 1²3 ٣٤ 日本語 한국어́ x\u0000y 😀z", "\ud800 lone", "ẞ ſ K Å"]
    assert not any(chr(i).isalnum() for i in range(T._LAST_WORD_CHAR, 0x110000))
    for limit in (1 << 19, 40):
        monkeypatch.setattr(T, "BLOCK_CHARS", limit)
        for first, last, h, counts in T.word_blocks(texts):
            end = np.cumsum(counts)
            for k in range(first, last):
                own = h[end[k - first] - counts[k - first] : end[k - first]].tolist()
                ws = T.words(texts[k])
                assert len(own) == len(ws), texts[k]
                assert own == [int(T.word_hashes(w)[0]) for w in ws]


def test_grams_are_sets():
    (_, _, grams, sizes), *_ = T.gram_blocks(["a b a b a", "a", "", None, "b a"], 2)
    assert sizes.tolist() == [2, 1, 0, 0, 1]
    assert grams[3] in grams[:2]  # "b a"
    assert len(np.unique(T.set_ids(grams, sizes[sizes > 0]))) == 3


# -- 3: n-gram Jaccard join


def grams(text, n):
    ws = re.findall(r"\w+", (text or "").lower())
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def brute_pairs(rows, n, t):
    sets = {i: grams(x, n) for i, x in rows if i is not None and grams(x, n)}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(frozenset(sets[i]), i)
    out = {(rep[frozenset(s)], i): 1.0 for i, s in sets.items() if rep[frozenset(s)] != i}
    for a, b in itertools.combinations(sorted(rep.values()), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= t - 1e-9:
            out[a, b] = round(j, 6)
    return out


@pytest.mark.parametrize(("n", "t", "groups"), [(2, 0.6, None), (1, 0.5, 2)])
def test_join_equals_brute_force(spark, monkeypatch, n, t, groups):
    if groups:  # few classes, so that small sets reach the combinations of frequent tokens
        monkeypatch.setattr(ngram_join, "GROUPS", groups)
        monkeypatch.setattr(ngram_join, "PER_BUCKET", 200)
    rows = corpus()
    got = {(r[0], r[1]): r[2] for r in ngram_join.ngram_jaccard_join(docs_of(spark, rows), t, n).collect()}
    assert got == brute_pairs(rows, n, t)


@pytest.mark.parametrize(("frequent", "m"), [(256, 3), (8, 6), (1, 6)])
def test_similar_sets_share_signatures(frequent, m):
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 12, ngram_join._sketch.WIDTH).astype(np.uint8)
    for t in (0.5, 0.6, 0.8):
        for _ in range(150):
            size = int(rng.integers(1, 200))
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            y = x[rng.random(len(x)) > rng.random() * 0.5]
            y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(rng.integers(0, 40))).astype(np.uint64)]))
            if not len(y):
                continue
            both = len(np.intersect1d(x, y))
            if both / (len(x) + len(y) - both) < t:
                continue
            h, _, d = ngram_join.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), levels, frequent, t, m)
            need = 1 if min(len(x), len(y)) < ngram_join._small(t, m, frequent) else m
            assert len(np.intersect1d(h[d == 0], h[d == 1])) >= need


def test_join_of_nothing_and_bad_thresholds(spark):
    assert ngram_join.ngram_jaccard_join(docs_of(spark, [(1, "a b")]).limit(0)).count() == 0
    for t in (0, 1.1):
        with pytest.raises(ValueError):
            ngram_join.ngram_jaccard_join(docs_of(spark, [(1, "a")]), t)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(VOCAB[:20])
    rows = [(5, text), (3, text), (9, text + " w50"), (9, text + " w50"), (7, "other words here"), (None, text), (8, None)]
    kept = ngram_join.drop_near_duplicates(docs_of(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "8", "None"] and kept.columns == ["doc_id", "text", "size", "sid", "a"]
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 40)], "doc_id_a long, doc_id_b long, jaccard double")
    assert {tuple(r) for r in ngram_join.duplicate_groups(chain).collect()} == {(i, 1) for i in range(1, 41)}


# -- 8: line dedup


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices(VOCAB[:25], k=rng.randint(1, 12))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(base) if rng.random() < 0.6 else " ".join(rng.choice(base).split()[1:]) for _ in range(5))) for i in range(15)]
    rows += [(None, base[0]), (20, None), (21, ""), (22, "\n\n .\n"), (3, base[1] + "\n" + base[2])]
    lines = sorted({(i, k, frozenset(re.findall(r"\w+", x.lower()))) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n"))}, key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    want = set()
    for i, k, s in lines:
        for a, b, o in lines:
            if (a, b) >= (i, k):
                break
            if len(s & o) / len(s | o) >= 0.8 - 1e-9:
                want.add((i, k, a, b))
                break
    gone = line_dedup.repeated_lines(docs_of(spark, rows))
    assert {tuple(r)[:4] for r in gone.collect()} == want
    left = line_dedup.remove_lines(docs_of(spark, rows), gone)
    assert left.columns == ["doc_id", "text", "size", "sid", "a"] and left.count() == len(rows)
    assert line_dedup.repeated_lines(docs_of(spark, rows).limit(0)).count() == 0


# -- 6: decontamination


def edit_distance_within(item, text):
    """Least edits between item and any substring of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(3, 25)))) for i in range(6)] + [(6, None), (7, ""), (None, "w1"), (8, "w1 w2")]
    rows = []
    for i in range(40):
        text = list(rng.choice(items[:6])[1])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice("xw1 ")
        rows.append((i, "W3, " + "".join(text).upper() + " w9." if rng.random() < 0.8 else None))
    rows += [(None, items[0][1]), (50, ""), (3, items[2][1])]
    want = {}
    for d, t in rows:
        for i, x in items:
            x, t2 = decontaminate.normal(x), decontaminate.normal(t)
            if d is not None and i is not None and x and t2 and (e := edit_distance_within(x, t2)) <= int(0.06 * (len(x) - 2) + 1e-9):
                want[d, i] = min(e, want.get((d, i), 99))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, distance int")
    got = {(r[0], r[1]): r[2] for r in decontaminate.find_leaks(docs_of(spark, rows), bench).collect()}
    assert got == want and len(want) > 10
    clean = decontaminate.drop_leaks(docs_of(spark, rows), bench)
    dirty = {t for d, t in rows if t and any(edit_distance_within(decontaminate.normal(x), decontaminate.normal(t)) <= int(0.06 * (len(decontaminate.normal(x)) - 2) + 1e-9) for i, x in items if i is not None and x)}
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(t) for _, t in rows if t not in dirty)


def test_chunked_benchmarks_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} has its own words") for i in range(9)], "item_id long, text string")
    rows = docs_of(spark, [(i, f"so: Item number {i} has its own words!") for i in range(9)])
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", 100)
    assert {tuple(r) for r in decontaminate.find_leaks(rows, bench, 0.0).collect()} == {(i, i, 0) for i in range(9)}
    assert decontaminate.drop_leaks(rows, bench).count() == 0
    assert decontaminate.find_leaks(rows, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(rows, bench.limit(0)).count() == 9
    assert decontaminate.find_leaks(rows.limit(0), bench).count() == 0


# -- 4: language

WORDS = {"en": "the and that with this from have were which their", "de": "der und nicht mit sich auf für ist eine werden", "fr": "les des une est pas dans pour que avec sur", "es": "los una del por con para como más pero sus"}


def speak(lang, rng, n=40):
    return " ".join(rng.choices(WORDS[lang].split(), k=n))


def test_languages(spark):
    rng = random.Random(5)
    rows = [(i, speak(lang, rng), lang) for i, lang in enumerate(list(WORDS) * 30)] + [(900, None, "en"), (901, "", "de"), (902, "123 456", "fr"), (None, speak("en", rng), "en"), (0, speak("de", rng), None), (903, speak("es", rng, 20_000), "es")]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, lang string, predicted string, loss double")
    model = langid.fit(docs)
    out = langid.identify(docs, model).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (None, 0)}
    assert all(by[i]["predicted"] == lang and not by[i]["ambiguous"] for i, _, lang in rows[1:120])
    assert all(by[i]["predicted"] is None and by[i]["loss"] is None and by[i]["ambiguous"] for i in (900, 901, 902))
    assert by[903]["predicted"] == "es"
    held = [(speak(lang, rng, 25), lang) for lang in WORDS for _ in range(25)]
    got = langid.identify_texts(model, [t for t, _ in held], 0.15, 0.69)
    assert (got["predicted"] == [lang for _, lang in held]).mean() >= 0.98 and got["ambiguous"].mean() <= 0.05
    noise = langid.identify_texts(model, ["xqzk " * 20, "jjvw qxz " * 9], 0.15, 0.69)
    assert noise["gap"].max() < got["gap"].median()
    assert langid.drop_ambiguous(docs).columns == docs.columns
    one = docs.where("lang = 'en'")
    assert not any(r["ambiguous"] for r in langid.identify(one.where("text <> ''"), langid.fit(one)).collect())
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 20):
        c = langid.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= max(1, c.shape[1] // 4)


# -- 2: mixing


def test_rates_match_targets_and_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([2, 1, 1], 300)
    n = rng.integers(0, 400, 300)
    table = spark.createDataFrame([(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    found = mixing.fit_rates(table, {"clean": 0.6, "low": 0.25, "toxic": 0.15}, 30_000.0)
    r = np.array([x["rate"] for x in mixing.rated(table, found).orderBy("doc_id").collect()])
    assert (r >= 0).all()
    totals = (r * n) @ p
    assert np.abs(totals - np.array([18_000, 7_500, 4_500])).max() <= 1e-4 * 30_000 * 1.01
    assert np.allclose(totals, found.totals)


def test_rates_match_targets_of_a_rare_domain(spark):
    rng = np.random.default_rng(2)
    n, rare = 40_000, 4
    p = np.column_stack([rng.uniform(0.9, 1, n), np.zeros(n), 10 ** rng.uniform(-9, -6, n)])
    p[: n // 20, 0] = rng.uniform(0, 0.1, n // 20)
    p[-rare:] = [0.02, 0.01, 0.97]
    p[:, 1] = 1 - p[:, 0] - p[:, 2]
    tokens = rng.integers(50, 400, n)
    tokens[-rare:] = 10
    table = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "n_tokens": tokens, **{f"p_{d}": p[:, k] for k, d in enumerate(mixing.DOMAINS)}}))
    found = mixing.fit_rates(table)
    got = mixing.rated(table, found).toPandas()
    totals = (got["rate"] * got["n_tokens"]).to_numpy() @ got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.abs(totals - found.targets).max() <= 1.01e-4 * found.targets.sum() and np.allclose(totals, found.totals)
    assert totals[2] == pytest.approx(found.targets[2], rel=0.01)


def test_targets_out_of_reach_are_reported(spark):
    rows = [(i, 10, 0.8, 0.2, 0.0) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    with pytest.warns(UserWarning, match="out of reach"):
        found = mixing.fit_rates(table, {"clean": 0.6, "low": 0.3, "toxic": 0.1}, 500.0)
    # one rate for all: least sum of squares over targets
    rate = (300 / 300 * 0.8 + 150 / 150 * 0.2) / (0.8 * 0.8 / 300 + 0.2 * 0.2 / 150) / 500
    assert np.allclose(found.totals, np.array([0.8, 0.2, 0]) * 500 * rate, rtol=1e-4)


def test_mixing_of_odd_rows(spark):
    rows = [(i, ("good words here " if i % 3 else "bad junk junk ") * (1 + i % 5)) for i in range(60)] + [(100, None), (101, ""), (None, "good words"), (5, "good words")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0, 9) for i in range(60)] + [(None, 1, 0, 9), (7, None, None, 9)], "doc_id long, quality int, toxic int, n_tokens int")
    out = mixing.mix(docs, labels).collect()
    assert len(out) == len(rows) and all(r["rate"] >= 0 and abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in out)
    assert all(r["n_tokens"] == 0 for r in out if r["doc_id"] in (100, 101))
    expected = sum(r["copies"] for r in out)
    kept = mixing.resample(docs, labels)
    assert kept.columns == docs.columns and kept.count() == expected
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.mix(docs, labels.limit(0)).count() == len(rows)


# -- 10: token files

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_token_files_round_trip(spark, tmp_path):
    rows = corpus() + [(200, "a" * 20_000 + " " * 9000 + "1" * 5000), (201, "日本語 😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    docs = docs_of(spark, rows).repartition(3)
    index = token_files.write_tokens(docs, VOCABULARY, f"file://{tmp_path}/out").orderBy("doc_index").collect()
    tok, files = token_files.Tokenizer(token_files.load_ranks(VOCABULARY)), token_files.TokenFiles(f"{tmp_path}/out")
    assert len(files) == len(rows) == len(index) and [r["doc_index"] for r in index] == list(range(len(rows)))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    at = 0
    for r in index:
        assert r["token_offset"] == at and len(files[r["doc_index"]]) == r["n_tokens"]
        assert tok.decode(files[r["doc_index"]]) in texts[r["doc_id"]]
        at += r["n_tokens"]
    with pytest.raises(IndexError):
        files[len(files)]
    empty = token_files.write_tokens(docs.limit(0), VOCABULARY, f"file://{tmp_path}/none")
    assert empty.count() == 0 and len(token_files.TokenFiles(f"{tmp_path}/none")) == 0
    ended = token_files.write_tokens(docs.where("text IS NULL"), VOCABULARY, f"file://{tmp_path}/ended", end_id=70_000)
    assert ended.first()["n_tokens"] == 1 and token_files.TokenFiles(f"{tmp_path}/ended")[0].tolist() == [70_000]


# -- 7: nearest neighbours


def test_inner_product_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 33)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1.0), (1000, None, 1.0), (1001, [1.0], 1.0), (1002, [float("nan")] * 33, 1.0), (5, (x[5]).tolist(), 1.0), (1003, [], 1.0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.search(vectors, vectors, rerank=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -np.inf)
    hits = 0
    assert sorted(got) == list(range(900))
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 11))
        assert all(abs(v - s[q, i]) < 1e-3 for _, i, v in near)
        hits += len({i for _, i, _ in near} & set(np.argsort(-s[q])[:10].tolist()))
    assert hits / 9000 >= 0.9
    assert ann.search(vectors.limit(0), vectors).count() == 0 and ann.search(vectors, vectors.limit(0)).count() == 0
    three = vectors.where("vec_id = 3")
    assert ann.search(three, three).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0], 0.0) for i in range(5)], vectors.schema)
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(ties, ties, 2).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]


def test_copies_beyond_the_reranked_rows_are_found(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 400)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1000, 32))
    x[:500] = x[0] + 0.02 * rng.standard_normal((500, 32))  # near copies, more than ``rerank`` in a block
    x[500:700] = x[500]  # equal vectors
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = rng.permutation(1000)
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in ann.search(vectors, vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    s = np.einsum("qd,rd->qr", x.astype(np.float64), x.astype(np.float64))
    np.fill_diagonal(s, -np.inf)
    hits = [len(set(got[ids[q]]) & set(ids[np.lexsort((ids, -s[q]))[:10]])) / 10 for q in range(1000)]
    assert [np.mean(hits[a:b]) for a, b in ((0, 500), (500, 700), (700, 1000))] == [1, 1, 1]


def test_anisotropic_codes_keep_inner_products_better():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 16)).astype(np.float32)
    grid = np.array([-1.51, -0.453, 0.453, 1.51], np.float32)
    books = np.tile(np.stack(np.meshgrid(grid, grid, indexing="ij"), -1).reshape(1, 16, 2), (8, 1, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    along = []
    for eta in (1.0, 4.0):
        c = ann.encode(x, books, eta)
        r = x - np.concatenate([books[j][c[:, j]] for j in range(8)], 1)
        along.append(np.abs((r * unit).sum(1)).mean())
    assert along[1] < 0.6 * along[0]


# -- 9: chat formatting


def test_spans_and_rewrites(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "again"), (2, 0, "user", None), (2, None, None, "last"), (None, 0, "user", "x"), (3, 0, "user", "dup"), (3, 0, "user", "dup")]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    got = {(r["conv_id"], r["template"]): r for r in chat_format.format_chats(turns).collect()}
    assert len(got) == 9
    for conv in (1, 2, 3):
        r = got[conv, "chatml"]
        assert not r["rewrites"]
        assert "".join(r["text"][s["start"] : s["end"]] for s in r["spans"]) == r["text"]
    assert [s["role"] for s in got[1, "chatml"]["spans"]] == ["system", "user", "assistant", "user"]
    assert got[2, "chatml"]["spans"][1]["turn"] is None and got[2, "chatml"]["text"].endswith("last<|im_end|>\n")
    assert [s["rewrites"] for s in got[1, "system_last"]["spans"]] == [False, False, False, True]
    assert got[1, "system_last"]["spans"][1]["start"] is None
    broken = chat_format.format_chats(turns, {"b": lambda ms: 1 / 0}).collect()
    assert all(r["text"] is None and r["spans"] == [] for r in broken)
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# -- 1: URL trust


def test_trust_and_distrust(spark):
    def page(i, host, *to):
        return (i, f"https://{host}/p{i}", "".join(f'<a href="http://{h}/x">l</a>' for h in to), 1.0)

    rows = [page(1, "good.org", "nice.org"), page(2, "nice.org", "meh.org"), page(3, "meh.org"), page(4, "shady.org", "bad.org"), page(5, "bad.org", "good.org"), page(6, "mixed.org", "bad.org", *[f"h{i}.org" for i in range(40)]), (7, None, None, 1.0), (8, "no host", "<a href=>", 1.0), page(4, "shady.org", "bad.org")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score double")
    got = {r["page_id"]: r for r in url_trust.filter_urls(pages, ["good.org"], ["BAD.org."]).collect()}
    assert not got[5]["keep"] and not got[4]["keep"] and got[1]["keep"] and got[2]["keep"] and got[3]["keep"]
    assert got[1]["trust"] >= 1 and got[2]["trust"] == pytest.approx(0.85, abs=0.05) and got[2]["trust"] > got[3]["trust"] > 0
    assert got[7]["host"] is None and got[7]["keep"] and got[8]["keep"]
    assert url_trust.filter_urls(pages, ["good.org"], ["bad.org"]).count() == len(rows)
    assert url_trust.filter_urls(pages.limit(0), ["good.org"], []).count() == 0
    hosts = spark.createDataFrame([("HTTPS://u:p@A.Org.:80/x",), ("//b.org?q",), ("/rel",), (None,)], "u string").select(url_trust.host_of(F.col("u"))).collect()
    assert [r[0] for r in hosts] == ["a.org", "b.org", None, None]


def test_distrust_reaches_the_end_of_a_chain_and_of_a_cycle(spark):
    def page(i, host, to):
        return (i, f"https://{host}/p{i}", f'<a href="http://{to}/x">l</a>')

    rows = [page(i, f"h{i}.org", f"h{i + 1}.org" if i < 15 else "bad.org") for i in range(1, 16)] + [page(20, "a.org", "b.org"), page(21, "b.org", "a.org")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_trust.filter_urls(pages, ["a.org"], ["bad.org"]).collect()}
    for i in range(1, 16):
        assert got[i]["distrust"] == pytest.approx(0.85 ** (16 - i), abs=1e-6) and not got[i]["keep"]
    assert got[20]["trust"] == pytest.approx(1 / (1 - 0.85**2), abs=1e-5)


# -- 5: toxicity


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = toxicity.Net(1)
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    ws = [f"word{i}" for i in range(12)]
    inputs = toxicity.word_inputs(ws)
    at = rng.integers(0, 12, (toxicity.WINDOW, 3))
    mask = np.arange(toxicity.WINDOW)[:, None] < np.array([toxicity.WINDOW, 5, 20])
    y, keep = np.array([1.0, 0.0, 1.0]), np.ones(12)
    _, g = net.gradients(inputs, at, mask, y, keep)
    for name in ("uf", "ub", "wx", "wa", "va", "wo", "bo"):
        i = tuple(rng.integers(0, n) for n in net.p[name].shape)
        losses = []
        for e in (1e-3, -2e-3):
            net.p[name][i] += e
            losses.append(net.gradients(inputs, at, mask, y, keep)[0])
        net.p[name][i] += 1e-3
        assert g[name][i] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.05, abs=2e-5), name


def test_windows_cover_the_text():
    for n in (1, 31, 32, 33, 56, 57, 500):
        s = toxicity.window_starts(n)
        covered = np.zeros(n, bool)
        for a in s:
            covered[a : a + toxicity.WINDOW] = True
        assert covered.all() and (np.diff(s) > 0).all()


def test_passages_of_half_a_window_lie_whole_in_one():
    for n in (40, 57, 200, 333):
        s = toxicity.window_starts(n)
        for size in range(1, toxicity.WINDOW // 2 + 1):
            for a in range(n - size + 1):
                assert ((s <= a) & (a + size <= s + toxicity.WINDOW)).any()


def test_toxicity_on_odd_rows_and_held_out(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        ws = rng.choices(VOCAB, k=rng.randint(5, 120))
        if i % 3 == 0:
            at = rng.randrange(len(ws))
            ws[at:at] = rng.choices(["vilefoo", "scumbar", "hatebaz"], k=3)
        rows.append((i, " ".join(ws)))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), 0.5) for i in range(200)] + [(None, 1, 1, 0.5), (5, None, None, 0.5)], "doc_id long, quality int, toxic int, score double")
    odd = [(900, None), (901, ""), (902, ", ."), (None, rows[0][1]), (7, "vilefoo"), (903, " ".join(rng.choices(VOCAB, k=5000)) + " vilefoo scumbar hatebaz " + " ".join(rng.choices(VOCAB, k=5000)))]
    docs = docs_of(spark, rows + odd)
    out = toxicity.detect(docs, labels).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (None, 7)}
    assert all(by[i]["n_windows"] == 0 and by[i]["score"] == 0 and not by[i]["toxic"] and by[i]["worst_window"] is None for i in (900, 901, 902))
    held = range(200, 300)
    assert np.mean([by[i]["toxic"] == (i % 3 == 0) for i in held]) >= 0.95
    assert by[903]["toxic"] and abs(by[903]["worst_window"] * toxicity.STRIDE - 5000) < 2 * toxicity.WINDOW
    assert not any(r["toxic"] for r in toxicity.detect(docs, labels.limit(0)).collect())
    assert toxicity.detect(docs.limit(0), labels).count() == 0
