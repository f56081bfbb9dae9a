"""Operators against plain versions of their definitions, and the bounds of their samples."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
import tiktoken

from orrery.llm import _codec, chat_format, decontaminate, langid, line_dedup, mixing, ngram_join, token_files, toxicity, url_trust
from tests.llm.test_operators import VOCAB, VOCABULARY, brute_pairs, corpus, docs_of, grams, speak


# -- 3: n-gram Jaccard join


def classes_of(rows, n, t):
    """(class_id, copy_of, copies, links) of each id, from all pairs."""
    sets = {}
    for i, x in rows:
        if i is not None:
            sets.setdefault(i, set())
            if x is not None and grams(x, n):
                sets[i].add(frozenset(grams(x, n)))
    owners = {}
    for i, own in sets.items():
        for s in own:
            owners.setdefault(s, set()).add(i)
    links = {s: set() for s in owners}
    for a, b in itertools.combinations(owners, 2):
        if len(a & b) / len(a | b) >= t - 1e-9:
            links[a].add(b)
            links[b].add(a)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for s, ids in owners.items():
        for o in (s, *links[s]):
            a, b = sorted((find(min(ids)), find(min(owners[o]))))
            root[b] = a
        for i in ids:
            a, b = sorted((find(i), find(min(ids))))
            root[b] = a
    return {i: (find(i), min([min(owners[s]) for s in own], default=i), sum(len(owners[s]) for s in own), sum(len(links[s]) for s in own)) for i, own in sets.items()}


@pytest.mark.parametrize(("n", "t"), [(2, 0.6), (1, 0.5)])
def test_classes_equal_brute_force(spark, monkeypatch, n, t):
    monkeypatch.setattr(ngram_join, "PER_BUCKET", 300)
    rows = [*corpus(), (3, "an id that is there with another text"), (70, None), (70, corpus()[5][1])]
    got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["copies"], r["links"]) for r in ngram_join.jaccard_classes(docs_of(spark, rows), t, n).collect()}
    assert got == classes_of(rows, n, t)
    assert sum(x[3] > 0 for x in got.values()) > 10
    assert ngram_join.jaccard_classes(docs_of(spark, rows).limit(0), t, n).count() == 0


def test_no_link_of_a_large_group_is_lost(spark):
    rng = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(300):
        ws = list(base)
        for k in rng.sample(range(120), rng.randint(0, 6)):
            ws[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = {r["doc_id"]: r["links"] for r in ngram_join.jaccard_classes(docs_of(spark, rows)).collect()}
    want = {i: x[3] for i, x in classes_of(rows, 2, 0.6).items()}
    assert got == want and sum(want.values()) > 10_000
    pairs = {(r[0], r[1]) for r in ngram_join.ngram_jaccard_join(docs_of(spark, rows)).collect()}
    assert pairs == set(brute_pairs(rows, 2, 0.6))


@pytest.mark.parametrize("t", [0.4, 0.6, 0.8])
def test_crowds_of_near_copies_are_compared_without_an_index(spark, monkeypatch, t):
    for name, value in (("CROWD", 12), ("BLOCK_SETS", 25), ("BLOCK_TOKENS", 2000)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    sizes, placed = [], ngram_join.placed_pairs
    monkeypatch.setattr(ngram_join, "placed_pairs", lambda pairs: sizes.append(pairs.count()) or placed(pairs))
    rng = random.Random(9)
    rows = list(corpus())
    for k, edits in enumerate((8, 30, 45)):  # the last of them are near some of the others only
        base = [f"c{k}w{i}" for i in range(100)]
        for _ in range(90):
            ws = list(base)
            for j in rng.sample(range(100), rng.randint(0, edits)):
                ws[j] = f"x{rng.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(ws)))
    rows += [(5000 + i, x) for i, (_, x) in enumerate(rows[-60:-50])]
    got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["copies"], r["links"]) for r in ngram_join.jaccard_classes(docs_of(spark, rows), t).collect()}
    want = classes_of(rows, 2, t)
    assert got == want
    if t >= 0.6:  # else balls are smaller than what is similar
        assert sizes[0] < sum(x[3] for x in want.values()) / 4  # half the links at least, were all pairs met in the index
    pairs = {(r[0], r[1]) for r in ngram_join.ngram_jaccard_join(docs_of(spark, rows), t).collect()}
    assert pairs == set(brute_pairs(rows, 2, t))


def test_pairs_of_a_bucket_come_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 40, False)) for _ in range(80)]
    tokens, sizes = np.concatenate(sets), np.array([40] * 80)
    levels = np.zeros(ngram_join._sketch.WIDTH, np.uint8)
    index = pd.concat(ngram_join._index(lambda texts: [(tokens, sizes)], 0.5, type("Shared", (), {"value": levels}), 256, 1, 1, False)([pd.DataFrame({"text": [""]})]))
    seen = []
    for most in (10**9, 100):
        monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", most, raising=False)
        met = list(ngram_join._candidates(0.5, 1, 256, 3, False)(iter([index])))
        assert most > 100 or len(met) > 20
        blobs = pd.concat(met)
        assert blobs["pairs"].tolist() == [len(ngram_join.blob_pairs(x)[0]) for x in blobs["blob"]]
        out = [pd.concat(ngram_join._merged(1)(iter([own]))) for _, own in blobs.groupby("reducer")]
        pairs = [tuple(x) for x in pd.concat(out).to_numpy().tolist()]
        assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
        seen.append(set(pairs))
    assert seen[0] == seen[1] and len(seen[0]) > 1000


def test_no_pairs_have_no_links():
    assert ngram_join.linked(pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "jaccard": []})).empty


def test_pair_blobs_and_planes_come_back():
    rng = np.random.default_rng(0)
    for most in (1, 255, 256, 1 << 40):
        v = rng.integers(0, most, 50)
        assert _codec.unplaned(_codec.planes(v)).tolist() == v.tolist()
    assert len(_codec.unplaned(_codec.planes(np.zeros(0, np.int64)))) == 0
    names = np.sort(rng.integers(-(2**63), 2**63 - 1, 40))
    pairs = sorted({tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(200)})
    a, b = np.array(pairs).T
    n = rng.integers(1, 7, len(pairs))
    x, y, k = ngram_join.blob_pairs(ngram_join.pair_blob(names, a, b, n))
    assert x.tolist() == names[a].tolist() and y.tolist() == names[b].tolist() and k.tolist() == n.tolist()


# -- 8: line dedup


def test_parities_never_hide_a_similar_set():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, 20)).astype(np.uint64)]))
        if len(y):
            low, high = ngram_join.parities(np.concatenate([x, y]), np.array([len(x), len(y)]))
            apart = len(np.setxor1d(x, y))
            fold = low ^ high
            assert int(fold[0] ^ fold[1]).bit_count() <= apart
            if min(len(x), len(y)) > ngram_join.FOLDED:
                assert int(low[0] ^ low[1]).bit_count() + int(high[0] ^ high[1]).bit_count() <= apart


def test_long_and_repeated_lines(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, "x\n" + long), (4, "x\nx\nx")]
    got = sorted(tuple(r)[:4] for r in line_dedup.repeated_lines(docs_of(spark, rows)).collect())
    assert got == [(2, 0, 1, 0), (3, 1, 1, 0), (4, 0, 3, 0), (4, 1, 3, 0), (4, 2, 3, 0)]


# -- 6: decontamination


def test_items_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "the cat"), (2, "art")], "item_id long, text string")
    rows = docs_of(spark, [(1, "bathe cathedral"), (2, "a party"), (3, "so The cat, sat"), (4, "art"), (5, "cat the art " * 20_000)])
    assert {tuple(r) for r in decontaminate.find_leaks(rows, bench).collect()} == {(3, 1, 0), (4, 2, 0), (5, 2, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(rows, bench).collect()) == [1, 2]


# -- 4: language


def test_decoding_equals_its_definition():
    rng = np.random.default_rng(3)
    code = langid.codewords(7)
    model = langid.LanguageModel(list("abcdefg"), code, rng.standard_normal((langid.WIDTH, code.shape[1])).astype(np.float32), rng.standard_normal(code.shape[1]).astype(np.float32), rng.uniform(0.5, 1.5, code.shape[1]))
    texts = ["one two three", "drei vier", "", None, "cinq six sept huit"]
    got = langid.identify_texts(model, texts, 0.15, 0.69)
    for k, text in enumerate(texts):
        x = np.zeros(langid.WIDTH, np.float32)
        if not langid.features(text, x):
            assert got["predicted"][k] is None and got["ambiguous"][k]
            continue
        loss = []
        for word in code:
            total = 0.0
            for b, bit in enumerate(word):
                f = float(sum(float(x[i]) * float(model.weights[i, b]) for i in np.flatnonzero(x))) + float(model.bias[b])
                total += model.trust[b] * math.log1p(math.exp(-float(bit) * f))
            loss.append(total / code.shape[1])
        order = sorted(range(7), key=lambda i: (loss[i], i))
        assert got["predicted"][k] == model.languages[order[0]] and got["loss"][k] == pytest.approx(loss[order[0]], rel=1e-4)
        assert got["gap"][k] == pytest.approx(loss[order[1]] - loss[order[0]], abs=1e-4)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    rng = random.Random(1)
    seen = []
    monkeypatch.setattr(langid, "fit_arrays", lambda x, y, languages: seen.append(np.bincount(y).tolist()))
    rows = [(1, speak("en", rng), "en") for _ in range(3000)] + [(i, speak("en", rng), "en") for i in range(2, 60)] + [(i, speak("de", rng), "de") for i in range(60, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs, per_language=30)
    assert seen == [[20, 30]]
    labels = spark.createDataFrame([(1, 1, 0)] * 2000 + [(i, 0, 0) for i in range(2, 60)] + [(i, 1, 1) for i in range(60, 80)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(mixing, "fit_arrays", lambda idx, shapes, y: seen.append(np.bincount(y, minlength=3).tolist()) or mixing.DomainModel(*[np.zeros(3)] * 6))
    mixing.fit(docs, labels, per_domain=25)
    assert seen[1] == [1, 25, 20]


def test_network_learns_from_one_text_of_an_id(spark):
    rows = [(1, "vile words here") for _ in range(500)] + [(1, "another text")] + [(i, "fine words there") for i in range(2, 30)]
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 30)], "doc_id long, toxic int")
    net = toxicity.fit(docs_of(spark, rows), labels, per_class=10)
    assert isinstance(net, toxicity.Net)
    assert toxicity.fit(docs_of(spark, rows), labels.limit(0)) is None


# -- 2: mixing


def test_rates_are_the_nearest_to_one_that_meet_the_targets(spark):
    """Dykstra's alternating projections in the metric of the token counts."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet([2, 1, 0.5], 80)
    n = rng.integers(1, 60, 80).astype(float)
    a = (p * n[:, None]).T
    targets = np.array([0.15, 0.25, 0.60]) * 0.5 * n.sum()
    r, back = np.ones(80), np.zeros(80)
    gram = np.linalg.inv(a @ (a / n).T)
    for _ in range(20_000):
        y = r - (a / n).T @ (gram @ (a @ r - targets))
        r, back = np.maximum(0, y + back), np.minimum(0, y + back)
    table = spark.createDataFrame([(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    found = mixing.fit_rates(table, dict(zip(mixing.DOMAINS, [0.15, 0.25, 0.60])), float(targets.sum()), tolerance=1e-9)
    got = np.array([x["rate"] for x in mixing.rated(table, found).orderBy("doc_id").collect()])
    assert np.allclose(got, r, atol=1e-4) and (got == 0).any()


def test_posteriors_and_copies_equal_their_definitions(spark):
    rng = np.random.default_rng(2)
    model = mixing.DomainModel(rng.standard_normal((1 << mixing.BITS, 3)), rng.standard_normal((mixing.SHAPES, 3)), rng.standard_normal(3), rng.standard_normal(mixing.SHAPES), rng.uniform(1, 2, mixing.SHAPES), np.array([True, True, False]))
    rows = [(1, "Some words, some twice: some 12"), (2, ""), (3, None), (4, "w " * 50_000)]
    got = {r["doc_id"]: r for r in mixing.posteriors(docs_of(spark, rows), model).collect()}
    for i, text in rows:
        (idx, shape, n), = mixing.features([text])
        z = [sum((shape[j] - model.mean[j]) / model.scale[j] * model.shapes[j, k] for j in range(mixing.SHAPES)) + model.bias[k] + sum(model.words[w, k] for w in idx) / math.sqrt(max(1, len(idx))) for k in range(2)]
        e = [math.exp(x - max(z)) for x in z]
        assert got[i]["n_tokens"] == n and got[i]["p_toxic"] == 0
        assert [got[i]["p_clean"], got[i]["p_low"]] == pytest.approx([x / sum(e) for x in e], abs=1e-6)


def test_resampling_repeats_rows_by_their_copies(spark):
    rows = [(i, ("good words here " if i % 3 else "bad junk junk ") * (1 + i % 5)) for i in range(80)] + [(100, None), (None, "good words"), (5, "good words")]
    docs = docs_of(spark, rows).withColumnsRenamed({"size": "posterior", "sid": "copy", "a": "__rate"})
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    copies = {}
    for r in mixing.mix(docs, labels).collect():
        copies.setdefault((r["doc_id"], r["n_tokens"]), []).append(r["copies"])
    kept = mixing.resample(docs, labels)
    assert kept.columns == docs.columns
    counted = {}
    for r in kept.collect():
        counted[r["doc_id"], r["text"]] = counted.get((r["doc_id"], r["text"]), 0) + 1
    for i, text in rows:
        assert counted.get((i, text), 0) == copies[i, len((text or "").split())][0]


# -- 5: toxicity


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(9)
    net = toxicity.Net(3)
    for k in net.p:
        net.p[k] = (net.p[k] + 0.3 * rng.standard_normal(net.p[k].shape)).astype(np.float32)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    size = toxicity.H

    def plain(ws):
        states = np.zeros((len(ws), 2 * size))
        rows, flat, starts = toxicity.word_inputs(ws)
        ends = np.append(starts[1:], len(flat))
        x = [np.concatenate([p["ew"][r], np.mean([p["ec"][c] for c in flat[a:b]], axis=0)]) @ p["wx"] + p["bx"] for r, a, b in zip(rows, starts, ends)]
        for base, u, order in ((0, p["uf"], range(len(ws))), (3 * size, p["ub"], range(len(ws) - 1, -1, -1))):
            h = np.zeros(size)
            for t in order:
                v, r = x[t][base : base + 3 * size], h @ u
                z, q = sigmoid(v[:size] + r[:size]), sigmoid(v[size : 2 * size] + r[size : 2 * size])
                h = z * h + (1 - z) * np.tanh(v[2 * size :] + q * r[2 * size :])
                states[t, base // 3 : base // 3 + size] = h
        e = np.array([np.tanh(s @ p["wa"] + p["ba"]) @ p["va"] for s in states])
        e = np.exp(e - e.max())
        return sigmoid((e / e.sum()) @ (states @ p["wo"]) + p["bo"][0])

    texts = [" ".join(rng.choice(VOCAB, k)) for k in (1, 5, 31, 32, 33, 70)] + [None, ""]
    got = toxicity.Scorer(net).scores(texts)
    for text, scores in zip(texts, got):
        ws = (text or "").split()
        want = [plain(ws[a : a + toxicity.WINDOW]) for a in toxicity.window_starts(len(ws))] if ws else []
        assert scores == pytest.approx(want, abs=1e-4)


# -- 9: chat formatting


def plain_spans(render, messages):
    """Spans by comparing characters one by one, for templates that render every prefix."""
    before, spans, rewrote = render([]), [], []
    for i in range(len(messages)):
        after = render(messages[: i + 1])
        head = 0
        while head < min(len(before), len(after)) and before[head] == after[head]:
            head += 1
        tail = 0
        while head < len(before) and tail < min(len(before), len(after)) - head and before[-1 - tail] == after[-1 - tail]:
            tail += 1
        again = head + tail < len(before)
        spans = [s if s and s[1] <= head else None for s in spans] + [None if again else (head, len(after) - tail)]
        rewrote.append(again)
        before = after
    return before, spans, rewrote


def test_spans_equal_a_plain_comparison():
    rng = random.Random(6)
    closed = lambda ms: "<s>" + "".join(f"[{m['role']}]{m['content']}" for m in ms) + "</s>"
    for _ in range(200):
        ms = [{"role": rng.choice(["system", "user", "assistant"]), "content": "".join(rng.choices("ab ", k=rng.randint(0, 6)))} for _ in range(rng.randint(0, 6))]
        for render in (*chat_format.TEMPLATES.values(), closed):
            assert chat_format.locate(render, ms) == plain_spans(render, ms)


def test_a_template_may_refuse_prefixes(spark):
    def strict(ms):
        if not ms:
            raise ValueError("no messages")
        return chat_format.chatml(ms)

    def answered(ms):
        if ms and ms[-1]["role"] == "user":
            raise ValueError("no answer")
        return chat_format.chatml(ms)

    ms = [{"role": r, "content": c * 40_000} for r, c in (("system", "S"), ("user", "q"), ("assistant", "a"))]
    assert chat_format.locate(strict, ms) == chat_format.locate(chat_format.chatml, ms)
    text, spans, _ = chat_format.locate(answered, ms)
    assert text == chat_format.chatml(ms) and spans[0] == (0, len(chat_format.chatml(ms[:1]))) and spans[1:] == [None, None]
    turns = spark.createDataFrame([(1, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["text"] for r in chat_format.format_chats(turns, {"t": answered}).collect()}
    assert got[1] is None and got[2] is not None


# -- 10: token files


def test_ids_are_those_of_the_uncut_tokenizer(spark, tmp_path, monkeypatch):
    ranks = token_files.load_ranks(VOCABULARY)
    plain = tiktoken.Encoding("plain", pat_str=token_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = [(i, t) for i, t in corpus() if i is not None and t] + [(200, "x" + " " * 9001 + "y" + "7" * 6300), (201, "!" * 5000 + "\n" * 9000), (202, "".join(rng.choices(["a", " ", "  ", "\n", "\t\t\t", "　", "9", "'s"], k=3000)))]
    monkeypatch.setattr(token_files, "RUN", 100)
    tok = token_files.Tokenizer(ranks)
    assert all(tok.encode(t) == plain.encode_ordinary(t) for _, t in rows)
    monkeypatch.undo()
    spaces = " " * 2_000_000 + "end"  # more than the splitter's stack holds
    assert token_files.Tokenizer(ranks).encode(spaces)[-1:] == plain.encode_ordinary(" end") and plain.decode(token_files.Tokenizer(ranks).encode(spaces)) == spaces
    out = tmp_path / "out"
    out.mkdir()
    (out / "other.bin").write_bytes(b"kept")
    index = token_files.write_tokens(docs_of(spark, rows), VOCABULARY, f"file://{out}").collect()
    files, texts = token_files.TokenFiles(str(out)), {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in index:
        assert files[r["doc_index"]].tolist() == plain.encode_ordinary(texts[r["doc_id"]])
    assert (out / "other.bin").read_bytes() == b"kept"


# -- ties and very long texts


def test_ties_go_to_the_first(spark):
    model = langid.LanguageModel(["a", "b"], langid.codewords(2), np.zeros((langid.WIDTH, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    got = langid.identify_texts(model, ["some words"], 0.15, 0.69)
    assert got["predicted"][0] == "a" and got["gap"][0] == 0 and got["ambiguous"][0]
    row = toxicity.score(docs_of(spark, [(1, "same " * 200), (1, "same " * 200)]), toxicity.Net(2)).collect()
    assert [r["worst_window"] for r in row] == [0, 0] and row[0]["score"] == row[1]["score"]


def test_a_page_of_many_links(spark):
    html = "".join(f'<p>text</p><a class="x" href="https://h{i % 5000}.org/{i}">l</a>' for i in range(20_000)) + "x" * 1_000_000 + '<a href="//bad.org">b</a>'
    pages = spark.createDataFrame([(1, "https://many.org", html), (1, "https://many.org", html), (2, "https://bad.org", "")], "page_id long, url string, html string")
    got = url_trust.filter_urls(pages, ["many.org"], ["bad.org"]).collect()
    assert [r["keep"] for r in sorted(got, key=lambda r: r["page_id"])] == [True, True, False]
    edges = url_trust.host_edges(pages, spark.createDataFrame([("trust", "many.org")], "kind string, host string")).collect()
    assert len(edges) == 5001 and all(r["n"] == 2 for r in edges)


def test_edges_of_a_hub_in_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://h{i % 40}.org", f'<a href="https://hub.org">a</a><a href="https://h{(i * 7 + 1) % 40}.org">b</a>') for i in range(120)] + [(500, "https://hub.org", '<a href="https://bad.org">c</a>')], "page_id long, url string, html string")

    def scores():
        return sorted(tuple(r) for r in url_trust.filter_urls(pages, ["h3.org"], ["bad.org"]).collect())

    whole = scores()
    monkeypatch.setattr(url_trust, "EDGES_PER_PART", 7)
    assert scores() == whole and any(r[4] > 0.5 for r in whole)
