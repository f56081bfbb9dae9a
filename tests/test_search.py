import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import graph, ivf, search, walk
from orrery.operators.filters import field, on_struct


@pytest.fixture(scope="module")
def circle(spark):
    rows = [(i, ("target" if 118 <= i <= 127 else "other",), [math.cos(math.radians(1.5 * i)), math.sin(math.radians(1.5 * i))]) for i in range(240)]
    return spark.createDataFrame(rows, "key int, content struct<Tag:string>, embedding array<float>").cache()


def groups():
    """Six planes of 30 unit vectors, three degrees apart."""
    out = []
    for g in range(6):
        for j in range(30):
            v = [0.0] * 32
            v[2 * g], v[2 * g + 1] = math.cos(math.radians(3 * j)), math.sin(math.radians(3 * j))
            out.append((g * 30 + j, v))
    return out


@pytest.fixture(scope="module")
def planes(spark):
    return spark.createDataFrame(groups(), "key int, embedding array<float>").cache()


def _query(g):
    q = [0.0] * 32
    q[2 * g], q[2 * g + 1] = math.cos(math.radians(31)), math.sin(math.radians(31))
    return q


def test_known_distances(planes):
    for g in (0, 3):
        hits = search.exact_topk(planes, _query(g), 10).collect()
        want = sorted(range(30), key=lambda j: abs(3 * j - 31))[:10]
        assert [h["key"] - 30 * g for h in hits] == want
        assert all(abs(h["score"] - math.cos(math.radians(3 * j - 31))) < 1e-4 for h, j in zip(hits, want))


def test_ivf_finds_known_neighbours_and_full_probe_is_exact(planes):
    index = ivf.build(planes, 6)
    exact = [h["key"] for h in search.exact_topk(planes, _query(2), 10).collect()]
    found = [h["key"] for h in ivf.probe(index, _query(2), 10, 2).collect()]
    assert len(set(found) & set(exact)) >= 9 and found[0] == exact[0]
    assert [h["key"] for h in ivf.probe(index, _query(2), 10, len(index.centers)).collect()] == exact


def test_rare_filter_still_fills_the_result(circle):
    where = on_struct(field("content.Tag") == "target", circle.schema)
    for hits in (search.exact_topk(circle, [1.0, 0.0], 10, where=where), ivf.probe(ivf.build(circle, 24), [1.0, 0.0], 10, 1, where=where)):
        assert sorted(h["key"] for h in hits.collect()) == list(range(118, 128))


def test_odd_rows_are_never_hits(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 0.0]), (6, [float("nan"), 1.0])], "key int, embedding array<float>")
    assert [(h["key"], h["score"]) for h in search.exact_topk(rows, [2.0, 0.0], 10).collect()] == [(1, 1.0), (5, 1.0)]
    batch = search.batch_topk(rows, rows, 10, qid="key").where("query_id = 1").orderBy("rank").collect()
    assert [h["key"] for h in batch] == [1, 5]
    for top, q in ((0, [1.0, 0.0]), (-1, [1.0, 0.0]), (5, [])):
        assert search.exact_topk(rows, q, top).count() == 0
    assert search.exact_topk(rows.limit(0), [1.0, 0.0]).count() == 0


def test_many_queries_meet_entries_by_blocks(spark, planes, monkeypatch):
    rows = planes.union(spark.createDataFrame([(900, [1.0]), (901, None), (902, [2.0])], planes.schema))
    few = search.batch_topk(rows, rows, 5, qid="key").orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 64)
    many = search.batch_topk(rows, rows, 5, qid="key")
    assert "CartesianProduct" in many._jdf.queryExecution().executedPlan().toString()
    many = many.orderBy("query_id", "rank").collect()
    assert [r[:3] for r in few] == [r[:3] for r in many] and len(few) == 180 * 5 + 4


def test_product_of_blocks_gives_few_rows_a_query(spark, planes, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    seen = []
    ranked = search.ranked
    monkeypatch.setattr(search, "ranked", lambda found, top: seen.append(found.count()) or ranked(found, top))
    search.batch_topk(planes, planes, 5, qid="key").count()
    assert seen == [180 * 5]  # not 5 for each of some hundred pairs of blocks


def test_best_of_a_block_is_brute_force_with_ties(monkeypatch):
    monkeypatch.setattr(search, "QUERY_TILE", 16)
    monkeypatch.setattr(search, "ENTRY_TILE", 32)
    monkeypatch.setattr(search, "RESCORED", 50)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((150, 7))] * 4 + [np.zeros((1, 7))])
    keys = rng.permutation(len(x))
    q = np.concatenate([rng.standard_normal((30, 7)), x[:20], np.zeros((1, 7))])
    for top in (1, 10, 700):
        best = search.Best(q, top)
        for a in range(0, len(x), 100):
            best.add(x[a : a + 100], pa.array([f"{k:04d}" for k in keys[a : a + 100]]))
        got = [[] for _ in q]
        for i, k, score in best.found():
            for a, b, c in zip(i, k.to_pylist(), score):
                got[a].append((b, c))
        for a, v in enumerate(q[:-1]):
            cos = [(round(float(v @ y / np.linalg.norm(v) / np.linalg.norm(y)), 12), f"{k:04d}") for y, k in zip(x[:-1], keys)]
            want = [k for _, k in sorted(cos, key=lambda c: (-c[0], c[1]))[:top]]
            assert [k for k, _ in sorted(got[a], key=lambda c: (-c[1], c[0]))] == want
        assert got[-1] == []


def test_min_score_applies_after_the_ranking(circle):
    assert search.exact_topk(circle, [1.0, 0.0], 5, min_score=0.9999).count() == 1


def test_lazy_search_switches_once(planes):
    lazy = ivf.LazySearch(planes, threshold=180, n_lists=6)
    lazy.search(_query(0))
    assert lazy.index is not None
    small = ivf.LazySearch(planes, threshold=181)
    small.search(_query(0))
    assert small.index is None


def test_lazy_search_stays_exact_beyond_the_threshold(spark, planes):
    x = np.random.default_rng(0).standard_normal((1500, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, embedding array<float>").cache()
    lazy = ivf.LazySearch(rows, threshold=1500)
    for q in (0, 1, 2):
        exact = [h["key"] for h in search.exact_topk(rows, x[q].tolist()).collect()]
        assert [h["key"] for h in lazy.search(x[q].tolist()).collect()] == exact
    assert lazy.index is not None and len(lazy.index.centers) > ivf.N_PROBE
    where = F.col("key") % 100 == 7
    exact = [h["key"] for h in search.exact_topk(rows, x[0].tolist(), where=where).collect()]
    assert [h["key"] for h in lazy.search(x[0].tolist(), where=where).collect()] == exact
    near = ivf.LazySearch(planes, threshold=180, n_lists=24)
    assert [h["key"] for h in near.search(_query(3)).collect()] == [h["key"] for h in search.exact_topk(planes, _query(3)).collect()]


def test_names_are_trimmed_and_distinct_regardless_of_case():
    assert search.distinct_names(["A", " a ", "", "b", "  ", "B"]) == ["A", "b"]


def test_multi_collection_default_top(spark):
    rows = spark.createDataFrame([(c, i, [1.0, float(i)]) for c in ("x", "y") for i in range(30)], "collection string, key int, embedding array<float>")
    assert search.multi_collection_topk(rows, ["x", "y", "nope"], [1.0, 0.0], 0).count() == 20


def test_best_per_key(spark):
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (2, "c", 0.1)], "key int, content string, score double")
    assert sorted(map(tuple, search.best_per_key(hits).collect())) == [(1, "b", 0.9), (2, "c", 0.1)]


def test_vector_kernels(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<float>, z array<float>, s array<float>")
    a, z, s = F.col("a"), F.col("z"), F.col("s")
    got = row.select(V.cosine(a, a), V.cosine(a, z), V.cosine(a, s), V.l2_normalize(a), V.l2_normalize(z), V.sq8(V.l2_normalize(a)), V.sq8_dot(V.sq8(V.l2_normalize(a)), V.sq8(V.l2_normalize(a)))).first()
    assert got[0] == pytest.approx(1) and got[1] is None and got[2] is None
    assert got[3] == pytest.approx([0.6, 0.8]) and got[4] == [0, 0] and got[5] == [76, 102]
    assert got[6] == pytest.approx((76 * 76 + 102 * 102) / 127**2)
    with pytest.raises(Exception, match="vector lengths differ"):
        row.select(V.cosine_distance(a, s, strict=True)).collect()


def test_walks_over_a_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 12))
    rows = spark.createDataFrame([(i, i % 5, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, 0, None)], "key int, tag int, embedding array<float>").cache()
    queries = rows.where("key < 20")
    near = graph.knn_edges(rows, 24)
    found = walk.beam_search(near, rows, queries, qid="key", beam=64)
    exact = search.batch_topk(rows, queries, qid="key")
    assert search.recall_at_k(found, exact, 10).first()[0] >= 0.95
    some = walk.beam_search(near, rows, queries, 5, 0, where=F.col("tag") == 1, qid="key").collect()
    assert some and all(r["key"] % 5 == 1 for r in some) and max(r["rank"] for r in some) == 5
    assert walk.beam_search(near.limit(0), rows.limit(0), queries, qid="key").count() == 0 and walk.beam_search(near, rows, queries, 0, qid="key").count() == 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    spread = {}
    for r in walk.spread_neighbours(near, rows, 6, keep_pruned=False).collect():
        spread.setdefault(r["src"], []).append(r["dst"])
    for src in (0, 7, 100):
        order = sorted((i for i in range(400) if i != src), key=lambda i: -unit[src] @ unit[i])[:24]
        want = []
        for i in order:
            if len(want) < 6 and all(unit[i] @ unit[j] < unit[i] @ unit[src] for j in want):
                want.append(i)
        assert sorted(spread[src]) == sorted(want)
    full = walk.spread_neighbours(near, rows, 6).groupBy("src").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(full) == (6, 6)
    assert walk.nearest_neighbours(near, 3).count() == 1200
    drawn = {r["level"]: r["n"] for r in walk.level_histogram(rows, 4).collect()}
    assert sum(drawn.values()) == 401 and drawn[0] > drawn[1] > 0


def test_index_reopens_grows_and_reads_only_its_lists(spark, planes, tmp_path):
    index = ivf.build(planes.where("key < 150"), 8, path=f"file://{tmp_path}/ivf")
    again = ivf.IvfIndex.open(spark, f"file://{tmp_path}/ivf")
    again.insert(planes.where("key >= 150"))
    assert again.table.count() == 180 and sum(r["n"] for r in ivf.list_histogram(again).collect()) == 180
    for g in range(6):
        a = [(r["key"], round(r["score"], 9)) for r in ivf.nearest(again, _query(g)).collect()]
        assert a == [(r["key"], round(r["score"], 9)) for r in search.exact_topk(planes, _query(g)).collect()]
    plan = ivf.probe(index, _query(0), n_probe=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_graph_snapshot(planes):
    nodes, edges, truncated = graph.snapshot(planes, 100)
    nodes, edges = nodes.collect(), edges.collect()
    assert len(nodes) == 100 and truncated
    assert all(-1 - 1e-9 <= x <= 1 + 1e-9 for n in nodes for x in n["coords"])
    own = {n["key"] for n in nodes}
    assert edges and all(e["src"] in own and e["dst"] in own and e["src"] < e["dst"] for e in edges)
    nodes, _, truncated = graph.snapshot(planes, 1000)
    assert nodes.count() == 180 and not truncated


def test_spread_neighbours_of_groups_in_one_batch_of_arrow(spark):
    """Groups of unequal sizes, ties by dst, and no pandas group a source."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 6))
    x[31] = x[30]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, embedding array<double>")
    pairs = [(s, d, float(unit[s] @ unit[d]) if d != 31 else float(unit[s] @ unit[30])) for s in range(20) for d in range(20, 33 + s)]
    found = walk.spread_neighbours(spark.createDataFrame(pairs, "src int, dst int, score double"), rows, 5, keep_pruned=False)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    for s in range(20):
        want = []
        for _, d, c in sorted((p for p in pairs if p[0] == s), key=lambda p: (-p[2], p[1])):
            if len(want) < 5 and all(unit[d] @ unit[j] < c for j in want):
                want.append(d)
        assert got[s] == set(want)


def test_probe_of_many_queries_is_brute_force_on_its_lists(spark, planes, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 64)
    index = ivf.build(planes, 6)
    found = ivf.probe_batch(index, planes, 5, 2, qid="key")
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    x = np.array([v for _, v in groups()], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = {r["key"]: r["list"] for r in index.table.collect()}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    for k in range(180):
        lists = np.argsort(-(index.centers @ x[k]), kind="stable")[:2]
        want = sorted((x[k] @ x[j] for j in own if own[j] in lists), reverse=True)[:5]
        assert np.allclose(got[k], want)
