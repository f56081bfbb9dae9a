import json

import pytest
from pyspark.sql import functions as F

from orrery.operators.filters import field, on_variant
from orrery.operators.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def one_hot(i, n=8):
    return [1.0 if k == i else 0.0 for k in range(n)]


def test_documents(store):
    docs = store.documents("docs")
    docs["a"] = {"Title": "x", "Tags": ["science"], "Metadata": {"Country": "IT"}}
    docs["b"] = {"Title": "y", "Tags": ["sport"], "Metadata": {"Country": "IT"}}
    assert len(docs) == 2 and "a" in docs and "c" not in docs and docs["b"]["Title"] == "y" and docs.get("c") is None
    found = docs.search(on_variant(field("Tags").any("science") & (field("Metadata.Country") == "IT"), "document"))
    assert [bytes(r["key"]) for r in found.collect()] == [b"a"]
    docs["a"] = {"Title": "z"}
    assert docs["a"] == {"Title": "z"} and len(docs) == 2


def test_delete_survives_reopening_and_adding_again(spark, store):
    docs = store.documents("docs")
    docs["a"] = 1
    del docs["a"]
    assert "a" not in Store(spark, store.path).documents("docs")
    with pytest.raises(KeyError):
        del docs["a"]
    docs["a"] = 2
    assert Store(spark, store.path).documents("docs")["a"] == 2


def test_clear(store):
    docs = store.documents("docs")
    docs["a"], docs["b"] = 1, 2
    store.documents("other")["a"] = 3
    assert docs.clear() == 2 and len(docs) == 0 and docs.clear() == 0 and len(store.documents("other")) == 1
    docs["c"] = 4
    assert len(docs) == 1


def test_upsert_replaces_the_whole_entry(store):
    v = store.vectors("v")
    v.add("a", {"n": 1}, one_hot(1))
    v.add("a", {"n": 2})
    assert v["a"] == {"n": 2} and v.embedding("a") is None and v.nearest(one_hot(1)).count() == 0


def test_vector_search_with_filter_and_sentences(store):
    v = store.vectors("v", lambda s: one_hot(len(s) % 8))
    for i in range(8):
        v.add(i, {"Category": "news" if i % 2 == 0 else "blog"}, one_hot(i))
    top = v.nearest(one_hot(3), 8).first()
    assert top["key"] == (3).to_bytes(8, "little") and top["score"] > 0.99
    found = v.nearest(one_hot(3), 8, where=on_variant(field("Category") == "news", "document"))
    assert sorted(json.loads(r["content"])["Category"] for r in found.collect()) == ["news"] * 4
    v.add_sentence("s", {}, "aa")
    v.add_sentence("blank", {}, "  ")
    assert v.embedding("blank") is None and v.nearest("cc", 1).first()["score"] == pytest.approx(1) and v.nearest(" ").count() == 0
    assert v.more_like("s", 1).first()["score"] == pytest.approx(1)
    with pytest.raises(ValueError):
        store.vectors("v").nearest("cc")


def test_mixed_dimensions_are_rejected_before_writing(spark, store):
    v = store.vectors("v")
    v.add("a", 1, [1.0, 2.0])
    rows = spark.createDataFrame([("v", bytearray(b"b"), "1", [1.0, 2.0]), ("v", bytearray(b"c"), "1", [1.0])], "collection string, key binary, content string, embedding array<float>")
    for bad in (rows, rows.where("size(embedding) = 1")):
        with pytest.raises(ValueError):
            store.append(bad)
    assert len(v) == 1


def test_append_only_insert(spark, store):
    store.documents("d")["a"] = 1
    rows = spark.createDataFrame([("d", bytearray(b"a"), "9"), ("d", bytearray(b"b"), "2")], "collection string, key binary, content string").withColumn("embedding", F.lit(None).cast("array<float>"))
    assert [bytes(r["key"]) for r in store.insert_new(rows).collect()] == [b"a"]
    assert store.documents("d")["a"] == 1 and store.documents("d")["b"] == 2


def test_transactions(store):
    docs = store.documents("d")
    docs["old"] = 0
    with store.transaction() as tx:
        tx.set("d", "a", "1")
        tx.set("d", "a", "2")
        tx.delete("d", "old")
        assert len(docs) == 1
    assert docs["a"] == 2 and "old" not in docs
    with pytest.raises(RuntimeError):
        tx.commit()
    rolled = store.transaction()
    rolled.set("d", "b", "1")
    rolled.rollback()
    with pytest.raises(RuntimeError):
        rolled.set("d", "b", "1")
    store.transaction().commit()
    assert len(docs) == 1


def test_incomplete_transaction_is_ignored(spark, store):
    docs = store.documents("d")
    docs["a"] = 1
    rows = spark.createDataFrame([("d", bytearray(b"a"), "delete", "t1"), ("d", bytearray(b"b"), "set", "t1")], "collection string, key binary, op string, tx string")
    store._append(rows)
    assert docs["a"] == 1 and "b" not in docs


def test_compaction_and_dead_space(store):
    docs = store.documents("d")
    for i in range(3):
        docs["a"] = i
    before = store.dead_space().first()
    assert (before["total_bytes"], before["dead_bytes"]) == (3, 2)
    store.compact()
    assert docs["a"] == 2 and store.dead_space().first()["dead_bytes"] == 0
    docs["b"] = 5
    assert len(docs) == 2


def test_a_writer_that_dies_leaves_the_state_before_it(spark, store):
    docs = store.documents("d")
    docs["a"] = 1
    rows = spark.createDataFrame([("d", bytearray(b"b"), "9")], "collection string, key binary, content string")
    point, store._point = store._point, lambda state: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.append(rows.withColumn("embedding", F.lit(None).cast("array<float>")))
    store._point = point
    again = Store(spark, store.path).documents("d")
    assert len(again) == 1 and "b" not in again
    again["c"] = 2
    assert sorted(bytes(r[0]) for r in again.keys().collect()) == [b"a", b"c"]
    names = store._pointers()
    with open(f"{store.path.removeprefix('file://')}/pointers/p{int(names[0][1:]) + 1:012d}", "w") as f:
        f.write('{"generation": "g0", "ba')  # torn
    assert Store(spark, store.path).documents("d")["c"] == 2
    store.compact()
    assert len(Store(spark, store.path).documents("d")) == 2


def test_entries_without_a_pointer_are_not_forgotten(spark, store):
    store.documents("d")["a"] = 1
    for name in store._pointers():
        store._fs.delete(store._jpath(f"{store.path}/pointers/{name}"), False)
    with pytest.raises(ValueError):
        Store(spark, store.path)


def test_vector_length_is_free_again_after_clear_and_delete(store):
    v = store.vectors("v")
    v.add("a", 1, [1.0, 2.0])
    v.clear()
    v.add("a", 1, [1.0, 2.0, 3.0])
    del v["a"]
    v.add("b", 1, [1.0])
    with pytest.raises(ValueError):
        v.add("c", 1, [1.0, 2.0])


def test_indexed_collection_equals_exact_search(spark, store):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 6))
    rows = spark.createDataFrame([("v", bytearray(f"{i:03d}".encode()), json.dumps({"even": i % 2 == 0}), [float(a) for a in r]) for i, r in enumerate(x)], "collection string, key binary, content string, embedding array<float>")
    store.append(rows)
    v, exact = store.vectors("v", threshold=200), store.vectors("v")
    where = on_variant(field("even") == True, "document")  # noqa: E712

    def same():
        for q in (x[0], x[7]):
            for how in ({}, {"where": where}, {"min_score": 0.7, "content": False}):
                a, b = ([(bytes(r["key"]), round(r["score"], 9)) for r in c.nearest(q.tolist(), 12, **how).collect()] for c in (v, exact))
                assert a == b and a, how
            assert v.nearest(q.tolist()).columns == exact.nearest(q.tolist()).columns

    same()
    index = v._index[3]
    store.delete("v", "000")
    v.add("new", {"even": True}, x[0].tolist())
    v.add("007", {"even": True}, (x[0] + 0.1).tolist())
    tx = store.transaction()
    tx.set("v", "020", "{}", x[7].tolist())
    tx.commit()
    same()
    assert v._index[3] is index
    store.compact()
    same()
    assert v._index[3] is not index
