import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import image, keys
from orrery.functions import text as T
from orrery.functions.embed import embed, hash_embedder, select_output, with_embeddings
from orrery.operators import lookup, metrics
from orrery.operators.store import Store
from orrery.sources import documents, vectors
from orrery.streaming.ingest import ingest


def test_chunks_and_truncation(spark):
    row = spark.createDataFrame([("a b c d e f g",), ("",), (None,)], "t string").select(T.split_tokens(F.col("t")).alias("x"))
    got = [r[0] for r in row.select(T.chunks(F.col("x"), 3, 1)).collect()]
    assert got == [[["a", "b", "c"], ["c", "d", "e"], ["e", "f", "g"]], [], []]
    assert [r[0] for r in row.select(T.chunks(F.col("x"), 3, 9)).collect()][0][:2] == [["a", "b", "c"], ["b", "c", "d"]]
    assert row.select(T.head_tail(F.col("x"), 4, 3)).first()[0] == ["a", "b", "c", "g"]


def test_embedding_of_blanks_chunks_and_given_vectors(spark):
    rows = spark.createDataFrame([(1, "x y z", None), (2, " ", None), (3, None, None), (4, "x", [1.0])], "key int, sentence string, embedding array<float>")
    got = {r["key"]: r["embedding"] for r in with_embeddings(rows, hash_embedder(8)).collect()}
    assert len(got[1]) == 8 and got[2] is None and got[3] is None and got[4] == [1.0]
    count = lambda batch: np.array([[float(len(t))] for t in batch])
    long = spark.createDataFrame([(" ".join("w" * 1 for _ in range(5)),)], "t string")
    assert long.select(embed(F.col("t"), count, size=3, overlap=1)).first()[0] == [3.0]  # runs of 3 and 3
    assert long.select(embed(F.col("t"), count, chunked=False, longest=4, head=2)).first()[0] == [4.0]


def test_output_selection():
    mask = np.array([[1, 1, 0]])
    states = np.arange(6.0).reshape(1, 3, 2)
    assert select_output({"x": states}, mask).tolist() == [[1.0, 2.0]]
    assert select_output({"x": states, "sentence_embedding": np.ones((1, 2))}, mask).tolist() == [[1, 1]]
    assert select_output({"x": np.arange(4.0)}, mask).shape == (1, 4)
    assert select_output({"x": np.arange(4.0)}, np.ones((2, 3))).shape == (2, 0)


def test_masked_mean(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0]], [0])], "s array<array<double>>, m array<int>")
    assert [r[0] for r in rows.select(T.masked_mean(F.col("s"), F.col("m"))).collect()] == [[2.0, 3.0], None]


def test_tiles_cover_the_image_and_end_with_it_whole(spark):
    got = image.tiles(spark.createDataFrame([(1, 500, 224), (2, 0, 5)], "id int, width int, height int"), 224).orderBy("tile_no").collect()
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in got] == [(0, 0, 224, 224), (224, 0, 224, 224), (276, 0, 224, 224), (0, 0, 500, 224)]


def test_image_embedding(spark):
    rows = spark.createDataFrame([(bytearray(bytes(4 * 4 * 3)), 4, 4), (bytearray(b"xx"), 4, 4), (None, 4, 4)], "p binary, h int, w int")
    model = lambda x: x.reshape(len(x), -1)[:, :5]
    got = [r[0] for r in rows.select(image.embed_images(F.col("p"), F.col("h"), F.col("w"), model, 8)).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1) and got[1:] == [[], []]
    flat = image.prepared(np.full((5, 7, 3), 128, np.uint8), 6, (0, 0, 0), (1, 1, 1))
    assert np.allclose(flat, 128 / 255)


def test_key_codecs(spark):
    assert keys.encode_key(42, "int") == b"\x2a\0\0\0" != keys.encode_key(42, "long")
    assert keys.encode_key("42") == keys.encode_key(42, "long") and keys.encode_key("abc") == b"abc"
    with pytest.raises(ValueError):
        keys.encode_key("x", "decimal")
    rows = documents.accepted(spark.createDataFrame([("5",), (" ",), (None,), ("abc",)], "key string")).collect()
    assert [bytes(r[0]) for r in rows] == [keys.encode_key(5, "long"), b"abc"]
    assert documents.accepted(spark.createDataFrame([("5",), ("x",)], "key string"), key_type="int").count() == 1


def test_flat_vector_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.f32").write_bytes(x.tobytes() + b"\0\0")
    assert [r["embedding"] for r in vectors.read_flat(spark, f"file://{tmp_path}/a.f32", 4).orderBy("id").collect()] == x.tolist()
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.array([4], "<i4").tobytes() + r.tobytes() for r in x))
    assert [r["embedding"] for r in vectors.read_fvecs(spark, f"file://{tmp_path}/a.fvecs").orderBy("id").collect()] == x.tolist()
    (tmp_path / "a.ivecs").write_bytes(np.array([2, 7, 9, 2, 1, 3], "<i4").tobytes())
    assert [r["neighbours"] for r in vectors.read_ivecs(spark, f"file://{tmp_path}/a.ivecs").orderBy("id").collect()] == [[7, 9], [1, 3]]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    rows = documents.read_json_documents(spark, f"file://{tmp_path}/a.json")
    assert rows.count() == 2
    assert sorted(r[0] for r in rows.select(documents.as_json(F.col("document"))).collect()) == ['{"a":1}', '{"a":2}']
    assert [r[0] for r in documents.decoded_if(rows, F.col("content").contains("2"), "a int").select("content.a").collect()] == [2]


def test_streamed_ingest_embeds_only_non_blank_sentences(spark, tmp_path):
    rows = spark.createDataFrame([("c", bytearray(b"a"), "1", "hello"), ("c", bytearray(b"b"), "2", " ")], "collection string, key binary, content string, sentence string")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/db")
    for _ in range(2):  # the second run finds nothing new
        ingest(stream, store, f"file://{tmp_path}/cp", embedder=hash_embedder(8)).awaitTermination()
    v = store.vectors("c")
    assert len(v) == 2 and len(v.embedding(b"a")) == 8 and v.embedding(b"b") is None


def test_history_is_anchored_at_the_last_sample(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts FROM range(100)")
    assert metrics.history(rows, "1h").count() == 7 and metrics.history(rows, "nope").count() == 7
    assert metrics.retained(spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 2) AS ts FROM range(2000)")).count() == 720


def test_collection_info_of_an_unknown_collection(spark):
    rows = spark.createDataFrame([("c", 1, "xy", [1.0])], "collection string, key int, content string, embedding array<float>")
    assert tuple(lookup.collection_info(rows, "c").first()) == ("c", 1, 1, 2, 4)
    with pytest.raises(KeyError):
        lookup.collection_info(rows, "d")


def test_visibility_and_distinct_users(spark):
    cat = spark.createDataFrame([("a", "u1", ["u2"]), ("b", "u3", None)], "name string, owner string, users array<string>")
    assert [r["name"] for r in lookup.visible_databases(cat, "u2").collect()] == ["a"] and lookup.visible_databases(cat, "x", True).count() == 2
    assert lookup.distinct_users(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c")], "id int, name string")).count() == 2


def test_status_sampler_appends_samples(spark, tmp_path):
    from orrery.operators.metrics import retained
    from orrery.streaming.ingest import status_sampler

    query = status_sampler(spark, lambda: spark.range(1).selectExpr("'a' AS database", "3L AS vectors"), f"file://{tmp_path}/s", "1 second")
    try:
        for _ in range(120):
            if len(query.recentProgress) > 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    rows = retained(spark.read.parquet(f"file://{tmp_path}/s")).collect()
    assert rows and all(r["vectors"] == 3 and r["ts"] is not None for r in rows)


def test_image_files_are_decoded(spark, tmp_path):
    import struct
    import zlib

    from orrery.sources.images import images

    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)

    def png(pixels, kind):
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        rows = b"".join(b"\0" + r.tobytes() for r in pixels)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    (tmp_path / "rgb.png").write_bytes(png(x, 2))
    (tmp_path / "clear.png").write_bytes(png(np.concatenate([x, np.full((5, 7, 1), 9, np.uint8)], 2), 6))
    (tmp_path / "torn.png").write_bytes(png(x, 2)[:40])
    rows = images(spark, f"file://{tmp_path}")
    got = {r["origin"].rpartition("/")[2]: r for r in rows.collect()}
    for name in ("rgb.png", "clear.png"):
        r = got[name]
        assert (r["height"], r["width"]) == (5, 7) and np.frombuffer(r["pixels"], np.uint8).reshape(5, 7, 3).tolist() == x.tolist()
    assert got["torn.png"]["pixels"] is None and got["torn.png"]["height"] is None
    made = rows.select("origin", image.embed_images(F.col("pixels"), F.col("height"), F.col("width"), lambda b: b.reshape(len(b), -1)[:, :6], 8).alias("v")).collect()
    assert sorted(len(r["v"]) for r in made) == [0, 6, 6]


def onnx_model(table):
    """A model that looks ids up in ``table``, as the bytes of its protocol buffer."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    number = lambda field, n: varint(field << 3) + varint(n)
    text = lambda field, data: varint(field << 3 | 2) + varint(len(data)) + data

    def value(name, kind, *dims):
        shape = b"".join(text(1, text(2, d.encode()) if isinstance(d, str) else number(1, d)) for d in dims)
        return text(1, name.encode()) + text(2, text(1, number(1, kind) + text(2, shape)))

    node = text(1, b"table") + text(1, b"input_ids") + text(2, b"states") + text(4, b"Gather")
    tensor = number(1, table.shape[0]) + number(1, table.shape[1]) + number(2, 1) + text(8, b"table") + text(9, table.astype("<f4").tobytes())
    graph = text(1, node) + text(2, b"g") + text(5, tensor) + text(11, value("input_ids", 7, "n", "t")) + text(12, value("states", 1, "n", "t", table.shape[1]))
    return number(1, 8) + text(7, graph) + text(8, number(2, 13))


def test_embedding_by_a_model_file(spark, tmp_path):
    from orrery.functions.embed import onnx_embedder

    table = np.random.default_rng(2).standard_normal((30, 4)).astype(np.float32)
    path = str(tmp_path / "m.onnx")
    with open(path, "wb") as f:
        f.write(onnx_model(table))
    embedder = onnx_embedder(path, lambda tokens: [int(t) for t in tokens], ("NoSuchProvider",))
    rows = spark.createDataFrame([("1 2 3",), ("7",), ("",), (None,), (" ".join(str(i % 30) for i in range(50)),)], "s string")
    got = [r[0] for r in rows.select(embed(F.col("s"), embedder, size=20, overlap=0)).collect()]
    assert got[2] == [] and got[3] == []
    for text, v in (("1 2 3", got[0]), ("7", got[1]), (" ".join(str(i % 30) for i in range(50)), got[4])):
        assert v == pytest.approx(table[[int(t) for t in text.split()]].astype(float).mean(0).tolist(), abs=1e-5)


def test_embedding_holds_the_tokens_of_a_slice_of_the_texts(monkeypatch):
    from orrery.functions import embed as E

    monkeypatch.setattr(E, "SLICE", 2000)
    cut_at, held = [], []

    def runs_of(tokens):
        cut_at.append(len(tokens))
        return [tokens] if tokens else []

    def embedder(batch):
        held.append(sum(cut_at))
        cut_at.clear()
        return E.hash_embedder(8)(batch)

    texts = [f"word{i} other words {i}" for i in range(500)] + ["", None, "a " * 3000]
    got = E.vectors(pa.array(texts), embedder, runs_of).to_pylist()
    assert max(held[:-1]) <= 500 and len(got) == 503 and got[500] == got[501] == []
    assert np.allclose(got[:500], E.hash_embedder(8)([t.split() for t in texts[:500]]))
    assert E.vectors(pa.array([], pa.string()), embedder, runs_of).to_pylist() == []
