"""A store: one folder with a Parquet log, its compactions, and collections over it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import encode_key
from ..session import new_path
from . import ivf, lookup, search
from . import log as logs

KEPT_POINTERS = 8


class Store:
    """Mutations append Parquet batches; reads see the latest live entries.

    One writer at a time. A generation is a folder of batches; ``compact`` writes
    the live entries as a new one. A change counts once a further, numbered pointer
    file names it: the newest whole one holds, so a writer that dies leaves the
    state before it, and the batch it wrote is overwritten by the next. The pointer
    also has the vector length of each collection, so an append reads only its own rows.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._jpath(f"{self.path}/pointers"))
        if not self._pointers():
            if any(s.getPath().getName().startswith("g") for s in self._fs.listStatus(self._jpath(self.path))):
                raise ValueError(f"{self.path} has entries but no pointer to them")
            self._point({"generation": "g0", "batch": 0, "dims": {}})

    # -- files

    def _pointers(self) -> list[str]:
        """Names of the pointer files, the newest first."""
        return sorted((x.getPath().getName() for x in self._fs.listStatus(self._jpath(f"{self.path}/pointers")) if x.getPath().getName().startswith("p")), reverse=True)

    def _read(self) -> dict:
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        for name in self._pointers():
            stream = self._fs.open(self._jpath(f"{self.path}/pointers/{name}"))
            try:
                return json.loads(text(stream, "UTF-8"))
            except ValueError:  # of a writer that died
                continue
            finally:
                stream.close()
        raise ValueError(f"{self.path} has no whole pointer")

    def _point(self, state: dict) -> None:
        """Makes ``state`` the one that holds; another writer's file of that number is an error."""
        have = self._pointers()
        number = int(have[0][1:]) + 1 if have else 0
        out = self._fs.create(self._jpath(f"{self.path}/pointers/p{number:012d}"), False)
        out.write(json.dumps(state).encode())
        out.close()
        for name in have[KEPT_POINTERS:]:
            self._fs.delete(self._jpath(f"{self.path}/pointers/{name}"), False)

    def log(self) -> DataFrame:
        state = self._read()
        folder = f"{self.path}/{state['generation']}"
        if not self._fs.exists(self._jpath(folder)):
            return self.spark.createDataFrame([], logs.LOG)
        return self.spark.read.schema(logs.LOG).option("recursiveFileLookup", "true").parquet(folder).where(F.col("batch") <= state["batch"])

    def version(self) -> tuple[str, int]:
        """Generation and batch of the newest change."""
        state = self._read()
        return state["generation"], state["batch"]

    def entries(self) -> DataFrame:
        return logs.latest_live(self.log())

    # -- mutations

    def _append(self, rows: DataFrame, dims: dict[str, int | None] | None = None) -> int:
        """Writes a batch; ``dims`` changes vector lengths of collections, None to none."""
        state = self._read()
        batch = state["batch"] + 1
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
        if "ord" not in rows.columns:
            rows = rows.withColumn("ord", F.monotonically_increasing_id())
        for c, kind in (x.strip().split(" ") for x in logs.LOG.split(",")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        names = [x.strip().split(" ") for x in logs.LOG.split(",")]
        rows.select(*[F.col(c).cast(k).alias(c) for c, k in names]).write.mode("overwrite").parquet(f"{self.path}/{state['generation']}/b{batch:012d}")
        kept = {k: v for k, v in {**state["dims"], **(dims or {})}.items() if v is not None}
        self._point({**state, "batch": batch, "dims": kept})
        return batch

    def check_dimensions(self, rows: DataFrame) -> dict[str, int]:
        """Vector lengths of the collections of ``rows``; ValueError unless all vectors of one
        have one length, that of its live entries if there are any."""
        new = rows.where(F.size("embedding") > 0).groupBy("collection").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).collect()
        had = self._read()["dims"]
        odd = [r[0] for r in new if had.get(r[0], r[1]) != r[1]]
        if odd:  # the entries of that length may all be gone
            live = self.entries().where(F.col("collection").isin(odd) & (F.size("embedding") > 0)).groupBy("collection").agg(F.max(F.size("embedding")))
            had = {**{k: v for k, v in had.items() if k not in odd}, **{r[0]: r[1] for r in live.collect()}}
        bad = [r[0] for r in new if r[1] != r[2] or had.get(r[0], r[1]) != r[1]]
        if bad:
            raise ValueError(f"vectors of unequal length in {sorted(bad)[:5]}")
        return {r[0]: r[1] for r in new}

    def append(self, rows: DataFrame) -> int:
        """Upserts (collection, key, content, embedding) rows in one batch; the whole batch is checked first.

        ``key`` is binary; ``ord``, if given, orders rows of one key within the batch.
        """
        dims = self.check_dimensions(rows)
        return self._append(rows.withColumn("op", F.lit("set")), dims)

    set = append

    def insert_new(self, rows: DataFrame) -> DataFrame:
        """Appends the rows whose key is not live; returns the rejected ones, from a table in the shared folder."""
        live = self.entries().select("collection", "key")
        path = new_path(self.spark, "rejected")
        rejected = logs.conflicts(rows, live)
        rejected.write.parquet(path)  # before the append makes conflicts of the rest
        self.append(logs.only_new(rows, live))
        return self.spark.read.schema(rejected.schema).parquet(path)

    def delete(self, collection: str, key, kind: str | None = None) -> bool:
        """A tombstone; whether the key was there."""
        k = encode_key(key, kind)
        there = lookup.contains(self.entries(), bytearray(k), collection)
        if there:
            self._append(self.spark.createDataFrame([(collection, bytearray(k), "delete")], "collection string, key binary, op string"))
        return there

    def clear(self, collection: str) -> int:
        """Removes all entries of a collection; how many there were."""
        n = self.entries().where(F.col("collection") == collection).count()
        if n:
            self._append(self.spark.createDataFrame([(collection, "clear", 1 << 62)], "collection string, op string, ord long"), {collection: None})
        return n

    def transaction(self) -> Transaction:
        return Transaction(self)

    # -- maintenance

    def dead_space(self) -> DataFrame:
        return logs.dead_space(self.log())

    def compact(self) -> None:
        """Rewrites the live entries as a new generation and drops the old one."""
        state = self._read()
        new, old = f"g{uuid.uuid4().hex[:12]}", state["generation"]
        live = self.entries().withColumn("op", F.lit("set")).withColumn("tx", F.lit(None).cast("string"))
        live.select(*[x.strip().split(" ")[0] for x in logs.LOG.split(",")]).write.parquet(f"{self.path}/{new}/base")
        self._point({**state, "generation": new})
        self._fs.delete(self._jpath(f"{self.path}/{old}"), True)

    def vectors(self, name: str, embedder: Callable[[str], Sequence[float]] | None = None, threshold: int = ivf.THRESHOLD) -> VectorCollection:
        return VectorCollection(self, name, embedder, threshold)

    def documents(self, name: str) -> DocumentCollection:
        return DocumentCollection(self, name)


class Transaction:
    """An ordered buffer of inserts and deletes, visible all at once or not at all."""

    def __init__(self, store: Store) -> None:
        self.store, self.id, self.rows, self.open = store, uuid.uuid4().hex, [], True

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is closed")

    def set(self, collection: str, key, content: str | None = None, embedding: Sequence[float] | None = None, kind: str | None = None) -> None:
        self._check()
        self.rows.append((collection, bytearray(encode_key(key, kind)), "set", content, None if embedding is None else [float(x) for x in embedding]))

    def delete(self, collection: str, key, kind: str | None = None) -> None:
        self._check()
        self.rows.append((collection, bytearray(encode_key(key, kind)), "delete", None, None))

    def commit(self) -> None:
        """Writes the rows and their commit marker as one batch; an empty commit writes nothing."""
        self._check()
        if self.rows:
            rows = [(*r, i, self.id) for i, r in enumerate(self.rows)] + [(None, None, "commit", None, None, len(self.rows), self.id)]
            df = self.store.spark.createDataFrame(rows, "collection string, key binary, op string, content string, embedding array<float>, ord long, tx string")
            self.store._append(df, self.store.check_dimensions(df.where("op = 'set'")))
        self.open = False

    def rollback(self) -> None:
        self._check()
        self.open, self.rows = False, []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_: object) -> None:
        if self.open:
            self.commit() if kind is None else self.rollback()


class DocumentCollection:
    """Dictionary-like access to one collection of JSON contents."""

    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name = store, name

    def entries(self) -> DataFrame:
        return self.store.entries().where(F.col("collection") == self.name)

    def __len__(self) -> int:
        return self.entries().count()

    def __contains__(self, key) -> bool:
        return lookup.contains(self.entries(), bytearray(encode_key(key)))

    def __getitem__(self, key):
        row = lookup.get_content(self.entries(), bytearray(encode_key(key))).first()
        if row is None:
            raise KeyError(key)
        return None if row[0] is None else json.loads(row[0])

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def __setitem__(self, key, document) -> None:
        self.add(key, document)

    def __delitem__(self, key) -> None:
        if not self.store.delete(self.name, key):
            raise KeyError(key)

    def __iter__(self):
        return (bytes(r[0]) for r in self.keys().toLocalIterator())

    def add(self, key, document, embedding: Sequence[float] | None = None) -> None:
        row = (self.name, bytearray(encode_key(key)), json.dumps(document), None if embedding is None else [float(x) for x in embedding])
        self.store.append(self.store.spark.createDataFrame([row], "collection string, key binary, content string, embedding array<float>"))

    def clear(self) -> int:
        return self.store.clear(self.name)

    def keys(self) -> DataFrame:
        return lookup.keys(self.entries())

    def values(self) -> DataFrame:
        return lookup.values(self.entries())

    def search(self, where: Column | None = None) -> DataFrame:
        """Entries whose parsed content matches; ``where`` is over the VARIANT ``document``."""
        parsed = self.entries().where("content IS NOT NULL").withColumn("document", F.try_parse_json("content"))
        return search.scan(parsed, where).drop("document")


class VectorCollection(DocumentCollection):
    """A collection whose entries also have vectors."""

    def __init__(self, store: Store, name: str, embedder: Callable[[str], Sequence[float]] | None = None, threshold: int = ivf.THRESHOLD) -> None:
        super().__init__(store, name)
        self.embedder, self.threshold = embedder, threshold
        self._index: tuple[str, int, int, ivf.IvfIndex] | None = None

    def add_sentence(self, key, document, sentence: str) -> None:
        """Adds an entry whose vector is the sentence's; a blank sentence has none."""
        self.add(key, document, self.embed(sentence) if sentence and sentence.strip() else None)

    def embed(self, sentence: str) -> Sequence[float]:
        if self.embedder is None:
            raise ValueError("the collection has no embedder")
        return self.embedder(sentence)

    def embedding(self, key) -> list[float] | None:
        row = lookup.get_embedding(self.entries(), bytearray(encode_key(key))).first()
        return row[0] if row else None

    def nearest(self, query: Sequence[float] | str, top: int = search.DEFAULT_TOP, where: Column | None = None, min_score: float | None = None, content: bool = True) -> DataFrame:
        """Hits of a vector or a sentence; a blank sentence or empty vector has none.

        From ``threshold`` entries on an index answers, with the hits of exact
        search: it is built at a search, and again once a tenth of it has changed.
        Entries that changed since are searched exactly and take the place of theirs.
        """
        if isinstance(query, str):
            query = self.embed(query) if query.strip() else []

        def parsed(rows: DataFrame) -> DataFrame:
            return rows if where is None else rows.withColumn("document", F.try_parse_json("content"))

        held = self._indexed() if len(query) and top > 0 else None
        if held is None:
            hits = search.exact_topk(parsed(self.entries()), query, top, where=where, min_score=min_score, content=content)
            return hits.drop("document", "batch", "ord")
        index, fresh = held
        keys = logs.committed(fresh).select("key").distinct()
        old = ivf.IvfIndex(parsed(index.table.join(keys, "key", "left_anti")), index.centers, index.vec)
        old._radii = index.radii()
        names = ["collection", "key", *(["content"] if content else []), "embedding"]
        found = ivf.nearest(old, query, top, where=where).select(*names, "score")
        new = search.exact_topk(parsed(logs.latest_live(fresh)), query, top, where=where).select(*names, "score")
        hits = found.unionByName(new).orderBy(F.desc("score"), "key").limit(top)
        hits = hits if content else hits.drop("collection")
        return hits if min_score is None else hits.where(F.col("score") >= min_score)

    def _indexed(self) -> tuple[ivf.IvfIndex, DataFrame] | None:
        """The index and the log rows of the collection since it was built; None below ``threshold`` entries."""
        generation, batch = self.store.version()
        if self._index is not None and self._index[0] == generation:
            at, size, index = self._index[1:]
            fresh = self.store.log().where((F.col("batch") > at) & ((F.col("collection") == self.name) | (F.col("op") == "commit")))
            n, clears = fresh.agg(F.count("*"), F.count(F.when(F.col("op") == "clear", 1))).first() if batch > at else (0, 0)
            if not clears and n <= size // 10:
                return index, fresh
        n = len(self)
        if n < self.threshold:
            return None
        index = ivf.build(self.entries().drop("batch", "ord"))
        self._index = (generation, batch, n, index)
        return index, self.store.log().where(F.lit(False))

    def more_like(self, key, top: int = search.DEFAULT_TOP) -> DataFrame:
        return self.nearest(self.embedding(key) or [], top)
