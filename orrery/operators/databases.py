"""Databases: named stores below one folder, with their owners in a system store."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lookup
from .store import Store

SYSTEM, CATALOG = "SYSTEM", "baseinfo"
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class Databases:
    """Creates, opens, lists and deletes databases.

    The catalog is itself a document collection: one entry per database with its
    owner and the users it is shared with.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._system = Store(spark, f"{self.root}/{SYSTEM}")

    def _entries(self):
        return self._system.documents(CATALOG)

    def catalog(self) -> DataFrame:
        """(name, owner, users) of all databases."""
        schema = "name string, owner string, users array<string>"
        return self._entries().values().select(F.from_json("content", schema).alias("c")).select("c.*")

    def create(self, name: str, owner: str | None = None, users: list[str] | None = None) -> Store:
        """A new database; ValueError for a bad, reserved or taken name."""
        if not NAME.fullmatch(name) or name.upper() == SYSTEM:
            raise ValueError(f"bad database name {name!r}")
        entries = self._entries()
        if name.encode() in entries:
            raise ValueError(f"database {name!r} exists")
        entries[name.encode()] = {"name": name, "owner": owner, "users": list(dict.fromkeys(users or []))}
        return self.open(name)

    def open(self, name: str) -> Store:
        """The store of a database; KeyError if there is none."""
        if name.encode() not in self._entries():
            raise KeyError(name)
        return Store(self.spark, f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        """Removes a database and its files; KeyError if there is none."""
        del self._entries()[name.encode()]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def names(self, user: str | None = None, is_admin: bool = True) -> list[str]:
        """Names in order; those that ``user`` owns or shares unless ``is_admin``."""
        rows = self.catalog() if is_admin else lookup.visible_databases(self.catalog(), user or "")
        return [r[0] for r in rows.select("name").orderBy("name").collect()]

    def info(self) -> DataFrame:
        """(name, owner, users, vectors, size, file_bytes, n_collections, collections) of every database.

        ``size`` is of the live contents and vectors, ``file_bytes`` what the folder holds.
        """
        rows, infos = [], None
        for name in self.names():
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            rows.append((name, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()))
            own = self.details(name).withColumn("name", F.lit(name))
            infos = own if infos is None else infos.unionByName(own)
        files = self.spark.createDataFrame(rows, "name string, file_bytes long")
        out = self.catalog().join(F.broadcast(files), "name")
        if infos is None:
            return out.selectExpr("name", "owner", "users", "0L AS vectors", "0L AS size", "file_bytes", "0L AS n_collections", "CAST(array() AS array<string>) AS collections")
        total = lookup.database_info(infos, ["name"])
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out.join(total, "name", "left").select("name", "owner", "users", zero("vectors"), zero("size"), "file_bytes", zero("n_collections"), F.coalesce("collections", F.array().cast("array<string>")).alias("collections"))

    def details(self, name: str) -> DataFrame:
        """One row per collection of a database: the statistics of ``lookup.collection_info``."""
        return lookup.collection_info(self.open(name).entries())
