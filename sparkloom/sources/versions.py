"""Versioned tables: data files that never change, and a commit file per version that names them.

A store is a folder with ``data/`` and ``commits/``.  A commit lists, for each table, its schema and the folder of each
of its buckets; it becomes the next version by a rename that fails where that version exists already, so that of two
writers one wins and the other starts again from what the first has written.  Until then nothing refers to the new
files: a writer that dies at any step leaves the last version as it was, and readers always see one whole version, of
all tables together.  Rows lie in buckets by their keys, or by some of them; an upsert reads and writes the buckets that
its changes touch alone.  ``vacuum`` deletes files that no kept version names.

The rename is atomic where the file system's is (HDFS; on a local disk there is one machine to be careful on).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
ATTEMPTS = 20
BUCKET = "__bucket"


class Conflict(Exception):
    """Another writer has made this version."""


class Added(NamedTuple):
    """Rows to be added to a table as they are, whatever keys it has already."""

    rows: DataFrame


class Rewritten(NamedTuple):
    """All rows of some buckets as they are now, with their bucket (``BUCKET``), a bucket's rows in one partition."""

    rows: DataFrame
    buckets: set[str]


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    # ------------------------------------------------------------ commits

    def versions(self) -> list[int]:
        """The versions that there are, in order."""
        place = self._path("commits")
        if not self._fs.exists(place):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(place))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdecimal())

    def tables(self, version: int | None = None) -> dict:
        """What a version (the last one) says of each table; no tables where there is no version."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return {"version": 0, "tables": {}}
        if version not in known:
            raise ValueError(f"{self.folder} has no version {version}")
        stream = self._fs.open(self._path(f"commits/{version:012d}.json"))
        try:
            body = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(body)

    def _commit(self, base: int, tables: dict) -> int:
        """Makes version base + 1, or raises Conflict."""
        version = base + 1
        self._fs.mkdirs(self._path("commits"))
        draft = self._path(f"commits/_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps({"version": version, "tables": tables}).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, self._path(f"commits/{version:012d}.json"), how)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"{self.folder} has version {version} already") from error
            raise
        return version

    def _again(self, change: Callable[[dict, int], dict]) -> int:
        """Applies a change to the last version, and to the one after it where another writer was faster."""
        for _ in range(ATTEMPTS):
            last = self.tables()
            try:
                return self._commit(last["version"], change(last["tables"], last["version"]))
            except Conflict:
                continue
        raise Conflict(f"{self.folder}: {ATTEMPTS} other writers were faster")

    # ------------------------------------------------------------ data

    def _written(self, df: DataFrame) -> dict[str, str]:
        """The rows, which have a bucket, as new files: bucket -> folder."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(BUCKET).parquet(f"{self.folder}/{name}")
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(name)))
        return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def _rows(self, table: dict, buckets: set[str] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, at in table["files"].items() if buckets is None or b in buckets for p in _places(at)]
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.empty(schema)

    def empty(self, schema: StructType) -> DataFrame:
        """No rows, without a Python worker, so that the optimizer sees that there are none."""
        return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).where("false")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as one version (the last) has it; later versions do not change what is read."""
        return self._rows(self.tables(version)["tables"][name])

    def of_keys(self, name: str, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of some keys (a frame with the columns that buckets go by); other keys' buckets are not read."""
        rows = self.of_buckets(name, self.touched(name, keys, version), version)
        return rows.join(keys, _same(rows, keys, _by(self.tables(version)["tables"][name])), "left_semi")

    def bucket(self, name: str, version: int | None = None) -> Column:
        """The bucket of a table's row."""
        table = self.tables(version)["tables"][name]
        return _bucket(_by(table), table["buckets"])

    def touched(self, name: str, keys: DataFrame, version: int | None = None) -> set[str]:
        """The buckets of a table that some keys (a frame with the columns that buckets go by) fall into."""
        return {str(r[0]) for r in keys.select(self.bucket(name, version)).distinct().collect()}  # at most the number of buckets

    def of_buckets(self, name: str, buckets: set[str], version: int | None = None) -> DataFrame:
        """The rows of some buckets; the others are not read."""
        return self._rows(self.tables(version)["tables"][name], buckets)

    def note(self, name: str) -> dict:
        return self.tables()["tables"][name].get("note", {})

    def replace(self, frames: dict[str, tuple[DataFrame, list[str]]], buckets: int = BUCKETS, by: dict[str, list[str]] | None = None) -> int:
        """Tables with their keys, all new in one version; other tables stay as they are.  ``by`` names the keys that a
        table's buckets go by, where these are not all of them: ``of_keys`` finds rows by these."""
        new = {}
        for name, (df, keys) in frames.items():
            within = (by or {}).get(name, keys)
            files = self._written(df.withColumn(BUCKET, _bucket(within, buckets)).repartition(BUCKET))
            new[name] = {"schema": df.schema.jsonValue(), "keys": keys, "by": within, "buckets": buckets, "files": files}
        return self._again(lambda tables, version: tables | new)

    def upsert(self, name: str, changes: DataFrame, deleted: str | None = None, note: Callable[[dict], dict] | None = None) -> int:
        """A version in which rows of changes stand for those of equal keys (null equals null); where ``deleted``
        names a boolean column of changes, its rows go.  All rows of a key are replaced by those that changes have
        of it, in the table's columns.  ``note`` makes the table's note, a small dict, from the last one: it changes with the rows or not at all."""

        return self.amend(lambda version: {name: (changes, deleted)}, {name: note} if note else None)

    def amend(self, make: Callable[[int], dict[str, tuple[DataFrame, str | None] | Added | Rewritten]], notes: dict[str, Callable[[dict], dict]] | None = None) -> int:
        """Changes of several tables in one version, each as in ``upsert``.  ``make`` gives them (table: its changes and the
        name of their ``deleted``, rows that are ``Added``, or buckets that are ``Rewritten``) for the version that they
        stand on, and is asked again where another writer was faster."""

        def change(tables: dict, version: int) -> dict:
            how = {Added: self._longer, Rewritten: self._rewritten}
            new = {name: tables[name] | how.get(type(given), self._merged)(tables[name], *given) for name, given in make(version).items()}
            for name, note in (notes or {}).items():
                table = new.get(name, tables[name])
                new[name] = table | {"note": note(table.get("note", {}))}
            return tables | new

        return self._again(change)

    def _merged(self, table: dict, changes: DataFrame, deleted: str | None) -> dict:
        """What changes make of a table: new files for the buckets that they touch."""
        keys, bucket = table["keys"], _bucket(_by(table), table["buckets"])
        touched = {str(r[0]) for r in changes.select(bucket).distinct().collect()}  # at most the number of buckets
        if not touched:
            return {}
        old = self._rows(table, touched)
        stay = old.join(changes, _same(old, changes, keys), "left_anti")
        fresh = changes.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else changes
        merged = stay.unionByName(fresh.select(*(F.col(f"`{c}`") for c in old.columns)))
        files = self._written(merged.withColumn(BUCKET, bucket).repartition(BUCKET))
        return {"files": {b: p for b, p in table["files"].items() if b not in touched} | files}

    def _longer(self, table: dict, rows: DataFrame) -> dict:
        """The files of a table with new ones beside them; what is there is not read."""
        columns = StructType.fromJson(table["schema"]).names
        placed = rows.select(*(F.col(f"`{c}`") for c in columns)).withColumn(BUCKET, _bucket(_by(table), table["buckets"]))
        files = self._written(placed.repartition(BUCKET))
        return {"files": table["files"] | {b: [*_places(table["files"].get(b, [])), p] for b, p in files.items()}}

    def _rewritten(self, table: dict, rows: DataFrame, buckets: set[str]) -> dict:
        """New files for some buckets; their old ones are not read."""
        files = self._written(rows) if buckets else {}
        return {"files": {b: p for b, p in table["files"].items() if b not in buckets} | files}

    def compact(self, name: str, most: int = 8) -> int:
        """One folder for each bucket that has more than ``most``; no row changes.  How many buckets were rewritten."""
        done: list[str] = []

        def change(tables: dict, version: int) -> dict:
            table = tables[name]
            done[:] = [b for b, at in table["files"].items() if len(_places(at)) > most]
            if not done:
                return tables
            rows = self._rows(table, set(done)).withColumn(BUCKET, _bucket(_by(table), table["buckets"]))
            return tables | {name: table | {"files": table["files"] | self._written(rows.repartition(BUCKET))}}

        if any(len(_places(at)) > most for at in self.tables()["tables"][name]["files"].values()):
            self._again(change)
        return len(done)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last versions, and data that no kept version names; the number of folders that went.
        Not to be run while a writer is at work: its new files are not named yet."""
        known = self.versions()
        old, kept = (known[:-keep], known[-keep:]) if keep else (known, [])
        named = {p.split("/")[1] for v in kept for t in self.tables(v)["tables"].values() for at in t["files"].values() for p in _places(at)}
        for v in old:
            self._fs.delete(self._path(f"commits/{v:012d}.json"), False)
        gone = 0
        for place in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            if place.getPath().getName() not in named:
                gone += bool(self._fs.delete(place.getPath(), True))
        return gone


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _places(at: str | list[str]) -> list[str]:
    """The folders of a bucket: one, or several where rows were added."""
    return [at] if isinstance(at, str) else at


def _by(table: dict) -> list[str]:
    """The columns that a table's buckets go by."""
    return table.get("by", table["keys"])


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Rows of equal keys; null equals null."""
    return reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys))
