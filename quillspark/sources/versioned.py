"""Tables of Parquet folders with a commit log: versions that stay readable, writers that do not overwrite each other.

A table is a folder ``root/name``. A write puts its rows into a new folder under ``data`` and then publishes the next
numbered file in ``_log``, which lists all folders that make up the table from then on. Publishing fails if that number
exists, whoever wrote it; the loser takes the new state and tries again. Folders are never changed, so a version reads
as it did when it was new, and rows of a writer that died are in no version.

A table with a key column is laid out in hash buckets of the key. Replacing or merging rows rewrites the buckets that
hold their keys, no others, and two writers collide only where they touch the same bucket. A key column may hold lists
of keys that share a bucket (``key_bucket``); such a row belongs to all keys of its list.

A stream names its batches (writer, number): the log remembers the last number of each writer, and a batch that is there
already is not written again.

Publishing is an atomic hard link on local file systems and a rename that refuses an existing target on HDFS; a store
without either is not supported.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.ordering import latest_per_key

BUCKET = "_bucket"
Batch = tuple[str, int]


class Conflict(RuntimeError):
    """Other writers have published first, again and again."""


@dataclass(frozen=True)
class Commit:
    """A version: the folders of each bucket, and what the writer said about it."""

    version: int
    operation: str
    schema: dict
    key: str | None
    buckets: int
    folders: dict[str, list[str]]
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)


def _nullable(schema):
    """A schema's JSON in which everything may be null, as in files."""
    if isinstance(schema, list):
        return [_nullable(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    free = {"nullable", "containsNull", "valueContainsNull"}
    return {k: True if k in free else x if k == "metadata" else _nullable(x) for k, x in schema.items()}


def key_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


class VersionedTables:
    """Named tables under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8, retries: int = 20):
        self.spark, self.root, self.buckets, self.retries = spark, root.rstrip("/"), buckets, retries

    # the log

    def _path(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def versions(self, name: str) -> list[int]:
        fs, path = self._path(f"{self.root}/{name}/_log")
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, name: str, version: int | None = None) -> Commit | None:
        """A version of a table, the last one by default; None where there is no table."""
        known = self.versions(name)
        if version is None:
            if not known:
                return None
            version = known[-1]
        elif version not in known:
            raise ValueError(f"table {name} has no version {version}")
        fs, path = self._path(self._log(name, version))
        stream = fs.open(path)
        try:
            return Commit(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _log(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/_log/{version:020d}.json"

    def _publish(self, name: str, commit: Commit) -> bool:
        """False if another writer has published that version."""
        target, text = self._log(name, commit.version), json.dumps(asdict(commit), ensure_ascii=False)
        fs, path = self._path(target)
        fs.mkdirs(path.getParent())
        draft = f"{target}.{uuid.uuid4().hex}"
        if fs.getScheme() == "file":
            local, own = path.toUri().getPath(), self._path(draft)[1].toUri().getPath()
            with open(own, "x", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(own, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        draft_path = self._path(draft)[1]
        out = fs.create(draft_path, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.rename(draft_path, path):
            return True
        fs.delete(draft_path, False)
        return False

    # reading

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.commit(name, version)
        if found is None:
            raise ValueError(f"no table {name}")
        return self._rows(found, found.folders)

    def _rows(self, commit: Commit, folders: dict[str, list[str]]) -> DataFrame:
        schema = StructType.fromJson(commit.schema)
        paths = [p for bucket in sorted(folders) for p in folders[bucket]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read_keys(self, name: str, keys: list) -> DataFrame:
        """Rows of some keys; only the buckets of these are read."""
        found = self.commit(name)
        if found is None:
            raise ValueError(f"no table {name}")
        if found.key is None:
            raise ValueError(f"table {name} has no key")
        kind = StructType.fromJson(found.schema)[found.key].dataType
        lists = isinstance(kind, ArrayType)
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(found.key, kind.elementType if lists else kind))
        wanted = self._touched(asked, found.key, found.buckets)
        rows = self._rows(found, {b: p for b, p in found.folders.items() if b in wanted})
        if not keys:
            return rows.where(F.lit(False))
        return rows.where(F.exists(found.key, lambda k: k.isin(list(keys))) if lists else F.col(found.key).isin(list(keys)))

    def history(self, name: str) -> list[Commit]:
        return [self.commit(name, v) for v in self.versions(name)]

    # writing

    def _bucket(self, rows: DataFrame, key: str, buckets: int) -> Column:
        lists = isinstance(rows.schema[key].dataType, ArrayType)
        return key_bucket(F.get(key, F.lit(0)) if lists else F.col(key), buckets)

    def _touched(self, rows: DataFrame, key: str, buckets: int) -> set[str]:
        """Buckets of the rows: at most ``buckets`` of them come to the driver."""
        return {str(r[0]) for r in rows.select(self._bucket(rows, key, buckets)).distinct().collect()}

    def _put(self, name: str, rows: DataFrame, key: str | None, buckets: int, shuffled: bool = True) -> dict[str, list[str]]:
        """Write rows to a new folder; the folder of each bucket. Rows that are not shuffled leave a file per task and bucket."""
        folder = f"{self.root}/{name}/data/{uuid.uuid4().hex}"
        if key is None:
            rows.write.parquet(folder)
            return {"0": [folder]}
        keyed = rows.withColumn(BUCKET, self._bucket(rows, key, buckets))
        # Large buckets are split over files, small tasks are joined.
        (keyed.hint("rebalance", BUCKET) if shuffled else keyed).write.partitionBy(BUCKET).parquet(folder)
        fs, path = self._path(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith(f"{BUCKET}=")}

    def _change(
        self, name: str, operation: str, write: Callable[[Commit | None], tuple[dict[str, list[str]], set[str] | None, StructType]],
        key: str | None, batch: Batch | None, notes: dict[str, str] | None,
    ) -> int:
        """write gives new folders, the buckets whose old folders they replace (None: all), and the schema.

        What was written is kept through a conflict as long as the buckets that it replaces are those that it was made from.
        """
        made, base = None, None
        for _ in range(self.retries):
            head = self.commit(name)
            if head and batch and head.batches.get(batch[0], -1) >= batch[1]:
                return head.version
            buckets = head.buckets if head else self.buckets
            own_key = head.key if head else key
            if made is None or not self._same(base, head, made[1]):
                made, base = write(head), head
            folders, replaced, schema = made
            old = {} if head is None or replaced is None else {b: p for b, p in head.folders.items() if b not in replaced}
            every = {b: [*old.get(b, []), *folders.get(b, [])] for b in {*old, *folders}}
            batches = dict(head.batches if head else {}) | ({batch[0]: batch[1]} if batch else {})
            said = dict(head.notes if head else {}) | (notes or {})
            version = head.version + 1 if head else 1
            if self._publish(name, Commit(version, operation, _nullable(schema.jsonValue()), own_key, buckets, every, batches, said)):
                return version
        raise Conflict(f"table {name}: {self.retries} attempts to publish {operation!r} lost to other writers")

    @staticmethod
    def _same(base: Commit | None, head: Commit | None, replaced: set[str] | None) -> bool:
        if (base is None) != (head is None):
            return False
        if head is None or base.version == head.version:
            return True
        if replaced is None:
            return base.folders == head.folders
        return all(base.folders.get(b) == head.folders.get(b) for b in replaced)

    @staticmethod
    def _fit(rows: DataFrame, head: Commit | None) -> DataFrame:
        """Rows in the table's columns."""
        if head is None:
            return rows
        schema = StructType.fromJson(head.schema)
        if set(schema.names) != set(rows.columns):
            raise ValueError(f"columns {rows.columns} are not those of the table, {schema.names}")
        return rows.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

    def append(
        self, name: str, rows: DataFrame | Callable[[int], DataFrame], key: str | None = None, batch: Batch | None = None,
        notes: dict[str, str] | None = None, shuffled: bool = True,
    ) -> int:
        """Add rows; appends of several writers all go in, in some order. The first write fixes the key. ``rows`` may be made
        from the number of buckets. Where each task has much for every bucket, they need not be ``shuffled`` by bucket."""

        def write(head: Commit | None):
            own_key, buckets = (head.key, head.buckets) if head else (key, self.buckets)
            fitted = self._fit(rows(buckets) if callable(rows) else rows, head)
            return self._put(name, fitted, own_key, buckets, shuffled), set(), fitted.schema

        return self._change(name, "append", write, key, batch, notes)

    def overwrite(self, name: str, rows: DataFrame, key: str | None = None, batch: Batch | None = None, notes: dict[str, str] | None = None) -> int:
        """These rows are the table from now on."""

        def write(head: Commit | None):
            own_key, buckets = (head.key, head.buckets) if head else (key, self.buckets)
            return self._put(name, rows, own_key, buckets), None, rows.schema

        return self._change(name, "overwrite", write, key, batch, notes)

    def transact(self, name: str, change: Callable[[DataFrame | None], DataFrame], key: str | None = None, batch: Batch | None = None) -> int:
        """``change`` makes the new table from the last one (None at first) and is asked again if another writer was
        faster, so that what it read, such as a highest number, still holds when its rows go in."""

        def write(head: Commit | None):
            rows = change(self._rows(head, head.folders) if head else None)
            own_key, buckets = (head.key, head.buckets) if head else (key, self.buckets)
            return self._put(name, self._fit(rows, head), own_key, buckets), None, self._fit(rows, head).schema

        return self._change(name, "transact", write, key, batch, None)

    def _rewrite(
        self, name: str, operation: str, rows: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: Batch | None,
        keys: DataFrame | None = None,
    ) -> int:
        def write(head: Commit | None):
            if head is None:
                return self._put(name, merge(rows.limit(0), rows), key, self.buckets), set(), rows.schema
            if head.key != key:
                raise ValueError(f"table {name} is keyed by {head.key}, not {key}")
            fitted = self._fit(rows, head)
            touched = self._touched(fitted if keys is None else keys, key, head.buckets)
            old = self._rows(head, {b: p for b, p in head.folders.items() if b in touched})
            return self._put(name, merge(old, fitted), key, head.buckets), touched, fitted.schema

        return self._change(name, operation, write, key, batch, None)

    def replace_keys(self, name: str, rows: DataFrame, key: str, batch: Batch | None = None, keys: DataFrame | None = None) -> int:
        """All rows of every key in ``rows`` give way to these. ``keys`` may give the keys, if they are known: then rows are
        computed once, and old rows of a key without new ones go too. It must hold all keys of ``rows``."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join((new if keys is None else keys).select(key).distinct(), key, "left_anti").unionByName(new)

        return self._rewrite(name, "replace", rows, key, merge, batch, keys)

    def upsert(
        self, name: str, rows: DataFrame, keys: list[str], key: str | None = None, order: list[Column] | None = None, batch: Batch | None = None,
        known: DataFrame | None = None,
    ) -> int:
        """Rows replace those of equal ``keys``; ``key``, one of them, lays the table out. Of equal ones the last by
        ``order`` counts, else that with the greatest other values. ``known`` may give the values of ``keys`` in ``rows``, if each is
        there once: then rows are computed once."""
        key = key or keys[0]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            if known is not None:
                return old.join(known.select(*keys), keys, "left_anti").unionByName(new)
            last = latest_per_key(new, keys, order or [F.col(c) for c in new.columns if c not in keys])
            return old.join(last.select(*keys), keys, "left_anti").unionByName(last)

        return self._rewrite(name, "upsert", rows, key, merge, batch, known)

    def set_values(self, name: str, keys: DataFrame, values: dict[str, Column], batch: Batch | None = None) -> int:
        """Set columns of all rows whose values of the columns of ``keys`` are in it. Rows are joined once and stay as many as they are;
        where ``keys`` lacks the table's key, its buckets are looked up first."""

        def write(head: Commit | None):
            if head is None or head.key is None:
                raise ValueError(f"no table {name} with a key")
            hit = keys.distinct()
            told = hit if head.key in keys.columns else self._rows(head, head.folders).join(hit, keys.columns, "left_semi")
            touched = self._touched(told, head.key, head.buckets)
            old = self._rows(head, {b: p for b, p in head.folders.items() if b in touched})
            met = old.join(hit.withColumn("_hit", F.lit(True)), keys.columns, "left")
            new = met.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(old.columns)
            return self._put(name, self._fit(new, head), head.key, head.buckets), touched, StructType.fromJson(head.schema)

        return self._change(name, "set", write, None, batch, None)

    def delete_keys(self, name: str, gone: DataFrame, batch: Batch | None = None) -> int:
        """Delete all rows of the keys in the one column of ``gone``."""

        def write(head: Commit | None):
            if head is None or head.key is None:
                raise ValueError(f"no table {name} with a key")
            dead = gone.toDF(head.key).distinct()
            touched = self._touched(dead, head.key, head.buckets)
            old = self._rows(head, {b: p for b, p in head.folders.items() if b in touched})
            return self._put(name, old.join(dead, head.key, "left_anti"), head.key, head.buckets), touched, old.schema

        return self._change(name, "delete", write, None, batch, None)

    def vacuum(self, name: str, keep: int, unused_for_hours: float = 24.0) -> int:
        """Delete folders that none of the last ``keep`` versions names, and the log before these. Folders younger than
        ``unused_for_hours`` stay, as a writer may be about to publish them. Gives the number of folders."""
        import time

        known = self.versions(name)
        data = f"{self.root}/{name}/data/"
        used = {p.removeprefix(data).split("/")[0] for v in known[-keep:] for paths in self.commit(name, v).folders.values() for p in paths}
        fs, path = self._path(data)
        before, gone = (time.time() - unused_for_hours * 3600) * 1000, 0
        for status in fs.listStatus(path) if fs.exists(path) else []:
            if status.getPath().getName() not in used and status.getModificationTime() <= before:
                fs.delete(status.getPath(), True)
                gone += 1
        for v in known[:-keep]:
            fs.delete(self._path(self._log(name, v))[1], False)
        return gone
