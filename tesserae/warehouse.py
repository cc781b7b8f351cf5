"""Versioned tables: immutable files and one pointer that moves all tables together.

A commit writes new files and then creates the next numbered pointer, which names the folders of
every table. The pointer is created only if it does not exist, so of two writers one fails and no
half of a commit is ever seen. Readers take the highest pointer. Tables are laid out in one of three
ways, and a commit writes no more than each needs:

* keyed tables lie in buckets by a hash of their key; a ``Change`` replaces the buckets that it
  touches and leaves the others as they are;
* the index lies in segments; an ``Append`` adds one, and nothing that is there is written again;
* other tables, small ones, are written whole.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.store import apply_change
from tesserae.schemas import BUCKETED, ROW_KEYS, SEGMENTED, TABLES
from tesserae.staging import hadoop_path, small

BUCKETS = 32
#: The pointer's entry of streams and their last batches; no table has such a name.
STREAMS = "#streams"
#: A table whose touched buckets are larger than this on average gets four times as many.
BUCKET_BYTES = 256 << 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Change:
    """What a commit does to a keyed table: the rows of ``keys`` that ``gone`` names go, and ``rows``
    take the place of those of their keys. With ``order`` a key is one row, the last in that order.

    Both are read twice, so they should be stored or cheap.
    """

    keys: list[str]
    rows: DataFrame | None = None
    gone: DataFrame | None = None
    order: list[str] | None = None

    def on(self, stored: DataFrame) -> DataFrame:
        return apply_change(stored, self.keys, self.rows, self.gone, self.order)


@dataclass(frozen=True)
class Append:
    """Rows that a commit adds to a segmented table, as a segment of the commit's version."""

    rows: DataFrame


@dataclass(frozen=True)
class Segment:
    version: int
    folder: str
    size: int


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.spark, self.root, self.buckets, self.bucket_bytes = spark, root.rstrip("/"), buckets, bucket_bytes

    def versions(self) -> list[int]:
        path, fs = hadoop_path(self.spark, f"{self.root}/_versions")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _pointer(self, version: int | None = None) -> tuple[int, dict]:
        """A version and its tables. The last one by default: one that is still being written, or whose
        writer has died, does not count, and a writer that starts from the one before meets a conflict."""
        for n in reversed(self.versions()) if version is None else [version]:
            path, fs = hadoop_path(self.spark, self._version(n))
            stream = fs.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return n, json.loads(text)
            except ValueError:
                if version is not None:
                    raise
        return 0, {}

    def _version(self, number: int) -> str:
        return f"{self.root}/_versions/{number:012d}.json"

    # -- reading

    def load(self, name: str, folders: list[str]) -> DataFrame:
        """Some of a table's folders."""
        if not folders:
            return small(self.spark, [], TABLES[name])
        reader = self.spark.read
        return (reader.schema(TABLES[name]) if name in TABLES else reader).parquet(*[f"{self.root}/{f}" for f in folders])

    def folders(self, name: str, version: int | None = None) -> list[str]:
        """The folders that make up a table."""
        return _folders(self._pointer(version)[1].get(name))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the last one by default); one that was never written is empty."""
        return self.load(name, self.folders(name, version))

    def segments(self, name: str) -> list[Segment]:
        return [Segment(*s) for s in self._pointer()[1].get(name, {}).get("segments", [])]

    # -- committing

    def _folder(self, name: str) -> str:
        return f"{name}/{uuid.uuid4().hex}"

    def _size(self, folder: str) -> int:
        path, fs = hadoop_path(self.spark, f"{self.root}/{folder}")
        return fs.getContentSummary(path).getLength()

    def _write_buckets(self, name: str, rows: DataFrame, count: int) -> dict[str, str]:
        """Writes rows by bucket; the folder of each bucket that has any."""
        at = self._folder(name)
        rows.withColumn("bucket", bucket(name, count)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{at}")
        path, fs = hadoop_path(self.spark, f"{self.root}/{at}")
        found = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
        return {n.removeprefix("bucket="): f"{at}/{n}" for n in found if n.startswith("bucket=")}

    def _changed(self, name: str, change: Change, entry: dict | None) -> dict | None:
        """A keyed table's next entry; None if the change touches nothing."""
        count = entry["count"] if entry else self.buckets
        keys = [p.select(*change.keys) for p in (change.rows, change.gone) if p is not None]
        touched = {str(r[0]) for k in keys for r in k.select(bucket(name, count)).distinct().collect()}  # at most ``count`` rows
        if not touched:
            return None
        held = entry["buckets"] if entry else {}
        mine = [held[b] for b in sorted(touched) if b in held]
        if mine and sum(map(self._size, mine)) > self.bucket_bytes * len(mine):
            return {"count": 4 * count, "buckets": self._write_buckets(name, change.on(self.load(name, list(held.values()))), 4 * count)}
        made = self._write_buckets(name, change.on(self.load(name, mine)), count)
        return {"count": count, "buckets": {b: f for b, f in held.items() if b not in touched} | made}

    def _appended(self, name: str, rows: DataFrame, version: int) -> list[list]:
        at = self._folder(name)
        (rows.withColumn("seg", F.lit(version).cast("long")) if "seg" in SEGMENTED[name] else rows).write.parquet(f"{self.root}/{at}")
        return [] if self.load(name, [at]).isEmpty() else [[version, at, self._size(at)]]

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """What has changed in a table between two versions: its rows of the later one (of the earlier one
        where they are gone) with ``change``: ``insert``, ``update`` or ``delete``. Files that both
        versions name are not read, so the work grows with what commits have touched."""
        keys, before, after = ROW_KEYS[name], self.folders(name, since), self.folders(name, until)
        old, new = self.load(name, [f for f in before if f not in set(after)]), self.load(name, [f for f in after if f not in set(before)])
        whole = F.to_json(F.struct(*[F.col(c) for c in new.columns]))
        was = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*old.columns).alias("_old"), whole.alias("_was"))
        now = new.withColumn("_now", whole)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        change = F.when(F.col("_was").isNull(), "insert").when(F.col("_now").isNull(), "delete").when(F.col("_was") != F.col("_now"), "update")
        met = now.join(was, same, "full").withColumn("change", change).where(F.col("change").isNotNull())
        return met.select(*[F.when(F.col("_now").isNull(), F.col("_old")[c]).otherwise(F.col(c)).alias(c) for c in new.columns], "change")

    def batch_of(self, stream: str) -> int | None:
        """The last batch of a stream that has been committed."""
        return self._pointer()[1].get(STREAMS, {}).get(stream)

    def commit(self, tables: dict[str, DataFrame | Change | Append], drop: dict[str, list[int]] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Writes what changes and makes it current at once; returns the new version. ``drop`` names
        segments, by version, that go. If nothing changes nothing is written. With ``batch``, a
        stream's name and batch number, the number is part of what is committed, and a batch that has
        been committed before is passed over."""
        version, current = self._pointer()
        streams = current.get(STREAMS, {})
        if batch and streams.get(batch[0], -1) >= batch[1]:
            return version
        placed = {n: {"segments": [s for s in current.get(n, {}).get("segments", []) if s[0] not in gone]} for n, gone in (drop or {}).items()}
        for name, given in tables.items():
            if isinstance(given, Change):
                if entry := self._changed(name, given, current.get(name)):
                    placed[name] = entry
            elif isinstance(given, Append):
                if made := self._appended(name, given.rows, version + 1):
                    before = placed.get(name) or current.get(name) or {"segments": []}
                    placed[name] = {"segments": before["segments"] + made}
            elif name in BUCKETED:
                placed[name] = {"count": self.buckets, "buckets": self._write_buckets(name, given, self.buckets)}
            elif name in SEGMENTED:
                placed[name] = {"segments": self._appended(name, given, version + 1)}
            else:
                at = self._folder(name)
                given.write.parquet(f"{self.root}/{at}")
                placed[name] = {"folder": at}
        if all(current.get(n) == entry for n, entry in placed.items()) and not batch:
            return version
        if batch:
            placed[STREAMS] = streams | {batch[0]: batch[1]}
        self._point(version + 1, current | placed)
        return version + 1

    def _point(self, version: int, tables: dict) -> None:
        path, fs = hadoop_path(self.spark, self._version(version))
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} exists") from e
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()

    def vacuum(self, keep: int = 1, least_age: float = 86400.0) -> int:
        """Deletes folders that none of the last ``keep`` versions names. Those younger than
        ``least_age`` seconds stay, as a writer may be about to commit them."""
        last = self._pointer()[0]
        for v in self.versions():  # pointers that a writer left behind half written
            path, fs = hadoop_path(self.spark, self._version(v))
            if v > last and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 >= least_age:
                fs.delete(path, False)
        kept = {"/".join(f.split("/")[:2]) for v in [v for v in self.versions() if v <= last][-keep:] for n, entry in self._pointer(v)[1].items() if n != STREAMS for f in _folders(entry)}
        path, fs = hadoop_path(self.spark, self.root)
        gone = 0
        for table in fs.listStatus(path) if fs.exists(path) else []:
            if table.getPath().getName().startswith("_"):
                continue
            for folder in fs.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in kept and time.time() - folder.getModificationTime() / 1000 >= least_age:
                    fs.delete(folder.getPath(), True)
                    gone += 1
        return gone

    def views(self) -> None:
        """Registers every table as a temporary view, for ``spark.sql(text, args)``."""
        for name in {*TABLES, *self._pointer()[1]} - {STREAMS}:
            self.read(name).createOrReplaceTempView(name)

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        self.views()
        return self.spark.sql(text, args=args)


def _folders(entry: dict | None) -> list[str]:
    if entry is None:
        return []
    if "buckets" in entry:
        return list(entry["buckets"].values())
    return [s[1] for s in entry["segments"]] if "segments" in entry else [entry["folder"]]


def bucket(name: str, count: int) -> Column:
    return F.pmod(F.xxhash64(*BUCKETED[name]), F.lit(count)).cast("int")


def full_tier(segments: list[Segment], fanout: int, unit: int = 1 << 20) -> list[Segment]:
    """The segments of the least tier that holds ``fanout`` of them: tiers are powers of ``fanout``
    times ``unit`` bytes. None where no tier is full."""
    tiers: dict[int, list[Segment]] = {}
    for s in segments:
        tiers.setdefault(max(0, math.ceil(math.log(max(s.size, 1) / unit, fanout))), []).append(s)
    return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fanout), [])
