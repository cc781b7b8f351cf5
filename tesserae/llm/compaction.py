"""Sharded storage with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet shards. A compaction sorts the live shards into
size tiers (powers of ``FANOUT``), and a tier is merged once it holds ``FANOUT`` shards: they are
packed into runs of about the target size, each written as one new shard of a higher tier, which
may fill that tier in turn. A flush also merges tiers that hold fewer. Runs never mix tiers.
Every change is one new manifest
version, a file that is created only if no other writer has taken its number. One that can't be read
as a whole, as it is being written or its writer has died, is no version: readers see the one before,
and writers that start from that one meet a conflict until ``vacuum`` has removed it. Data files are
never changed; files that no kept version names are removed by ``vacuum``, but for young ones that a
writer may be about to commit.

A merge reads a run's shards in one task and writes one file, with no shuffle; up to ``RUNS_A_JOB``
runs of a compaction are one job, and a task that is lost is run again. The driver holds file names and
sizes only, about one for each target size of data.

Edge cases: nulls in any column, empty and very long texts and repeated rows are stored as they
are; an empty table appends a version without shards; columns of any names are kept, as rows are
never joined.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import temporary

TARGET_BYTES = 64 << 20
SHARD_ROWS = 4000
FANOUT = 4
RUNS_A_JOB = 256


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


@dataclass(frozen=True)
class Shard:
    name: str
    size: int

    @property
    def tier(self) -> int:
        tier, size = 0, self.size >> 16
        while size >= FANOUT:
            tier, size = tier + 1, size // FANOUT
        return tier


class ShardStore:
    """A folder of shards and manifest versions, reached through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name: str) -> list[tuple[str, int]]:
        at = self._path(name)
        if not self._fs.exists(at):
            return []
        return sorted((f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(at))

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return _drain(self._jvm, stream)
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self._list("manifest") if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the latest whole one by default; version 0 is empty."""
        for v in reversed(self.versions()) if version is None else [version][: bool(version)]:
            try:
                return json.loads(self._read_text(f"manifest/{v:012d}.json"))
            except ValueError:
                if version is not None:
                    raise
        return {"version": 0, "schema": None, "shards": []}

    def commit(self, base: dict, shards: list[Shard], schema: str) -> int:
        version = base["version"] + 1
        self._fs.mkdirs(self._path("manifest"))
        try:
            out = self._fs.create(self._path(f"manifest/{version:012d}.json"), False)
        except Exception as e:
            raise CommitConflict(f"version {version} exists") from e
        try:
            out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [[s.name, s.size] for s in shards]}).encode()))
        finally:
            out.close()
        return version

    def _written(self, folder: str) -> list[Shard]:
        return [Shard(f"{folder}/{n}", size) for n, size in self._list(folder) if n.startswith("part-")]

    def append(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Writes arrivals as shards of at most ``shard_rows`` rows and commits them."""
        base = self.manifest()
        folder = f"data/arrival-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(f"{self.root}/{folder}")
        return self.commit(base, [*_shards(base), *self._written(folder)], rows.schema.json())

    def plan(self, shards: list[Shard], target: int, least: int = FANOUT) -> list[list[Shard]]:
        """Runs to merge: shards of one tier, in size order, up to about the target size. A tier
        of fewer than ``least`` shards waits. Shards of at least half the target stay as they are."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted((s for s in shards if 2 * s.size < target), key=lambda s: (s.size, s.name)):
            tiers.setdefault(s.tier, []).append(s)
        runs: list[list[Shard]] = []
        for tier in sorted(tiers):
            if len(tiers[tier]) < least:
                continue
            run: list[Shard] = []
            for s in tiers[tier]:
                if run and sum(x.size for x in run) + s.size > target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, target: int = TARGET_BYTES, *, flush: bool = False) -> int:
        """Merges the planned runs and commits the result; returns the version it leaves. With
        ``flush``, tiers of two shards or more are merged too."""
        base = self.manifest()
        shards = _shards(base)
        runs = self.plan(shards, target, 2 if flush else FANOUT)
        if not runs:
            return base["version"]
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        fresh: list[Shard] = []
        for lo in range(0, len(runs), RUNS_A_JOB):
            parts = [self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.name}" for s in run]).coalesce(1) for run in runs[lo : lo + RUNS_A_JOB]]
            folder = f"data/merged-{uuid.uuid4().hex}"
            with _separate_unions(self.spark):
                reduce(DataFrame.union, parts).write.parquet(f"{self.root}/{folder}")
            fresh += self._written(folder)
        gone = {s.name for run in runs for s in run}
        return self.commit(base, [*(s for s in shards if s.name not in gone), *fresh], base["schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        held = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(held["schema"]))
        if not held["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n, _ in held["shards"]])

    def vacuum(self, keep: int = 1, least_age: float = 86400.0) -> int:
        """Removes versions but the last ``keep``, and data files that none of these names and that are
        at least ``least_age`` seconds old, as are manifests that were never finished."""
        last = self.manifest()["version"]
        whole = [v for v in self.versions() if v <= last]
        live = {n for v in whole[-keep:] for n, _ in self.manifest(v)["shards"]}
        removed = 0
        for folder, _ in self._list("data"):
            for name, _ in self._list(f"data/{folder}"):
                at = f"data/{folder}/{name}"
                if name.startswith("part-") and at not in live and self._age(at) >= least_age:
                    self._fs.delete(self._path(at), False)
                    removed += 1
        for v in [*whole[:-keep], *(v for v in self.versions() if v > last and self._age(f"manifest/{v:012d}.json") >= least_age)]:
            self._fs.delete(self._path(f"manifest/{v:012d}.json"), False)
        return removed

    def _age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000


@contextlib.contextmanager
def _separate_unions(spark: SparkSession):
    """Keeps a union's single-partition inputs apart; Spark would else join them in one task."""
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _shards(held: dict) -> list[Shard]:
    return [Shard(n, size) for n, size in held["shards"]]


def _drain(jvm, stream) -> str:
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    out = []
    while (line := reader.readLine()) is not None:
        out.append(line)
    return "\n".join(out)


def op8(docs: DataFrame) -> DataFrame:
    """Appends the whole table as arrivals, compacts them, drops the merged inputs and reads the
    committed version back: one row a document, with a digest of its stored text."""
    spark = docs.sparkSession
    store = ShardStore(spark, temporary(spark, "store"))
    store.append(docs)
    version = store.compact(flush=True)
    store.vacuum(least_age=0.0)  # no other writer knows of this store
    raw = F.encode("text", "UTF-8")
    return store.read(version).select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("text_sha256"))


#: DuckDB twin of op8: compaction keeps every row as it was.
OP8_SQL = "SELECT doc_id, lang, source, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"
