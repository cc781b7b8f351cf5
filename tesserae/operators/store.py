"""Snapshots of the document store: content-addressed upserts, soft deletes, index upkeep.

An operator takes the stored and the incoming rows and returns the next snapshot, or the rows that
change, of which a warehouse replaces the buckets that they touch (single writer).
"""

from __future__ import annotations

import posixpath
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.staging import hadoop_path

KEYS = ["source_collection_id", "path"]
ID_SHARDS = 256


def new_content(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A row for each hash that is not stored yet: the least of the new ones."""
    rest = [c for c in stored.columns if c != "hash"]
    rest.sort(key=lambda c: c != "created_at")
    fresh = new.groupBy("hash").agg(F.min(F.struct(*rest)).alias("_r")).join(stored.select("hash"), "hash", "left_anti")
    return fresh.select("hash", "_r.*").select(*stored.columns)


def upsert_content(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Adds hashes that are not stored yet; the first writer of a hash stays."""
    return stored.unionByName(new_content(stored, new))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def largest_id(documents: DataFrame) -> DataFrame:
    return documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))


def upsert_documents(stored: DataFrame, new: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """By collection and path: known rows take the new title, hash, time and whatever else ``new``
    brings, and become active again; new ones get ids after the largest. Of rows of one key the
    last written counts. ``is_new`` tells them apart.

    New ids are numbered within ``ID_SHARDS`` hash shards, so that no task sees all of them; ids are
    unique and the same on every run. They come after the largest of ``stored``, or after the one of
    ``top(_top)`` where ``stored`` is but the part of a table that changes.
    """
    shards = ID_SHARDS
    new = latest(new, KEYS, ["modified_at", "hash"])
    given = [c for c in stored.columns if c in new.columns and c not in KEYS]
    top = largest_id(stored) if top is None else top
    add = new.join(stored.select(*KEYS), KEYS, "left_anti").crossJoin(F.broadcast(top))  # one row
    add = add.withColumn("_shard", F.pmod(F.xxhash64(*KEYS), F.lit(shards)))
    number = F.row_number().over(Window.partitionBy("_shard").orderBy(*KEYS))
    add = add.withColumn("id", F.col("_top") + (number - 1) * shards + F.col("_shard") + 1)
    changed = new.select(*KEYS, F.struct(*given).alias("_n"))
    merged = stored.join(changed, KEYS, "left")
    value = lambda c: F.coalesce(F.col("_n")[c], F.col(c)).alias(c) if c in given else (F.col(c) | F.col("_n").isNotNull()).alias(c) if c == "active" else F.col(c)
    known = merged.select(*[value(c) for c in stored.columns], F.lit(False).alias("is_new"))
    types = dict(stored.dtypes)
    absent = lambda c: F.lit(True).alias(c) if c == "active" else F.lit(None).cast(types[c]).alias(c)
    fresh = add.select(*[F.col(c) if c in add.columns and c != "active" else absent(c) for c in stored.columns], F.lit(True).alias("is_new"))
    return known.unionByName(fresh)


def soft_delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    mark = gone.select(*KEYS).distinct().withColumn("_gone", F.lit(True))
    return stored.join(mark, KEYS, "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).select(*stored.columns)


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row a key: the last in ``order``, of equals any one."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_change(stored: DataFrame, keys: list[str], rows: DataFrame | None, gone: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """The stored rows without those of the keys of ``gone`` and ``rows``, and ``rows``, of which with
    ``order`` the last of each key counts. Null keys are equal."""
    left = stored
    for part in (gone, rows):
        if part is not None:
            named = part.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            left = left.join(named, same, "left_anti")
    if rows is None:
        return left
    return left.unionByName((last_of(rows, keys, order) if order else rows).select(*stored.columns))


def replace_rows(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Last write wins on ``keys``: for metadata of a document or vectors of a hash. A key that comes
    twice in ``new`` is one row: the last in ``order``, or by all columns where none is given."""
    return apply_change(stored, keys, new, order=order or [c for c, t in new.dtypes if c not in keys and not t.startswith("map")] or keys)


def delete_rows(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_model(vectors: DataFrame, model: str) -> DataFrame:
    """The vectors without a model's, metadata and vector alike."""
    return vectors.where(~F.col("model").eqNullSafe(F.lit(model)))


def keep_live(rows: DataFrame, live: DataFrame, on: list[str]) -> DataFrame:
    """Drops what no live row refers to."""
    return rows.join(live.select(*on).distinct(), on, "left_semi")


def orphans(rows: DataFrame, live: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(live.select(*on), on, "left_anti")


def remove_collection(documents: DataFrame, content: DataFrame, collection: int) -> tuple[DataFrame, DataFrame]:
    """The documents without a collection's, and the content that any document still needs."""
    left = documents.where(F.col("source_collection_id") != collection)
    return left, keep_live(content, left, ["hash"])


def changes(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """``(path, change)`` of a listing against the store: new, modified or unchanged."""
    old = stored.select("path", F.col("hash").alias("_old"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("hash"), "modified").otherwise("unchanged")
    return listing.join(old, "path", "left").select("path", kind.alias("change"))


def touched(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """``(path, touched)`` by modification time alone, before any text is read: a file that is not
    stored, or has no stored time, counts as touched, and so does a stored file that is gone."""
    old, now = stored.select("path", F.col("mtime").alias("_old")), listing.select("path", F.col("mtime").alias("_now"))
    differs = F.col("_old").isNull() | F.col("_now").isNull() | (F.col("_old") != F.col("_now"))
    return old.join(now, "path", "full").select("path", differs.alias("touched"))


def stale(stored: DataFrame, listing: DataFrame) -> DataFrame:
    return stored.where("active").join(listing.select("path"), "path", "left_anti")


def needs_refresh(fetched, now, age: str):
    """Whether a fetch time is absent or older than ``age`` (an interval)."""
    return fetched.isNull() | (fetched < now - F.expr(f"INTERVAL {age}"))


def cache_documents(rows: DataFrame, base: str, name: str, *, partitions: int | None = None) -> DataFrame:
    """Writes the ``text`` of each ``(path, text)`` to ``<base>/<name>/<path>`` by the tasks that
    hold them, in the file system that Spark has for ``base``; gives ``(path, uri)``.

    Files are staged as Parquet rows by Spark and moved by no driver loop: every task opens its
    own files, so ``base`` has to be a folder that all nodes share.
    """
    root = base.removeprefix("file://").rstrip("/")
    if "://" in root:
        raise ValueError("the document cache needs a mounted folder; object stores take the content table itself")

    def write(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            paths, uris = batch.column(0).to_pylist(), []
            for path, text in zip(paths, batch.column(1)):
                at = posixpath.normpath(posixpath.join(root, name, path))
                if not at.startswith(f"{root}/{name}/"):
                    raise ValueError(f"{path!r} leaves the cache")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.part", "w", encoding="utf-8") as f:
                    f.write(text.as_py() or "")
                os.replace(f"{at}.part", at)  # a task that runs twice writes the same file
                uris.append("file://" + quote(at))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(uris, pa.string())], names=["path", "uri"])

    rows = rows.select("path", "text")
    return (rows.repartition(partitions, "path") if partitions else rows).mapInArrow(write, "path string, uri string")


def uncache_paths(rows: DataFrame, base: str, name: str) -> DataFrame:
    """Removes the cached files of ``(path)`` by the tasks that hold them, and folders that are left
    empty; gives ``(path, removed)``."""
    root = f"{base.removeprefix('file://').rstrip('/')}/{name}"

    def remove(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            paths, done = batch.column(0).to_pylist(), []
            for path in paths:
                at = posixpath.normpath(posixpath.join(root, path))
                done.append(at.startswith(f"{root}/") and os.path.isfile(at))
                if done[-1]:
                    os.remove(at)
                    up = os.path.dirname(at)
                    while up.startswith(root):
                        try:
                            os.rmdir(up)  # fails where anything is left
                        except OSError:
                            break
                        up = os.path.dirname(up)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(done, pa.bool_())], names=["path", "removed"])

    return rows.select("path").mapInArrow(remove, "path string, removed boolean")


def uncache_documents(spark, base: str, name: str, paths: list[str] | None = None) -> int:
    """Removes cached files of a collection, all of them without ``paths``; their count."""
    if paths is not None:
        rows = spark.createDataFrame([(p,) for p in paths], "path string")
        return uncache_paths(rows, base, name).where("removed").count()
    root, fs = hadoop_path(spark, f"{base.rstrip('/')}/{name}")
    if not fs.exists(root):
        return 0
    files, n = fs.listFiles(root, True), 0
    while files.hasNext():
        n += not files.next().getPath().getName().endswith(".crc")
    fs.delete(root, True)
    return n
