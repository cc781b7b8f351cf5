"""Folders as a Python data source: ``spark.read.format("tesserae_files")``.

It lists every file below a folder, hidden names too (Spark's own file sources leave out names that
begin with a dot or an underscore), and reads no content. The driver descends only until there are
``WIDTH`` folders; each is then listed by a task of its own. ``fetch`` reads the files of listed
rows, in tasks too. Local paths have to be mounted on all nodes; addresses with a scheme go through
Arrow's file systems.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "tesserae_files"
SCHEMA = "uri string, path string, size long, mtime timestamp, linked boolean"
WIDTH = 64
#: Content that a task holds at once, but for a single larger file.
FETCH_BYTES = 16 << 20


def _local(root: str) -> str | None:
    """A root as a path of the local file system; None for one of another."""
    parsed = urlparse(root)
    return unquote(parsed.path) if parsed.scheme == "file" else root if len(parsed.scheme) < 2 else None


class _Mounted:
    """Entries of local folders: ``(name, is folder, size, mtime in µs, is link)``."""

    def __init__(self, root: str, follow: bool) -> None:
        self.root, self.follow = root.rstrip("/") or "/", follow

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int, int, bool]]:
        with os.scandir(os.path.join(self.root, folder)) as found:
            for e in found:
                link = e.is_symlink()
                try:
                    if e.is_dir(follow_symlinks=True):
                        if not link or (self.follow and not self._around(e.path)):
                            yield e.name, True, 0, 0, link
                    elif e.is_file():
                        s = e.stat()
                        yield e.name, False, s.st_size, s.st_mtime_ns // 1000, link
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue

    @staticmethod
    def _around(link: str) -> bool:
        """Whether a link leads to a folder that it lies in."""
        return os.path.realpath(os.path.dirname(link)).startswith(os.path.realpath(link))

    def uri(self, path: str) -> str:
        return "file://" + quote(os.path.join(os.path.abspath(self.root), path))


class _Remote:
    """The same of a file system that Arrow knows by the address's scheme."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.base, self.select = root.rstrip("/"), fs.FileSelector
        self.fs, self.root = fs.FileSystem.from_uri(root)

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int, int, bool]]:
        for f in self.fs.get_file_info(self.select(f"{self.root}/{folder}".rstrip("/"))):
            yield f.base_name, not f.is_file, f.size or 0, (f.mtime_ns or 0) // 1000, False

    def uri(self, path: str) -> str:
        return f"{self.base}/{quote(path)}"


def _tree(root: str, follow: bool):
    local = _local(root)
    return _Remote(root) if local is None else _Mounted(local, follow)


@dataclass
class Folder(InputPartition):
    path: str
    below: bool


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.follow = options["path"], options.get("follow_symlinks", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        tree, wait, flat = _tree(self.root, self.follow), [""], []
        while wait and len(wait) + len(flat) < WIDTH:
            flat.append(wait.pop(0))
            wait += [f"{flat[-1]}{e[0]}/" for e in tree.entries(flat[-1]) if e[1]]
        return [*(Folder(f, False) for f in flat), *(Folder(f, True) for f in wait)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        tree, todo = _tree(self.root, self.follow), [partition.path]
        while todo:
            folder, rows = todo.pop(), []
            for name, inner, size, mtime, link in tree.entries(folder):
                if inner:
                    if partition.below:
                        todo.append(f"{folder}{name}/")
                elif self.follow or not link:
                    rows.append((tree.uri(folder + name), folder + name, size, mtime, link))
                if len(rows) == 4096:
                    yield _listed(rows)
                    rows = []
            if rows:
                yield _listed(rows)


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["uri", "path", "size", "mtime", "linked"])


class FilesSource(DataSource):
    """Options: ``path`` and ``follow_symlinks``; files behind symbolic links are left out unless
    they are followed, and a link to a folder around it is never."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)


def listing(spark: SparkSession, root: str, *, follow_symlinks: bool = False) -> DataFrame:
    """``uri, path, size, mtime, linked`` of every file below a folder; a root that is no folder raises."""
    local = _local(root)
    if local is not None and not os.path.exists(local):
        raise FileNotFoundError(f"no such folder: {root}")
    if local is not None and not os.path.isdir(local):
        raise NotADirectoryError(f"not a folder: {root}")
    spark.dataSource.register(FilesSource)
    return spark.read.format(FORMAT).option("path", root).option("follow_symlinks", str(follow_symlinks).lower()).load()


def _open(uri: str) -> bytes:
    local = _local(uri)
    if local is not None:
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def fetch(rows: DataFrame) -> DataFrame:
    """Adds ``content`` and ``failure`` to rows that have a ``uri``: the files are dealt over the tasks
    by their addresses, and one that can't be read fails alone."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = rows.withColumns({"content": F.lit(None).cast("binary"), "failure": F.lit(None).cast("string")}).schema
    at = rows.columns.index("uri")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, held, size = 0, [], 0
            for n, uri in enumerate(batch.column(at).to_pylist()):
                try:
                    held.append((_open(uri), None))
                except OSError as e:
                    held.append((None, str(e)))
                size += len(held[-1][0] or b"")
                if size >= FETCH_BYTES:
                    yield _with_content(batch.slice(lo, n + 1 - lo), held, schema.names)
                    lo, held, size = n + 1, [], 0
            if held:
                yield _with_content(batch.slice(lo), held, schema.names)

    return rows.repartition(parts, "uri").mapInArrow(read, schema)


def _with_content(batch: pa.RecordBatch, held: list[tuple], names: list[str]) -> pa.RecordBatch:
    content, failure = zip(*held)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary()), pa.array(failure, pa.string())], names=names)
