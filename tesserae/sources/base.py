"""Document sources: one interface over folders, tables, web addresses and loader objects.

A source lists and reads its documents as one DataFrame ``(uri, path, size, mtime, content_type, etag,
http_status, fetch_duration_ms, text, error)``; its capabilities tell the ingestion plan what it can skip.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.store import touched
from tesserae.sources import files

COLUMNS = {"uri": "string", "path": "string", "size": "long", "mtime": "timestamp", "content_type": "string", "etag": "string", "http_status": "int", "fetch_duration_ms": "int", "text": "string", "error": "string"}


@dataclass(frozen=True)
class Capabilities:
    incremental: bool = False
    last_modified: bool = False
    etag: bool = False
    streaming: bool = False
    read_only: bool = True
    document_metadata: bool = False


def shaped(rows: DataFrame) -> DataFrame:
    """A listing's columns; those that a source does not know are null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


class Source:
    """The interface; ``read`` alone has to be given."""

    capabilities = Capabilities()

    def read(self) -> DataFrame:
        raise NotImplementedError

    def listing(self) -> DataFrame:
        """What is there, without the texts."""
        return self.read().drop("text")

    def fetch(self, rows: DataFrame) -> DataFrame:
        """Adds ``text`` and ``error`` to some rows of the listing; given by sources that know
        modification times."""
        raise NotImplementedError

    def check_modified(self, stored: DataFrame) -> DataFrame:
        """``(path, touched)`` against stored ``(path, mtime)``; all, where times are not known."""
        if self.capabilities.last_modified:
            return touched(stored, self.listing())
        return self.listing().select("path", F.lit(True).alias("touched"))


@dataclass(frozen=True)
class Settings:
    """How a folder is read."""

    root: str
    patterns: tuple[str, ...] = tuple(files.DEFAULT_PATTERNS)
    encoding: str = "utf-8"
    follow_symlinks: bool = False
    metadata_profile: str | None = None

    @classmethod
    def of(cls, uri: str, config: dict | None = None) -> Settings:
        """From a ``file://`` address or a bare path, and a collection's settings; ``glob_patterns``
        count before the older single ``glob_pattern``."""
        config = config or {}
        parsed = urlparse(uri)
        given = config.get("glob_patterns")
        if isinstance(given, str) and "\n" in given:
            given = given.split("\n")
        patterns = files.parse_patterns(config.get("glob_pattern") if given is None else given)
        follow = str(config.get("follow_symlinks", False)).lower() in ("true", "1", "yes")
        return cls(unquote(parsed.path) if parsed.scheme == "file" else uri, tuple(patterns), config.get("encoding", "utf-8"), follow, config.get("metadata_profile"))


@dataclass
class FolderSource(Source):
    spark: SparkSession
    settings: Settings
    capabilities = Capabilities(incremental=True, last_modified=True, document_metadata=True)

    def read(self) -> DataFrame:
        return self.fetch(self.listing())

    def listing(self) -> DataFrame:
        s = self.settings
        return files.list_files(self.spark, s.root, list(s.patterns), follow_symlinks=s.follow_symlinks)

    def fetch(self, rows: DataFrame) -> DataFrame:
        return files.read_texts(rows, self.settings.encoding)


@dataclass
class DirectorySource(Source):
    """A folder's files by suffix instead of patterns."""

    spark: SparkSession
    root: str
    recursive: bool = True
    suffixes: tuple[str, ...] = ()
    capabilities = Capabilities(incremental=True, last_modified=True)

    @classmethod
    def of(cls, spark: SparkSession, uri: str, config: dict | None = None) -> DirectorySource:
        config = config or {}
        suffixes = tuple(s for s in str(config.get("suffixes", "")).replace(",", " ").split())
        return cls(spark, uri, str(config.get("recursive", True)).lower() in ("true", "1", "yes"), suffixes)

    def read(self) -> DataFrame:
        return self.fetch(self.listing())

    def listing(self) -> DataFrame:
        return files.list_directory(self.spark, self.root, recursive=self.recursive, suffixes=list(self.suffixes))

    def fetch(self, rows: DataFrame) -> DataFrame:
        return files.read_texts(rows)


@dataclass
class TableSource(Source):
    """Documents of a Parquet table with ``path`` and ``text``."""

    spark: SparkSession
    root: str
    capabilities = Capabilities(incremental=True)

    def read(self) -> DataFrame:
        return shaped(self.spark.read.parquet(self.root))


@dataclass
class WebSource(Source):
    spark: SparkSession
    urls: list[str]
    plain: bool = True

    def read(self) -> DataFrame:
        return shaped(files.read_web(self.spark, self.urls, plain=self.plain))


@dataclass
class LoaderSource(Source):
    """What an object with ``load_data()`` gives; it is loaded once."""

    spark: SparkSession
    loader: object
    options: dict = field(default_factory=dict)
    _rows: DataFrame | None = None

    def read(self) -> DataFrame:
        if self._rows is None:
            self._rows = files.read_loader(self.spark, self.loader, **self.options)
        return shaped(self._rows)


class SourceRegistry:
    """Source kinds by name."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable[..., Source]] = {
            "filesystem": lambda spark, uri, config=None: FolderSource(spark, Settings.of(uri, config)),
            "directory": DirectorySource.of,
            "parquet": lambda spark, uri, config=None: TableSource(spark, uri),
            "web": lambda spark, uri, config=None: WebSource(spark, uri.split()),
        }

    def register(self, kind: str, make: Callable[..., Source]) -> None:
        self._makers[kind] = make

    def create(self, kind: str, spark: SparkSession, uri: str, config: dict | None = None) -> Source:
        if kind not in self._makers:
            raise ValueError(f"unknown source type {kind!r}; known: {', '.join(sorted(self._makers))}")
        return self._makers[kind](spark, uri, config)
