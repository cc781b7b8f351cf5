"""File sources: glob patterns with excludes, loader objects, and a registry by type."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import mime_type
from tesserae.functions.text import title as first_heading
from tesserae.sources import tree

DEFAULT_PATTERNS = ["**/*.md"]


def parse_patterns(patterns: list[str] | str | None) -> list[str]:
    if patterns is None or patterns == []:
        return list(DEFAULT_PATTERNS)
    return [patterns] if isinstance(patterns, str) else list(patterns)


def glob_regex(pattern: str) -> str:
    """A pattern as a regular expression over relative paths; ``**/x`` also matches at the root."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def _component(part: str) -> str:
    return "[^/]+" if part in ("*", "**") else "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part)


def match_regex(pattern: str) -> str:
    """A pattern as one over a path's last components: ``*.md`` fits ``d/b.md``, and ``**`` stands
    for one component. A leading ``**/`` may also stand for nothing, and ``**/name/**`` fits any
    path that has the component ``name``."""
    forms = ["(?:.*/)?" + "/".join(map(_component, pattern.strip("/").split("/")))]
    if pattern.startswith("**/"):
        rest = pattern[3:]
        forms.append(match_regex(rest)[1:-1] if rest.startswith("**/") else "(?:.*/)?" + "/".join(map(_component, rest.split("/"))))
        if rest.endswith("/**") and "/" not in rest[:-3]:
            forms.append("(?:.*/)?" + re.escape(rest[:-3]) + "(?:/.*)?")
    return "^(?:" + "|".join(forms) + ")$"


def split_patterns(patterns: list[str] | str | None) -> tuple[list[str], list[str]]:
    """Includes and ``!`` excludes; without an include it raises."""
    listed = parse_patterns(patterns)
    takes, drops = [p for p in listed if not p.startswith("!")], [p[1:] for p in listed if p.startswith("!")]
    if not takes:
        raise ValueError("at least one include pattern is needed")
    return takes, drops


def _any(path: Column, forms: list[str]) -> Column:
    hit = F.lit(False)
    for f in forms:
        hit = hit | path.rlike(f)
    return hit


def matches_patterns(path: Column, patterns: list[str] | str | None) -> Column:
    """Any include and no exclude, both over a path's last components."""
    takes, drops = split_patterns(patterns)
    return _any(path, list(map(match_regex, takes))) & ~_any(path, list(map(match_regex, drops)))


def lists_patterns(path: Column, patterns: list[str] | str | None) -> Column:
    """What listing a folder takes: includes are anchored at the folder, with a recursive ``**``."""
    takes, drops = split_patterns(patterns)
    return _any(path, list(map(glob_regex, takes))) & ~_any(path, list(map(match_regex, drops)))


def list_files(spark: SparkSession, root: str, patterns: list[str] | str | None = None, *, follow_symlinks: bool = False) -> DataFrame:
    """``uri, path, size, mtime, content_type`` of the files of a folder that the patterns list, hidden
    names too; no content is read. Files behind symbolic links are left out unless followed."""
    found = tree.listing(spark, root, follow_symlinks=follow_symlinks).where(lists_patterns(F.col("path"), patterns))
    return found.select("uri", "path", "size", "mtime", mime_type(F.col("path")).alias("content_type"))


def read_texts(rows: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """Adds ``text`` and ``error`` to listed files: decoded, with ``\\n`` line ends; a file that does
    not decode, or can't be read, has an error and no text."""
    utf8 = encoding.lower().replace("_", "-") in ("utf-8", "utf8")
    good = F.is_valid_utf8(F.col("content")) if utf8 else F.lit(True)
    text = F.regexp_replace(F.decode("content", "UTF-8" if utf8 else encoding), "\r\n?", "\n")
    read = tree.fetch(rows)
    return read.select(*rows.columns, F.when(F.col("failure").isNull() & good, text).alias("text"), F.when(F.col("failure").isNotNull(), F.col("failure")).when(~good, F.lit("not valid UTF-8")).alias("error"))


def read_files(spark: SparkSession, root: str, patterns: list[str] | str | None = None, *, encoding: str = "utf-8", follow_symlinks: bool = False) -> DataFrame:
    """``uri, path, size, mtime, content_type, text, error``: the files that ``list_files`` lists."""
    return read_texts(list_files(spark, root, patterns, follow_symlinks=follow_symlinks), encoding)


def read_directory(spark: SparkSession, root: str, *, recursive: bool = True, suffixes: list[str] | None = None) -> DataFrame:
    """The files of a folder as ``read_files`` gives them, chosen by suffix instead of patterns."""
    return read_texts(list_directory(spark, root, recursive=recursive, suffixes=suffixes))


def list_directory(spark: SparkSession, root: str, *, recursive: bool = True, suffixes: list[str] | None = None) -> DataFrame:
    rows = list_files(spark, root, ["**/*"])
    if not recursive:
        rows = rows.where(~F.col("path").contains("/"))
    if suffixes:
        rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    return rows


def html_text(html: Column) -> Column:
    """A page's text: tags dropped, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def read_pages(pages: DataFrame) -> DataFrame:
    """Stored web pages as documents."""
    return pages.select(F.col("url").alias("path"), html_text(F.col("html")).alias("text"))


def read_web(spark: SparkSession, urls: list[str], *, plain: bool = True, timeout: float = 30.0) -> DataFrame:
    """``uri, path, text, error, mtime, content_type, etag, http_status, fetch_duration_ms`` of the given
    addresses, fetched by the tasks; an address that fails has an error and no text."""
    schema = "uri string, text string, error string, mtime timestamp, content_type string, etag string, http_status int, fetch_duration_ms int"

    def fetch(batches):
        import time
        import urllib.error
        import urllib.request
        from email.utils import parsedate_to_datetime

        for batch in batches:
            rows = []
            for url in batch["uri"]:
                began, text, error, status, head = time.monotonic(), None, None, None, {}
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
                        head, status = reply.headers, getattr(reply, "status", None)
                        text = reply.read().decode(getattr(head, "get_content_charset", lambda: None)() or "utf-8", "replace")
                except urllib.error.HTTPError as e:
                    error, status, head = str(e), e.code, e.headers
                except Exception as e:
                    error = str(e)
                try:
                    changed = pd.Timestamp(parsedate_to_datetime(head["Last-Modified"])).tz_convert("UTC").tz_localize(None) if head and head.get("Last-Modified") else None
                except (TypeError, ValueError):
                    changed = None
                kind = (head.get("Content-Type") or "").partition(";")[0].strip() if head else ""
                rows.append((url, text, error, changed, kind or None, head.get("ETag") if head else None, status, int(1000 * (time.monotonic() - began))))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out.astype({"http_status": "Int32", "fetch_duration_ms": "Int32", "mtime": "datetime64[ns]"})

    rows = spark.createDataFrame([(u,) for u in urls], "uri string").mapInPandas(fetch, schema).withColumn("path", F.col("uri"))
    return rows.withColumn("text", html_text(F.col("text"))) if plain else rows


def read_loader(spark: SparkSession, loader, *, path_key: str = "path", uri_key: str = "uri", title_key: str = "title", namespace: str = "", allow_multiple: bool = True, **options) -> DataFrame:
    """Rows of an object with ``load_data()``: ``uri, path, title, text, extra``. The uri is the
    metadata's, the object's id, or a hash; a uri that comes twice raises, and so does more than
    one object unless several are allowed. The title is the metadata's, the text's first heading
    or the path; all the metadata are kept in ``extra``."""
    docs = list(loader.load_data(**options))
    if len(docs) > 1 and not allow_multiple:
        raise ValueError(f"the loader gave {len(docs)} documents where one is allowed")
    rows = []
    for i, doc in enumerate(docs):
        meta = dict(getattr(doc, "metadata", None) or {})
        text = getattr(doc, "text", None) or ""
        uri = meta.get(uri_key) or getattr(doc, "id_", None) or "hash-" + hashlib.sha256(f"{namespace}{text}{sorted(meta.items())}".encode()).hexdigest()[:16]
        rows.append((str(uri), str(meta.get(path_key) or meta.get("id") or f"doc-{i}"), meta.get(title_key), text, {str(k): str(v) for k, v in meta.items()}))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a loader gave one uri twice")
    made = spark.createDataFrame(rows, "uri string, path string, title string, text string, extra map<string,string>")
    return made.withColumn("title", F.coalesce("title", first_heading(F.col("text"), F.col("path"))))
