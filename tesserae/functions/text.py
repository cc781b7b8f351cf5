"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Input formats.
FRONTMATTER = r"(?s)\A---\s*\n(.*?)\n?---\s*\n?"
FENCED, CODE, TAG = r"(?s)```.*?```", r"`[^`]+`", r"(?:^|[\s(\[\"{])#([a-zA-Z][a-zA-Z0-9_/-]*)"
#: The content type of each suffix.
MIME_TYPES = {
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
    ".rst": "text/x-rst",
    ".html": "text/html",
    ".htm": "text/html",
    ".json": "application/json",
    ".yaml": "text/yaml",
    ".yml": "text/yaml",
    ".xml": "application/xml",
    ".csv": "text/csv",
}


def _accents() -> dict[str, str]:
    """Lower-case Latin letters with marks and their plain ones, by canonical decomposition."""
    base = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]) if c.islower()}
    return {c: b for c, b in base.items() if b != c and b.isascii()}


ACCENTS = _accents()
_PLAIN = str.maketrans(ACCENTS)


def fold(text: Column) -> Column:
    """Lower-case text without diacritics."""
    return F.translate(text, "".join(ACCENTS), "".join(ACCENTS.values()))


def fold_text(text: str) -> str:
    return text.translate(_PLAIN)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def title(text: Column, fallback: Column) -> Column:
    """The first line that starts with ``# ``, without the mark, else the fallback."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("# "))
    return F.when(F.size(lines) > 0, F.trim(F.substring(F.get(lines, F.lit(0)), 3, 1 << 30))).otherwise(fallback)


def is_indexable(text: Column) -> Column:
    """False for blank texts and for a lone heading with nothing under it."""
    body = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"(?U)^\s+|\s+$", "")
    return (body != "") & ~(body.startswith("# ") & ~body.contains("\n"))


def frontmatter(text: Column) -> Column:
    """The YAML block between the opening and closing marks; empty if there is none."""
    return F.regexp_extract(text, FRONTMATTER, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def inline_tags(text: Column) -> Column:
    """``#tags`` outside code, in order, duplicates kept."""
    plain = F.regexp_replace(F.regexp_replace(text, FENCED, " "), CODE, " ")
    return F.regexp_extract_all(plain, F.lit(TAG), F.lit(1))


def normalize_tag(tag: Column) -> Column:
    return F.trim(F.lower(F.ltrim(tag, F.lit("#"))))


def nested_tags(tag: Column, separator: str = "/") -> Column:
    """A hierarchical tag and its prefixes: ``a/b`` gives ``a`` and ``a/b``. Leading separators
    leave an empty tag and go: ``/a`` gives the empty tag and ``a``."""
    bare = F.ltrim(tag, F.lit(separator))
    parts = F.split(bare, separator)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    return F.when(tag.startswith(separator), F.array_distinct(F.concat(F.array(F.lit("")), steps))).otherwise(steps)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def mime_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit("text/plain"))


def profile(path: Column, text: Column) -> Column:
    """The metadata profile that a path or a text calls for; paths come before contents."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.obsidian|vault"), "obsidian")
        .when(low.rlike("drafts"), "drafts")
        .when(text.rlike(r"\[\[[^\]]+\]\]") | text.contains("%%") | text.rlike(r"#[a-zA-Z]+/[a-zA-Z]+"), "obsidian")
        .when(text.rlike(r"(?i)uuid:\s*[a-f0-9-]{36}") | text.contains("created_latitude:"), "drafts")
        .otherwise("generic")
    )


def variations(reply: Column, most: int) -> Column:
    """Query variations in a model's reply: one a line, without numbers, bullets or end marks. A
    number's place is the first three characters."""
    clean = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    steps = [lambda x: F.when(x.rlike(r"^\d") & F.substring(x, 1, 3).contains("."), F.trim(F.substring(x, 4, 1 << 30))).otherwise(x)]
    unmark = lambda b: lambda x: F.when(x.startswith(b), F.trim(F.substring(x, 3, 1 << 30))).otherwise(x)
    steps += [unmark(b) for b in ("- ", "* ", "• ")]
    steps += [lambda x: F.trim(F.regexp_replace(x, r"[.?!:]$", ""))]
    for step in steps:
        clean = F.transform(clean, step)
    return F.slice(F.filter(clean, lambda x: x != ""), 1, most)


def mask_secrets(config: Column) -> Column:
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).rlike("token|password"), F.lit("***")).otherwise(v))
