"""Frontmatter metadata by profile: a registry of profiles, and an Arrow-batched function.

A profile takes a text and gives tags, the tags as written, and attributes. The registry tells
by path patterns, then by detectors of the text, which one a document calls for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import CODE, FENCED, FRONTMATTER, TAG

_FRONT, _FENCE, _CODE, _INLINE = (re.compile(p) for p in (FRONTMATTER, FENCED, CODE, TAG))
SCHEMA = "profile string, tags array<string>, source_tags array<string>, attributes string"


@dataclass(frozen=True)
class Metadata:
    tags: frozenset[str] = frozenset()
    source_tags: tuple[str, ...] = ()
    attributes: dict = field(default_factory=dict)
    profile: str = ""

    def merge(self, other: Metadata) -> Metadata:
        """Tags united, tags as written one after the other, values of one attribute as a list."""
        both = dict(self.attributes)
        as_list = lambda v: v if isinstance(v, list) else [v]
        for k, v in other.attributes.items():
            both[k] = as_list(both[k]) + as_list(v) if k in both else v
        return Metadata(self.tags | other.tags, self.source_tags + other.source_tags, both, self.profile or other.profile)


def field_tags(value) -> list[str]:
    """Tags of a frontmatter field. Lists give their items (nulls and blanks left out); a text is
    split at commas, or where ``#one #two`` follow each other into words, and else is one tag; any
    other true value is its text."""
    if isinstance(value, str):
        several = value.split(",") if "," in value else re.findall(r"\w+", value) if re.search(r"#\w+\s+#\w+", value) else [value]
    elif isinstance(value, list):
        several = [str(v) for v in value if v is not None]
    else:
        several = [str(value)] if value else []
    return [t for t in map(str.strip, several) if t]


def read_frontmatter(text: str) -> tuple[dict, str]:
    """The parsed block and the body; a block that is no mapping is kept under ``_raw``, and one
    that does not parse counts as text."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    try:
        import yaml

        value = yaml.safe_load(m[1])
    except Exception:
        return {}, text
    return ({} if value is None else value if isinstance(value, dict) else {"_raw": value}), text[m.end() :]


def normal(tag: str) -> str:
    return tag.lstrip("#").lower().strip()


def prefixes(tag: str, separator: str) -> set[str]:
    """A hierarchical tag and its prefixes, as ``text.nested_tags`` has them."""
    parts = tag.lstrip(separator).split(separator)
    return {separator.join(parts[: i + 1]) for i in range(len(parts))} | ({""} if tag.startswith(separator) else set())


@dataclass(frozen=True)
class Profile:
    """Which fields hold tags and attributes, how attributes are written, and which separator makes
    tags hierarchical. ``lists`` are attributes read like tags; ``kept`` ones keep lists of texts."""

    name: str
    tag_fields: tuple[str, ...] = ("tags",)
    attributes: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    kept: tuple[str, ...] = ()
    true_only: bool = False
    separator: str = ""

    def _attribute(self, name: str, value):
        if name in self.lists:
            return field_tags(value) or None
        if name in self.kept and isinstance(value, list):
            return [str(v) for v in value]
        if value is None or (self.true_only and not value) or (name in self.kept and isinstance(value, dict)):
            return None
        return str(value)

    def extract(self, text: str) -> Metadata:
        front, rest = read_frontmatter(text)
        found = [t for f in self.tag_fields for t in field_tags(front.get(f))]
        inline = _INLINE.findall(_CODE.sub(" ", _FENCE.sub(" ", rest)))
        tags = {normal(t) for t in [*found, *inline]}
        if self.separator:
            tags = {p for t in tags for p in prefixes(t, self.separator)}
        held = {a: self._attribute(a, front[a]) for a in (*self.lists, *self.attributes) if a in front}
        return Metadata(frozenset(tags), (*found, *("#" + t for t in inline)), {a: v for a, v in held.items() if v is not None}, self.name)


_COMMON = ("title", "author", "date", "created", "modified")
#: The fields that each profile reads.
GENERIC = Profile("generic", ("tags", "tag", "keywords", "categories", "category"), (*_COMMON, "description"), kept=(*_COMMON, "description"))
OBSIDIAN = Profile("obsidian", ("tags",), ("cssclass", *_COMMON), lists=("aliases",), kept=("cssclass",), true_only=True, separator="/")
DRAFTS = Profile("drafts", ("tags",), ("uuid", "flagged", "created_at", "modified_at", "created_latitude", "created_longitude"))
DRAFTS_NESTED = Profile("drafts", DRAFTS.tag_fields, DRAFTS.attributes, separator="-")


@dataclass(frozen=True)
class _Entry:
    profile: Profile
    paths: tuple[re.Pattern, ...]
    detectors: tuple[Callable[[str, str], bool], ...]
    priority: int


class Registry:
    """Profiles by name; the one of the highest priority that knows a document's path or text is
    its profile, among equals the one registered first."""

    def __init__(self) -> None:
        self._entries: dict[str, _Entry] = {}

    def register(self, profile: Profile, *, path_patterns: tuple[str, ...] = (), detectors: tuple[Callable[[str, str], bool], ...] = (), priority: int = 0, override: bool = False) -> None:
        if profile.name in self._entries and not override:
            raise ValueError(f"profile {profile.name!r} is registered; override=True replaces it")
        self._entries[profile.name] = _Entry(profile, tuple(re.compile(p, re.I) for p in path_patterns), tuple(detectors), priority)

    def unregister(self, name: str) -> bool:
        return self._entries.pop(name, None) is not None

    def get(self, name: str) -> Profile | None:
        return self._entries[name].profile if name in self._entries else None

    def names(self) -> list[str]:
        return list(self._entries)

    def detect(self, text: str, path: str) -> Profile | None:
        for e in sorted(self._entries.values(), key=lambda e: -e.priority):
            if any(p.search(path) for p in e.paths) or any(_safe(d, text, path) for d in e.detectors):
                return e.profile
        return None

    def detect_or_default(self, text: str, path: str, default: str = "generic") -> Profile:
        found = self.detect(text, path) or self.get(default)
        if found is None:
            raise ValueError(f"default profile {default!r} is not registered")
        return found


def _safe(detector: Callable[[str, str], bool], text: str, path: str) -> bool:
    try:
        return bool(detector(text, path))
    except Exception:  # a detector that fails does not know the text
        return False


def default_registry() -> Registry:
    out = Registry()
    note = lambda text, path: bool(re.search(r"\[\[[^\]]+\]\]", text) or "%%" in text or re.search(r"#[a-zA-Z]+/[a-zA-Z]+", text))
    draft = lambda text, path: bool(re.search(r"(?i)uuid:\s*[a-f0-9-]{36}", text) or "created_latitude:" in text)
    out.register(OBSIDIAN, path_patterns=(r"\.obsidian", "vault"), detectors=(note,), priority=10)
    out.register(DRAFTS, path_patterns=("drafts",), detectors=(draft,), priority=10)
    out.register(GENERIC, priority=-100)
    return out


def extract(text: str, profile: Profile) -> dict:
    found = profile.extract(text or "")
    return {"profile": found.profile, "tags": sorted(found.tags), "source_tags": list(found.source_tags), "attributes": json.dumps(found.attributes, sort_keys=True)}


def document_metadata(text: Column, path: Column, forced: Column | None = None, registry: Registry | None = None) -> Column:
    """``struct<profile, tags, source_tags, attributes>`` of a text, by an Arrow-batched function.
    ``forced`` names a registered profile where it is not null, else path and text decide."""
    known = registry or default_registry()

    def apply(text: pd.Series, path: pd.Series, forced: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p, f in zip(text, path, forced):
            profile = (known.get(f) if f else None) or known.detect_or_default(t or "", p or "")
            rows.append(extract(t, profile))
        return pd.DataFrame(rows, columns=["profile", "tags", "source_tags", "attributes"])

    return F.pandas_udf(apply, SCHEMA)(text, path, F.lit(None).cast("string") if forced is None else forced)
