"""Source collections: a small table of named sources, and its operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.files import parse_patterns


class Unknown(LookupError):
    """No such collection."""


class Exists(ValueError):
    """A collection of this name exists."""


def find(table: DataFrame, name: str | None = None, number: int | None = None):
    """The collection of a name or an id as a row; None if there is none."""
    hit = table.where(F.col("name") == name if name is not None else F.col("id") == number)
    return hit.first()


def need(table: DataFrame, name: str):
    row = find(table, name)
    if row is None:
        raise Unknown(f"collection {name!r} not found")
    return row


def listed(table: DataFrame) -> DataFrame:
    return table.orderBy("name")


def create(table: DataFrame, name: str, pwd: str, patterns: list[str] | str | None, now: Column, kind: str = "filesystem", config: dict[str, str] | None = None) -> DataFrame:
    """Adds a collection; its patterns are kept in its settings too."""
    if find(table, name) is not None:
        raise Exists(f"collection {name!r} exists")
    listed_ = parse_patterns(patterns)
    settings = {**(config or {}), "glob_patterns": "\n".join(listed_)}
    pairs = [F.lit(x) for kv in settings.items() for x in kv]
    number = table.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = number.select(
        "id", F.lit(name).alias("name"), F.lit(pwd).alias("pwd"), F.array(*map(F.lit, listed_)).alias("glob_patterns"), F.lit(kind).alias("source_type"), F.create_map(*pairs).alias("source_config"), now.alias("created_at"), now.alias("updated_at")
    )
    return table.unionByName(row)


def _changed(table: DataFrame, which: str, now: Column, **values: Column) -> DataFrame:
    mine = F.col("name") == which
    values["updated_at"] = now
    return table.select(*[F.when(mine, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def rename(table: DataFrame, old: str, new: str, now: Column) -> DataFrame:
    need(table, old)
    if new != old and find(table, new) is not None:
        raise Exists(f"collection {new!r} exists")
    return _changed(table, old, now, name=F.lit(new))


def update_path(table: DataFrame, name: str, pwd: str, now: Column, patterns: list[str] | str | None = None) -> DataFrame:
    """Moves a collection to another folder; patterns stay unless given."""
    need(table, name)
    values = {"pwd": F.lit(pwd)}
    if patterns:
        values["glob_patterns"] = F.array(*map(F.lit, parse_patterns(patterns)))
        values["source_config"] = F.map_concat(F.map_filter("source_config", lambda k, v: k != "glob_patterns"), F.create_map(F.lit("glob_patterns"), F.lit("\n".join(parse_patterns(patterns)))))
    return _changed(table, name, now, **values)
