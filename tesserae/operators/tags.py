"""Tag inference, retrieval, aliases and the tag ontology."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.staging import small

#: Our own small dictionaries; larger ones are loaded from JSON files.
ONTOLOGY = {"lang": ["en", "fr", "de", "es"], "proj": ["proj/src0", "proj/src1", "proj/src2"], "romance": ["fr", "es"], "world": ["lang", "proj"], "topic": [f"topic-{i}" for i in range(7)]}
ALIASES = {"english": "en", "french": "fr", "german": "de", "spanish": "es", "deutsch": "de"}
PARENT_WEIGHT = 0.7
MOST_HOPS = 10


@dataclass(frozen=True)
class Ontology:
    """A forest of tags, a dictionary that callers ship: each tag has one parent, the last that
    lists it."""

    pairs: tuple[tuple[str, str], ...]
    descriptions: dict[str, str] = field(default_factory=dict)
    parent_weight: float = PARENT_WEIGHT

    @property
    def parents(self) -> dict[str, str]:
        return {c: p for p, c in self.pairs}

    @property
    def tags(self) -> set[str]:
        return {t for pair in self.pairs for t in pair} | set(self.descriptions)

    def has_tag(self, tag: str) -> bool:
        return tag in self.tags

    def description(self, tag: str) -> str | None:
        return self.descriptions.get(tag)

    def children(self, tag: str) -> list[str]:
        return [c for p, c in self.pairs if p == tag]

    def closure(self, most: int = MOST_HOPS) -> list[tuple[str, str, int]]:
        """``(tag, ancestor, hop)``, nearest first; ``most`` hops also guard against cycles."""
        up, out = self.parents, []
        for tag in up:
            at, hop = tag, 0
            while at in up and hop < most:
                at, hop = up[at], hop + 1
                out.append((tag, at, hop))
        return out


def read_ontology(data: dict) -> Ontology:
    """From ``{tag: {children, description}}`` or ``{tag: [children]}``, plain or under ``tags``."""
    entries = data.get("tags", data)
    entries = {k: v if isinstance(v, dict) else {"children": v} for k, v in entries.items() if k != "parent_weight"}
    parent = {c: p for p, v in entries.items() for c in v.get("children", [])}
    told = {k: v["description"] for k, v in entries.items() if v.get("description")}
    told |= {k: "" for k in entries if k not in told}
    return Ontology(tuple((p, c) for c, p in parent.items()), told, data.get("parent_weight", PARENT_WEIGHT))


def load_ontology(path: str | None = None) -> Ontology:
    if not path:
        return read_ontology(ONTOLOGY)
    with open(path) as f:
        return read_ontology(json.load(f))


class Matcher:
    """Known tags and aliases, registered by name; what ``infer`` takes."""

    def __init__(self, tags: list[str] = (), aliases: dict[str, str] | None = None) -> None:
        self._tags: set[str] = set()
        self._aliases: dict[str, str] = {}
        self.register_tags(tags)
        for a, c in (aliases or {}).items():
            self.register_alias(a, c)

    def register_tags(self, tags) -> None:
        self._tags |= {t.lower() for t in tags}

    def register_alias(self, alias: str, canonical: str) -> None:
        self._aliases[alias.lower()] = canonical.lower()

    def clear(self) -> None:
        self._tags.clear()
        self._aliases.clear()

    @property
    def tags(self) -> frozenset[str]:
        return frozenset(self._tags)

    @property
    def aliases(self) -> dict[str, str]:
        return dict(self._aliases)

    def is_alias(self, tag: str) -> bool:
        return tag.lower() in self._aliases

    def resolve(self, tag: str) -> str:
        return self._aliases.get(tag.lower(), tag.lower())

    def frame(self, spark: SparkSession) -> DataFrame:
        return small(spark, [(t,) for t in sorted(self._tags)], "tag string")


def load_aliases(path: str | None = None) -> dict[str, str]:
    """``{"aliases": {alias: canonical}}`` of a file, or the built-in ones."""
    if not path:
        return dict(ALIASES)
    with open(path) as f:
        return {k.lower(): v.lower() for k, v in json.load(f)["aliases"].items()}


def default_matcher(tags: list[str] = ()) -> Matcher:
    return Matcher(tags, ALIASES)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")


def resolve(tag: Column, aliases: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.element_at(_map(ALIASES if aliases is None else aliases), F.lower(tag)), F.lower(tag))


def ancestors(tags: DataFrame, ontology: Ontology, most: int = MOST_HOPS) -> DataFrame:
    """``(tag, ancestor, hop)`` of the given tags. The dictionary's closure is made once; one join
    by broadcast follows."""
    links = small(tags.sparkSession, ontology.closure(most), "tag string, ancestor string, hop int")
    return tags.select("tag").join(F.broadcast(links), "tag")


def descendants(tags: DataFrame, ontology: Ontology, most: int = MOST_HOPS) -> DataFrame:
    links = small(tags.sparkSession, [(a, t, h) for t, a, h in ontology.closure(most)], "tag string, descendant string, hop int")
    return tags.select("tag").join(F.broadcast(links), "tag")


def expand(tags: DataFrame, ontology: Ontology, hops: int = 2, weight: float | None = None) -> DataFrame:
    """``(query_id, tag, weight)``: the tags at 1 and their ancestors at ``weight`` per hop."""
    weight = ontology.parent_weight if weight is None else weight
    links = [(t, a, weight**h) for t, a, h in ontology.closure(hops)]
    table = small(tags.sparkSession, links, "tag string, up string, weight double")
    far = tags.join(F.broadcast(table), "tag").select("query_id", F.col("up").alias("tag"), "weight")  # the dictionary
    return tags.select("query_id", "tag", F.lit(1.0).alias("weight")).union(far).groupBy("query_id", "tag").agg(F.max("weight").alias("weight"))


def infer(queries: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None, prefix: bool = False) -> DataFrame:
    """``(query_id, tag, confidence, at, rank)``: exact names 1.0, aliases 0.9, and if asked for,
    prefixes of three letters or more 0.7; a tag's first match counts. ``rank`` is by confidence,
    then by place. How the known tags reach the tokens is left to the optimizer; prefixes meet in
    an equality join on the tags' own prefixes."""
    table = _map(ALIASES if aliases is None else aliases)
    token = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9_/-]+"), F.lit(0))).alias("at", "token"))
    names = known.select(F.col("tag").alias("token")).distinct().withColumn("_exact", F.lit(True))
    found = token.join(names, "token", "left").withColumn("_alias", F.element_at(table, F.col("token")))
    tag = F.when(F.col("_exact"), F.col("token")).otherwise(F.col("_alias"))
    hits = found.select("query_id", "at", "token", tag.alias("tag"), F.when(F.col("_exact"), 1.0).otherwise(0.9).alias("confidence"))
    out = hits.where(F.col("tag").isNotNull())
    if prefix:
        left = hits.where(F.col("tag").isNull() & (F.length("token") >= 3)).drop("tag", "confidence")
        cuts = known.select("tag").distinct().where(F.length("tag") >= 3).select("tag", F.explode(F.sequence(F.lit(3), F.length("tag"))).alias("n"))
        more = left.join(cuts.select("tag", F.expr("left(tag, n)").alias("token")), "token").select("query_id", "at", "token", "tag", F.lit(0.7).alias("confidence"))
        out = out.union(more)
    w = Window.partitionBy("query_id", "tag").orderBy("at", F.desc("confidence"))
    best = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "at", "tag")
    first = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    return first.withColumn("rank", F.row_number().over(best) - 1).select("query_id", "tag", "confidence", "at", "rank")


def tag_weights(doc_tags: DataFrame, query_tags: DataFrame) -> DataFrame:
    """``(query_id, document_id, weight)``: summed weights of the tags that a document shares with
    a query. The query tags of a batch are few; the inverted index is not shuffled to meet them."""
    return doc_tags.join(F.broadcast(query_tags), "tag").groupBy("query_id", "document_id").agg(F.sum("weight").alias("weight"))


def tag_hits(doc_tags: DataFrame, query_tags: DataFrame) -> DataFrame:
    """``(query_id, document_id, score)``: those sums over the best of the query."""
    return scored(tag_weights(doc_tags, query_tags))


def scored(weights: DataFrame) -> DataFrame:
    """The best of a query comes from a partial maximum, not from a window over all its hits."""
    held = weights.where(F.col("weight") > 0)
    top = held.groupBy("query_id").agg(F.max("weight").alias("_top"))  # a row a query
    return held.join(F.broadcast(top), "query_id").select("query_id", "document_id", (F.col("weight") / F.col("_top")).alias("score"))


def with_all(doc_tags: DataFrame, tags: list[str]) -> DataFrame:
    found = doc_tags.where(F.col("tag").isin(tags)).groupBy("document_id").agg(F.count_distinct("tag").alias("n"))
    return found.where(F.col("n") == len(set(tags))).select("document_id")


def with_any(doc_tags: DataFrame, tags: list[str]) -> DataFrame:
    return doc_tags.where(F.col("tag").isin(tags)).select("document_id").distinct()


def frequency(doc_tags: DataFrame) -> DataFrame:
    return doc_tags.groupBy("tag").agg(F.count("*").alias("n"))
