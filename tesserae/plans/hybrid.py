"""The hybrid search plan: full text, vectors and tags, fused, boosted and normalised.

Lists carry ids and paths only; texts are joined, if asked for, to the rows that are left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import blockmax, fulltext, fusion, index, tags, vectors
from tesserae.staging import small


@dataclass(frozen=True)
class SearchConfig:
    """Knobs of a search; the defaults are the engine's."""

    limit: int = 5
    min_score: float = 0.0
    fts_weight: float = 1.0
    vec_weight: float = 1.0
    tag_weight: float = 0.8
    rrf_k: int = 60
    expansion_weight: float = 0.5
    candidates: int = 30
    boost_factor: float = 1.15
    boost_cap: float = 2.0
    normalize: bool = True
    stemmed: bool = True


@dataclass(frozen=True)
class Query:
    """A query with its vector, its expanded variants, and an optional collection."""

    query_id: int
    text: str
    vector: tuple[float, ...] = ()
    variants: tuple[str, ...] = field(default=())
    collection: int | None = None


def scope_of(spark, queries: list[Query]) -> DataFrame | None:
    """``(query_id, collection)``, or None where no query names a collection."""
    if all(q.collection is None for q in queries):
        return None
    return small(spark, [(q.query_id, q.collection) for q in queries], "query_id long, collection long")


def lenient(text: str) -> fulltext.Node | None:
    """A model's variant as a query; None where it is none."""
    try:
        return fulltext.parse_query(text)
    except ValueError:
        return None


def text_list(corpus, asked: list[tuple[int, fulltext.Node]], limit: int, *, scope: DataFrame | None = None, mode: str = "reference", stemmed: bool = True, pruned: bool = False) -> DataFrame:
    """``(query_id, rank, document_id, filepath, score)`` of the full-text searcher; statistics
    cover the whole index, a collection is cut out before the page. ``pruned`` skips blocks of a
    stored index where the queries are such that it can and name no collection."""
    if pruned and stemmed and scope is None and blockmax.takes(asked):
        hits = blockmax.search(corpus.index, corpus.blocks, asked, limit, corpus.active).hits
    else:
        hits = index.search(corpus.index, asked, stemmed=stemmed)
    hits = hits.join(corpus.active.select("id", "path", "source_collection_id"), "id")
    hits = hits if scope is None else vectors.within(hits, scope)
    top = fulltext.normalize_hits(fulltext.top_hits(hits, limit), mode)
    return top.select("query_id", "rank", F.col("id").alias("document_id"), F.col("path").alias("filepath"), "score")


def vector_list(corpus, queries: list[tuple[int, list[float]]], limit: int, *, scope: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    chunks = vectors.nearest_chunks(corpus.vectors, queries, 3 * limit)
    found = vectors.best_per_path(chunks, limit, scope=scope, min_score=min_score)
    return found.select("query_id", "rank", F.col("id").alias("document_id"), F.col("path").alias("filepath"), "score")


def live_weights(corpus, query_tags: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``(query_id, document_id, weight, path)`` of active documents that share tags with a query."""
    of = corpus.active.select(F.col("id").alias("document_id"), "path", "source_collection_id")
    found = tags.tag_weights(corpus.tags, query_tags).join(of, "document_id")
    return found if scope is None else vectors.within(found, scope)


def tag_list(corpus, query_tags: DataFrame, limit: int, scope: DataFrame | None = None) -> DataFrame:
    weights = live_weights(corpus, query_tags, scope)
    top = fulltext.top_hits(tags.scored(weights), limit, tie="document_id")
    paths = corpus.active.select(F.col("id").alias("document_id"), F.col("path").alias("filepath"))
    return top.join(paths, "document_id").select("query_id", "rank", "document_id", "filepath", "score")


def as_list(hits: DataFrame, number: int, weight: float, source: str) -> DataFrame:
    return hits.select("query_id", F.lit(number).alias("list_idx"), "rank", F.lit(weight).alias("weight"), F.lit(source).alias("source"), "document_id", "filepath", "score")


def boosted(fused: DataFrame, doc_tags: DataFrame, query_tags: DataFrame, factor: float, cap: float) -> DataFrame:
    """Fused documents with scores raised by the weights of the tags they share with the query;
    the few fused rows meet the tag sums once."""
    sums = tags.tag_weights(doc_tags, query_tags).withColumnRenamed("weight", "_w")
    both = fused.join(sums, ["query_id", "document_id"], "left")
    return both.withColumn("score", F.col("score") * fusion.boost_by_weight(F.coalesce("_w", F.lit(0.0)), factor, cap)).drop("_w")


def finish(ranked: DataFrame, config: SearchConfig, rerank=None) -> DataFrame:
    """Blends with rerank scores, normalises, cuts by score and limit."""
    if rerank is not None:
        ranked = fusion.blend(ranked, rerank(ranked))
    if config.normalize:
        ranked = fusion.max_normalize(ranked)
    ranked = fusion.resort(ranked.where(F.col("score") >= config.min_score)).where(F.col("pos") < config.limit)
    return ranked.withColumnRenamed("filepath", "file")


def hybrid(corpus, queries: list[Query], config: SearchConfig = SearchConfig(), rerank=None, aliases: dict[str, str] | None = None, ontology: tags.Ontology | None = None) -> DataFrame:
    """``(query_id, pos, file, score)`` with provenance, best first. ``rerank`` takes the cut
    candidates and returns ``(query_id, filepath, rerank_score)``. A malformed query raises; a
    malformed variant is passed over."""
    spark = corpus.spark
    deep = 3 * config.limit
    scope = scope_of(spark, queries)
    raw = small(spark, [(q.query_id, q.text) for q in queries], "query_id long, query string")
    found = tags.infer(raw, corpus.tags.select("tag").distinct(), aliases).select("query_id", "tag")
    weights = tags.expand(found, ontology or tags.load_ontology())
    text = lambda asked, number, share: as_list(text_list(corpus, asked, deep, scope=scope, stemmed=config.stemmed), number, config.fts_weight * share, "fts")
    lists = [text([(q.query_id, fulltext.parse_query(q.text)) for q in queries], 0, 1.0)]
    if given := [(q.query_id, list(q.vector)) for q in queries if q.vector]:
        lists.append(as_list(vector_list(corpus, given, deep, scope=scope), 1, config.vec_weight, "vec"))
    lists.append(as_list(tag_list(corpus, weights, deep, scope), 2, config.tag_weight, "tag"))
    for i in range(max((len(q.variants) for q in queries), default=0)):
        asked = [(q.query_id, node) for q in queries if len(q.variants) > i and (node := lenient(q.variants[i]))]
        if asked:
            lists.append(text(asked, 3 + i, config.expansion_weight))
    hits = lists[0]
    for more in lists[1:]:
        hits = hits.union(more)
    fused = fusion.fuse(hits, config.rrf_k, keep=["document_id"]).where(F.col("pos") < config.candidates)
    ranked = fusion.resort(boosted(fused, corpus.tags, weights, config.boost_factor, config.boost_cap))
    return finish(ranked, config, rerank)
