"""Rank fusion, score blending, normalisation and tag boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
TOP_BONUS, NEXT_BONUS = 0.05, 0.02


def rrf_term(weight: Column, rank: Column, k: int = RRF_K) -> Column:
    """A list's share of a fused score; the first three ranks get a flat bonus."""
    bonus = F.when(rank == 0, TOP_BONUS).when(rank <= 2, NEXT_BONUS).otherwise(0.0)
    return weight / (k + rank + 1) + bonus


def rrf_inverse(score: Column, k: int = RRF_K) -> Column:
    return F.when(score > 0, 1 / score - k - 1).otherwise(F.lit(float("inf")))


def fuse(hits: DataFrame, k: int = RRF_K, key: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of long-form hits ``(query_id, list_idx, rank, weight, source,
    filepath, score)`` with the provenance of each document, best first by ``pos``. Columns of
    ``keep`` come from the representative: the hit of the highest score, the first among equals."""
    key = key or ["filepath"]
    source = lambda s: F.col("source") == s if s != "vec" else ~F.col("source").isin("fts", "tag")
    rank = F.col("rank")
    best = F.struct("score", (-F.col("list_idx")).alias("_l"), (-rank).alias("_r"))
    fused = hits.groupBy("query_id", *key).agg(
        F.sum(rrf_term(F.coalesce("weight", F.lit(1.0)), rank, k)).alias("score"),
        *[F.max(F.when(source(s), F.col("score"))).alias(f"{s}_score") for s in ("fts", "vec", "tag")],
        *[F.min(F.when(source(s), rank)).alias(f"{s}_rank") for s in ("fts", "vec", "tag")],
        F.count_distinct("source").alias("sources_count"),
        F.min(F.struct("list_idx", "rank")).alias("_first"),
        *[F.max_by(c, best).alias(c) for c in keep],
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "_first", *key)
    return fused.withColumn("pos", F.row_number().over(w) - 1).drop("_first")


def default_weights(lists: int) -> list[float]:
    """The weights of lists that are given none: the first two count twice."""
    return [2.0 if i < 2 else 1.0 for i in range(lists)]


def max_normalize(ranked: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def blend_weight(pos: Column) -> Column:
    return F.when(pos < 3, 0.75).when(pos < 10, 0.60).otherwise(0.40)


def blend(ranked: DataFrame, rerank: DataFrame) -> DataFrame:
    """Position-aware blend with rerank scores ``(query_id, filepath, rerank_score)``; a document
    without one counts 0.5."""
    both = ranked.join(rerank, ["query_id", "filepath"], "left").withColumn("blend_weight", blend_weight(F.col("pos")))
    final = F.col("blend_weight") * F.col("score") + (1 - F.col("blend_weight")) * F.coalesce("rerank_score", F.lit(0.5))
    return resort(both.withColumn("score", final))


def simple_blend(ranked: DataFrame, rerank: DataFrame, share: float = 0.6, top_k: int | None = None) -> DataFrame:
    both = ranked.join(rerank, ["query_id", "filepath"], "left")
    mixed = F.when(F.col("rerank_score").isNull(), F.col("score")).otherwise(share * F.col("score") + (1 - share) * F.col("rerank_score"))
    out = resort(both.withColumn("score", mixed))
    return out if top_k is None else out.where(F.col("pos") < top_k)


def resort(ranked: DataFrame) -> DataFrame:
    """Best first again; ties keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos")
    return ranked.withColumn("_pos", F.row_number().over(w) - 1).drop("pos").withColumnRenamed("_pos", "pos")


def weighted_average(fts: Column, vec: Column, wf: float, wv: float) -> Column:
    return F.lit(0.0) if wf + wv == 0 else (fts * wf + vec * wv) / (wf + wv)


def confidence(p: Column, s: Column, threshold: float = 0.2) -> Column:
    gap = F.abs(p - s)
    return F.when(gap <= threshold, F.least(F.lit(1.0), p + 0.1 * (1 - gap))).otherwise(p * (1 - gap))


def boost_by_count(n: Column, factor: float = 1.3, most: float = 2.0, least_tags: int = 1) -> Column:
    return F.when(n >= least_tags, F.least(F.lit(most), 1 + (factor - 1) * (1 + 0.5 * (n - 1)))).otherwise(1.0)


def boost_by_weight(total: Column, factor: float = 1.15, most: float = 2.0) -> Column:
    return F.when(total > 0, F.least(F.pow(F.lit(factor), total), F.lit(most))).otherwise(1.0)


def judge_score(relevant: Column, error: Column | None = None) -> Column:
    """A yes/no judgement as a score: yes 0.95, no 0.45, failure 0.5."""
    score = F.when(relevant, 0.5 + 0.5 * 0.9).when(~relevant, 0.5 * (1 - 0.1)).otherwise(0.5)
    return score if error is None else F.when(error, 0.5).otherwise(score)
