"""Nearest-neighbour search over chunk vectors for a batch of query vectors: exact, or in the cells
of a coarse partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.fulltext import first_rows
from tesserae.staging import small

MOST_QUERIES = 4096


def distance(a: str, b: str):
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def _asked(spark, queries: list[tuple[int, list[float]]]) -> DataFrame:
    return F.broadcast(small(spark, [(q, [float(x) for x in v]) for q, v in queries], "query_id long, _query array<float>"))


def _nearest(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id", "id")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def nearest_chunks(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The ``k`` nearest chunks of each query: ``(query_id, distance)`` and the chunk's columns.

    The stated queries (at most ``MOST_QUERIES``, else in blocks) are sent to the chunks, which
    stay where they are; each task keeps its ``k`` best a query before the shuffle.
    """
    out = None
    for lo in range(0, max(1, len(queries)), MOST_QUERIES):
        asked = _asked(vectors.sparkSession, queries[lo : lo + MOST_QUERIES])
        found = vectors.crossJoin(asked).withColumn("distance", distance("embedding", "_query")).drop("_query", "embedding")
        found = _nearest(found, k)
        out = found if out is None else out.union(found)
    return out


def fit_cells(vectors: DataFrame, cells: int, *, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of a coarse partition, by k-means on at most ``sample`` vectors, those whose hashes
    are least. Only the centres come of the sample; every vector is put into a cell."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float32)
    if not len(x):
        return np.zeros((0, 0), dtype=np.float32)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = _closest(x, centres, 1)[:, 0]
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    gap = (centres**2).sum(1) - 2 * x @ centres.T
    return np.argsort(gap, axis=1, kind="stable")[:, :n]


def put_in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``cell``, each vector's closest centre; a stored table is partitioned by it."""

    @F.pandas_udf("int")
    def cell(embedding: pd.Series) -> pd.Series:
        return pd.Series(_closest(np.stack(embedding.to_numpy()).astype(np.float32), centres, 1)[:, 0].astype(np.int32))

    return vectors.withColumn("cell", cell("embedding"))


def nearest_in_cells(vectors: DataFrame, centres: np.ndarray, queries: list[tuple[int, list[float]]], k: int, probes: int = 8) -> DataFrame:
    """As ``nearest_chunks``, over the ``probes`` closest cells of each query alone: a partition
    filter and an equality join on the cell. Its recall is measured against the exact search."""
    spark = vectors.sparkSession
    near = _closest(np.array([v for _, v in queries], dtype=np.float32), centres, probes)
    rows = [(q, [float(x) for x in v], int(c)) for (q, v), cells in zip(queries, near) for c in cells]
    asked = F.broadcast(small(spark, rows, "query_id long, _query array<float>, cell int"))  # the stated queries
    held = vectors.where(F.col("cell").isin(sorted({r[2] for r in rows})))
    found = held.join(asked, "cell").withColumn("distance", distance("embedding", "_query")).drop("_query", "embedding", "cell")
    return _nearest(found, k)


def best_per_path(chunks: DataFrame, limit: int, *, collection: int | None = None, scope: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    """Documents by their best chunk: filters come after the chunk cut, then one chunk a path.
    ``scope`` gives ``(query_id, collection)`` for each query of a batch, null for all."""
    found = chunks.where("active").withColumn("score", 1 / (1 + F.col("distance")))
    if collection is not None:
        found = found.where(F.col("source_collection_id") == collection)
    if scope is not None:
        found = within(found, scope)
    found = found.where(F.col("score") >= min_score)
    best = Window.partitionBy("query_id", "path").orderBy(F.round("distance", 9), "vec_id", "id")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n")
    return first_rows(found, ["query_id"], [F.round("distance", 9), F.col("vec_id"), F.col("id")], limit, "rank")


def within(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Hits of each query's collection, or all where it names none."""
    held = hits.join(F.broadcast(scope), "query_id")  # a row a query
    return held.where(F.col("collection").isNull() | (F.col("collection") == F.col("source_collection_id"))).drop("collection")
