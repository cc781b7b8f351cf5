"""Plain Lloyd clustering in exact integer arithmetic.

Vectors are quantised once and stored. A round sends the centroids (``k`` times the number of
components, whatever the table's size) to every task; the tasks compute integer squared differences
to each centroid, take the nearest (the lower number of equals) and give one row of integer sums a
centroid; a grouping adds the rows up, and the driver divides ``k`` sums by their counts. A round
that moves no centroid would repeat itself for ever, so it is the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged

K, ROUNDS, SEED, SIZE, SCALE = 8, 10, 3, 64, 1024
#: Components beyond this could overflow the squared distance of a long (64 squares of 2^28).
MOST = 1 << 27
#: Vectors whose differences are held at once.
BLOCK = 4096

Centroids = list[list[int]]


def whole(vector: str, size: int) -> Column:
    """Vectors of exactly ``size`` components, none of them null, NaN or infinite."""
    x = F.col(vector)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return x.isNotNull() & (F.size(x) == size) & ~F.exists(x, bad)


def quantised(rows: DataFrame, id: str, vector: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The stored table ``(id, q)`` of the whole vectors, each component as ``floor(scale * x)``.
    One beyond ``MOST`` is an error, as distances would not fit a long."""
    step = lambda v: F.floor(v.cast("double") * scale)
    fits = lambda v: F.when(F.abs(v.cast("double") * scale) < MOST, step(v)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}")).cast("long"))
    made = rows.where(whole(vector, size)).select(F.col(f"`{id}`").alias("id"), F.transform(F.col(vector), fits).cast("array<int>").alias("q"))
    return staged(made, "lloyd-vectors")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> Centroids:
    """The ``k`` vectors whose ids have the least hashes, in their order; fewer of a smaller table.
    A null id hashes as the empty text; of equal hashes the lesser vector comes first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in vectors.select("q", key.alias("h")).orderBy("h", "q").limit(k).collect()]  # k rows


def _blocks(batches: Iterator[pd.DataFrame], centroids: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their vectors, nearest centroids and squared distances, in blocks."""
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            rows = batch.iloc[lo : lo + BLOCK]
            x = np.stack(rows["q"].to_numpy()).astype(np.int64)
            gaps = np.empty((len(centroids), len(x)), dtype=np.int64)
            for i, c in enumerate(centroids):
                d = x - c
                gaps[i] = np.einsum("ij,ij->i", d, d)
            near = gaps.argmin(axis=0)  # the lowest of equals
            yield rows, x, near, gaps[near, np.arange(len(x))]


def partial_sums(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """``(cluster, n, sums)``: for each centroid and task one row."""
    c = np.array(centroids, dtype=np.int64)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(len(c), dtype=np.int64), np.zeros(c.shape, dtype=np.int64)
        for _, x, near, _ in _blocks(batches, c):
            n += np.bincount(near, minlength=len(c))
            for i in np.unique(near):
                sums[i] += x[near == i].sum(axis=0)
        held = np.flatnonzero(n)
        if len(held):
            yield pd.DataFrame({"cluster": held.astype(np.int32), "n": n[held], "sums": list(sums[held])})

    return vectors.select("q").mapInPandas(add, "cluster int, n long, sums array<long>")


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after one round; one without vectors stays."""
    size = len(centroids[0])
    total = partial_sums(vectors, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).alias("sums"))
    out = list(centroids)
    for r in total.collect():  # a row a centroid
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]  # exact, towards minus infinity
    return out


def assigned(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """``(id, cluster, distance)`` of every vector."""
    c = np.array(centroids, dtype=np.int64)
    kind = vectors.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _, near, gap in _blocks(batches, c):
            yield pd.DataFrame({"id": rows["id"], "cluster": near.astype(np.int32), "distance": gap})

    return vectors.mapInPandas(apply, f"id {kind}, cluster int, distance long")


def cluster(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", *, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE, watch: Callable[[int, Centroids], None] | None = None) -> tuple[DataFrame, Centroids]:
    """``(id, cluster, distance)`` of every whole vector, as a stored table, and the centroids after
    ``rounds`` rounds. ``watch`` is told of the centroids after each round.

    Vectors that are null, of another length, or with a null, NaN or infinite component are left
    out. Rows of one id count each. An id may be null. A table without a whole vector gives no
    rows and no centroids. A component of ``MOST / scale`` or more is an error. Other columns are not
    read.
    """
    vectors = quantised(rows, id, vector, size, scale)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for n in range(rounds):
        before, centroids = centroids, moved(vectors, centroids)
        if watch:
            watch(n, centroids)
        if before == centroids:
            break
    return staged(assigned(vectors, centroids), "lloyd-clusters"), centroids


def op13(rows: DataFrame) -> DataFrame:
    """Every whole vector's cluster and squared distance, with the sums of distances and a digest of
    its centroid. Edge cases are those of ``cluster``."""
    found, centroids = cluster(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    digests = small(found.sparkSession, [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = sums.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(total))  # a row a centroid, one row of totals
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> str:
    """The rounds written out, each as an assignment and a step of the centroids."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q AS c FROM (SELECT q, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    near = """a{n} AS MATERIALIZED (SELECT r, vec_id, q, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, cluster) AS place
  FROM (SELECT r, vec_id, q, cluster, CAST(list_sum(list_transform(range(1, {end}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS BIGINT) AS distance FROM v CROSS JOIN c{n})) WHERE place = 1)"""
    step = """c{m} AS MATERIALIZED (SELECT c.cluster, coalesce(s.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT cluster, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT cluster, i, CAST(sum(q[i]) AS BIGINT) AS t, count(*) AS n FROM a{n}, range(1, {end}) AS g(i) GROUP BY ALL) GROUP BY cluster) s USING (cluster))"""
    for n in range(rounds):
        parts += [near.format(n=n, end=size + 1), step.format(n=n, m=n + 1, end=size + 1)]
    parts.append(near.format(n=rounds, end=size + 1))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""  # fmt: skip


#: DuckDB twin of op13.
OP13_SQL = _sql()
