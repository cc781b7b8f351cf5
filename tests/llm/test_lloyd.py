"""Clustering against Python integers."""

import hashlib
import math
import random

import pytest

from tesserae.llm import lloyd


def brute(rows, k=8, rounds=10, seed=3, size=64, scale=1024):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [q for _, q in sorted(good, key=key)[:k]]
    gap = lambda q, m: sum((a - b) ** 2 for a, b in zip(q, m))
    near = lambda q: min(range(len(c)), key=lambda i: (gap(q, c[i]), i))
    for _ in range(rounds):
        at = [near(q) for _, q in good]
        for i in range(len(c)):
            mine = [q for (_, q), n in zip(good, at) if n == i]
            if mine:
                c[i] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(q), gap(q, c[near(q)])) for i, q in good], c


def rows_of(df):
    return sorted(map(str, ((r["id"], r["cluster"], r["distance"]) for r in df.collect())))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(64)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    rows += [(900, None), (901, []), (902, rows[0][1][:63]), (903, [*rows[0][1], 0.0]), (904, [None, *rows[0][1][1:]]), (905, [math.nan, *rows[0][1][1:]]), (906, [math.inf, *rows[0][1][1:]]), (907, [-math.inf, *rows[0][1][1:]])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, distance string")
    return df, [(r["vec_id"], r["embedding"]) for r in df.collect()]


def test_against_integers(vectors):
    df, rows = vectors
    for options in ({}, {"k": 3, "rounds": 2}, {"k": 40, "rounds": 4}, {"rounds": 0}):
        got, c = lloyd.cluster(df, **options)
        want, centres = brute(rows, **options)
        assert rows_of(got) == sorted(map(str, want)) and c == centres


def test_query(vectors):
    df, rows = vectors
    want, c = brute(rows)
    got = lloyd.op13(df).collect()
    assert sorted(str((r["vec_id"], r["cluster"], r["distance"])) for r in got) == sorted(map(str, want))
    assert {r["inertia"] for r in got} == {sum(w[2] for w in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_ties_and_empty_clusters(spark):
    """Equal vectors make equal centroids: the lowest takes all, and the others stay as they are."""
    rows = [(i, [1.0, -1.0]) for i in range(6)] + [(6, [3.0, -1.0]), (7, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, c = lloyd.cluster(df, size=2)
    want, centres = brute(rows, size=2)
    assert rows_of(got) == sorted(map(str, want)) and c == centres and len({w[1] for w in want}) == 3


def test_few_and_none(spark):
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert len(lloyd.cluster(few)[1]) == 2 and lloyd.op13(few).count() == 2
    none = few.limit(0)
    assert lloyd.cluster(none)[1] == [] and lloyd.op13(none).count() == 0
    with pytest.raises(Exception, match="beyond"):
        lloyd.op13(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


def test_a_fixed_point_ends_the_rounds(spark):
    seen = []
    df = spark.createDataFrame([(i, [float(i % 2)] * 64) for i in range(20)], "vec_id long, embedding array<float>")
    lloyd.cluster(df, k=2, watch=lambda n, c: seen.append(n))
    assert len(seen) < 10
