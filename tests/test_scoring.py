import math

import pytest
from pyspark.sql import functions as F

from tesserae.operators import fusion, tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("weight", "rank", "want"),
    [(1.0, 0, 0.066393443), (1.0, 1, 0.036129032), (1.0, 2, 0.035873016), (1.0, 3, 0.015625), (0.8, 0, 0.063114754), (0.5, 0, 0.058196721)],
)
def test_rrf_term(spark, weight, rank, want):
    assert one(spark, fusion.rrf_term(F.lit(weight), F.lit(rank))) == pytest.approx(want, abs=1e-9)


def test_rrf_of_one_document_in_two_lists(spark):
    hits = spark.createDataFrame([(1, 0, 0, 1.0, "fts", "a", 2.0), (1, 1, 2, 1.0, "vec", "a", 0.5), (1, 1, 0, 1.0, "vec", "b", 0.9)], "query_id long, list_idx int, rank int, weight double, source string, filepath string, score double")
    a, b = fusion.fuse(hits).orderBy("pos").collect()
    assert (a["filepath"], a["sources_count"], a["fts_rank"], a["vec_rank"], a["tag_rank"]) == ("a", 2, 0, 2, None)
    assert a["score"] == pytest.approx(0.102266458, abs=1e-9)
    assert (b["filepath"], b["pos"]) == ("b", 1)


def test_inverse(spark):
    assert one(spark, fusion.rrf_inverse(F.lit(1 / 61))) == pytest.approx(0, abs=1e-9)
    assert math.isinf(one(spark, fusion.rrf_inverse(F.lit(0.0))))


def test_blend_and_resort(spark):
    ranked = spark.createDataFrame([(1, "a", 0, 0.066393443), (1, "b", 1, 0.05)], "query_id long, filepath string, pos int, score double")
    judged = spark.createDataFrame([(1, "a", 0.95)], "query_id long, filepath string, rerank_score double")
    got = {r["filepath"]: r["score"] for r in fusion.blend(ranked, judged).collect()}
    assert got["a"] == pytest.approx(0.287295082, abs=1e-9)
    assert got["b"] == pytest.approx(0.75 * 0.05 + 0.25 * 0.5, abs=1e-9)


@pytest.mark.parametrize(("p", "s", "want"), [(0.8, 0.85, 0.895), (0.8, 0.65, 0.885), (0.8, 0.3, 0.4)])
def test_confidence(spark, p, s, want):
    assert one(spark, fusion.confidence(F.lit(p), F.lit(s))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("n", "want"), [(0, 1.0), (1, 1.3), (2, 1.45), (3, 1.6), (5, 1.9), (6, 2.0)])
def test_boost_by_count(spark, n, want):
    assert one(spark, fusion.boost_by_count(F.lit(n))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("w", "want"), [(0.0, 1.0), (0.7, 1.102779002), (1.7, 1.268195853), (10.0, 2.0)])
def test_boost_by_weight(spark, w, want):
    assert one(spark, fusion.boost_by_weight(F.lit(w))) == pytest.approx(want, abs=1e-8)


def test_weighted_average(spark):
    assert one(spark, fusion.weighted_average(F.lit(0.8), F.lit(0.6), 2, 1)) == pytest.approx(0.733333333, abs=1e-9)
    assert one(spark, fusion.weighted_average(F.lit(0.8), F.lit(0.6), 0, 0)) == 0


def test_judge(spark):
    assert [one(spark, fusion.judge_score(F.lit(x).cast("boolean"))) for x in (True, False, None)] == pytest.approx([0.95, 0.45, 0.5])


def test_prefix_inference_and_aliases(spark):
    q = spark.createDataFrame([(1, "Top german topic-1 german")], "query_id long, query string")
    known = spark.createDataFrame([("topic-1",), ("topic-2",)], "tag string")
    got = {(r["tag"], r["confidence"]) for r in tags.infer(q, known, prefix=True).collect()}
    assert got == {("topic-1", 0.7), ("topic-2", 0.7), ("de", 0.9)}


def test_ontology_cycle_ends(spark):
    links = tags.Ontology((("a", "b"), ("b", "a")))
    assert tags.ancestors(spark.createDataFrame([("a",)], "tag string"), links, 4).count() == 4
