import corpus_pipeline as pipeline
from tesserae.llm.common import staged

from .test_bagminhash import brute as classes
from .test_packing import check as packed
from .test_repeats import brute as spans


def test_stages(spark, small):
    docs, seen = small, []
    for name, stage in pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, ""), "t")
        assert out.columns == docs.columns
        seen.append((name, docs, out))
        docs = out
    (_, before, tagged), (_, _, single), (_, _, cut) = seen
    assert tagged.count() == before.count()  # clean documents stay
    want = {c for _, c in classes([(r["doc_id"], r["text"]) for r in tagged.collect()])}
    assert {r["doc_id"] for r in single.collect()} == want
    removed = {r[0]: r for r in spans([(r["doc_id"], r["text"]) for r in single.collect()])}
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= removed[r["doc_id"]][1] - removed[r["doc_id"]][2]
    packed(cut)
    assert {name for name, _ in pipeline.STAGES} == {"language_id", "near_dedup", "repeat_dedup", "packing"}


def test_edges(spark, edge, empty):
    for docs in (edge, empty):
        for _, stage in pipeline.STAGES:
            docs = staged(stage(spark, docs, ""), "t")
    assert docs.count() == 0


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_foreign_languages_go(spark, small):
    from pyspark.sql import functions as F

    foreign = ["Всички хора се раждат свободни и равни по достойнство", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności"]
    template = small.limit(1).drop("doc_id", "text", "lang")
    texts = spark.createDataFrame([(10**9 + i, x, None) for i, x in enumerate(foreign)], "doc_id long, text string, lang string")
    docs = small.unionByName(texts.crossJoin(template))
    mixed = docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.min_by("text", F.length("text") < 200).alias("x")).agg(F.concat_ws(" ", F.collect_list(F.substring("x", 1, 300))))
    docs = docs.unionByName(spark.createDataFrame([(2 * 10**9, mixed.first()[0], None)], "doc_id long, text string, lang string").crossJoin(template))
    gone = docs.select("doc_id").subtract(pipeline.language_id(spark, docs, "").select("doc_id"))
    assert {r["doc_id"] for r in gone.collect()} == {10**9, 10**9 + 1}
