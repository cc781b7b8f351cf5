"""Exact dedup against a dictionary of the whole texts."""

import hashlib
import random

from pyspark.sql import functions as F

from tesserae.llm import radix


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, (n, text) in enumerate(rows):
        groups.setdefault(lower(text), []).append((n is not None, n, i))
    out = []
    for body, members in groups.items():
        best = max((m[0], m[1] if m[0] else 0) for m in members)
        keep = best[1] if best[0] else None
        out += [(m[1], keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for m in members]
    return sorted(map(str, out)), len(groups)


def found(df):
    rows = df.collect()
    return sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in rows), sum(r["kept"] for r in rows)


def test_whole_table(small):
    assert found(radix.op12(small)) == brute([(r["doc_id"], r["text"]) for r in small.collect()])


def test_edges(edge, empty):
    rows = edge.select("doc_id", "text").collect()
    got = radix.op12(edge)
    assert found(got) == brute([(r["doc_id"], r["text"]) for r in rows])
    same = got.where("doc_id in (1, 2) and group_size = 3").collect()
    assert len(same) == 3 and [r["keep_id"] for r in same] == [2, 2, 2] and sum(r["kept"] for r in same) == 1
    assert radix.op12(empty).count() == 0 and radix.deduplicated(empty).columns == empty.columns
    stay = radix.deduplicated(edge)
    assert stay.columns == edge.columns and stay.count() == brute([(r["doc_id"], r["text"]) for r in rows])[1]
    assert stay.where("`a.b` = 'dot'").count() == stay.count()


def test_texts_that_part_late(spark):
    """Shared beginnings of every length, texts that are beginnings of others, and ends at a digit's end."""
    rng = random.Random(3)
    stem = "".join(rng.choice("aAbé ") for _ in range(400))
    texts = [stem[:n] + tail for n in (0, 1, 2, 3, 5, 6, 7, 13, 14, 15, 30, 62, 200, 400) for tail in ("", "x", "X", "xy")]
    rows = [(i, rng.choice(texts)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = df.select(F.col("doc_id").alias("id"), radix.body("text").alias("rest"))
    want = {}
    for i, t in rows:
        want.setdefault(lower(t), []).append(i)
    whole = {i: (max(g), len(g), i == max(g)) for g in want.values() for i in g}
    for first, grow in ((1, 2), (2, 3), (32, 64), (1000, 2)):
        got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in radix.classes(table, first, grow).collect()}
        assert got == whole


def test_hot_group_is_split(spark):
    """The plan of a round deals a group's rows by a join that adaptive execution can split: both
    sides are exchanged right below it."""
    rows = spark.range(2000).select("id", F.lit(0).cast("long").alias("part"), F.when(F.col("id") % 3 == 0, "hot text of many rows").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).cast("binary").alias("rest"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        out = radix.split(rows.repartition(8), 64)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in keys:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
