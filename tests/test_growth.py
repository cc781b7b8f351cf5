"""What queries shuffle and build: the index without a shuffle, and only where it is read."""

import re

from pyspark.sql import functions as F

from tesserae.corpus import Corpus
from tesserae.operators import index

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_built_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a.md", "Être Running être"), (2, "b.md", ""), (3, "c.md", None), (4, "être.md", "x " * 3000 + "y")], "id long, path string, text string").coalesce(1)
    made = index.build(docs, {"path": F.col("path"), "body": F.col("text")})
    assert "Exchange" not in plan(made.postings)
    monkeypatch.setattr(index, "MOST_WORDS", 2)  # of the driver: sizes of slices do not change the rows
    rows = {(r["doc_id"], r["col"], r["token"]): (r["key"], r["positions"]) for r in made.postings.collect()}
    assert rows[1, "body", "être"] == ("etr", [0, 2]) and rows[1, "body", "running"] == ("run", [1])
    assert rows[4, "path", "être"] == ("etr", [0]) and rows[4, "body", "x"] == ("x", list(range(3000))) and rows[4, "body", "y"] == ("y", [3000])
    assert len(rows) == 2 + 2 + 2 + 2 + 2 + 2
    laid = {(r["doc_id"], r["col"], r["token"]): (r["key"], r["positions"]) for r in index.laid_out(made).collect()}
    assert laid == rows


def test_runs_by_slices_and_documents_are_the_same_postings(monkeypatch):
    import pyarrow as pa

    words = [["a", "b", "a"], [], ["b"], ["a", "c", "c", "a"], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8, 9]), pa.array(["body", "body", "path", "body", "path"]), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "col", "w"]).slice(1)
    want = {(i, c, t): [k for k, x in enumerate(w) if x == t] for i, c, w in zip([6, 7, 8, 9], ["body", "path", "body", "path"], words[1:]) for t in w}
    for most, docs in ((1, 1), (3, 2), (1 << 20, 1), (1 << 20, 1024)):
        monkeypatch.setattr(index, "MOST_WORDS", most)
        monkeypatch.setattr(index, "MOST_DOCS", docs)
        got = {}
        for made in index._runs([batch]):
            for r in made.to_pylist():
                assert len(r["docs"]) == len(r["ends"]) and r["ends"][-1] == len(r["at"])
                for d, lo, hi in zip(r["docs"], [0, *r["ends"]], r["ends"]):
                    assert (d, r["col"], r["token"]) not in got
                    got[d, r["col"], r["token"]] = r["at"][lo:hi]
        assert got == want


def test_queries_that_read_no_index_build_none(spark, monkeypatch):
    from tesserae.plans import registry

    def none(self):
        raise AssertionError("an index is built")

    monkeypatch.setattr(Corpus, "index", property(none))
    for name in ("files_touched", "ingest_documents", "backfill_metadata", "embed_summary", "embed_vectors"):
        registry.QUERIES[name](spark, SMALL)


def test_texts_move_only_where_they_are_read(spark):
    """Of a listing, no text passes the shuffle for the rows of documents; a backfill moves texts after
    the documents that have metadata are out."""
    from tesserae.plans import registry

    lines = registry.QUERIES["ingest_documents"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [next(x for x in lines[i:] if "Project [" in x) for i, line in enumerate(lines) if "row_number()" in line and "mtime#" in line]
    assert below and not [x for x in below if re.search(r"( AS |[\[ ])text#\d+(?=[,\]])", x)]
    lines = registry.QUERIES["backfill_metadata"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    anti = [i for i, line in enumerate(lines) if "Join LeftAnti" in line and "id#" in line and "document_id" not in line.split("LeftAnti")[0]]
    joined = [i for i, line in enumerate(lines) if "Join Inner" in line and "hash#" in line]
    assert anti and joined and max(anti) > min(joined)


def test_chunks_are_embedded_a_slice_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from tesserae.functions import chunking, models

    texts = ["a b\nc d", None, "", "x" * 30 + "\n" + "y" * 30, "   "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["id", "text"])
    whole = [(i, n, pos, part) for i, t in enumerate(texts) for n, (part, pos) in enumerate(chunking.split_text(t or "", 40))]
    assert [r for rows in chunking.slices(batch, 40) for r in rows] == whole
    monkeypatch.setattr(chunking, "SLICE", 1)
    assert len(list(chunking.slices(batch, 40))) == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = chunking.chunk(docs, "text", "id", 40).where(F.trim("text") != "").select("id", "seq", "pos", models.embed(F.col("text")).alias("embedding"))
    assert sorted(models.embed_chunks(docs, "text", "id", 40).collect()) == sorted(want.collect())
