import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import __main__ as cli
from tesserae import config
from tesserae.functions import models
from tesserae.plans import answers

from .conftest import SMALL


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[tesserae]\nlimit = 7\nrrf_k = 9\nunknown = 1\n")
    got = config.load(str(f), {"TESSERAE_RRF_K": "11", "TESSERAE_NORMALIZE": "no"}, root="r")
    assert (got.limit, got.rrf_k, got.normalize, got.root, got.candidates) == (7, 11, False, "r", 30)


def test_embedder(spark):
    rows = spark.createDataFrame([("a b",), ("b a",), ("",), (None,)], "t string").select(models.embed(F.col("t")).alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] and np.isclose(np.linalg.norm(rows[0]["v"]), 1) and not any(rows[2]["v"]) and len(rows[3]["v"]) == 64


def test_judge(spark):
    asked = spark.createDataFrame([(1, "a", "red fox", "a red fox"), (1, "b", "red fox", "nothing"), (1, "c", "red fox", None)], "query_id long, filepath string, query string, body string")
    got = {r["filepath"]: (r["relevant"], r["rerank_score"]) for r in models.judge(asked).collect()}
    assert got == {"a": (True, 0.95), "b": (False, 0.45), "c": (False, 0.45)}

    def broken(query, body):
        raise RuntimeError

    assert {r["rerank_score"] for r in models.judge(asked, broken).collect()} == {0.5}


def test_expand():
    assert models.expand("q", lambda q: "1. one?\n\n- two\nthree") == ["q", "one", "two"]

    def broken(query):
        raise RuntimeError

    assert models.expand("q", broken) == ["q"] and models.expand("q") == ["q"]


def test_context_and_answer(spark):
    ranked = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 0.5), (1, 9, "c", 0.1)], "query_id long, pos int, file string, score double")
    docs = spark.createDataFrame([("a", "xx"), ("b", "yyy"), ("c", "z")], "path string, text string")
    text = answers.context(answers.passages(ranked, docs, chars=2)).first()["context"]
    assert text == "[1] a:\nxx\n\n[2] b:\nyy" and answers.sources(text) == ["a", "b"]
    assert answers.answer("?", text, lambda p: "ok")["answer"] == "ok"
    assert answers.answer("?", "", lambda p: "ok")["answer"].startswith("Unable")


def test_show():
    rows = [{"file": "a<b", "score": 0.5, "sources_count": 2}]
    assert answers.show(rows) == "1. a<b 0.500 (2 sources)" and json.loads(answers.show(rows, "json")) == rows
    assert "a&lt;b" in answers.show(rows, "xml") and answers.show(rows, "csv").startswith("file,score") and answers.show(rows, "md").count("|") == 12
    with pytest.raises(ValueError):
        answers.show(rows, "yaml")


def test_details():
    row = {"file": "a", "score": 0.5, "title": "T", "fts_score": 1.0, "fts_rank": 0, "rerank_score": 0.95, "relevant": True, "blend_weight": 0.75}
    assert answers.show([row]).split("\n") == ["1. T - a 0.500", "   fts_score: 1.000 (rank 1)", "   rerank: 0.950 (relevant)", "   blend: 75% fused, 25% rerank"]
    assert answers.show([row], "files") == "a"
