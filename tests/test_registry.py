"""Every registered query of the search engine against its SQL twin on the smallest tables."""

import duckdb
import pytest

from tesserae.plans.registry import ORACLES, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert len(got)
    rows = lambda d: sorted(map(str, d[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_only_named_queries_lack_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_python_stays_out_of_built_in_plans(spark):
    for name in ("bm25_search", "hybrid_search", "vector_search", "tag_search", "change_detection"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_searches_read_no_text(spark):
    """The stored index answers: no scan of the text column, and of hits only what the pages need."""
    for name in ("bm25_search", "bm25_grammar", "hybrid_search", "rrf_fusion"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan


def test_searches_cut_to_the_page_before_the_shuffle(spark):
    for name in ("bm25_search", "tag_search", "hybrid_search", "vector_search"):
        assert "WindowGroupLimit" in QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_a_query_needs(spark):
    plan = QUERIES["weighted_score"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" in plan and "l_shipdate" not in plan
