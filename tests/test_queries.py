"""Every registered query that has SQL gives the rows that SQL gives."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from strataweave.plans import everything as registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if isinstance(x, (list, np.ndarray)):
            return [v.item() if isinstance(v, np.generic) else v for v in x]
        return None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else x

    frame = frame[sorted(frame.columns)].astype(object).map(plain)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(db.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_top_k_is_one_bounded_sort(spark):
    plan = registry.QUERIES["rag_01_match_chunks"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def as_sql(spark, folder, name, **tables):
    """The query and its SQL over tables (rows of a SELECT in DuckDB) of a folder agree."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    assert rows(registry.QUERIES[name](spark, str(folder)).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())


def test_first_write_wins_with_nulls_and_ties(spark, tmp_path):
    lines = "(1, 2, 20), (1, 1, NULL), (1, NULL, 9), (2, NULL, 5), (3, 1, 8), (3, 1, 7), (3, 1, 9), (NULL, 2, 1), (NULL, 1, 4)"
    as_sql(spark, tmp_path, "snk_04_first_write_wins", lineitem=f"SELECT a::BIGINT AS l_orderkey, b::INT AS l_linenumber, c::BIGINT AS l_partkey FROM (VALUES {lines}) t(a, b, c)")


def test_page_links_of_pages_that_share_a_url(spark, tmp_path):
    made = """(1, 'https://h.org/a', '<a href="/x#q"><a href="https://h.org/abs"><a href="r">'), (2, 'https://h.org/a', '<a href="/y">'), (3, NULL, '<a href="/n">'), (4, 'https://h.org/a', NULL), (5, 'bare', '<a href="//o.org/">')"""
    as_sql(spark, tmp_path, "src_08_page_links", pages=f"SELECT a::BIGINT AS page_id, b AS url, c AS html FROM (VALUES {made}) t(a, b, c)")


def test_labels_of_ties_and_of_numbers_that_are_large_or_none(spark, tmp_path):
    prices = "('1500'), ('-487500'), ('-1250'), ('1e27'), ('123456789012345678'), ('nan'), ('inf'), ('-inf'), ('-1'), (NULL)"
    ties = "SELECT (500 * i)::DOUBLE FROM range(-1000, 1000) t(i)"
    as_sql(spark, tmp_path, "str_19_20_labels", orders=f"SELECT row_number() OVER () AS o_orderkey, x AS o_totalprice, CASE WHEN x > 0 THEN 'F' END AS o_orderstatus FROM (SELECT p::DOUBLE AS x FROM (VALUES {prices}) t(p) UNION ALL {ties})")


def test_indexed_keywords_with_several_vectors_and_missing_ids(spark, tmp_path):
    texts = "(1, 'Danes and the Qu and  the'), (2, NULL), (3, ''), (NULL, 'planes quit'), (4, repeat('the hand quotes anes. ', 200)), (5, 'İANES quİ ẞ')"
    docs = f"SELECT a::BIGINT AS doc_id, b AS text, 'en' AS lang, 's' AS source FROM (VALUES {texts}) t(a, b)"
    as_sql(spark, tmp_path, "rag_05_indexed_keywords", documents=docs, embeddings="SELECT unnest([1, 1, 4, 4, 4, NULL, 9])::BIGINT AS vec_id, [1.0::FLOAT, 2] AS embedding")
