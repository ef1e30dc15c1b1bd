"""The registered queries on the smallest tables, against their SQL where there is one."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from featloom.llm import queries

SF = "/root/testdata/sf0.001"
ROWS = {"op6_warc": "pages", "op7_html_extraction": "pages", "op10_top_k": None, "op12_lexical": None}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in queries.QUERIES} and set(queries.QUERIES) < names
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.ORACLES:
        problem, n = oracle.compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF)
        assert problem is None, problem
    else:
        n = queries.QUERIES[name](spark, SF).count()
    table = ROWS.get(name, "documents")
    if table:
        assert n == con.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
