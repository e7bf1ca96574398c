"""Every registered query against its DuckDB oracle at sf0.001 (the driver uses sf0.01)."""

import re

import pytest

import __spark_entry__ as E
from oracle_harness import SMALL, compare, duck

ORACLE = E.oracle_sql()
# the training-data queries have tests of their own, in tests/llm
QUERIES = {n: q for n, q in E.queries().items() if n != "pipeline" and not re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SMALL)
    assert res.get("ok") is not False, res
    assert res["rows"] >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["page_id", "url", "title", "description", "text_content", "content_type", "n_images"]


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE) and set(ORACLE) <= set(E.queries())
