"""The registered queries against their SQL, and what is registered."""

import re

import pytest

import __spark_entry__ as E
from oracle_harness import SMALL, compare, duck

ORACLE = {n: s for n, s in E.oracle_sql().items() if re.match(r"op\d+_", n)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    result = compare(spark, duck(SMALL), name, E.queries()[name], ORACLE[name], SMALL)
    assert result["ok"], result


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = sorted(int(m[1]) for n in E.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 1 + max(numbers))) and "pipeline" in E.queries()
