"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally)."""

import pytest

import __spark_entry__ as E
from demoforge.plans.queries import QUERIES
from tests.conftest import SF_CHECK
from tests.oracle_check import check, duck

ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = check(spark, con, SF_CHECK, name, QUERIES[name], ORACLES.get(name), verbose=True)
    assert res["status"] in ("ok", "rows-only"), res


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only: set = set()
    assert set(QUERIES) - set(ORACLES) <= rows_only
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["n_samples"] == 87
    assert abs(rows[0]["informative_demos"] - 0.873563) < 1e-6
    assert abs(rows[0]["random_demos"] - 0.62069) < 1e-6
