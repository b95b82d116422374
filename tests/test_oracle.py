"""Every registered query with an oracle matches DuckDB on the smallest supplied tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    res = compare(name, queries()[name](spark, SF_SMALL), con, ORACLES[name])
    assert res["status"] == "match", res


def test_every_query_is_registered_with_a_callable():
    q = queries()
    assert len(q) >= 55
    assert set(ORACLES) <= set(q)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0]["approved_count"] > 0
