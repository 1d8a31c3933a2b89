"""Every registered query against its SQL, on whole tables."""

import re

import pytest

import __spark_entry__ as contract
from checking import compare, connect


@pytest.fixture(scope="module")
def engine(sf_dir):
    return connect(sf_dir)


def core_queries():
    """Those of ``llm`` have tests of their own beside them."""
    return sorted(name for name in contract.queries()
                  if name != "pipeline" and not re.match(r"op\d+_", name))


@pytest.mark.parametrize("name", core_queries())
def test_query(spark, sf_dir, engine, name):
    df = contract.queries()[name](spark, sf_dir)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        difference = compare(df, engine, sql)
        assert difference is None, difference


def test_entry_reports_both_forecasters(spark):
    rows = {r["variant"]: r for r in contract.entry(spark).collect()}
    assert set(rows) == {"rate", "market"}
    for row in rows.values():
        assert row["n"] > 0
        assert row["brier_check"] == pytest.approx(
            row["reliability"] - row["resolution"] + row["uncertainty"], abs=1e-8)


def test_checks_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
