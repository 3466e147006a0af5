"""Every registered query against its SQL text, and the shape of the contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
import check
from tidelog.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def test_contract():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries) and set(ORACLES) <= set(sql)
    assert set(QUERIES) - set(ORACLES) == {"agg_6_approx_distinct", "agg_13_daily_quality_approx"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    line = check.compare(spark, con, sf_dir, name)
    assert line.startswith(("ok", "rows")), line


def test_approximate_counts_are_close(spark, sf_dir):
    q = contract.queries()
    for exact, approx in (("agg_6_exact_distinct", "agg_6_approx_distinct"), ("agg_12_daily_quality_ist", "agg_13_daily_quality_approx")):
        a, b = q[exact](spark, sf_dir).collect(), q[approx](spark, sf_dir).collect()
        key = "ist_date" if "ist_date" in a[0].asDict() else None
        other = {r[key] if key else 0: r for r in b}
        for r in a:
            for c, v in r.asDict().items():
                if c.startswith(("distinct_", "l_")):
                    assert abs(other[r[key] if key else 0][c] - v) <= max(2, 0.03 * v)
