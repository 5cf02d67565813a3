"""Every registered query of the core against its SQL twin on the smallest tables."""

import pytest

from meshlark.plans.catalog import ORACLES, QUERIES

from .conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_entry_is_registered(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())


def test_stream_equals_table(spark):
    """The stateful stream ends in the state that the windows over the table give."""
    from pyspark.sql import functions as F

    from meshlark.plans.telemetry import CEILING, HIGH, LOW, readings
    from meshlark.plans.registry import Tables
    from meshlark.streaming import telemetry as T

    stream = {r.key: r for r in QUERIES["q51_telemetry_stateful_stream"](spark, DATA).collect()}
    d = T.latch(T.sliding_mkt(readings(Tables(spark, DATA)), "user_id", "ts", "temp"), "user_id", "ts", F.lit(CEILING))
    d = T.excursions(d, "user_id", "ts", F.col("temp").between(LOW, HIGH), 3600)
    newest = d.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max(F.struct("ts", "mkt_c", "latched", "excursion")).alias("s")).collect()
    assert len(newest) == len(stream)
    for r in newest:
        s = stream[r.key]
        assert abs(r.s.mkt_c - s.mkt_c) < 1e-3 and r.s.latched == s.latched and r.s.excursion == s.excursion


def test_entry_needs_no_session():
    """The driver may list the queries before it starts Spark."""
    import subprocess
    import sys

    from .conftest import ROOT

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=ROOT, check=True, timeout=120)
