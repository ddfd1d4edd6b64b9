"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check
from trialstats.operators import timing

WITH_SQL = sorted(entry.oracle_sql())
# Fits without SQL; each algorithm has its own dense test.
# Corpus queries have tests of their own, beside their operators.
ROWS_ONLY = sorted(n for n in set(entry.queries()) - set(WITH_SQL) if n != "pipeline" and not n.startswith("op"))


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, con, sf, name):
    ok, note, *_ = check.compare(spark, con, sf, name)
    assert ok, note


# Queries that join, sort events or parse, forced into the layout for large tables:
# nothing broadcast by Spark, and logs cut every few lines.
LARGE_LAYOUT = [
    "acc_by_region", "acc_by_task_region", "analysis_with_demographics", "complexity_join", "learning_curve",
    "natural_join", "parse_delimited", "bind_rows_by_name", "time_on_task", "trials_with_instances",
    "trials_with_times", "drop_cols", "model_grid_ols_sat_pt", "lmm_time_prop_mstrat", "panel_random_effects",
]


@pytest.mark.parametrize("name", LARGE_LAYOUT)
def test_large_layout_gives_the_same_rows(spark, con, sf, name, monkeypatch):
    monkeypatch.setattr(timing, "SLICE_LINES", 12)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ok, note, *_ = check.compare(spark, con, sf, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ok, note


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_returns_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
