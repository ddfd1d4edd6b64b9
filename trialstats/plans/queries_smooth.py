"""Registered queries: smoothed outcomes along a predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialstats.operators import smoothing
from trialstats.plans import bindings as b
from trialstats.plans.queries_data import rounded
from trialstats.plans.registry import query

BANDWIDTH, WIDTH = 40.0, 4.0


def _sql(rows: str, x: str, y: str, by: str) -> str:
    reach = int(BANDWIDTH / WIDTH)
    return f"""
WITH bins AS (SELECT {by}, CAST(floor({x} / {WIDTH}) AS BIGINT) AS bin, count(*) AS n, avg({x}) AS mx, avg({y}) AS my,
                     var_pop({x}) * count(*) AS xx, covar_pop({x}, {y}) * count(*) AS xy
              FROM ({rows}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
points AS (SELECT a.{by}, a.bin, (a.bin + 0.5::DOUBLE) * {WIDTH}::DOUBLE AS centre FROM bins a),
near AS (SELECT p.{by}, p.bin, centre, b.* EXCLUDE ({by}, bin), mx - centre AS d, abs(mx - centre) / {BANDWIDTH}::DOUBLE AS part
         FROM points p JOIN bins b ON p.{by} IS NOT DISTINCT FROM b.{by} AND abs(p.bin - b.bin) <= {reach}),
sums AS (SELECT {by}, centre, sum(w * n) AS s0, sum(w * n * d) AS s1, sum(w * (xx + n * d * d)) AS s2, sum(w * n * my) AS t0,
                sum(w * (xy + n * my * d)) AS t1, sum(n)::BIGINT AS n
         FROM (SELECT *, (1 - part ** 3) ** 3 AS w FROM near WHERE part < 1) GROUP BY 1, 2)
SELECT {by}, round(centre, 6) AS {x}, n,
       round(CASE WHEN s0 * s2 - s1 * s1 <= 1e-12 * s0 * s2 THEN t0 / s0 ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END, 6) AS fit,
       round(CASE WHEN s0 * s2 - s1 * s1 > 1e-12 * s0 * s2 THEN (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) END, 6) AS slope
FROM sums"""


@query("smooth_time_by_propagations", _sql(f"SELECT Region, propagations, TimeOnTask FROM ({b.SQL_ANALYSIS})", "propagations", "TimeOnTask", "Region"))
def smooth_time(spark, d):
    rows = b.analysis(spark, d, with_complexity=True)
    return rounded(smoothing.local_linear(rows, "propagations", "TimeOnTask", BANDWIDTH, WIDTH, ["Region"]))


@query("smooth_accuracy_by_age", _sql(f"SELECT InPhaseTransition, Age * 10 AS Age, correct FROM ({b.SQL_WITH_PEOPLE})", "Age", "correct", "InPhaseTransition"))
def smooth_accuracy(spark, d):
    """Accuracy along age, in tenths of a year."""
    rows = b.analysis(spark, d, with_demographics=True).withColumn("Age", F.col("Age") * 10)
    return rounded(smoothing.local_linear(rows, "Age", "correct", BANDWIDTH, WIDTH, ["InPhaseTransition"]))
