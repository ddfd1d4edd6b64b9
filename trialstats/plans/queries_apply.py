"""Registered queries: summaries of groups by states that merge."""

from __future__ import annotations

from trialstats.operators.apply import group_apply, regression, shape
from trialstats.plans import bindings as b
from trialstats.plans.queries_data import rounded
from trialstats.plans.registry import query


@query(
    "apply_time_on_propagations",
    f"""SELECT Region, regr_count(TimeOnTask, propagations)::BIGINT AS n,
               round(regr_slope(TimeOnTask, propagations), 6) AS slope, round(regr_intercept(TimeOnTask, propagations), 6) AS intercept,
               round(corr(TimeOnTask, propagations), 6) AS correlation
        FROM ({b.SQL_ANALYSIS}) GROUP BY Region""",
)
def time_on_propagations(spark, d):
    """A line of time on propagations for every region."""
    rows = b.analysis(spark, d, with_complexity=True)
    return rounded(group_apply(rows, ["Region"], ["propagations", "TimeOnTask"], regression("propagations", "TimeOnTask")))


@query(
    "apply_shape_by_participant",
    f"""SELECT participant_id, InPhaseTransition, count(v)::BIGINT AS n, round(any_value(m), 6) AS mean,
               round(CASE WHEN var_pop(v) > 0 THEN avg(d ** 3) / var_pop(v) ** 1.5 END, 6) AS skewness,
               round(CASE WHEN var_pop(v) > 0 THEN avg(d ** 4) / var_pop(v) ** 2 END, 6) AS kurtosis
        FROM (SELECT *, v - m AS d FROM (
            SELECT participant_id, InPhaseTransition, TimeOnTask AS v,
                   avg(TimeOnTask) OVER (PARTITION BY participant_id, InPhaseTransition) AS m
            FROM ({b.SQL_ANALYSIS}))) GROUP BY 1, 2""",
)
def shape_by_participant(spark, d):
    """Skewness and kurtosis of every participant's times, inside and outside the phase transition."""
    rows = b.analysis(spark, d, participant=True)
    return rounded(group_apply(rows, ["participant_id", "InPhaseTransition"], ["TimeOnTask"], shape("TimeOnTask")))
