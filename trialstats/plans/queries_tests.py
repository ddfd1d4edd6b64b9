"""Registered queries: hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialstats.inference import significance as sig
from trialstats.operators import recode
from trialstats.plans import bindings as b
from trialstats.plans import sqltext
from trialstats.plans.queries_data import region_pair_rows, rounded
from trialstats.plans.registry import query


def _sql_chi2_2x2(rows: str) -> str:
    """Two-by-two chi-square with continuity correction from rows of (a, b)."""
    return f"""
WITH r AS ({rows}),
 lv AS (SELECT min(a) AS a1, min(b) AS b1 FROM r),
 c AS (SELECT count(*) FILTER (a = a1 AND b = b1)::DOUBLE AS n11, count(*) FILTER (a = a1 AND b <> b1)::DOUBLE AS n12,
              count(*) FILTER (a <> a1 AND b = b1)::DOUBLE AS n21, count(*) FILTER (a <> a1 AND b <> b1)::DOUBLE AS n22 FROM r, lv),
 s AS (SELECT *, n11 + n12 + n21 + n22 AS n, abs(n11 * n22 - n12 * n21) / (n11 + n12 + n21 + n22) AS gap FROM c),
 x AS (SELECT n, (gap - least(0.5, gap)) * (gap - least(0.5, gap)) * n * n * n
              / ((n11 + n12) * (n21 + n22) * (n11 + n21) * (n12 + n22)) AS statistic FROM s)
SELECT round(statistic, 6) AS statistic, 1::BIGINT AS df, n::BIGINT AS n, round({sqltext.chi2_p1("statistic")}, 6) AS p_value FROM x"""


@query(
    "chi2_pt_correct",
    _sql_chi2_2x2(f"SELECT InPhaseTransition AS a, correct AS b FROM ({b.SQL_ANALYSIS}) WHERE type <= 4"),
)
def chi2_pt_correct(spark, d):
    return rounded(sig.chi2_test(b.analysis(spark, d).filter(F.col("type") <= 4), "InPhaseTransition", "correct"))


def _register_region_tests() -> None:
    """Accuracy and time, phase transition against each other region."""
    for name, other in (("under", recode.UNDER), ("over", recode.OVER)):
        rows = f"""SELECT CASE WHEN Region LIKE 'Phase%' THEN 'PT' ELSE '{name.title()}' END AS a, correct AS b, TimeOnTask AS y
                   FROM ({b.SQL_ANALYSIS}) WHERE Region LIKE 'Phase%' OR Region = '{other}'"""

        def pair(spark, d, other=other):
            rows = region_pair_rows(b.analysis(spark, d), other)
            return rows.withColumn("Region", recode.relabel(F.col("Region")))

        def chi2(spark, d, pair=pair):
            return rounded(sig.chi2_test(pair(spark, d), "Region", "correct"))

        def welch(spark, d, pair=pair):
            return rounded(sig.welch_t(pair(spark, d), "TimeOnTask", "Region"))

        query("chi2_region_pair" if name == "under" else "chi2_region_pair_over", _sql_chi2_2x2(rows))(chi2)
        query("welch_time_region" if name == "under" else "welch_time_region_over", _sql_welch(rows))(welch)


def _sql_welch(rows: str) -> str:
    """Welch test from rows of (a, y).  With these sample sizes df is in the
    thousands; the critical value is the Cornish-Fisher expansion of the t quantile."""
    z = "1.959963984540054"
    critical = f"""({z} + (pow({z}, 3) + {z}) / (4 * df) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * df * df)
        + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow(df, 3)))"""
    return f"""
WITH g AS (SELECT a, avg(y) AS m, var_samp(y) AS v, count(*)::DOUBLE AS k FROM ({rows}) GROUP BY a),
 w AS (SELECT min(a) AS group1, max(a) AS group2, arg_min(m, a) AS mean1, arg_max(m, a) AS mean2,
              arg_min(v / k, a) AS e1, arg_max(v / k, a) AS e2, arg_min(k, a) AS k1, arg_max(k, a) AS k2 FROM g),
 t AS (SELECT *, (mean1 - mean2) / sqrt(e1 + e2) AS statistic,
              (e1 + e2) * (e1 + e2) / (e1 * e1 / (k1 - 1) + e2 * e2 / (k2 - 1)) AS df FROM w)
SELECT group1, group2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(statistic, 6) AS statistic, round(df, 6) AS df,
       round({sqltext.t_p("statistic", "df")}, 6) AS p_value,
       round(mean1 - mean2 - {critical} * sqrt(e1 + e2), 6) AS conf_low,
       round(mean1 - mean2 + {critical} * sqrt(e1 + e2), 6) AS conf_high FROM t"""


_register_region_tests()


@query("welch_time_pt", _sql_welch(f"SELECT InPhaseTransition AS a, TimeOnTask AS y FROM ({b.SQL_ANALYSIS})"))
def welch_time_pt(spark, d):
    return rounded(sig.welch_t(b.analysis(spark, d), "TimeOnTask", "InPhaseTransition"))


@query("cor_by_type", f"SELECT type, round(corr(TimeOnTask, correct), 6) AS correlation FROM ({b.SQL_ANALYSIS}) GROUP BY 1")
def cor_by_type(spark, d):
    return rounded(sig.cor_by_group(b.analysis(spark, d), "TimeOnTask", "correct", "type"))


_SQL_COR_TEST = f"""SELECT type, estimate, df, estimate * sqrt(df) / sqrt(1 - estimate * estimate) AS statistic
     FROM (SELECT type, corr(TimeOnTask, correct) AS estimate, (count(*) - 2)::DOUBLE AS df FROM ({b.SQL_ANALYSIS}) GROUP BY 1)"""


@query(
    "cor_test_by_type",
    f"""SELECT type, round(estimate, 6) AS estimate, round(statistic, 6) AS statistic, df,
               round({sqltext.t_p("statistic", "df")}, 6) AS p_value,
               round(tanh(atanh(estimate) - {sig.Z_975} / sqrt(df - 1)), 6) AS conf_low,
               round(tanh(atanh(estimate) + {sig.Z_975} / sqrt(df - 1)), 6) AS conf_high FROM ({_SQL_COR_TEST})""",
)
def cor_test_by_type(spark, d):
    return rounded(sig.cor_test_by_group(b.analysis(spark, d), "TimeOnTask", "correct", "type"))


@query(
    "cor_test_long",
    f"""SELECT type, 'estimate' AS description, round(estimate, 6) AS correlation FROM ({_SQL_COR_TEST})
        UNION ALL SELECT type, 'p.value', round({sqltext.t_p("statistic", "df")}, 6) FROM ({_SQL_COR_TEST})""",
)
def cor_test_long(spark, d):
    return rounded(sig.cor_test_long(b.analysis(spark, d), "TimeOnTask", "correct", "type"))


_MATRIX = ["TrialNumber", "correct", "TimeOnTask"]
_MATRIX_PAIRS = " UNION ALL ".join(
    f"SELECT '{hi}' AS \"row\", '{lo}' AS col, corr({lo}, {hi}) AS r, count(*)::BIGINT AS n FROM a"
    for lo, hi in (("TrialNumber", "correct"), ("TrialNumber", "TimeOnTask"), ("correct", "TimeOnTask"))
)


@query(
    "cor_matrix",
    f"""WITH a AS (SELECT {', '.join(_MATRIX)} FROM ({b.SQL_ANALYSIS}) WHERE TrialNumber IS NOT NULL),
         m AS ({_MATRIX_PAIRS}), t AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r) AS t, (n - 2)::DOUBLE AS df FROM m)
        SELECT "row", col, round(r, 6) AS r, n, round({sqltext.t_p("t", "df")}, 6) AS p_value FROM t""",
)
def cor_matrix(spark, d):
    return rounded(sig.cor_matrix(b.analysis(spark, d), _MATRIX))
