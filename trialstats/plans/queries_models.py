"""Registered queries: regression models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.models import catalogue, report
from trialstats.models.glmm import fit_glmm, fit_glmm_grid, laplace_profile
from trialstats.models.lmm import fit_lmm, fit_lmm_grid, reml_profile, reml_profile_slope
from trialstats.models.logit import fit_logit
from trialstats.models.ols import fit_ols
from trialstats.models.panel import fit_panel
from trialstats.models.spec import Fit, ModelSpec
from trialstats.operators import recode
from trialstats.operators.permute import shuffle_column
from trialstats.plans import bindings as b
from trialstats.plans import sqltext
from trialstats.plans.queries_data import rounded
from trialstats.plans.registry import query

LEVELS = {"InPhaseTransition": ["No", "Yes"]}
PEOPLE = {*catalogue.DEMOGRAPHICS, "MultipleStrategies", *b.STRATEGY_BITS}
COMPLEXITY = {"propagations", "decisions"}


def model_frame(spark, d, specs: list[ModelSpec], extra: tuple[str, ...] = ()) -> DataFrame:
    """The analysis columns a set of models needs, joining only the tables behind them."""
    names = {v for s in specs for n in (*s.fixed, s.outcome, s.group) if n for v in n.split(":")} | set(extra)
    frame = b.analysis(
        spark,
        d,
        participant=catalogue.PARTICIPANT in names,
        with_complexity=bool(names & COMPLEXITY),
        with_demographics=bool(names & PEOPLE),
    )
    return frame.select(*sorted(names))


def tidy(spark, fits: list[Fit]) -> DataFrame:
    """Coefficient table, p-values at six places and the rest at five.

    Sums of doubles taken in another order differ by about 1e-11 of an estimate,
    so an intercept near 100 has no stable sixth place in either engine.
    """
    table = report.coefficients(spark, fits)
    return rounded(table.withColumns({c: F.round(c, 5) for c in ("estimate", "std_error", "statistic")}))


def _terms(spec: ModelSpec) -> list[str]:
    return [f"{n}Yes" if n == "InPhaseTransition" else n for n in spec.fixed]


def _fixed(task: str, outcome: str, short: str) -> list[ModelSpec]:
    sets = catalogue.FAMILIES[task].get((outcome, "fe", short), ())
    return [catalogue.spec(task, outcome, "fe", catalogue.MAIN[short], c) for c in sets]


def _people_needed(specs: list[ModelSpec]) -> str:
    return b.SQL_WITH_PEOPLE if any(set(s.fixed) & PEOPLE for s in specs) else b.SQL_ANALYSIS


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- single models, one per kind -------------------------------------------------

_CELLS = f"""SELECT count(*) FILTER (x = 1 AND y = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND y = 0)::DOUBLE AS b,
  count(*) FILTER (x = 0 AND y = 1)::DOUBLE AS c, count(*) FILTER (x = 0 AND y = 0)::DOUBLE AS d
  FROM (SELECT correct AS y, CASE WHEN InPhaseTransition = 'Yes' THEN 1 ELSE 0 END AS x FROM ({b.SQL_ANALYSIS}))"""

LOGIT_PT = ModelSpec("logit_pt", "correct", ("InPhaseTransition",), "binomial")


@query(
    "logit_pt",
    f"""WITH t AS ({_CELLS}), est AS (
          SELECT '(Intercept)' AS term, ln(c / d) AS estimate, sqrt(1 / c + 1 / d) AS std_error FROM t
          UNION ALL SELECT 'InPhaseTransitionYes', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM t)
        {sqltext.tidy("logit_pt", sqltext.normal_p("statistic"))}""",
)
def logit_pt(spark, d):
    """One binary predictor: the estimates are log odds, checked in closed form."""
    return tidy(spark, fit_logit(model_frame(spark, d, [LOGIT_PT]), [LOGIT_PT], LEVELS))


@query(
    "logit_pt_fit",
    f"""WITH t AS (SELECT *, a + b + c + d AS n FROM ({_CELLS})), l AS (
          SELECT n, a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) AS loglik FROM t)
        SELECT 'logit_pt' AS model, n::BIGINT AS n, round(loglik, 4) AS loglik, round(-2 * loglik, 4) AS deviance,
               round(-2 * loglik + 4, 4) AS aic, round(-2 * loglik + 2 * ln(n), 4) AS bic FROM l""",
)
def logit_pt_fit(spark, d):
    return _logit_fits(spark, fit_logit(model_frame(spark, d, [LOGIT_PT]), [LOGIT_PT], LEVELS))


def _logit_fits(spark, fits: list[Fit]) -> DataFrame:
    table = report.fit_table(spark, fits).select("model", "n", "loglik", "deviance", "aic", "bic")
    return rounded(table, 4)


OLS_PT = ModelSpec("ols_time_pt", "TimeOnTask", ("InPhaseTransition",))


@query("ols_time_pt", sqltext.ols("ols_time_pt", b.SQL_ANALYSIS, "TimeOnTask", ["InPhaseTransitionYes"]))
def ols_time_pt(spark, d):
    return tidy(spark, fit_ols(model_frame(spark, d, [OLS_PT]), [OLS_PT], LEVELS))


OLS_PROP = ModelSpec("ols_time_prop", "TimeOnTask", ("propagations",))


@query(
    "ols_time_prop",
    f"""SELECT 'ols_time_prop' AS model, round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope,
               round(regr_r2(y, x), 6) AS r2 FROM (SELECT TimeOnTask AS y, propagations AS x FROM ({b.SQL_ANALYSIS}))""",
)
def ols_time_prop(spark, d):
    """One numeric predictor, checked against the engine's own regression aggregates."""
    (fit,) = fit_ols(model_frame(spark, d, [OLS_PROP]), [OLS_PROP])
    row = (fit.spec.name, *map(float, fit.estimate), float(fit.stats["r2"]))
    return rounded(spark.createDataFrame([row], "model string, intercept double, slope double, r2 double"))


# --- every fixed-effect model of every task, one grid per outcome and predictor ----


def _register_grids() -> None:
    for task in catalogue.TASKS:
        for short in ("PT", "prop"):
            accuracy, time = _fixed(task, "acc", short), _fixed(task, "time", short)
            suffix = f"{task}_{short.lower()}"
            if accuracy:
                sql = _union([sqltext.logit(s.name, _people_needed([s]), s.outcome, _terms(s)) for s in accuracy])

                def logits(spark, d, specs=accuracy):
                    return tidy(spark, fit_logit(model_frame(spark, d, specs), specs, LEVELS))

                query(f"model_grid_logit_{suffix}", sql)(logits)
            if time:
                sql = _union([sqltext.ols(s.name, _people_needed([s]), s.outcome, _terms(s)) for s in time])

                def lines(spark, d, specs=time):
                    return tidy(spark, fit_ols(model_frame(spark, d, specs), specs, LEVELS))

                query(f"model_grid_ols_{suffix}", sql)(lines)


_register_grids()

SAT_OLS = _fixed("sat", "time", "PT")
SAT_LOGIT = _fixed("sat", "acc", "prop")


@query(
    "model_fits_ols",
    _union([sqltext.ols_fit(s.name, b.SQL_WITH_PEOPLE, s.outcome, _terms(s)) for s in SAT_OLS]),
)
def model_fits_ols(spark, d):
    """Fit statistics of the linear models side by side."""
    fits = fit_ols(model_frame(spark, d, SAT_OLS), SAT_OLS, LEVELS)
    table = report.fit_table(spark, fits).select("model", "n", "sigma", "r2", "adj_r2", "f", "loglik", "aic", "bic")
    return rounded(table.withColumns({c: F.round(c, 4) for c in ("loglik", "aic", "bic")}))


@query(
    "model_fits_logit",
    _union([sqltext.logit_fit(s.name, b.SQL_WITH_PEOPLE, s.outcome, _terms(s)) for s in SAT_LOGIT]),
)
def model_fits_logit(spark, d):
    return _logit_fits(spark, fit_logit(model_frame(spark, d, SAT_LOGIT), SAT_LOGIT, LEVELS))


def _side_by_side_sql(specs: list[ModelSpec]) -> str:
    cells = ", ".join(f"max(CASE WHEN model = '{s.name}' THEN cell END) AS {s.name}" for s in specs)
    rows = _union([sqltext.ols(s.name, b.SQL_WITH_PEOPLE, s.outcome, _terms(s)) for s in specs])
    return f"""SELECT term, {cells} FROM (SELECT term, model,
        format('{{:.3f}}', estimate) || stars || ' (' || format('{{:.3f}}', std_error) || ')' AS cell FROM ({rows})) GROUP BY term"""


@query("model_table_ols", _side_by_side_sql(SAT_OLS))
def model_table_ols(spark, d):
    """Published layout: terms down, models across."""
    return report.side_by_side(spark, fit_ols(model_frame(spark, d, SAT_OLS), SAT_OLS, LEVELS))


# --- accuracy on time, within subsets ------------------------------------------------

# Subset -> (column, row test, SQL test).  A model's outcome is NULL outside its
# subset, so all six models are fitted from the same patterns.
SUBSETS = {
    "Yes": ("randomYes", lambda c: c == 1, "randomYes = 1"),
    "No": ("randomYes", lambda c: c == 0, "randomYes = 0"),
    "all": ("randomYes", lambda c: F.lit(True), "TRUE"),
    "Under": ("Region", lambda c: c == recode.UNDER, f"Region = '{recode.UNDER}'"),
    "Over": ("Region", lambda c: c == recode.OVER, f"Region = '{recode.OVER}'"),
    "PT": ("Region", recode.is_transition, "Region LIKE 'Phase Transition%'"),
}


def _subset_sql() -> str:
    return _union(
        [
            sqltext.logit(f"acc_time_{name}", f"SELECT * FROM ({b.SQL_ANALYSIS}) WHERE {test}", "correct", ["TimeOnTask"]).replace(
                "'TimeOnTask'", f"'time_{name}'"
            )
            for name, (_, _, test) in SUBSETS.items()
        ]
    )


@query("logit_time_subsets", _subset_sql())
def logit_time_subsets(spark, d):
    """Accuracy on time among Yes, No, all, Under, Over and transition trials.

    Each subset gets its own copy of the predictor, NULL elsewhere, so the six
    fits share one scan and one Newton iteration.
    """
    trials = b.analysis(spark, d).select("correct", "TimeOnTask", "randomYes", "Region")
    inside = {f"time_{name}": F.when(test(F.col(c)), F.col("TimeOnTask")) for name, (c, test, _) in SUBSETS.items()}
    specs = [ModelSpec(f"acc_{c}", "correct", (c,), "binomial") for c in inside]
    return tidy(spark, fit_logit(trials.withColumns(inside), specs))


# --- mixed models ---------------------------------------------------------------------

LMM_PT = ModelSpec("lmm_time_pt", "TimeOnTask", ("InPhaseTransition",), group=catalogue.PARTICIPANT)
RATIOS = [0.0, 0.01, 0.1, 0.5, 1.0, 5.0]

_SQL_GROUPS = f"""f AS (SELECT participant_id AS g, CASE WHEN InPhaseTransition = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x,
        TimeOnTask AS y FROM ({b.SQL_ANALYSIS})),
  gr AS MATERIALIZED (SELECT g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy FROM f GROUP BY g),
  tot AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM f),
  szs AS MATERIALIZED (SELECT n, count(*)::DOUBLE AS k, sum(sx) AS x, sum(sy) AS y, sum(sx * sx) AS xx, sum(sx * sy) AS xy, sum(sy * sy) AS yy
        FROM gr GROUP BY n)"""
# Cross-products less the part explained by the groups at ratio r, and what follows.
_SQL_REML = """SELECT r, b0, b1, rss / (n - 2) AS s2, m00, m01, m11, det, n,
     (n - 2) * (ln(2 * pi() * rss / (n - 2)) + 1) + logdet + ln(det) AS reml
  FROM (SELECT *, c - b0 * v0 - b1 * v1 AS rss FROM (SELECT *, (m11 * v0 - m01 * v1) / det AS b0, (m00 * v1 - m01 * v0) / det AS b1
  FROM (SELECT *, m00 * m11 - m01 * m01 AS det FROM (
    SELECT r, any_value(tot.n) AS n, any_value(tot.n) - sum(r / (1 + r * s.n) * s.k * s.n * s.n) AS m00,
       any_value(tot.x) - sum(r / (1 + r * s.n) * s.n * s.x) AS m01, any_value(tot.xx) - sum(r / (1 + r * s.n) * s.xx) AS m11,
       any_value(tot.y) - sum(r / (1 + r * s.n) * s.n * s.y) AS v0, any_value(tot.xy) - sum(r / (1 + r * s.n) * s.xy) AS v1,
       any_value(tot.yy) - sum(r / (1 + r * s.n) * s.yy) AS c, sum(s.k * ln(1 + r * s.n)) AS logdet
    FROM szs s, tot, {ratios} GROUP BY r))))"""


@query(
    "lmm_time_pt_profile",
    f"""WITH {_SQL_GROUPS}
        SELECT r AS ratio, round(b0, 6) AS beta0, round(b1, 6) AS beta1, round(s2, 6) AS sigma2, round(reml, 4) AS reml
        FROM ({_SQL_REML.format(ratios="(VALUES " + ", ".join(f"({r}::DOUBLE)" for r in RATIOS) + ") AS ratios(r)")})""",
)
def lmm_time_pt_profile(spark, d):
    """The REML criterion and estimates along a grid of variance ratios."""
    profile = reml_profile(model_frame(spark, d, [LMM_PT]), LMM_PT, RATIOS, LEVELS)
    return rounded(profile.withColumn("reml", F.round("reml", 4)))


@query("lmm_time_pt", sqltext.lmm("lmm_time_pt", b.SQL_ANALYSIS, "TimeOnTask", catalogue.PARTICIPANT, ["InPhaseTransitionYes"]))
def lmm_time_pt(spark, d):
    return mixed_table(spark, [fit_lmm(model_frame(spark, d, [LMM_PT]), LMM_PT, LEVELS)])


def mixed_table(spark, fits: list[Fit]) -> DataFrame:
    """Coefficients with the variance components of their model, at display precision."""
    effects = report.coefficients(spark, fits).select("model", "term", *[F.round(c, 4).alias(c) for c in ("estimate", "std_error")], F.round("statistic", 3).alias("statistic"))
    parts = report.fit_table(spark, fits).select(
        "model", F.round("sigma", 4).alias("sigma"), F.round("group_sd", 2).alias("group_sd"), F.round("reml", 3).alias("reml")
    )
    return effects.join(parts, "model")


def _register_mixed() -> None:
    """The random-intercept models fitted for the knapsack task."""
    for short in ("PT", "prop"):
        for control in catalogue.NONE_LEARN_STRAT_MSTRAT:
            time = catalogue.spec("knapsack", "time", "me", catalogue.MAIN[short], control)
            accuracy = catalogue.spec("knapsack", "acc", "me", catalogue.MAIN[short], control)

            def linear(spark, d, spec=time):
                return mixed_table(spark, [fit_lmm(model_frame(spark, d, [spec]), spec, LEVELS)])

            def logistic(spark, d, spec=accuracy):
                return _logistic_table(spark, fit_glmm(model_frame(spark, d, [spec]), spec, LEVELS))

            suffix = "_".join(x for x in (short.lower(), control) if x)
            if suffix != "pt":
                sql = sqltext.lmm(time.name, _people_needed([time]), time.outcome, catalogue.PARTICIPANT, _terms(time))
                query(f"lmm_time_{suffix}", sql)(linear)
            sql = sqltext.glmm(accuracy.name, _people_needed([accuracy]), accuracy.outcome, catalogue.PARTICIPANT, _terms(accuracy))
            query(f"glmm_acc_{suffix}", sql)(logistic)


def _logistic_table(spark, fit: Fit) -> DataFrame:
    return _logistic_tables(spark, [fit])


def _logistic_tables(spark, fits: list[Fit]) -> DataFrame:
    effects = report.coefficients(spark, fits).select(
        "model", "term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error"), F.round("statistic", 3).alias("statistic")
    )
    parts = report.fit_table(spark, fits).select("model", F.round("group_sd", 4).alias("group_sd"), F.round("loglik", 4).alias("loglik"))
    return effects.join(parts, "model")


def _mixed_summary(spark, fit: Fit) -> DataFrame:
    return _mixed_summaries(spark, [fit])


def _mixed_summaries(spark, fits: list[Fit]) -> DataFrame:
    """One row per coefficient, with its model's fit statistics."""
    stats = report.fit_table(spark, fits).select(
        "model", "n", "converged", "loglik", "aic", "bic", "sigma", "group_sd", "slope_sd", "group_cor"
    )
    return rounded(report.coefficients(spark, fits).join(stats, "model"))


_register_mixed()


def _other_intercepts(task: str, outcome: str) -> list[ModelSpec]:
    """Random-intercept models of a task that have no query of their own above."""
    own = catalogue.NONE_LEARN_STRAT_MSTRAT if task == "knapsack" else ()
    families = [(main, sets) for (of, kind, main), sets in catalogue.FAMILIES[task].items() if (of, kind) == (outcome, "me")]
    return [
        catalogue.spec(task, outcome, "me", catalogue.MAIN[main], control)
        for main, sets in families
        for control in sets
        if control not in own
    ]


def _slopes(task: str, outcome: str) -> list[ModelSpec]:
    """Every random-slope model of a task."""
    families = catalogue.FAMILIES[task].items()
    return [catalogue.spec(task, outcome, "mes", catalogue.MAIN[main], c) for (of, kind, main), sets in families if (of, kind) == (outcome, "mes") for c in sets]


def _grid(spark, d, specs: list[ModelSpec]) -> list[Fit]:
    fit = fit_glmm_grid if specs[0].family == "binomial" else fit_lmm_grid
    return fit(model_frame(spark, d, specs), specs, LEVELS)


def _register_mixed_grids() -> None:
    """All other mixed models of each task, a grid for each outcome, from one scan of the trials.

    The SQL of the single models is too slow with this many terms; tests hold
    grids against single fits, and the profiles are checked in SQL.
    """
    for task in catalogue.TASKS:
        lines, logits = _other_intercepts(task, "time"), _other_intercepts(task, "acc")

        def linear(spark, d, specs=lines):
            fits = _grid(spark, d, specs)
            known = report.fit_table(spark, fits).select("model", "n", "converged")
            return mixed_table(spark, fits).join(known, "model")

        def logistic(spark, d, specs=logits):
            fits = _grid(spark, d, specs)
            known = report.fit_table(spark, fits).select("model", "n", "converged")
            return _logistic_tables(spark, fits).join(known, "model")

        query(f"model_grid_lmm_{task}")(linear)
        query(f"model_grid_glmm_{task}")(logistic)
        for outcome, kind in (("time", "lmm"), ("acc", "glmm")):

            def slopes(spark, d, specs=_slopes(task, outcome)):
                return _mixed_summaries(spark, _grid(spark, d, specs))

            query(f"model_grid_{kind}_slope_{task}")(slopes)


_register_mixed_grids()


@query("post_learning_tsp")
def post_learning_tsp(spark, d):
    """The linear random-slope models that are fitted to the trials after the learning phase only."""
    wanted = set(catalogue.POST_LEARNING["tsp"])
    specs = [s for s in _slopes("tsp", "time") if s.name in wanted]
    late = model_frame(spark, d, specs, ("TrialNumber",)).filter(F.col("TrialNumber") > 6)
    return _mixed_summaries(spark, fit_lmm_grid(late, specs, LEVELS))


@query("lmm_slope_time_pt")
def lmm_slope_time_pt(spark, d):
    spec = catalogue.spec("sat", "time", "mes", "InPhaseTransition")
    return _mixed_summary(spark, fit_lmm(model_frame(spark, d, [spec]), spec, LEVELS))


# Lower factors of the relative covariance of intercept and slope.
FACTORS = [(0.0, 0.0, 0.0), (0.3, 0.0, 0.2), (0.5, -0.1, 0.3), (1.0, 0.4, 0.7), (0.1, 0.05, 0.02)]

# For a binary slope a group enters by its counts and sums: with M = Z'Z and the
# relative covariance G the weight is W = G (I + M G)^-1, two by two throughout.
_SQL_SLOPE_PROFILE = f"""WITH f AS (SELECT participant_id AS g, CASE WHEN InPhaseTransition = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x,
        TimeOnTask AS y FROM ({b.SQL_ANALYSIS})),
  gr AS MATERIALIZED (SELECT g, count(*)::DOUBLE AS n, sum(x) AS k, sum(y) AS b0, sum(x * y) AS b1, sum(y * y) AS c FROM f GROUP BY g),
  pts(point, l1, l2, l3) AS (VALUES {", ".join(f"({i}, {p[0]}::DOUBLE, {p[1]}::DOUBLE, {p[2]}::DOUBLE)" for i, p in enumerate(FACTORS))}),
  cov AS (SELECT point, l1 * l1 AS g0, l1 * l2 AS g1, l2 * l2 + l3 * l3 AS g2 FROM pts),
  pr AS (SELECT *, 1 + n * g0 + k * g1 AS q0, n * g1 + k * g2 AS q1, k * g0 + k * g1 AS q2, 1 + k * g1 + k * g2 AS q3 FROM gr, cov),
  wt AS (SELECT *, q0 * q3 - q1 * q2 AS det FROM pr),
  w AS (SELECT *, (g0 * q3 - g1 * q2) / det AS w0, (g1 * q0 - g0 * q1) / det AS w1, (g2 * q0 - g1 * q1) / det AS w2 FROM wt),
  s AS (SELECT point, sum(n) AS n, sum(ln(det)) AS logdet,
      sum(n - (n * n * w0 + 2 * n * k * w1 + k * k * w2)) AS m00, sum(k - (n * k * w0 + (n * k + k * k) * w1 + k * k * w2)) AS m01,
      sum(k - (k * k * w0 + 2 * k * k * w1 + k * k * w2)) AS m11,
      sum(b0 - (n * w0 * b0 + n * w1 * b1 + k * w1 * b0 + k * w2 * b1)) AS v0, sum(b1 - (k * w0 * b0 + k * w1 * b1 + k * w1 * b0 + k * w2 * b1)) AS v1,
      sum(c - (b0 * b0 * w0 + 2 * b0 * b1 * w1 + b1 * b1 * w2)) AS c FROM w GROUP BY point),
  d AS (SELECT *, m00 * m11 - m01 * m01 AS md FROM s),
  e AS (SELECT *, (m11 * v0 - m01 * v1) / md AS beta0, (m00 * v1 - m01 * v0) / md AS beta1 FROM d),
  r AS (SELECT *, c - beta0 * v0 - beta1 * v1 AS rss FROM e)
  SELECT point, round(beta0, 6) AS beta0, round(beta1, 6) AS beta1, round(rss / (n - 2), 6) AS sigma2,
    round((n - 2) * (ln(2 * pi() * rss / (n - 2)) + 1) + logdet + ln(md), 4) AS reml FROM r"""


@query("lmm_slope_time_profile", _SQL_SLOPE_PROFILE)
def lmm_slope_time_profile(spark, d):
    """The REML criterion and estimates of the random-slope model at fixed covariance factors."""
    spec = catalogue.spec("sat", "time", "mes", "InPhaseTransition")
    profile = reml_profile_slope(model_frame(spark, d, [spec]), spec, FACTORS, LEVELS)
    return rounded(profile.withColumn("reml", F.round("reml", 4)))


@query("lmm_slope_time_difficulty")
def lmm_slope_time_difficulty(spark, d):
    spec = catalogue.spec("sat", "time", "mes", "Difficulty", "learn")
    return _mixed_summary(spark, fit_lmm(model_frame(spark, d, [spec]), spec, LEVELS))


@query("glmm_slope_acc_pt")
def glmm_slope_acc_pt(spark, d):
    spec = catalogue.spec("sat", "acc", "mes", "InPhaseTransition")
    return _mixed_summary(spark, fit_glmm(model_frame(spark, d, [spec]), spec, LEVELS))


# Points (intercept, slope, and the lower factor of the covariance of their random effects).
LAPLACE_POINTS = [(0.5, -0.3, 0.4, 0.1, 0.3), (0.2, 0.1, 0.0, 0.0, 0.0), (1.0, -0.8, 1.2, -0.5, 0.7), (0.4, 0.0, 0.1, 0.6, 0.05)]


def _sql_laplace(where: str) -> str:
    """The Laplace objective of a binary slope: the mode of a group's two effects by Newton steps on its four counts."""
    points = ", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in p)})" for k, p in enumerate(LAPLACE_POINTS))
    mu = "(1 / (1 + exp(-({}))))"
    e0, e1 = "b0 + l1 * v0", "b0 + b1 + (l1 + l2) * v0 + l3 * v1"
    m0, m1 = mu.format(e0), mu.format(e1)
    state = f"""SELECT *, s0 - n0 * m0 AS r0, s1 - n1 * m1 AS r1, n0 * m0 * (1 - m0) AS w0, n1 * m1 * (1 - m1) AS w1
        FROM (SELECT *, {m0} AS m0, {m1} AS m1 FROM (SELECT * FROM modes))"""
    curved = """SELECT *, 1 + w0 * l1 * l1 + w1 * (l1 + l2) * (l1 + l2) AS a00, w1 * (l1 + l2) * l3 AS a01, 1 + w1 * l3 * l3 AS a11,
        r0 * l1 + r1 * (l1 + l2) - v0 AS q0, r1 * l3 - v1 AS q1"""
    return f"""WITH RECURSIVE f AS (SELECT participant_id AS g, CASE WHEN InPhaseTransition = 'Yes' THEN 1 ELSE 0 END AS x, correct AS y
          FROM ({b.SQL_ANALYSIS}) WHERE {where}),
      gr AS (SELECT g, count(*) FILTER (x = 0)::DOUBLE AS n0, coalesce(sum(y) FILTER (x = 0), 0)::DOUBLE AS s0,
          count(*) FILTER (x = 1)::DOUBLE AS n1, coalesce(sum(y) FILTER (x = 1), 0)::DOUBLE AS s1 FROM f WHERE g IS NOT NULL AND y IS NOT NULL GROUP BY g),
      pts(point, b0, b1, l1, l2, l3) AS (VALUES {points}),
      modes AS (
        SELECT 0 AS k, *, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1 FROM gr, pts
        UNION ALL
        SELECT k + 1, g, n0, s0, n1, s1, point, b0, b1, l1, l2, l3, v0 + d0 * least(1, 2 / big), v1 + d1 * least(1, 2 / big)
        FROM (SELECT *, greatest(abs(d0), abs(d1), 1e-300) AS big FROM (
          SELECT *, (a11 * q0 - a01 * q1) / (a00 * a11 - a01 * a01) AS d0, (a00 * q1 - a01 * q0) / (a00 * a11 - a01 * a01) AS d1
          FROM ({curved} FROM ({state})))) WHERE k < 30
      )
      SELECT point, round(sum(s0 * ({e0}) - n0 * ln(1 + exp({e0})) + s1 * ({e1}) - n1 * ln(1 + exp({e1}))
          - 0.5 * (v0 * v0 + v1 * v1) - 0.5 * ln(a00 * a11 - a01 * a01)), 4) AS loglik
      FROM ({curved} FROM ({state})) WHERE k = 30 GROUP BY point"""


def _laplace_profile(spark, d, late: bool) -> DataFrame:
    spec = catalogue.spec("sat", "acc", "mes", "InPhaseTransition")
    frame = model_frame(spark, d, [spec], ("TrialNumber",))
    return rounded(laplace_profile(frame.filter(F.col("TrialNumber") > 6) if late else frame, spec, LAPLACE_POINTS, LEVELS), 4)


@query("glmm_slope_profile", _sql_laplace("TRUE"))
def glmm_slope_profile(spark, d):
    """The Laplace log-likelihood of the random-slope model at fixed points."""
    return _laplace_profile(spark, d, late=False)


@query("glmm_slope_profile_post_learning", _sql_laplace("TrialNumber > 6"))
def glmm_slope_profile_post_learning(spark, d):
    return _laplace_profile(spark, d, late=True)


@query("glmm_slope_acc_post_learning")
def glmm_slope_acc_post_learning(spark, d):
    """The random-slope model on the trials after the learning phase."""
    spec = catalogue.spec("sat", "acc", "mes", "InPhaseTransition")
    late = model_frame(spark, d, [spec], ("TrialNumber",)).filter(F.col("TrialNumber") > 6)
    return _mixed_summary(spark, fit_glmm(late, spec, LEVELS))


PANEL = ModelSpec("panel", "TimeOnTask", ("InPhaseTransition",), group=catalogue.PARTICIPANT)

_SQL_PANEL = f"""WITH {_SQL_GROUPS},
  q AS (SELECT sum(n) AS n, count(*)::DOUBLE AS k, sum(sx * sx / n) AS xx, sum(sx * sy / n) AS xy, sum(sy * sy / n) AS yy,
               sum(n * n) AS t00, sum(n * sx) AS t01, sum(sx * sx) AS t11 FROM gr),
  u AS (SELECT tot.n, q.k, (tot.yy - q.yy - (tot.xy - q.xy) * (tot.xy - q.xy) / (tot.xx - q.xx)) / (tot.n - q.k - 1) AS idio,
         tot.n AS p00, tot.x AS p01, q.xx AS p11, tot.y AS r0, q.xy AS r1, q.yy, t00, t01, t11, tot.n * q.xx - tot.x * tot.x AS pdet FROM tot, q),
  bt AS (SELECT *, (p11 * r0 - p01 * r1) / pdet AS c0, (p00 * r1 - p01 * r0) / pdet AS c1,
         n - (p11 * t00 - 2 * p01 * t01 + p00 * t11) / pdet AS spread FROM u),
  vc AS (SELECT idio, greatest((yy - c0 * r0 - c1 * r1 - (k - 2) * idio) / spread, 0) AS indiv FROM bt),
  rt AS MATERIALIZED (SELECT indiv / idio AS r FROM vc),
  o AS MATERIALIZED ({_SQL_REML.format(ratios="rt")}),
  est AS (SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(s2 * m11 / det) AS std_error FROM o
          UNION ALL SELECT 'InPhaseTransitionYes', b1, sqrt(s2 * m00 / det) FROM o)
  {sqltext.tidy("panel", sqltext.normal_p("statistic"))}"""


@query("panel_random_effects", _SQL_PANEL)
def panel_random_effects(spark, d):
    return tidy(spark, [fit_panel(model_frame(spark, d, [PANEL]), PANEL, LEVELS)])


@query(
    "placebo_logit",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, value FROM events),
          rs AS (SELECT event_id, y, row_number() OVER (ORDER BY md5(event_id || ':rows:11'), event_id) AS k FROM e),
          vs AS (SELECT value, row_number() OVER (ORDER BY md5(event_id || ':values:11'), event_id) AS k FROM e)
        {sqltext.logit("placebo", "SELECT y AS correct, value FROM rs JOIN vs USING (k)", "correct", ["value"])}""",
)
def placebo_logit(spark, d):
    """Logistic fit after permuting the predictor: the placebo analysis."""
    events = b.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type").isin("click", "view"), 1.0).otherwise(0.0).alias("correct"), "value"
    )
    permuted = shuffle_column(events, "event_id", "value", seed=11)
    return tidy(spark, fit_logit(permuted, [ModelSpec("placebo", "correct", ("value",), "binomial")]))
