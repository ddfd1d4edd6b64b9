"""Least squares and logistic regression against numpy and MLlib."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression

from trialstats.models import catalogue, report
from trialstats.models.logit import fit_logit
from trialstats.models.ols import fit_ols
from trialstats.models.spec import ModelSpec


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 600
    pdf = pd.DataFrame(
        {
            "kind": rng.choice(["No", "Yes"], n),
            "age": rng.normal(25, 4, n),
            "big": rng.normal(1e5, 50, n),
            "flag": rng.integers(0, 2, n).astype(float),
        }
    )
    eta = -0.4 + 0.8 * (pdf["kind"] == "Yes") + 0.05 * (pdf["age"] - 25) - 0.5 * pdf["flag"]
    pdf["correct"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    pdf["time"] = 20 + 3 * (pdf["kind"] == "Yes") - 0.2 * pdf["age"] + 0.01 * pdf["big"] + rng.normal(0, 2, n)
    return pdf


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data).repartition(4)
    holes = spark.createDataFrame(
        [(None, 20.0, 1e5, 1.0, 1.0, 30.0), ("Yes", None, 1e5, 0.0, 0.0, 31.0), ("No", 22.0, 1e5, 1.0, None, None)],
        df.schema,
    )
    return df.union(holes).cache()


SPECS = [
    ModelSpec("one", "time", ("kind",)),
    ModelSpec("two", "time", ("kind", "age")),
    ModelSpec("all", "time", ("kind", "age", "big", "flag")),
]


def dense(pdf, fixed, outcome):
    part = pdf.dropna(subset=[*fixed, outcome])
    x = np.column_stack([np.ones(len(part))] + [(part[c] == "Yes").astype(float) if c == "kind" else part[c] for c in fixed])
    return x, part[outcome].to_numpy()


def test_ols_matches_dense(frame):
    """Each model on its own complete rows."""
    pdf, specs = frame.toPandas(), SPECS
    for spec, fit in zip(specs, fit_ols(frame, specs), strict=True):
        x, y = dense(pdf, spec.fixed, "time")
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = ((y - x @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(y) - x.shape[1]) * np.diag(np.linalg.inv(x.T @ x)))
        assert fit.n == len(y)
        assert np.allclose(fit.estimate, beta, rtol=1e-6) and np.allclose(fit.std_error, se, rtol=1e-6)
        tss = ((y - y.mean()) ** 2).sum()
        assert math.isclose(fit.stats["r2"], 1 - rss / tss, rel_tol=1e-6)
    assert fit.terms == ["(Intercept)", "kindYes", "age", "big", "flag"]


@pytest.mark.parametrize("level", [0.0, 1e6, 1e8])
def test_predictors_far_from_zero_keep_their_digits(spark, level):
    """Least squares and mixed models against a QR on centred columns."""
    from trialstats.models.lmm import fit_lmm
    from trialstats.models.panel import fit_panel

    rng = np.random.default_rng(5)
    n = 5000
    x, z = level + rng.normal(0, 1, n), rng.normal(0, 1, n) - level
    g = rng.integers(0, 40, n)
    y = 2 * (x - level) - 0.5 * (z + level) + rng.normal(0, 1, 40)[g] + rng.normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "y": y, "g": g})).repartition(4)
    q, r = np.linalg.qr(np.column_stack([np.ones(n), x - x.mean(), z - z.mean()]))
    want = np.linalg.solve(r, q.T @ y)
    specs = [ModelSpec("one", "y", ("x",)), ModelSpec("two", "y", ("x", "z"))]
    single, (_, grid) = fit_ols(df, specs[1:])[0], fit_ols(df, specs)
    for fit in (single, grid):
        assert np.allclose(fit.estimate[1:], want[1:], rtol=0, atol=1e-8)
        assert np.isclose(fit.estimate[0], want[0] - want[1] * x.mean() - want[2] * z.mean(), rtol=1e-8, atol=1e-6)
    near = spark.createDataFrame(pd.DataFrame({"x": x - level, "z": z + level, "y": y, "g": g})).repartition(4)
    for fit_one in (fit_lmm, fit_panel):
        spec = ModelSpec("m", "y", ("x", "z"), group="g")
        far, close = fit_one(df, spec), fit_one(near, spec)
        assert np.allclose(far.estimate[1:], close.estimate[1:], rtol=0, atol=1e-7)
        assert np.allclose(far.std_error[1:], close.std_error[1:], rtol=1e-5)
        assert math.isclose(far.stats["group_sd"], close.stats["group_sd"], rel_tol=1e-5)


@pytest.mark.parametrize("scale", [1e-5, 1.0, 1e3])
def test_separation_does_not_depend_on_units(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 400)
    fine = (rng.random(400) < 1 / (1 + np.exp(-x))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x * scale + 3 * scale, "fine": fine, "apart": (x > 0).astype(float)}))
    (fit,) = fit_logit(df, [ModelSpec("m", "fine", ("x",), "binomial")])
    assert fit.converged
    (fit,) = fit_logit(df, [ModelSpec("m", "apart", ("x",), "binomial")])
    assert not fit.converged


def test_level_that_is_not_listed_is_refused(frame):
    with pytest.raises(Exception, match="not listed"):
        fit_ols(frame, [SPECS[0]], levels={"kind": ["Maybe", "No"]})
    with pytest.raises(ValueError):
        from trialstats.models.spec import factor_levels

        factor_levels(frame, ["kind"], max_levels=1)


def test_aliased_terms_are_left_out(spark, frame):
    """Constant terms and sums of earlier ones have no estimate; the others are as without them."""
    from trialstats.models.glmm import fit_glmm
    from trialstats.models.lmm import fit_lmm
    from trialstats.models.panel import fit_panel

    twice = frame.selectExpr("*", "2 * age AS age2", "1.0D AS one", "age + flag AS both", "CAST(floor(age) AS INT) % 7 AS g")
    fits = [
        (lambda s: fit_ols(twice, [s])[0], "time", {}),
        (lambda s: fit_logit(twice, [s])[0], "correct", {"family": "binomial"}),
        (lambda s: fit_lmm(twice, s), "time", {"group": "g"}),
        (lambda s: fit_panel(twice, s), "time", {"group": "g"}),
        (lambda s: fit_glmm(twice, s), "correct", {"family": "binomial", "group": "g"}),
    ]
    for fit, outcome, how in fits:
        full = fit(ModelSpec("m", outcome, ("one", "age", "age2", "flag", "both"), **how))
        plain = fit(ModelSpec("m", outcome, ("age", "flag"), **how))
        assert full.terms == ["(Intercept)", "one", "age", "age2", "flag", "both"] and full.n == plain.n
        assert np.isnan(full.estimate).tolist() == [False, True, False, True, False, True]
        assert np.allclose(full.estimate[[0, 2, 4]], plain.estimate, rtol=1e-6) and np.allclose(full.std_error[[0, 2, 4]], plain.std_error, rtol=1e-6)
        assert all(math.isclose(full.stats[k], plain.stats[k], rel_tol=1e-8) for k in ("loglik", "aic") if k in plain.stats)
        rows = {r["term"]: r for r in report.coefficients(spark, [full]).collect()}
        assert rows["age2"]["estimate"] is None and rows["age2"]["p_value"] is None and rows["age"]["p_value"] is not None


def test_leading_nulls_do_not_move_the_result(spark):
    """The first 1,500 of 5,000 values are missing, the others lie at 1e8."""
    rng = np.random.default_rng(8)
    n = 5000
    x = 1e8 + rng.normal(0, 1, n)
    y = 2 * (x - 1e8) + rng.normal(0, 1, n)
    g = rng.integers(0, 40, n)
    pdf = pd.DataFrame({"x": [None] * 1500 + x[1500:].tolist(), "y": y, "g": g})
    df = spark.createDataFrame(pdf, "x double, y double, g int").coalesce(1)
    near = spark.createDataFrame(pdf.assign(x=pdf["x"] - 1e8), "x double, y double, g int").repartition(5)
    q, r = np.linalg.qr(np.column_stack([np.ones(n - 1500), x[1500:] - x[1500:].mean()]))
    want = np.linalg.solve(r, q.T @ y[1500:])
    fit, other = (fit_ols(frame, [ModelSpec("m", "y", ("x",)), ModelSpec("n", "y", ("x",))])[0] for frame in (df, near))
    assert fit.n == 3500 and abs(fit.estimate[1] - want[1]) < 1e-8 and abs(other.estimate[1] - want[1]) < 1e-8
    assert np.isclose(fit.std_error[1], other.std_error[1], rtol=1e-8)


@pytest.mark.parametrize("offset", [1e4, 1e6])
def test_a_random_slope_does_not_depend_on_the_place_of_its_column(spark, offset):
    from trialstats.models.lmm import fit_lmm

    rng = np.random.default_rng(9)
    n = 2000
    x, g = rng.normal(0, 1, n), rng.integers(0, 40, n)
    y = 1 + (2 + rng.normal(0, 0.5, 40)[g]) * x + rng.normal(0, 1, 40)[g] + rng.normal(0, 1, n)
    spec = ModelSpec("m", "y", ("x",), group="g", slope="x")
    close, far = (fit_lmm(spark.createDataFrame(pd.DataFrame({"x": x + o, "y": y, "g": g})), spec) for o in (0.0, offset))
    assert close.converged and far.converged
    assert math.isclose(far.estimate[1], close.estimate[1], rel_tol=1e-7) and math.isclose(far.std_error[1], close.std_error[1], rel_tol=1e-6)
    for k in ("sigma", "slope_sd", "reml"):
        assert math.isclose(far.stats[k], close.stats[k], rel_tol=1e-5)


def test_states_merge_in_any_order():
    from trialstats.models import moments

    rng = np.random.default_rng(2)
    x = rng.normal(1e7, 1, (900, 4))
    x[rng.random((900, 4)) < 0.1] = np.nan
    for cuts in ([300, 600], [1, 2, 3, 899], []):
        merged = moments._Merged()
        for part in np.split(x, cuts):
            merged.add(*moments.block_states(part)[1:])
        for use in ([0, 1], [0, 1, 2, 3], [3]):
            full = x[~np.isnan(x[:, use]).any(axis=1)][:, use]
            state = moments.complete(list(merged.parts.values()), use)
            apart = full - full.mean(axis=0)
            assert state.n == len(full) and np.allclose(state.mean, full.mean(axis=0), rtol=1e-14)
            assert np.allclose(state.product, apart.T @ apart, rtol=1e-8, atol=1e-5)
    codes = rng.integers(0, 7, 900)
    code, count, mean, product = moments.block_states(x, codes)
    for k in range(7):
        assert count[code == k].sum() == (codes == k).sum()


LOGITS = [
    ModelSpec("one", "correct", ("kind",), "binomial"),
    ModelSpec("more", "correct", ("kind", "age", "flag"), "binomial"),
]


@pytest.mark.parametrize("local_rows", [20_000, 0])
def test_logit_matches_mllib(spark, frame, local_rows):
    fits = fit_logit(frame, LOGITS, local_rows=local_rows)
    for spec, fit in zip(LOGITS, fits, strict=True):
        complete = frame.dropna(subset=[*spec.fixed, "correct"])
        formula = RFormula(
            formula=f"correct ~ {' + '.join(spec.fixed)}", stringIndexerOrderType="alphabetDesc", featuresCol="f", labelCol="l"
        )
        ready = formula.fit(complete).transform(complete)
        glm = GeneralizedLinearRegression(family="binomial", featuresCol="f", labelCol="l", tol=1e-12, maxIter=50).fit(ready)
        # MLlib lists the intercept last.
        order = [*range(1, len(fit.estimate)), 0]
        assert np.allclose(fit.estimate[order], [*glm.coefficients, glm.intercept], rtol=1e-7)
        assert np.allclose(fit.std_error[order], glm.summary.coefficientStandardErrors, rtol=1e-6)
        assert math.isclose(fit.stats["deviance"], glm.summary.deviance, rel_tol=1e-9)
        assert math.isclose(fit.stats["aic"], glm.summary.aic, rel_tol=1e-9)
        assert fit.converged


def test_saturated_logit_is_the_log_odds_ratio(spark):
    cells = {("No", 0.0): 30, ("No", 1.0): 50, ("Yes", 0.0): 40, ("Yes", 1.0): 20}
    rows = [k for k, n in cells.items() for _ in range(n)]
    (fit,) = fit_logit(spark.createDataFrame(rows, "kind string, correct double"), [LOGITS[0]])
    assert math.isclose(fit.estimate[0], math.log(50 / 30), rel_tol=1e-9)
    assert math.isclose(fit.estimate[1], math.log((20 / 40) / (50 / 30)), rel_tol=1e-9)
    assert math.isclose(fit.std_error[1], math.sqrt(1 / 30 + 1 / 50 + 1 / 40 + 1 / 20), rel_tol=1e-6)
    n = sum(cells.values())
    assert math.isclose(fit.stats["bic"], fit.stats["deviance"] + 2 * math.log(n))


def test_separation_is_reported(spark):
    rows = [("No", 0.0)] * 20 + [("Yes", 1.0)] * 20
    (fit,) = fit_logit(spark.createDataFrame(rows, "kind string, correct double"), [LOGITS[0]])
    assert not fit.converged


def test_reports(spark, frame):
    fits = fit_ols(frame, SPECS)
    table = report.coefficients(spark, fits).collect()
    assert [r["term"] for r in table if r["model"] == "two"] == ["(Intercept)", "kindYes", "age"]
    kind = next(r for r in table if r["model"] == "all" and r["term"] == "kindYes")
    assert kind["stars"] == "***" and kind["p_value"] < 0.01
    wide = report.side_by_side(spark, fits)
    assert wide.columns == ["term", "one", "two", "all"] and wide.count() == 5
    assert report.fit_table(spark, fits).count() == 3
    assert [report.stars(p) for p in (0.001, 0.03, 0.08, 0.5, None)] == ["***", "**", "*", "", ""]


def test_spec_validation():
    with pytest.raises(ValueError):
        ModelSpec("m", "y", ("x",), "poisson")
    with pytest.raises(ValueError):
        ModelSpec("m", "y", ("x",), slope="x")


def test_catalogue_size_and_some_members():
    """48 live and 154 further models, of which 17 are on subsets, one is the
    panel model and one repeats a model on late trials."""
    sizes = {t: len(catalogue.specs(t)) for t in catalogue.TASKS}
    subsets = sum(len(s) for s in catalogue.TIME_SUBSETS.values())
    assert sum(sizes.values()) + subsets + 1 + 1 == 48 + 154
    names = {s.name: s for s in catalogue.specs("knapsack")}
    assert names["acc_me_prop_strat"].fixed == ("propagations", "Greedy", "Feasible", "Large_Items", "Prioritising_Properties")
    assert names["time_mes_dec_all"].slope == "decisions"
    assert len({s.name for s in catalogue.specs("sat")}) == sizes["sat"]
