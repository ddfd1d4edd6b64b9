"""Mixed and panel models against dense linear algebra on small data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstats.models import glmm
from trialstats.models.glmm import LaplaceData, fit_glmm, fit_glmm_grid
from trialstats.models.lmm import fit_lmm, fit_lmm_grid, lower_factor, reml_profile
from trialstats.models.logit import fit_logit
from trialstats.models.ols import fit_ols
from trialstats.models.optimise import newton_steps, side_by_side
from trialstats.models.panel import fit_panel
from trialstats.models.patterns import _block, opened
from trialstats.models.spec import ModelSpec


def simulate(groups, sizes, group_sd, slope_sd, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        a, b = rng.normal(0, group_sd), rng.normal(0, slope_sd)
        for _ in range(sizes(rng)):
            x, t = float(rng.integers(0, 2)), float(rng.normal(10, 3))
            eta = -0.4 + 0.9 * x + 0.08 * (t - 10) + a + b * x
            y = float(rng.random() < 1 / (1 + math.exp(-eta)))
            rows.append((f"g{g}", x, t, y, 20 + 3 * x + 0.5 * t + 3 * a + 3 * b * x + rng.normal(0, 2)))
    return pd.DataFrame(rows, columns=["g", "x", "t", "y", "w"])


@pytest.fixture(scope="module")
def pdf():
    return simulate(24, lambda r: r.integers(4, 22), 0.9, 0.6, 3)


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(3).cache()


def design(pdf):
    return np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["t"]])


def dense_reml(pdf, covariance, slope):
    """REML criterion, coefficients and variance with V = I + Z G Z' built in full."""
    x, y = design(pdf), pdf["w"].to_numpy()
    same = pdf["g"].to_numpy()[:, None] == pdf["g"].to_numpy()[None, :]
    z = np.column_stack([np.ones(len(pdf))] + ([pdf["x"]] if slope else []))
    v = np.eye(len(y)) + same * (z @ covariance @ z.T)
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    rss = (y - x @ beta) @ vi @ (y - x @ beta)
    df = len(y) - x.shape[1]
    reml = df * (math.log(2 * math.pi * rss / df) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return reml, beta, np.sqrt(rss / df * np.diag(np.linalg.inv(a)))


SPEC = ModelSpec("m", "w", ("x", "t"), group="g")
SLOPE = ModelSpec("m", "w", ("x", "t"), group="g", slope="x")


def test_profile_matches_dense(df, pdf):
    for row in reml_profile(df, SPEC, [0.0, 0.05, 0.7, 20.0]).collect():
        reml, beta, _ = dense_reml(pdf, np.array([[row["ratio"]]]), False)
        assert math.isclose(row["reml"], reml, rel_tol=1e-9)
        assert np.allclose([row["beta0"], row["beta1"], row["beta2"]], beta, rtol=1e-8)


@pytest.mark.parametrize("local_rows", [20_000, 0])
def test_random_intercept(df, pdf, local_rows):
    fit = fit_lmm(df, SPEC, local_rows=local_rows)
    ratio = (fit.stats["group_sd"] / fit.stats["sigma"]) ** 2
    reml, beta, se = dense_reml(pdf, np.array([[ratio]]), False)
    assert math.isclose(fit.stats["reml"], reml, rel_tol=1e-9)
    assert np.allclose(fit.estimate, beta, rtol=1e-7) and np.allclose(fit.std_error, se, rtol=1e-7)
    for factor in (0.99, 1.01):
        assert dense_reml(pdf, np.array([[ratio * factor]]), False)[0] > reml
    assert fit.stats["groups"] == 24


def test_random_slope(df, pdf):
    fit = fit_lmm(df, SLOPE)
    s, a, b = fit.stats["sigma"], fit.stats["group_sd"], fit.stats["slope_sd"]
    cov = np.array([[a * a, fit.stats["group_cor"] * a * b], [0, b * b]]) / s**2
    cov[1, 0] = cov[0, 1]
    reml, beta, se = dense_reml(pdf, cov, True)
    assert fit.converged and math.isclose(fit.stats["reml"], reml, rel_tol=1e-9)
    assert np.allclose(fit.estimate, beta, rtol=1e-6) and np.allclose(fit.std_error, se, rtol=1e-6)
    rng = np.random.default_rng(0)
    root = np.linalg.cholesky(cov)
    for _ in range(12):
        moved = root + 0.02 * np.tril(rng.normal(size=(2, 2)))
        assert dense_reml(pdf, moved @ moved.T, True)[0] > reml - 1e-6


def test_balanced_groups_give_the_anova_estimate(spark):
    rng = np.random.default_rng(8)
    k, m = 12, 7
    y = rng.normal(0, 2, (k, 1)) + rng.normal(0, 1, (k, m))
    x = np.tile(np.arange(m) - 3.0, (k, 1))
    rows = [(g, float(x[g, i]), float(y[g, i])) for g in range(k) for i in range(m)]
    fit = fit_lmm(spark.createDataFrame(rows, "g int, x double, w double"), ModelSpec("m", "w", ("x",), group="g"))
    slope = (x * y).sum() / (x * x).sum()
    resid = y - slope * x
    within = ((resid - resid.mean(1, keepdims=True)) ** 2).sum() / (k * (m - 1) - 1)
    between = m * resid.mean(1).var(ddof=1)
    assert math.isclose(fit.stats["sigma"] ** 2, within, rel_tol=1e-6)
    assert math.isclose(fit.stats["group_sd"] ** 2, (between - within) / m, rel_tol=1e-6)


def test_no_group_effect_is_the_boundary(spark):
    """Groups that balance out exactly leave no variance between them."""
    rows = [(g, float(i % 2), float(i * i % 5)) for g in range(6) for i in range(10)]
    df = spark.createDataFrame(rows, "g int, x double, w double")
    fit = fit_lmm(df, ModelSpec("m", "w", ("x",), group="g"))
    (ols,) = fit_ols(df, [ModelSpec("m", "w", ("x",))])
    assert fit.stats["group_sd"] == 0 and np.allclose(fit.estimate, ols.estimate)


def test_panel_matches_dense_gls(df, pdf):
    fit = fit_panel(df, SPEC)
    ratio = (fit.stats["group_sd"] / fit.stats["sigma"]) ** 2
    _, beta, se = dense_reml(pdf, np.array([[ratio]]), False)
    assert np.allclose(fit.estimate, beta, rtol=1e-7) and np.allclose(fit.std_error, se, rtol=1e-7)
    # The within variance: regression on deviations from group means.
    x = design(pdf)[:, 1:]
    means = pdf.groupby("g")[["x", "t", "w"]].transform("mean")
    xd, yd = x - means[["x", "t"]].to_numpy(), (pdf["w"] - means["w"]).to_numpy()
    b, *_ = np.linalg.lstsq(xd, yd, rcond=None)
    within = ((yd - xd @ b) ** 2).sum() / (len(pdf) - 24 - 2)
    assert math.isclose(fit.stats["sigma"] ** 2, within, rel_tol=1e-8)


def test_panel_balanced_components(spark):
    rng = np.random.default_rng(2)
    k, m = 15, 6
    x = rng.normal(size=(k, m))
    y = 2 * x + rng.normal(0, 1.5, (k, 1)) + rng.normal(size=(k, m))
    rows = [(g, float(x[g, i]), float(y[g, i])) for g in range(k) for i in range(m)]
    fit = fit_panel(spark.createDataFrame(rows, "g int, x double, w double"), ModelSpec("m", "w", ("x",), group="g"))
    xm, ym = x.mean(1), y.mean(1)
    design_ = np.column_stack([np.ones(k), xm])
    b, *_ = np.linalg.lstsq(design_, ym, rcond=None)
    between = ((ym - design_ @ b) ** 2).sum() / (k - 2)
    assert math.isclose(fit.stats["group_sd"] ** 2, between - fit.stats["sigma"] ** 2 / m, rel_tol=1e-8)


LOGIT = ModelSpec("m", "y", ("x", "t"), "binomial", group="g")
LOGIT_SLOPE = ModelSpec("m", "y", ("x", "t"), "binomial", group="g", slope="x")


def dense_laplace(pdf, beta, root):
    """Laplace log-likelihood, group by group, modes by damped Newton."""
    total = 0.0
    q = len(root)
    for _, part in pdf.groupby("g"):
        x = design(part)
        z, y = x[:, :q], part["y"].to_numpy()
        v = np.zeros(q)

        def height(v):
            eta = x @ beta + z @ root @ v
            return y @ eta - np.logaddexp(0, eta).sum() - v @ v / 2

        for _ in range(200):
            mu = 1 / (1 + np.exp(-(x @ beta + z @ root @ v)))
            curve = np.eye(q) + root.T @ (z * (mu * (1 - mu))[:, None]).T @ z @ root
            step = np.linalg.solve(curve, root.T @ z.T @ (y - mu) - v)
            while height(v + step) < height(v) - 1e-12:
                step = step / 2
            v = v + step
            if np.abs(step).max() < 1e-12:
                break
        mu = 1 / (1 + np.exp(-(x @ beta + z @ root @ v)))
        curve = np.eye(q) + root.T @ (z * (mu * (1 - mu))[:, None]).T @ z @ root
        total += height(v) - np.linalg.slogdet(curve)[1] / 2
    return total


def raw_root(fit):
    a = fit.stats["group_sd"]
    if "slope_sd" not in fit.stats:
        return np.array([[a]])
    b = fit.stats["slope_sd"]
    r = fit.stats.get("group_cor", 0.0)
    return np.array([[a, 0], [r * b, b * math.sqrt(max(1 - r * r, 0))]])


@pytest.mark.parametrize("spec", [LOGIT, LOGIT_SLOPE], ids=["intercept", "slope"])
@pytest.mark.parametrize(("hot", "few"), [(10**6, 64), (10**6, 0), (10, 64)], ids=["cold", "shuffled", "hot"])
def test_glmm_is_the_dense_laplace_maximum(df, pdf, spec, hot, few, monkeypatch):
    """Also with task results added by Spark, and with most groups spread over partitions."""
    monkeypatch.setattr(glmm, "FEW_TASKS", few)
    fit = fit_glmm(df, spec, hot_patterns=hot)
    root = raw_root(fit)
    best = dense_laplace(pdf, fit.estimate, root)
    assert fit.converged and math.isclose(fit.stats["loglik"], best, rel_tol=1e-8)
    scale = np.array([1.0, 1.0, 0.1])
    rng = np.random.default_rng(1)
    for _ in range(10):
        beta = fit.estimate + 0.02 * scale * rng.normal(size=3)
        assert dense_laplace(pdf, beta, root) < best
    for _ in range(6):
        moved = root + 0.02 * np.tril(rng.normal(size=root.shape))
        assert dense_laplace(pdf, fit.estimate, moved) < best + 1e-6


def test_glmm_standard_errors_are_from_the_full_curvature(df, pdf):
    fit = fit_glmm(df, LOGIT)
    point, h = np.append(fit.estimate, fit.stats["group_sd"]), np.array([1e-3, 1e-3, 1e-4, 1e-3])
    k = len(point)
    hessian = np.empty((k, k))

    def value(p):
        return -dense_laplace(pdf, p[:3], np.array([[p[3]]]))

    for i in range(k):
        for j in range(k):
            ei, ej = np.eye(k)[i] * h, np.eye(k)[j] * h
            hessian[i, j] = (
                value(point + ei + ej) - value(point + ei - ej) - value(point - ei + ej) + value(point - ei - ej)
            ) / (4 * h[i] * h[j])
    assert np.allclose(fit.std_error, np.sqrt(np.diag(np.linalg.inv(hessian)))[:3], rtol=1e-3)


@pytest.mark.parametrize("spec", [LOGIT, LOGIT_SLOPE], ids=["intercept", "slope"])
def test_laplace_gradient(df, spec):
    data = LaplaceData(df, [spec])
    try:
        point = np.array([-0.2, 0.3, 0.1, 0.6] if data.models[0].q == 1 else [-0.2, 0.3, 0.1, 0.6, 0.2, 0.4])
        h, k = 1e-5, len(point)
        f, g = data.evaluate({0: np.vstack([point, point + h * np.eye(k), point - h * np.eye(k)])})[0]
    finally:
        data.close()
    assert np.allclose(g[0], (f[1 : k + 1] - f[k + 1 :]) / (2 * h), rtol=1e-5, atol=1e-5)


def test_glmm_without_group_effect_is_the_logit(spark):
    rows = [(g, float(i % 2), float(i % 3 == 0)) for g in range(8) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    fit = fit_glmm(df, ModelSpec("m", "y", ("x",), "binomial", group="g"))
    (logit,) = fit_logit(df, [ModelSpec("m", "y", ("x",), "binomial")])
    assert fit.stats["group_sd"] < 1e-3 and np.allclose(fit.estimate, logit.estimate, atol=1e-5)
    assert math.isclose(fit.stats["loglik"], logit.stats["loglik"], rel_tol=1e-8)
    assert np.allclose(fit.std_error, logit.std_error, rtol=1e-4)


def test_lower_factor():
    assert lower_factor(np.array([2.0])).tolist() == [[2.0]]
    assert lower_factor(np.array([1.0, 2.0, 3.0])).tolist() == [[1.0, 0.0], [2.0, 3.0]]


def test_groups_are_solved_in_chunks(df, monkeypatch):
    """Small chunks, which end with a group, give the same fit as one piece."""
    whole = fit_glmm(df, LOGIT)
    monkeypatch.setattr(glmm, "CHUNK_ROWS", 7)
    cut = fit_glmm(df, LOGIT)
    assert np.allclose(whole.estimate, cut.estimate, rtol=1e-6) and math.isclose(whole.stats["loglik"], cut.stats["loglik"], rel_tol=1e-10)


def test_separated_groups_are_reported(spark):
    rows = [(i % 10, 1.0 if i % 2 else 0.0, float(i % 2)) for i in range(200)]
    frame = spark.createDataFrame(rows, "g int, x double, y double")
    assert not fit_glmm(frame, ModelSpec("m", "y", ("x",), "binomial", group="g")).converged


@pytest.mark.parametrize(("single", "grid", "base"), [(fit_lmm, fit_lmm_grid, SPEC), (fit_glmm, fit_glmm_grid, LOGIT)], ids=["linear", "logistic"])
def test_grid_equals_single_fits(spark, df, single, grid, base):
    """Models with their own complete rows, from one merged table."""
    from dataclasses import replace

    holes = df.select("*").limit(3).withColumn(base.fixed[-1], F.lit(None).cast("double"))
    frame = df.unionByName(holes)
    specs = [replace(base, name="all"), replace(base, name="one", fixed=base.fixed[:1])]
    for spec, fit in zip(specs, grid(frame, specs), strict=True):
        alone = single(frame, spec)
        assert fit.n == alone.n and fit.terms == alone.terms
        assert np.allclose(fit.estimate, alone.estimate, rtol=1e-5, atol=1e-7) and np.allclose(fit.std_error, alone.std_error, rtol=1e-5)


@pytest.mark.parametrize("hot", [10**6, 10], ids=["cold", "hot"])
def test_a_grid_of_intercepts_and_slopes_takes_the_jobs_of_its_longest_search(spark, df, hot):
    from dataclasses import replace

    specs = [replace(LOGIT, name="one", fixed=("x",)), replace(LOGIT, name="two"), replace(LOGIT_SLOPE, name="slope")]
    context = spark.sparkContext

    def counted(name, run):
        context.setJobGroup(f"{name}-{hot}", name)
        out = run()
        return out, len(context.statusTracker().getJobIdsForGroup(f"{name}-{hot}"))

    grid, jobs = counted("grid", lambda: fit_glmm_grid(df, specs, hot_patterns=hot))
    most = 0
    for spec, fit in zip(specs, grid, strict=True):
        alone, own = counted(spec.name, lambda spec=spec: fit_glmm(df, spec, hot_patterns=hot))
        most = max(most, own)
        assert np.allclose(fit.estimate, alone.estimate, rtol=1e-5, atol=1e-6) and math.isclose(fit.stats["loglik"], alone.stats["loglik"], rel_tol=1e-9)
    assert jobs <= 2 * most


def test_linear_grid_holds_slopes_too(df):
    from dataclasses import replace

    specs = [replace(SPEC, name="a"), replace(SLOPE, name="b"), replace(SPEC, name="c", fixed=("x",))]
    for spec, fit in zip(specs, fit_lmm_grid(df, specs), strict=True):
        alone = fit_lmm(df, spec)
        assert np.allclose(fit.estimate, alone.estimate, rtol=1e-7) and math.isclose(fit.stats["reml"], alone.stats["reml"], rel_tol=1e-10)


def test_linear_slopes_of_many_groups_share_their_jobs(spark, df):
    """Models with their own complete rows and slopes: the jobs of a grid don't grow with its models."""
    from dataclasses import replace

    holes = df.select("*").limit(5).withColumn("t", F.lit(None).cast("double"))
    frame = df.unionByName(holes).withColumn("u", F.col("t") + F.col("x"))
    specs = [SLOPE, replace(SLOPE, name="one", fixed=("x",)), replace(SLOPE, name="t", slope="t"), replace(SLOPE, name="u", fixed=("x", "t", "u"))]
    context = spark.sparkContext

    def counted(name, wanted, local_rows):
        context.setJobGroup(name, name)
        return fit_lmm_grid(frame, wanted, local_rows=local_rows), len(context.statusTracker().getJobIdsForGroup(name))

    (one,), own = counted("one slope", specs[:1], 0)
    grid, jobs = counted("all slopes", specs, 0)
    assert jobs <= 2 * own
    for spec, fit in zip(specs, grid, strict=True):
        (alone,), _ = counted("alone", [spec], 20_000)
        assert fit.n == alone.n and fit.terms == alone.terms and fit.stats["groups"] == alone.stats["groups"] == 24
        assert np.allclose(fit.estimate, alone.estimate, rtol=1e-6, equal_nan=True) and math.isclose(fit.stats["reml"], alone.stats["reml"], rel_tol=1e-9)
        assert all(math.isclose(fit.stats[k], alone.stats[k], rel_tol=1e-4) for k in ("sigma", "group_sd", "slope_sd", "group_cor"))
    assert np.allclose(one.estimate, grid[0].estimate, rtol=1e-6)


def test_rows_of_a_group_come_together_before_their_state_is_made(spark, df):
    """One state for each group, not one for each group and task that has some of its rows."""
    from trialstats.models.moments import GroupStates

    states = GroupStates(df.repartition(7).select("g", "x", "t", "w"))
    assert states.size == 24


@pytest.mark.parametrize("hot", [10**6, 10], ids=["cold", "hot"])
def test_laplace_hessian(df, hot):
    """A search gets the Hessian from one point; with spread-out groups from differences.  Constant, free and missing columns."""
    from dataclasses import replace

    frame = df.withColumn("c", F.hash("g") % 3 / 2.0).withColumn("h", F.when(F.hash("g", "t") % 4 > 0, F.col("t") * F.col("x")))
    specs = [replace(LOGIT, fixed=("x", "t", "c")), replace(LOGIT_SLOPE, fixed=("x", "t", "c", "h")), replace(LOGIT, fixed=("t", "h", "c"), slope="t")]
    data = LaplaceData(frame, specs, hot_patterns=hot)
    try:
        assert bool(data.hot) == (hot == 10)
        points = {k: np.linspace(-0.4, 0.6, m.p + (1 if m.q == 1 else 3)) for k, m in enumerate(data.models)}
        found = data.search({k: (x[None], True) for k, x in points.items()})
        h = 1e-5
        near = data.evaluate({k: np.vstack([x + h * np.eye(len(x)), x - h * np.eye(len(x))]) for k, x in points.items()})
    finally:
        data.close()
    for k, x in points.items():
        _, g, hessian = found[k]
        f, slopes = near[k]
        assert np.allclose(g[0], (f[: len(x)] - f[len(x) :]) / (2 * h), rtol=1e-4, atol=1e-4)
        assert np.allclose(hessian[0], (slopes[: len(x)] - slopes[len(x) :]) / (2 * h), rtol=1e-4, atol=1e-3)


def test_a_round_of_a_logistic_search_takes_one_point(df):
    """A full step that keeps its promise is not tried at a stencil of points, nor at shorter steps."""
    data = LaplaceData(df, [LOGIT_SLOPE])
    asked = []

    def counted(wanted):
        asked.extend(len(points) for points, _ in wanted.values())
        return data.search(wanted)

    try:
        ((point, *_, converged),) = side_by_side(counted, [newton_steps(data.models[0].start())])
    finally:
        data.close()
    assert converged and sum(asked) < 3 * len(asked) and max(asked) < len(point)


def test_models_share_merged_patterns():
    """Rows that agree in a model's varying columns are merged, once for all models that differ in constant ones."""
    x = np.array([[0.0, 0, 1, 1, 0, 1], [5, 5, 5, 5, 7, 7], [1, 2, 3, np.nan, 5, 6]])
    block = _block(x, np.ones(6), np.array([1.0, 0, 1, 1, 0, 1]), np.array([0, 0, 0, 0, 1, 1]), np.full(6, -1), [[0], [0, 1], [0, 2], [1]])
    assert block["of"] == [0, 0, 1, 2] and sorted(block["constant"]) == [1]
    groups, places = opened(block, 1, [0, 1], np.zeros(2), np.ones(2), None)
    assert places.tolist() == [0, 1] and groups.counts.tolist() == [2, 2]
    assert groups.m.tolist() == [2, 2, 1, 1] and groups.s.tolist() == [1, 2, 0, 1]
    assert groups.predictors().tolist() == [[1, 0, 5], [1, 1, 5], [1, 0, 7], [1, 1, 7]]
    lacking, _ = opened(block, 2, [0, 2], np.zeros(2), np.ones(2), 2)
    assert lacking.counts.tolist() == [3, 2] and lacking.predictors()[:, 2].tolist() == [1, 2, 3, 5, 6]
