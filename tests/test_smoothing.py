"""Local linear smoothing against fits from single rows."""

import numpy as np
import pytest

from trialstats.operators.smoothing import local_linear


def brute(x, y, at, bandwidth, place=None):
    """Weighted least squares over rows; weights by ``place`` (x itself if none)."""
    part = np.abs((x if place is None else place) - at) / bandwidth
    w = np.where(part < 1, (1 - part**3) ** 3, 0)
    design = np.c_[np.ones_like(x), x - at]
    return np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]


def made(n=3000, offset=0.0):
    rng = np.random.default_rng(5)
    x = rng.gamma(2, 10, n) + offset
    return x, np.sin((x - offset) / 10) + rng.normal(0, 0.3, n)


@pytest.mark.parametrize("offset", [0.0, -1e6])
def test_equals_rows_with_the_weights_of_their_bins(spark, offset):
    x, y = made(offset=offset)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    bins = np.floor(x / 2.0)
    means = np.zeros_like(x)
    for k in np.unique(bins):
        means[bins == k] = x[bins == k].mean()
    points = local_linear(df, "x", "y", 8.0, 2.0).collect()
    assert {r["x"] for r in points} == {(k + 0.5) * 2 for k in bins}
    inside = [r for r in points if r["n"] > 50]
    for r in inside:
        fit, slope = brute(x, y, r["x"], 8.0, means)
        assert r["fit"] == pytest.approx(fit, abs=1e-6) and r["slope"] == pytest.approx(slope, abs=1e-6)
    assert len(inside) > 10


def test_narrow_bins_near_the_fit_of_single_rows(spark):
    x, y = made()
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    worst = {}
    for width in (2.0, 0.25):
        points = [r for r in local_linear(df, "x", "y", 8.0, width).collect() if r["n"] > 200]
        worst[width] = max(abs(r["fit"] - brute(x, y, r["x"], 8.0)[0]) for r in points)
    assert worst[0.25] < 1e-3 and worst[0.25] < worst[2.0]


def test_a_line_is_kept_and_groups_are_apart(spark):
    rows = [(g, float(k), 2.0 * k + len(g or "")) for g in ("a", "bb", None) for k in range(40)]
    got = local_linear(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", 6.0, 1.0, ["g"]).collect()
    assert len(got) == 120
    for r in got:
        assert r["fit"] == pytest.approx(2 * r["x"] + len(r["g"] or "")) and r["slope"] == pytest.approx(2)


def test_defined_cases(spark):
    rows = [(1.0, 4.0), (1.0, 6.0), (None, 1.0), (1.0, None), (float("nan"), 2.0), (500.0, 3.0)]
    got = {r["x"]: (r["fit"], r["slope"], r["n"]) for r in local_linear(spark.createDataFrame(rows, "x double, y double"), "x", "y", 5.0, 5.0).collect()}
    assert got == {2.5: (5.0, None, 2), 502.5: (3.0, None, 1)}
    assert local_linear(spark.createDataFrame([], "x double, y double"), "x", "y", 5.0, 1.0).count() == 0
    with pytest.raises(ValueError):
        local_linear(spark.createDataFrame(rows, "x double, y double"), "x", "y", 1.0, 2.0)
