"""Formulas as text: what they stand for, what is refused, and fits with interactions."""

import numpy as np
import pandas as pd
import pytest

from trialstats.models import formula
from trialstats.models.lmm import fit_lmm
from trialstats.models.spec import ModelSpec


@pytest.mark.parametrize(
    "text, fixed, group, slope",
    [
        ("y ~ a", ("a",), None, None),
        ("y~1", (), None, None),
        ("y ~ b + a + b", ("b", "a"), None, None),
        ("y ~ a*b", ("a", "b", "a:b"), None, None),
        ("y ~ b:a + a:b + c", ("c", "b:a"), None, None),
        ("y ~ a*b*c", ("a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"), None, None),
        ("y ~ (a + b + c)^2 - a:c", ("a", "b", "c", "a:b", "b:c"), None, None),
        ("y ~ (a + b):c + 1", ("a:c", "b:c"), None, None),
        ("y ~ (a + b)^99", ("a", "b", "a:b"), None, None),
        ("y ~ a*b - a:b", ("a", "b"), None, None),
        ("y ~ a*b - b:a", ("a", "b"), None, None),
        ("y ~ a + (1 | g)", ("a",), "g", None),
        ("y ~ a + (a | g)", ("a",), "g", "a"),
        ("y ~ a + b + (1 + a | g) + c", ("a", "b", "c"), "g", "a"),
        ("y ~ `Time on task` + x.1", ("Time on task", "x.1"), None, None),
        ("y ~ (a + (b + c)) * d", ("a", "b", "c", "d", "a:d", "b:d", "c:d"), None, None),
    ],
)
def test_parsed(text, fixed, group, slope):
    assert formula.parse(text) == ModelSpec(text, "y", fixed, "gaussian", group, slope)


@pytest.mark.parametrize(
    "text",
    ["", "y", "y ~", "~ a", "y ~ a +", "y ~ a b", "y ~ a - 1", "y ~ 0 + a", "y ~ log(a)", "y ~ (a", "y ~ a)", "y ~ a ^ b", "y ~ a^0",
     "y ~ a + (1 | g) + (1 | h)", "y ~ a + b + (a + b | g)", "y ~ a + (b | g)", "y ~ a % b", "y ~ y", "y ~ a - (1 | g)", "y ~ a * (1 | g)",
     "y ~ `a:b`", "y ~ (1 | )", "y ~ (a | g | h)"],
)
def test_refused(text):
    with pytest.raises(ValueError):
        formula.parse(text)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    n = 900
    pdf = pd.DataFrame({"kind": rng.choice(["a", "b", "c"], n), "side": rng.choice(["l", "r"], n), "x": rng.normal(50, 2, n), "g": rng.integers(0, 30, n)})
    pdf["y"] = pdf["x"] * np.where(pdf["kind"] == "b", 2.0, -1.0) + (pdf["side"] == "r") + rng.normal(size=30)[pdf["g"]] + rng.normal(size=n)
    pdf["hit"] = (rng.random(n) < 0.3 + 0.3 * (pdf["kind"] == "b") + 0.2 * (pdf["side"] == "r") * (pdf["kind"] != "c")).astype(float)
    return pdf


def columns(pdf):
    b, c, r, x = ((pdf["kind"] == "b") * 1.0, (pdf["kind"] == "c") * 1.0, (pdf["side"] == "r") * 1.0, pdf["x"])
    return {"kindb": b, "kindc": c, "sider": r, "x": x, "kindb:sider": b * r, "kindc:sider": c * r, "kindb:x": b * x, "kindc:x": c * x}


def test_interactions_equal_lstsq(spark, data):
    df = spark.createDataFrame(data)
    one, two = formula.fit(df, {"m": "y ~ kind * side", "n": "y ~ kind * x"})
    made = columns(data)
    for fit, terms in ((one, ["kindb", "kindc", "sider", "kindb:sider", "kindc:sider"]), (two, ["kindb", "kindc", "x", "kindb:x", "kindc:x"])):
        want = np.linalg.lstsq(np.column_stack([np.ones(len(data)), *(made[t] for t in terms)]), data["y"], rcond=None)[0]
        assert fit.terms == ["(Intercept)", *terms] and np.allclose(fit.estimate, want, rtol=1e-7)
    assert (one.spec.name, two.spec.name) == ("m", "n")


def test_kinds_keep_their_order(spark, data):
    df = spark.createDataFrame(data)
    fits = formula.fit(df, ["y ~ side + (1 | g)", "y ~ side", "y ~ side + x + (1 | g)"])
    assert [f.spec.name for f in fits] == ["y ~ side + (1 | g)", "y ~ side", "y ~ side + x + (1 | g)"]
    alone = fit_lmm(df, ModelSpec("m", "y", ("side",), group="g"))
    assert np.allclose(fits[0].estimate, alone.estimate, rtol=1e-6) and len(fits[1].terms) == 2


def test_logistic_interaction_is_saturated(spark, data):
    """With a term for every cell the fitted chances are the cells' shares."""
    (fit,) = formula.fit(spark.createDataFrame(data), ["hit ~ side * kind"], "binomial")
    cells = data.assign(**{k: v for k, v in columns(data).items() if k != "x"})
    cells["sider:kindb"], cells["sider:kindc"] = cells["kindb:sider"], cells["kindc:sider"]
    eta = fit.estimate[0] + sum(e * cells[t] for t, e in zip(fit.terms[1:], fit.estimate[1:], strict=True))
    share = data.groupby(["kind", "side"])["hit"].transform("mean")
    assert 0 < share.min() and share.max() < 1 and np.allclose(1 / (1 + np.exp(-eta)), share, atol=1e-7)


def test_factor_needs_its_margin(spark, data):
    df = spark.createDataFrame(data)
    for text in ("y ~ x + kind:x", "y ~ side + kind:side"):
        ok = text == "y ~ x + kind:x"
        if ok:
            assert formula.fit(df, [text])[0].terms == ["(Intercept)", "x", "kindb:x", "kindc:x"]
        else:
            with pytest.raises(ValueError, match="beside it"):
                formula.fit(df, [text])
