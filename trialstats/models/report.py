"""Fits as tidy frames: one row per coefficient, one row per model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.functions.distributions import normal_two_sided, t_two_sided
from trialstats.models.spec import Fit

COEFFICIENTS = (
    "model string, term string, estimate double, std_error double, statistic double, p_value double, stars string"
)
STATISTICS = [
    "loglik", "deviance", "aic", "bic", "sigma", "r2", "adj_r2", "f", "f_p",
    "reml", "group_sd", "slope_sd", "group_cor", "theta", "groups",
]
FITS = "model string, n bigint, converged boolean, " + ", ".join(f"{s} double" for s in STATISTICS)


def stars(p: float | None) -> str:
    """Significance marks at 10, 5 and 1 percent."""
    if p is None:
        return ""
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""


def _plain(value) -> float | None:
    return None if value is None or not math.isfinite(value) else float(value)


def coefficients(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """p-values follow the t distribution where the fit has residual degrees of
    freedom and the normal distribution otherwise."""
    rows = []
    for fit in fits:
        for term, estimate, error in zip(fit.terms, fit.estimate, fit.std_error, strict=True):
            ratio = _plain(estimate / error) if error > 0 else None
            if ratio is None:
                p = None
            elif fit.df_resid is None:
                p = normal_two_sided(ratio)
            else:
                p = t_two_sided(ratio, fit.df_resid)
            rows.append((fit.spec.name, term, _plain(estimate), _plain(error), ratio, p, stars(p)))
    return spark.createDataFrame(rows, COEFFICIENTS)


def fit_table(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    rows = [
        (f.spec.name, f.n, bool(f.converged), *[_plain(f.stats.get(s)) for s in STATISTICS]) for f in fits
    ]
    return spark.createDataFrame(rows, FITS)


def side_by_side(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """One row per term, one column per model, cells ``estimate stars (std error)``."""
    names = [f.spec.name for f in fits]
    cell = F.concat(
        F.format_string("%.3f", "estimate"), F.col("stars"), F.format_string(" (%.3f)", "std_error")
    )
    return coefficients(spark, fits).groupBy("term").pivot("model", names).agg(F.first(cell))
