"""Linear regression from mergeable cross-products: one scan for any number of models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.functions.distributions import f_upper
from trialstats.models.moments import State, complete, independent, overall
from trialstats.models.spec import INTERCEPT, Fit, Levels, ModelSpec, factor_levels, predictor_columns, solve_normal, unscaled, with_aliased


def fit_ols(df: DataFrame, specs: list[ModelSpec], levels: Levels | None = None) -> list[Fit]:
    """Least squares for each specification on its own complete rows.

    A term that is constant or follows from those before it is left out and
    reported without an estimate.
    """
    names = sorted({n for s in specs for n in s.fixed})
    known = factor_levels(df, names, levels)
    designs = [predictor_columns(s.fixed, known) for s in specs]
    # One column per distinct term and outcome, shared by all models.
    columns = {t: c for terms in designs for t, c in terms.items()}
    columns.update({f"y:{s.outcome}": F.col(s.outcome).cast("double") for s in specs})
    where = {t: i for i, t in enumerate(columns)}
    states = overall(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())]))
    fits = []
    for spec, terms in zip(specs, designs, strict=True):
        state = complete(states, [*[where[t] for t in terms], where[f"y:{spec.outcome}"]])
        fits.append(from_state(spec, [INTERCEPT, *terms], state))
    return fits


def from_state(spec: ModelSpec, terms: list[str], state: State | None) -> Fit:
    """Least squares from the state of the predictors and the outcome."""
    kept = independent(state, len(terms) - 1) if state else []
    own = state.pick([*kept, len(terms) - 1]) if state else None
    p, n = len(kept) + 1, int(round(own.n)) if own else 0
    if n <= p:
        raise ValueError(f"{spec.name}: {n} complete rows for {p} coefficients")
    spread = own.spread[:-1]
    scale = np.append(spread, 1.0)
    scaled = State(own.n, np.zeros(p), own.product / scale[:, None] / scale[None, :])
    inverse, estimate, rss = solve_normal(scaled.gram())
    inverse, estimate = unscaled(inverse, estimate, own.mean[:-1], spread, own.mean[-1])
    tss = own.product[-1, -1]
    df = n - p
    s2 = rss / df
    loglik = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1) if rss > 0 else math.inf
    r2 = 1 - rss / tss if tss > 0 else math.nan
    stats = {"sigma": math.sqrt(s2), "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / df, "loglik": loglik}
    if p > 1 and s2 > 0:
        stats["f"] = (tss - rss) / (p - 1) / s2
        stats["f_p"] = f_upper(stats["f"], p - 1, df)
    k = p + 1
    stats["aic"] = -2 * loglik + 2 * k
    stats["bic"] = -2 * loglik + math.log(n) * k
    fit = Fit(spec, [INTERCEPT, *[terms[k + 1] for k in kept]], estimate, s2 * inverse, n, df_resid=df, stats=stats)
    return with_aliased(fit, terms)
