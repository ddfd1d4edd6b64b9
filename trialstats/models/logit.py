"""Logistic regression by Newton steps on covariate patterns.

Rows with the same covariates are merged once into (pattern, trials, successes).
Each Newton step is then one sum over the patterns, taken for all models of a
grid at the same time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.models.moments import State, independent
from trialstats.models.reduce import LOCAL_ROWS, Kernel, SumOverRows
from trialstats.models.spec import (
    INTERCEPT,
    Fit,
    Levels,
    ModelSpec,
    factor_levels,
    predictor_columns,
    scaled_inverse,
    with_aliased,
)

MAX_STEPS = 30
# Coefficients beyond this on the scale of a standardised predictor mean that
# the outcome is separated and no finite estimate exists.
SEPARATED = 15.0


def patterns(df: DataFrame, outcome: str, columns: dict) -> DataFrame:
    """One row per covariate pattern: the columns, ``m`` trials, ``s`` successes."""
    frame = df.select(F.col(outcome).cast("double").alias("y"), *[c.alias(n) for n, c in columns.items()])
    return (
        frame.filter(F.col("y").isNotNull())
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("s"))
    )


def log1p_exp(eta: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, eta)


def logistic(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * eta))


def newton_sums(x: np.ndarray, m: np.ndarray, s: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """[log-likelihood, trials, score, information] at ``beta``, flattened."""
    eta = x @ beta
    mu = logistic(eta)
    w = m * mu * (1 - mu)
    return np.concatenate(
        [
            [s @ eta - m @ log1p_exp(eta), m.sum()],
            x.T @ (s - m * mu),
            ((x * w[:, None]).T @ x).ravel(),
        ]
    )


def fit_logit(
    df: DataFrame, specs: list[ModelSpec], levels: Levels | None = None, local_rows: int = LOCAL_ROWS
) -> list[Fit]:
    """Maximum likelihood for each specification on its own complete rows.

    A term that is constant or follows from those before it is left out and
    reported without an estimate.
    """
    outcomes = {s.outcome for s in specs}
    if len(outcomes) != 1:
        raise ValueError("all models of one call must share the outcome")
    known = factor_levels(df, sorted({n for s in specs for n in s.fixed}), levels)
    designs = [predictor_columns(s.fixed, known) for s in specs]
    columns = {t: c for terms in designs for t, c in terms.items()}
    index = {t: f"c{i}" for i, t in enumerate(columns)}
    merged = patterns(df, outcomes.pop(), {index[t]: c for t, c in columns.items()})
    where = {t: i for i, t in enumerate(columns)}
    uses = [[where[t] for t in terms] for terms in designs]
    with SumOverRows(merged, local_rows) as table:
        states = _states(uses, table)
        kept = [independent(state, len(use)) for state, use in zip(states, uses, strict=True)]
        terms = [[list(d)[k] for k in own] for d, own in zip(designs, kept, strict=True)]
        states = [state.pick(own) for state, own in zip(states, kept, strict=True)]
        fits = _newton(specs, terms, [[use[k] for k in own] for use, own in zip(uses, kept, strict=True)], states, table)
    return [with_aliased(fit, [INTERCEPT, *d]) for fit, d in zip(fits, designs, strict=True)]


def _design(block: np.ndarray, use: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kept = block[~np.isnan(block[:, use]).any(axis=1)] if use else block
    return np.column_stack([np.ones(len(kept)), kept[:, use]]), kept[:, -2], kept[:, -1]


def _newton_kernel(points: list[tuple[list[int], np.ndarray]]) -> Kernel:
    def kernel(block: np.ndarray) -> np.ndarray:
        return np.concatenate([newton_sums(*_design(block, use), beta) for use, beta in points])

    return kernel


def _newton(specs, designs, uses, states: list[State], table: SumOverRows) -> list[Fit]:
    sizes = [len(u) + 1 for u in uses]
    beta = [np.zeros(p) for p in sizes]
    best: list[tuple[float, np.ndarray] | None] = [None] * len(specs)
    sums: list[np.ndarray | None] = [None] * len(specs)
    done = [False] * len(specs)
    for _ in range(MAX_STEPS):
        active = [k for k in range(len(specs)) if not done[k]]
        if not active:
            break
        flat, start = table.sum(_newton_kernel([(uses[k], beta[k]) for k in active])), 0
        for k in active:
            p = sizes[k]
            part = flat[start : start + 2 + p + p * p]
            start += len(part)
            if best[k] is not None and part[0] < best[k][0] - 1e-9 * abs(best[k][0]):
                beta[k] = (beta[k] + best[k][1]) / 2
                continue
            gained = math.inf if best[k] is None else part[0] - best[k][0]
            best[k], sums[k] = (part[0], beta[k]), part
            if part[1] == 0:
                raise ValueError(f"{specs[k].name}: no complete rows")
            score, information = part[2 : 2 + p], part[2 + p :].reshape(p, p)
            step = _safe_solve(information, score)
            # Half the squared Newton decrement bounds the gain still possible.
            if score @ step < 1e-14 * (abs(part[0]) + 1) and gained < 1e-8 * (abs(part[0]) + 1):
                done[k] = True
                best[k] = (part[0], beta[k] + step)
            beta[k] = beta[k] + step
    return [
        _finish(specs[k], [INTERCEPT, *designs[k]], best[k], sums[k], done[k], state.mean, state.spread)
        for k, state in enumerate(states)
    ]


def _states(uses: list[list[int]], table: SumOverRows) -> list[State]:
    """Trials, means and centred products of the predictors of each model: means first, then products around them."""

    def sums(part_of) -> list[np.ndarray]:
        def kernel(block: np.ndarray) -> np.ndarray:
            return np.concatenate([part_of(k, *_design(block, use)[:2]) for k, use in enumerate(uses)])

        flat, start, out = table.sum(kernel), 0, []
        for k, use in enumerate(uses):
            size = len(part_of(k, np.ones((0, len(use) + 1)), np.ones(0)))
            out.append(flat[start : start + size])
            start += size
        return out

    totals = sums(lambda k, x, m: m @ x)
    counts = [t[0] for t in totals]
    means = [t[1:] / max(t[0], 1.0) for t in totals]
    products = sums(lambda k, x, m: ((x[:, 1:] - means[k]) * m[:, None]).T.dot(x[:, 1:] - means[k]).ravel())
    return [State(n, mean, flat.reshape(len(mean), len(mean))) for n, mean, flat in zip(counts, means, products, strict=True)]


def _safe_solve(information: np.ndarray, score: np.ndarray) -> np.ndarray:
    try:
        return scaled_inverse(information) @ score
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(information, score, rcond=None)[0]


def _finish(
    spec: ModelSpec, terms: list[str], best, part: np.ndarray, done: bool, mean: np.ndarray, spread: np.ndarray
) -> Fit:
    p = len(terms)
    loglik, estimate = best
    n = int(round(part[1]))
    information = part[2 + p :].reshape(p, p)
    try:
        covariance = scaled_inverse(information)
    except np.linalg.LinAlgError:
        covariance, done = np.full((p, p), math.nan), False
    # Under separation the information vanishes along the diverging direction.
    # Both are judged for standardised predictors, so the units do not matter.
    scale = np.eye(p)
    scale[0, 1:] = mean
    scale[1:, 1:] = np.diag(spread)
    errors = np.sqrt(np.clip(np.diag(scale @ covariance @ scale.T), 0, None) * n)
    separated = bool(np.any(np.abs(scale @ estimate) > SEPARATED) and np.any(errors > 1e4))
    deviance = -2 * loglik
    stats = {
        "loglik": loglik,
        "deviance": deviance,
        "aic": deviance + 2 * p,
        "bic": deviance + p * math.log(n),
    }
    return Fit(spec, terms, estimate, covariance, n, converged=done and not separated, stats=stats)
