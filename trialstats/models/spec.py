"""Structured model specifications and the model frames built from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERCEPT = "(Intercept)"
# Default for the most levels a factor may have; more are usually a mistake in the specification.
MAX_LEVELS = 200


@dataclass(frozen=True)
class ModelSpec:
    """outcome ~ 1 + fixed [+ (1 | group)] [+ (1 + slope | group)].

    A predictor "a:b" is the interaction of a and b.
    """

    name: str
    outcome: str
    fixed: tuple[str, ...]
    family: str = "gaussian"
    group: str | None = None
    slope: str | None = None

    def __post_init__(self) -> None:
        if self.family not in ("gaussian", "binomial"):
            raise ValueError(f"unknown family: {self.family}")
        if self.slope is not None and (self.group is None or self.slope not in self.fixed):
            raise ValueError("a random slope needs a group and must also be a fixed effect")


Levels = Mapping[str, list[str]]


def factor_levels(
    df: DataFrame, names: list[str], known: Levels | None = None, max_levels: int = MAX_LEVELS
) -> dict[str, list[str]]:
    """Sorted levels of the text columns among ``names``; the first is the reference.

    A factor with more than ``max_levels`` levels is refused, none is left out.
    """
    names = list(dict.fromkeys(v for n in names for v in n.split(":")))
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    found = {n: sorted(known[n]) for n in names if known and n in known}
    todo = [n for n in names if n in text and n not in found]
    for n in todo:
        rows = df.select(n).filter(F.col(n).isNotNull()).distinct().limit(max_levels + 1).collect()
        found[n] = sorted(row[n] for row in rows)
    for n, levels in found.items():
        if not 2 <= len(levels) <= max(max_levels, len((known or {}).get(n, ()))):
            raise ValueError(f"factor {n} must have 2 to {max_levels} levels")
    return found


def predictor_columns(names: tuple[str, ...], levels: Levels) -> dict[str, Column]:
    """Term name -> numeric column; a factor gives one 0/1 column per non-reference level.

    A value that is not among the levels is an error, not the reference.  An interaction
    gives a product for each choice of its variables' columns; a factor in it needs the
    term without that factor beside it, as its reference level has no column.
    """
    terms: dict[str, Column] = {}
    sets = {frozenset(n.split(":")) for n in names}
    for n in names:
        variables = n.split(":")
        for v in variables if len(variables) > 1 else []:
            if v in levels and frozenset(variables) - {v} not in sets:
                raise ValueError(f"{n} needs {':'.join(w for w in variables if w != v)} beside it, as {v} is a factor")
        parts = [_own_columns(v, levels) for v in variables]
        for chosen in product(*(p.items() for p in parts)):
            terms[":".join(k for k, _ in chosen)] = reduce(lambda x, y: x * y, [c for _, c in chosen])
    return terms


def _own_columns(n: str, levels: Levels) -> dict[str, Column]:
    if n not in levels:
        return {n: F.col(n).cast("double")}
    listed = F.col(n).isNull() | F.col(n).isin(*levels[n])
    refused = F.raise_error(F.concat(F.lit(f"{n} has a level that is not listed: "), F.col(n).cast("string"))).cast("double")
    return {f"{n}{level}": F.when(listed, (F.col(n) == level).cast("double")).otherwise(refused) for level in levels[n][1:]}


@dataclass
class Fit:
    """Estimates of one model, small enough to live on the driver."""

    spec: ModelSpec
    terms: list[str]
    estimate: np.ndarray
    covariance: np.ndarray
    n: int
    converged: bool = True
    # Degrees of freedom of the t statistics; None for normal (z) statistics.
    df_resid: float | None = None
    stats: dict[str, float] = field(default_factory=dict)

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance), 0.0, None))


def scaled_inverse(a: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Inverse of a symmetric matrix, scaled to unit diagonal before inverting.

    ``size`` is what a diagonal entry of pure rounding error is compared with.
    """
    diagonal = np.diag(a)
    floor = 0.0 if size is None else 1e-14 * np.abs(size)
    if np.any(diagonal <= floor) or not np.all(np.isfinite(a)):
        raise np.linalg.LinAlgError("singular cross-product matrix: a predictor is constant")
    s = 1.0 / np.sqrt(diagonal)
    scaled = a * s[:, None] * s[None, :]
    if np.linalg.cond(scaled) > 1e14:
        raise np.linalg.LinAlgError("singular cross-product matrix: predictors are collinear")
    return np.linalg.inv(scaled) * s[:, None] * s[None, :]


def solve_normal(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Inverse, coefficients and residual sum from cross-products of [1, X, y].

    The intercept is eliminated first.  That centres the other columns, without
    which a predictor far from zero would cost most of the available digits.
    """
    p = len(gram) - 1
    means = gram[0, 1:] / gram[0, 0]
    centred = gram[1:, 1:] - np.outer(means, gram[0, 1:])
    centred = (centred + centred.T) / 2
    inner = scaled_inverse(centred[:-1, :-1], np.diag(gram)[1:-1]) if p > 1 else np.zeros((0, 0))
    slopes = inner @ centred[:-1, -1]
    inverse = np.empty((p, p))
    inverse[1:, 1:] = inner
    inverse[0, 1:] = inverse[1:, 0] = -inner @ means[:-1]
    inverse[0, 0] = 1 / gram[0, 0] + means[:-1] @ inner @ means[:-1]
    beta = np.concatenate([[means[-1] - means[:-1] @ slopes], slopes])
    return inverse, beta, max(float(centred[-1, -1] - centred[:-1, -1] @ slopes), 0.0)


def triangle(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def unpack(values, size: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle in row order."""
    out = np.zeros((size, size))
    for (i, j), v in zip(triangle(size), values, strict=True):
        out[i, j] = out[j, i] = 0.0 if v is None else float(v)
    return out


def unscaled(inverse: np.ndarray, beta: np.ndarray, mean: np.ndarray, spread: np.ndarray, level: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and coefficients of [1, X] from those for (X - mean) / spread and an outcome less ``level``."""
    back = np.eye(len(beta))
    back[1:, 1:] = np.diag(1 / spread)
    back[0, 1:] = -mean / spread
    moved = back @ beta
    moved[0] += level
    return back @ inverse @ back.T, moved


def with_aliased(fit: Fit, terms: list[str]) -> Fit:
    """The fit with a row for every term: those left out because others determine them have no estimate."""
    if len(terms) == len(fit.terms):
        return fit
    at = [terms.index(t) for t in fit.terms]
    estimate = np.full(len(terms), np.nan)
    covariance = np.full((len(terms), len(terms)), np.nan)
    estimate[at] = fit.estimate
    covariance[np.ix_(at, at)] = fit.covariance
    return replace(fit, terms=terms, estimate=estimate, covariance=covariance)
