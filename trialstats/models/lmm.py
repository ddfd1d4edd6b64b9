"""Linear mixed models by REML from per-group cross-products.

For group g with random-effect design Z the data enter the criterion only
through Z'Z, Z'[X y] and the overall [X y]'[X y].  One scan makes mergeable
states (means and centred cross-products) per group, for all models of a grid at
once; each model cuts its own blocks from them, standardised by the overall mean
and spread.  Groups with equal Z'Z are then merged, because their contribution is
linear in the outer products of Z'[X y]: for a random intercept this leaves one
row per distinct group size.  A random slope is fitted on its standardised column
as well and the covariance mapped back, so its place and units do not matter.

Groups with a random slope seldom agree in Z'Z.  Where there are many, each keeps
one short row of Z'[X y] for all models of a grid (`slopes`), and the models'
searches run side by side, a job for each round of all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.models.moments import GroupStates, complete, independent
from trialstats.models.optimise import newton_values, root, side_by_side, value_steps
from trialstats.models.reduce import LOCAL_ROWS, Kernel, SumOverRows
from trialstats.models.slopes import SlopeSums, slope_rows
from trialstats.models.spec import (
    INTERCEPT,
    Fit,
    Levels,
    ModelSpec,
    factor_levels,
    predictor_columns,
    solve_normal,
    triangle,
    unpack,
    unscaled,
    with_aliased,
)
from trialstats.runtime import held

# Decimals, in units of the slope's spread, to which groups must agree in Z'Z to be merged.
AGREE = 11


@dataclass(frozen=True)
class Layout:
    """Where the sums of a merged row are: Z'Z, number of groups, cross-products
    of [1 X y], outer products of Z'[1 X y].  Plain data, so kernels can carry it."""

    q: int
    width: int

    @property
    def first(self) -> int:
        return self.q * (self.q + 1) // 2

    @property
    def start(self) -> int:
        return self.first + 1 + self.width * (self.width + 1) // 2

    @property
    def size(self) -> int:
        return self.start + self.q * self.width * (self.q * self.width + 1) // 2

    def totals(self, block: np.ndarray) -> np.ndarray:
        return block[:, self.first : self.start].sum(axis=0)

    def parts(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Z'Z, number of groups and outer products per merged row."""
        rows, q, width = len(block), self.q, self.width
        zz = np.empty((rows, q, q))
        for at, (a, b) in enumerate(triangle(q)):
            zz[:, a, b] = zz[:, b, a] = block[:, at]
        outer = np.empty((rows, q * width, q * width))
        for at, (i, j) in enumerate(triangle(q * width)):
            outer[:, i, j] = outer[:, j, i] = block[:, self.start + at]
        return zz, block[:, self.first], outer.reshape(rows, q, width, q, width)


def merged_groups(layout: Layout, z: list[int], sums: np.ndarray) -> np.ndarray:
    """Rows of the layout from the cross-products of some groups: one for each different Z'Z."""
    i, j = np.triu_indices(layout.q)
    zz = sums[:, np.array(z)[i], np.array(z)[j]]
    zw = sums[:, z, :].reshape(len(sums), -1)
    i, j = np.triu_indices(layout.width)
    a, b = np.triu_indices(zw.shape[1])
    keys, of = np.unique(np.round(zz, AGREE), axis=0, return_inverse=True)
    order = np.argsort(of.reshape(-1), kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(of.reshape(-1)[order]) > 0])
    rows = np.column_stack([np.ones(len(sums)), sums[:, i, j], zw[:, a] * zw[:, b]])[order]
    return np.column_stack([keys, np.add.reduceat(rows, starts, axis=0)])


def _weighted_kernel(layout: Layout, weights) -> Kernel:
    def kernel(block: np.ndarray) -> np.ndarray:
        zz, _, outer = layout.parts(block)
        return np.einsum("rab,raibj->ij", weights(zz), outer).ravel()

    return kernel


def _correction_kernel(layout: Layout, factors: list[np.ndarray]) -> Kernel:
    def kernel(block: np.ndarray) -> np.ndarray:
        zz, count, outer = layout.parts(block)
        out = []
        for factor in factors:
            a = np.eye(layout.q) + factor.T @ zz @ factor
            weight = factor @ np.linalg.inv(a) @ factor.T
            out.append([count @ np.linalg.slogdet(a)[1]])
            out.append(np.einsum("rab,raibj->ij", weight, outer).ravel())
        return np.concatenate(out)

    return kernel


def _ratio_kernel(layout: Layout, ratios: np.ndarray) -> Kernel:
    """Change with the variance ratio of the log-determinant and of the correction."""

    def kernel(block: np.ndarray) -> np.ndarray:
        zz, count, outer = layout.parts(block)
        size = zz[:, 0, 0]
        out = []
        for ratio in ratios:
            out.append([count @ (size / (1 + ratio * size))])
            weight = 1 / (1 + ratio * size) ** 2
            out.append(np.einsum("r,rij->ij", weight, outer[:, 0, :, 0, :]).ravel())
        return np.concatenate(out)

    return kernel


class LinearRows:
    """Group states of the union design of some models with one group: one scan of the trials."""

    def __init__(self, df: DataFrame, specs: list[ModelSpec], levels: Levels | None = None, local_rows: int = LOCAL_ROWS):
        if len({s.group for s in specs}) != 1:
            raise ValueError("models of one grid must share the group")
        self.levels = factor_levels(df, sorted({n for s in specs for n in s.fixed}), levels)
        columns = {t: c for s in specs for t, c in predictor_columns(s.fixed, self.levels).items()}
        columns.update({f"y:{s.outcome}": F.col(s.outcome).cast("double") for s in specs})
        self.where = {t: i for i, t in enumerate(columns)}
        group = F.col(specs[0].group)
        keyed = df.filter(group.isNotNull()).select(group.alias("g"), *[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
        self.groups = GroupStates(keyed, local_rows)

    def terms(self, names: tuple[str, ...]) -> list[str]:
        return list(predictor_columns(names, self.levels))


class Design:
    """Which columns of the union design a model uses, and what follows from its overall cross-products.

    ``terms`` are those that take part, ``all_terms`` the whole design.
    """

    def __init__(self, rows: LinearRows, spec: ModelSpec):
        self.spec = spec
        names = rows.terms(spec.fixed)
        use = [*[rows.where[t] for t in names], rows.where[f"y:{spec.outcome}"]]
        state = complete(rows.groups.states, use)
        if state is None:
            raise ValueError(f"{spec.name}: no complete rows")
        kept = independent(state, len(names))
        state = state.pick([*kept, len(names)])
        #: Columns that must be there, and those that take part; the outcome comes last.
        self.needed, self.use = use, [use[k] for k in [*kept, len(names)]]
        self.all_terms = [INTERCEPT, *names]
        self.terms = [INTERCEPT, *[names[k] for k in kept]]
        self.p = len(self.terms)
        self.width = self.p + 1
        self.mean, self.spread = state.mean, np.append(state.spread[:-1], 1.0)
        self.slope = None
        if spec.slope is not None:
            own = rows.terms((spec.slope,))
            if len(own) != 1:
                raise ValueError("a random slope must be a single numeric or two-level column")
            if own[0] not in self.terms:
                raise ValueError(f"{spec.name}: the column of the random slope is constant or follows from others")
            self.slope = self.terms.index(own[0])
        self.z = [0] if self.slope is None else [0, self.slope]
        self.q = len(self.z)
        self.layout = Layout(self.q, self.width)
        self.n = int(round(state.n))
        self.gram = np.zeros((self.width, self.width))
        self.gram[0, 0] = state.n
        self.gram[1:, 1:] = state.product / self.spread[:, None] / self.spread[None, :]

    def generalised(self, correction: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Generalised least squares: inverse of X'VX, coefficients, residual sum."""
        inverse, beta, rss = self._standard(correction)
        return *unscaled(inverse, beta, self.mean[:-1], self.spread[:-1], self.mean[-1]), rss

    def _standard(self, correction: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The same for the standardised columns."""
        return solve_normal(self.gram - correction)

    def reml(self, logdet: float, correction: np.ndarray) -> float:
        inverse, _, rss = self._standard(correction)
        df = self.n - self.p
        # The determinant is that of the columns as they stand.
        units = 2 * np.log(self.spread).sum()
        return df * (math.log(2 * math.pi * rss / df) + 1) + logdet - np.linalg.slogdet(inverse)[1] + units

    def to_raw(self) -> np.ndarray:
        """Effects on (1, standardised slope) to effects on (1, slope)."""
        if self.slope is None:
            return np.eye(1)
        mean, spread = self.mean[self.slope - 1], self.spread[self.slope - 1]
        return np.array([[1.0, -mean / spread], [0.0, 1.0 / spread]])


class GroupMoments(Design):
    """Merged cross-products of [1, X, y] per group, X standardised and y less its mean, and sums over them."""

    def __init__(
        self,
        df: DataFrame,
        spec: ModelSpec,
        levels: Levels | None = None,
        local_rows: int = LOCAL_ROWS,
        shared: LinearRows | None = None,
    ):
        rows = shared or LinearRows(df, [spec], levels, local_rows)
        super().__init__(rows, spec)
        make = partial(merged_groups, self.layout, self.z)
        found = rows.groups.rows(self.use, self.mean, self.spread, make, self.layout.size)
        self.table = SumOverRows(found, local_rows)
        whole = self.table.sum(self.layout.totals)
        self.groups = int(round(whole[0]))
        self.gram = unpack(whole[1:], self.width)
        self.n = int(round(self.gram[0, 0]))

    def __enter__(self) -> "GroupMoments":
        return self

    def __exit__(self, *exc) -> None:
        self.table.__exit__(*exc)

    def weighted(self, weights) -> np.ndarray:
        """Sum over groups of [1 X y]'Z W Z'[1 X y] for W = weights(Z'Z)."""
        return self.table.sum(_weighted_kernel(self.layout, weights)).reshape(self.width, self.width)

    def corrections(self, factors: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """For each relative covariance factor L: the log-determinant of I + L'Z'ZL
        summed over groups, and the part of the cross-products explained by the groups."""
        flat = self.table.sum(_correction_kernel(self.layout, factors)).reshape(len(factors), 1 + self.width**2)
        return [(row[0], row[1:].reshape(self.width, self.width)) for row in flat]

    def criterion(self, factors: list[np.ndarray]) -> np.ndarray:
        return np.array([self.reml(*c) for c in self.corrections(factors)])

    def reml_slopes(self, ratios: np.ndarray) -> np.ndarray:
        """Derivative of the random-intercept criterion in the variance ratio."""
        corrections = self.corrections([np.array([[math.sqrt(r)]]) for r in ratios])
        changes = self.table.sum(_ratio_kernel(self.layout, ratios)).reshape(len(ratios), 1 + self.width**2)
        out = []
        for (_, correction), change in zip(corrections, changes, strict=True):
            inverse, beta, rss = self._standard(correction)
            moved = -change[1:].reshape(self.width, self.width)
            residual = np.append(-beta, 1.0)
            relative = residual @ moved @ residual / rss
            out.append((self.n - self.p) * relative + change[0] + np.sum(inverse * moved[: self.p, : self.p]))
        return np.array(out)

    def best_ratio(self) -> float:
        """Variance ratio at the REML minimum: nearest grid value, then the root of the slope."""
        grid = np.concatenate([[0.0], np.geomspace(1e-8, 1e8, 129)])
        best = int(np.argmin(self.criterion([np.array([[math.sqrt(r)]]) for r in grid])))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
        if low == 0.0 and self.reml_slopes(np.array([0.0]))[0] >= 0:
            return 0.0
        return root(self.reml_slopes, low, high)


def lower_factor(theta: np.ndarray) -> np.ndarray:
    return np.array([[theta[0]]]) if len(theta) == 1 else np.array([[theta[0], 0.0], [theta[1], theta[2]]])


def fit_lmm_grid(df: DataFrame, specs: list[ModelSpec], levels: Levels | None = None, local_rows: int = LOCAL_ROWS) -> list[Fit]:
    """REML fits of several models with one group, random intercepts and slopes alike, from one scan of the trials."""
    rows = LinearRows(df, specs, levels, local_rows)
    slopes = [k for k, spec in enumerate(specs) if spec.slope is not None]
    if rows.groups.size * len(slopes) <= local_rows:
        slopes = []
    fits = dict(zip(slopes, _fit_slopes([Design(rows, specs[k]) for k in slopes], rows), strict=True))
    return [fits[k] if k in fits else _fit_own(df, spec, levels, local_rows, rows) for k, spec in enumerate(specs)]


def fit_lmm(df: DataFrame, spec: ModelSpec, levels: Levels | None = None, local_rows: int = LOCAL_ROWS) -> Fit:
    """REML fit of a model with one grouping factor: (1 | g) or (1 + slope | g)."""
    return fit_lmm_grid(df, [spec], levels, local_rows)[0]


def _fit_own(df: DataFrame, spec: ModelSpec, levels: Levels | None, local_rows: int, shared: LinearRows) -> Fit:
    """A model fitted alone, from its merged groups."""
    with GroupMoments(df, spec, levels, local_rows, shared) as data:
        if data.q == 1:
            return _fit(data, np.array([[math.sqrt(data.best_ratio())]]), True, data.corrections, data.groups)

        def values(points: np.ndarray) -> np.ndarray:
            return data.criterion([lower_factor(t) for t in points])

        theta, converged = newton_values(values, STARTS[int(np.argmin(values(STARTS)))])
        return _fit(data, lower_factor(theta), converged, data.corrections, data.groups)


def _fit_slopes(models: list[Design], rows: LinearRows) -> list[Fit]:
    """Models with a random slope and many groups: their searches share every job."""
    if not models:
        return []
    with held(*slope_rows(models, rows)) as table:
        sums = SlopeSums(table, models, rows)

        def values(asked: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
            found = sums.corrections({k: [lower_factor(t) for t in points] for k, points in asked.items()})
            return {k: np.array([models[k].reml(*c) for c in own]) for k, own in found.items()}

        best = side_by_side(values, [_slope_search() for _ in models])
        last = sums.corrections({k: [lower_factor(theta)] for k, (theta, _) in enumerate(best)})
        return [_fit(m, lower_factor(theta), converged, lambda _, k=k: last[k], sums.groups[k]) for k, (m, (theta, converged)) in enumerate(zip(models, best, strict=True))]


# Where a search for the covariance of two effects may begin.
STARTS = np.array([[a, 0.0, b] for a in (0.05, 0.3, 1.0) for b in (0.05, 0.3, 1.0)])


def _slope_search():
    f = yield STARTS
    return (yield from value_steps(STARTS[int(np.argmin(f))]))


def _fit(data: Design, factor: np.ndarray, converged: bool, corrections, groups: int) -> Fit:
    ((logdet, correction),) = corrections([factor])
    inverse, beta, rss = data.generalised(correction)
    s2 = rss / (data.n - data.p)
    reml = data.reml(logdet, correction)
    parameters = data.p + data.q * (data.q + 1) // 2 + 1
    stats = {
        "sigma": math.sqrt(s2),
        "reml": reml,
        "loglik": -reml / 2,
        "aic": reml + 2 * parameters,
        "bic": reml + parameters * math.log(data.n),
        "groups": groups,
        "theta": float(abs(factor[0, 0])) if data.q == 1 else None,
        **random_effect_stats(s2 * data.to_raw() @ factor @ factor.T @ data.to_raw().T),
    }
    return with_aliased(Fit(data.spec, data.terms, beta, s2 * inverse, data.n, converged=converged, stats=stats), data.all_terms)


def random_effect_stats(covariance: np.ndarray) -> dict[str, float]:
    sds = np.sqrt(np.clip(np.diag(covariance), 0.0, None))
    out = {"group_sd": float(sds[0])}
    if len(sds) == 2:
        out["slope_sd"] = float(sds[1])
        if sds.min() > 1e-10:
            out["group_cor"] = float(covariance[0, 1] / (sds[0] * sds[1]))
    return out


def reml_profile(df: DataFrame, spec: ModelSpec, ratios: list[float], levels: Levels | None = None) -> DataFrame:
    """Coefficients, residual variance and REML criterion at given variance ratios."""
    table = _profile(df, spec, [np.array([[math.sqrt(r)]]) for r in ratios], levels)
    numbered = df.sparkSession.createDataFrame(list(enumerate(ratios)), "point int, ratio double")
    return numbered.join(table, "point").drop("point")


def reml_profile_slope(df: DataFrame, spec: ModelSpec, points: list[tuple[float, float, float]], levels: Levels | None = None) -> DataFrame:
    """The same at given lower factors (l11, l21, l22) of the relative covariance of intercept and slope."""
    return _profile(df, spec, [lower_factor(np.array(t)) for t in points], levels)


def _profile(df: DataFrame, spec: ModelSpec, factors: list[np.ndarray], levels: Levels | None) -> DataFrame:
    with GroupMoments(df, spec, levels) as data:
        rows = []
        standard = [np.linalg.solve(data.to_raw(), f) for f in factors]
        for point, (logdet, correction) in enumerate(data.corrections(standard)):
            _, beta, rss = data.generalised(correction)
            rows.append((point, *map(float, beta), float(rss) / (data.n - data.p), float(data.reml(logdet, correction))))
    betas = "".join(f", beta{i} double" for i in range(data.p))
    return df.sparkSession.createDataFrame(rows, f"point int{betas}, sigma2 double, reml double")
