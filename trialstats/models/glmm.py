"""Logistic mixed models by the Laplace approximation.

Rows are merged into (group, covariate pattern, trials, successes) and laid out
by group in blocks that serve all models of a grid (`patterns`).  One task finds
the modes of the random effects of all its groups and returns a single vector for
each model and parameter point: the objective, its gradient and, where a search
has arrived, its Hessian (`laplace`).

The searches of a grid's models run side by side and share every job; a round
evaluates the points of all that have not converged yet.

A group with very many patterns is spread over several partitions.  Its tasks
return sums over their patterns, and its mode is iterated on the driver, which
holds one or two numbers per such group; the Hessian of models with such groups
is differenced from gradients.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialstats import runtime
from trialstats.models.laplace import MODE_STEPS, MODE_TOLERANCE, Groups
from trialstats.models.lmm import lower_factor, random_effect_stats
from trialstats.models.logit import SEPARATED, log1p_exp, logistic
from trialstats.models.moments import MERGERS, State, _collected, _lists, complete, independent
from trialstats.models.optimise import newton_steps, side_by_side
from trialstats.models.patterns import SCHEMA, blocks, opened
from trialstats.models.shared import SharedRows
from trialstats.models.spec import INTERCEPT, Fit, Levels, ModelSpec, triangle, unpack, unscaled, with_aliased

# Patterns per partition, and the size above which a group is spread out.
ROWS_PER_PARTITION = 500_000
SMALL_PARTITION = 5_000
HOT_PATTERNS = 250_000
# Up to this many tasks their vectors are added on the driver, saving a shuffle.
FEW_TASKS = 64
# Patterns a task works on at a time; a group that is not spread out stays together.
CHUNK_ROWS = 16_000
# Step of the differences that give the Hessian of models with spread-out groups.
DIFFERENCE = 1e-4


def _group_sums(x, z, m, s, eta, starts) -> dict[str, np.ndarray]:
    """Everything the Laplace objective and its gradient need, per group."""
    mu = logistic(eta)
    w = m * mu * (1 - mu)
    resid = s - m * mu
    skew = w * (1 - 2 * mu)
    zz = z[:, :, None] * z[:, None, :]
    q = z.shape[1]

    def add(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts, axis=0)

    # one pair of effects after the other: no array is larger than the rows of x
    d = np.empty((len(starts), x.shape[1], q, q))
    for a, b in triangle(q):
        d[:, :, a, b] = d[:, :, b, a] = add(x * (zz[:, a, b] * skew)[:, None])
    return {
        "ll": add(s * eta - m * log1p_exp(eta)),
        "r": add(z * resid[:, None]),
        "h": add(zz * w[:, None, None]),
        "gx": add(x * resid[:, None]),
        "c": np.stack([add(x * (z[:, a] * w)[:, None]) for a in range(q)], axis=2),
        "t": add(zz[:, :, :, None] * z[:, None, None, :] * skew[:, None, None, None]),
        "d": d,
    }


def _shapes(p: int, q: int) -> dict[str, tuple[int, ...]]:
    return {"ll": (), "r": (q,), "h": (q, q), "gx": (p,), "c": (p, q), "t": (q, q, q), "d": (p, q, q)}


def _mode_step(r: np.ndarray, h: np.ndarray, v: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Newton step towards the mode of each group, at most two prior deviations long."""
    a = np.eye(factor.shape[0]) + factor.T @ h @ factor
    step = np.linalg.solve(a, (r @ factor - v)[:, :, None])[:, :, 0]
    length = np.abs(step).max(axis=1, keepdims=True)
    return step * np.minimum(1.0, 2.0 / np.maximum(length, 1e-300))


def _objective(sums: dict[str, np.ndarray], v: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """[log-likelihood, gradient in beta, gradient in theta], summed over groups at their modes."""
    q = factor.shape[0]
    h, t = sums["h"], sums["t"]
    a = np.eye(q) + factor.T @ h @ factor
    inverse = np.linalg.inv(a)
    weight = factor @ inverse @ factor.T
    value = sums["ll"] - 0.5 * (v * v).sum(axis=1) - 0.5 * np.linalg.slogdet(a)[1]

    # How the modes, and through them the curvature, move with beta.
    move = -np.einsum("gab,gpb->gpa", weight, sums["c"])
    curved = sums["d"] + np.einsum("gabc,gpc->gpab", t, move)
    beta = sums["gx"] - 0.5 * np.einsum("gab,gpab->gp", weight, curved)

    theta = []
    half = np.einsum("gab,bc,gcd->gad", h, factor, inverse)
    for k in range(q):
        for j in range(k + 1):
            shift = np.zeros_like(v)
            shift[:, k] = v[:, j]
            pull = -np.einsum("ba,gbc,gc->ga", factor, h, shift)
            pull[:, j] += sums["r"][:, k]
            moved = shift + np.einsum("ab,gbc,gc->ga", factor, inverse, pull)
            turned = np.einsum("gabc,gc->gab", t, moved)
            trace = 2 * half[:, k, j] + np.einsum("gab,gab->g", weight, turned)
            theta.append((sums["r"][:, k] * v[:, j] - 0.5 * trace).sum())
    return np.concatenate([[value.sum()], beta.sum(axis=0), theta])


class Laplace:
    """One model of a grid: its terms and what standardises them."""

    def __init__(self, spec: ModelSpec, terms: list[str], slope: list[str]):
        self.spec = spec
        self.all_terms = [INTERCEPT, *terms]
        if spec.slope is not None and len(slope) != 1:
            raise ValueError("a random slope must be a single numeric or two-level column")
        self.of = slope[0] if slope else None

    def settle(self, state: State | None, columns: list[int]) -> None:
        """``state`` has the columns of all terms and the share of successes."""
        if state is None:
            raise ValueError(f"{self.spec.name}: no complete rows")
        kept = independent(state, len(columns))
        self.terms = [INTERCEPT, *[self.all_terms[k + 1] for k in kept]]
        if self.of is not None and self.of not in self.terms:
            raise ValueError(f"{self.spec.name}: the column of the random slope is constant or follows from others")
        self.columns = [columns[k] for k in kept]
        self.mean, self.spread = state.mean[kept], state.spread[kept]
        self.n, self.successes = state.n, state.n * state.mean[-1]
        self.slope = None if self.of is None else self.terms.index(self.of)
        self.p, self.q = len(self.terms), 1 if self.of is None else 2

    def start(self) -> np.ndarray:
        """The intercept-only logit with moderate variance components."""
        rate = min(max(self.successes / self.n, 1e-6), 1 - 1e-6)
        beta = np.zeros(self.p)
        beta[0] = math.log(rate / (1 - rate))
        return np.concatenate([beta, [0.5] if self.q == 1 else [0.5, 0.0, 0.5]])

    def plain(self) -> tuple:
        """What a task needs, as plain data."""
        return self.columns, self.mean, self.spread, self.p, self.slope


class LaplaceData:
    """Patterns of some models of one outcome and group, laid out for repeated evaluation."""

    def __init__(self, df: DataFrame, specs: list[ModelSpec], levels: Levels | None = None, hot_patterns: int = HOT_PATTERNS):
        shared = SharedRows(df, specs, levels)
        self.models = [Laplace(s, shared.terms(s.fixed), shared.terms((s.slope,)) if s.slope else []) for s in specs]
        columns = [[shared.where[t] for t in m.all_terms[1:]] for m in self.models]
        self._stack = ExitStack()
        try:
            self._lay_out(shared, columns, hot_patterns)
            states = _collected(self.table.filter("n IS NOT NULL").select("n", "mean", "product"))
            for model, own in zip(self.models, columns, strict=True):
                model.settle(complete(states, [*own, len(shared.names)]), own)
        except BaseException:
            self.close()
            raise
        self.modes = [np.zeros((self.hot, m.q)) for m in self.models]

    def _lay_out(self, shared: SharedRows, columns: list[list[int]], hot_patterns: int) -> None:
        merged = shared.table
        rows = merged.count()
        # At most rows / hot_patterns groups, counted exactly and numbered where they are.
        counts = merged.groupBy("g").agg(F.count(F.lit(1)).alias("patterns")).filter(F.col("patterns") > hot_patterns)
        hot = runtime.stored(counts.withColumn("hot", F.row_number().over(Window.orderBy("g")) - 1), "hot")
        sizes = hot.agg(F.count(F.lit(1)).alias("groups"), F.max("patterns").alias("most")).first()
        self.hot = sizes["groups"]
        slices = max(2, math.ceil((sizes["most"] or 0) / hot_patterns))
        if self.hot:
            merged = merged.join(hot.select("g", "hot"), ["g"], "left").withColumn("hot", F.coalesce("hot", F.lit(-1)))
        else:
            merged = merged.withColumn("hot", F.lit(-1))
        piece = F.when(F.col("hot") >= 0, F.pmod(F.xxhash64("g", *shared.names), F.lit(slices))).otherwise(F.lit(0))
        cores = merged.sparkSession.sparkContext.defaultParallelism
        self.parts = max(min(cores, math.ceil(rows / SMALL_PARTITION)), math.ceil(rows / ROWS_PER_PARTITION), 1)
        if self.parts > cores:
            self.parts = cores * math.ceil(self.parts / cores)
        dealt = merged.withColumn("piece", piece).repartition(self.parts, "g", "piece").sortWithinPartitions("hot", "g")
        made = dealt.select("g", "hot", *shared.names, "m", "s").mapInArrow(blocks(shared.names, columns, CHUNK_ROWS), SCHEMA)
        self.table = self._stack.enter_context(runtime.held(made, "patterns"))

    def close(self) -> None:
        self._stack.close()

    def evaluate(self, asked: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Negative Laplace log-likelihood and gradient of each model at its parameter points."""
        return {k: (f, g) for k, (f, g, _) in self._found({k: (points, False) for k, points in asked.items()}).items()}

    def search(self, asked: dict[int, tuple[np.ndarray, bool]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """The same with Hessians, if asked for."""
        if not self.hot:
            return self._found(asked)
        found = self._found({k: (_stencil(points) if curved else points, False) for k, (points, curved) in asked.items()})
        return {k: _differenced(*found[k][:2], points) if curved else found[k] for k, (points, curved) in asked.items()}

    def _found(self, asked: dict[int, tuple[np.ndarray, bool]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        modes = {k: np.repeat(self.modes[k][None], len(points), axis=0) for k, (points, _) in asked.items()}
        total, sums = self._job(asked, modes, cold=True)
        if self.hot:
            for k, extra in self._hot_groups({k: points for k, (points, _) in asked.items()}, sums).items():
                total[k] += extra
        out = {}
        for k, (points, curved) in asked.items():
            size = points.shape[1]
            hessian = np.array([unpack(-row[1 + size :], size) for row in total[k]]) if curved else None
            out[k] = -total[k][:, 0], -total[k][:, 1 : 1 + size], hessian
        return out

    def _hot_groups(self, asked: dict[int, np.ndarray], sums: dict[int, list]) -> dict[int, np.ndarray]:
        factors = {k: [lower_factor(t[self.models[k].p :]) for t in points] for k, points in asked.items()}
        modes = {k: [self.modes[k].copy() for _ in points] for k, points in asked.items()}
        for _ in range(MODE_STEPS):
            steps = {k: [_mode_step(s["r"], s["h"], v, f) for s, v, f in zip(sums[k], modes[k], factors[k], strict=True)] for k in asked}
            if max(np.abs(step).max() for own in steps.values() for step in own) < MODE_TOLERANCE * 10:
                break
            modes = {k: [v + step for v, step in zip(modes[k], steps[k], strict=True)] for k in asked}
            _, sums = self._job({k: (points, False) for k, points in asked.items()}, {k: np.array(v) for k, v in modes.items()}, cold=False)
        for k in asked:
            self.modes[k] = modes[k][0]
        return {k: np.array([_objective(s, v, f) for s, v, f in zip(sums[k], modes[k], factors[k], strict=True)]).reshape(len(asked[k]), -1) for k in asked}

    def _job(self, asked: dict[int, tuple[np.ndarray, bool]], modes: dict[int, np.ndarray], cold: bool) -> tuple[dict[int, np.ndarray], dict[int, list[dict]]]:
        """One pass: totals of the groups solved in tasks, pattern sums of the spread-out ones."""
        task = _task({k: (points, curved, modes[k], self.models[k].plain()) for k, (points, curved) in asked.items()})
        frame = self.table.filter("block IS NOT NULL" if cold else "hot").select("block")
        parts = frame.mapInArrow(task, PARTS)
        if self.hot or self.parts > FEW_TASKS:
            parts = parts.repartition(MERGERS).mapInArrow(_added, PARTS)
        found = _add({}, parts.toArrow().to_batches())
        total, sums = {}, {}
        for k, (points, curved) in asked.items():
            size = points.shape[1]
            none = np.zeros(1 + size + curved * (size * (size + 1) // 2))
            total[k] = np.array([found.get((k, -1, i), none) for i in range(len(points))])
            if self.hot:
                sums[k] = _hot_sums(found, k, self.hot, len(points), _shapes(self.models[k].p, self.models[k].q))
        return total, sums


def _stencil(points: np.ndarray) -> np.ndarray:
    """Each point, and those beside it along each axis."""
    offsets = DIFFERENCE * np.eye(points.shape[1])
    return np.vstack([x + np.vstack([np.zeros(len(x)), offsets, -offsets]) for x in points])


def _differenced(f: np.ndarray, g: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count, size = points.shape
    f, g = f.reshape(count, -1), g.reshape(count, 2 * size + 1, size)
    hessian = (g[:, 1 : size + 1] - g[:, size + 1 :]) / (2 * DIFFERENCE)
    return f[:, 0], g[:, 0], (hessian + hessian.transpose(0, 2, 1)) / 2


def _hot_sums(found: dict[tuple, np.ndarray], model: int, groups: int, points: int, shapes: dict[str, tuple[int, ...]]) -> list[dict]:
    table = np.zeros((groups, points, sum(math.prod(s) for s in shapes.values())))
    for (k, group, point), part in found.items():
        if k == model and group >= 0:
            table[group, point] = part
    sums = []
    for k in range(points):
        at, one = 0, {}
        for name, shape in shapes.items():
            length = math.prod(shape)
            one[name] = table[:, k, at : at + length].reshape(groups, *shape)
            at += length
        sums.append(one)
    return sums


# Sums of one model and point over groups solved in tasks (hot = -1), or over a spread-out group's patterns.
PARTS = "model int, hot int, point int, part array<double>"


def _add(total: dict[tuple, np.ndarray], batches) -> dict[tuple, np.ndarray]:
    for batch in batches:
        for *key, part in zip(*(batch.column(c).to_pylist() for c in ("model", "hot", "point")), batch.column("part"), strict=True):
            own = part.values.to_numpy(zero_copy_only=False)
            total[tuple(key)] = total[tuple(key)] + own if tuple(key) in total else own.copy()
    return total


def _rows(total: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for key, part in total.items():
        yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), _lists(part[None])], ["model", "hot", "point", "part"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(_add({}, batches))


def _task(asked: dict[int, tuple]):
    """The per-partition function; closes over arrays only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for one in batch.column("block"):
                block = pickle.loads(one.as_buffer())
                for k, (points, curved, modes, (columns, mean, spread, p, slope)) in asked.items():
                    found = opened(block, k, columns, mean, spread, slope)
                    if found is None:
                        continue
                    groups, places = found
                    parts = _cold(groups, points, curved, p) if block["hot"] is None else _hot(groups, block["hot"][places], points, modes, p)
                    for (group, point), part in parts:
                        key = (k, group, point)
                        total[key] = total[key] + part if key in total else part
        yield from _rows(total)

    return run


def _cold(groups: Groups, points: np.ndarray, curved: bool, p: int) -> Iterator[tuple]:
    """Objective and gradient, and the Hessian if asked for, of groups that lie completely in the block."""
    v = np.zeros((groups.q, len(groups.counts)))
    for k, point in enumerate(points):
        # Points of a batch lie close together, so modes carry over.
        own, v = groups.evaluate(point[:p], lower_factor(point[p:]), v, curved)
        yield (-1, k), own


def _hot(groups: Groups, hot: np.ndarray, points: np.ndarray, modes: np.ndarray, p: int) -> Iterator[tuple]:
    """Sums over the patterns of spread-out groups at their modes so far."""
    x = groups.predictors()
    z = x[:, :1] if groups.slope is None else x[:, [0, groups.slope]]
    for k, point in enumerate(points):
        effect = np.repeat(modes[k][hot] @ lower_factor(point[p:]).T, groups.counts, axis=0)
        eta = x @ point[:p] + (z * effect).sum(axis=1)
        sums = _group_sums(x, z, groups.m, groups.s, eta, groups.starts)
        flat = np.concatenate([v.reshape(len(hot), -1) for v in sums.values()], axis=1)
        yield from (((int(g), k), part) for g, part in zip(hot, flat, strict=True))


# Below this relative size a variance component counts as zero.
BOUNDARY = 1e-3


def fit_glmm(df: DataFrame, spec: ModelSpec, levels: Levels | None = None, hot_patterns: int = HOT_PATTERNS) -> Fit:
    """Laplace fit with one grouping factor: (1 | g) or (1 + slope | g)."""
    return fit_glmm_grid(df, [spec], levels, hot_patterns)[0]


def fit_glmm_grid(df: DataFrame, specs: list[ModelSpec], levels: Levels | None = None, hot_patterns: int = HOT_PATTERNS) -> list[Fit]:
    """Laplace fits of several models of one outcome and group: one scan of the trials, and a job for each round of all searches."""
    data = LaplaceData(df, specs, levels, hot_patterns)
    try:
        found = side_by_side(data.search, [newton_steps(m.start()) for m in data.models])
    finally:
        data.close()
    return [_fit(model, *best) for model, best in zip(data.models, found, strict=True)]


def _fit(model: Laplace, point: np.ndarray, value: float, hessian: np.ndarray, converged: bool) -> Fit:
    p = model.p
    theta = point[p:]
    # A vanishing component has a flat or even objective; its row says nothing about beta.
    keep = list(range(p)) + [p + i for i in range(len(theta)) if abs(theta[i]) > BOUNDARY]
    covariance = np.linalg.pinv(hessian[np.ix_(keep, keep)])[:p, :p]
    covariance, estimate = unscaled(covariance, point[:p], model.mean, model.spread)
    factor = lower_factor(theta)
    if model.q == 2:
        j = model.slope - 1
        factor = np.array([[1.0, -model.mean[j] / model.spread[j]], [0.0, 1.0 / model.spread[j]]]) @ factor
    n, k = int(round(model.n)), len(point)
    # Coefficients of standardised predictors that run away: the outcome is separated.
    converged = converged and not bool(np.any(np.abs(point[:p]) > SEPARATED))
    spreads = random_effect_stats(factor @ factor.T)
    # A vanished component, or effects that determine each other.
    singular = bool(np.any(np.abs(np.diag(lower_factor(theta))) <= BOUNDARY)) or abs(spreads.get("group_cor", 0.0)) > 1 - 1e-4
    stats = {
        "singular": float(singular),
        "loglik": -value,
        "deviance": 2 * value,
        "aic": 2 * value + 2 * k,
        "bic": 2 * value + k * math.log(n),
        **spreads,
    }
    return with_aliased(Fit(model.spec, model.terms, estimate, covariance, n, converged=converged, stats=stats), model.all_terms)


def laplace_profile(df: DataFrame, spec: ModelSpec, points: list[tuple[float, ...]], levels: Levels | None = None) -> DataFrame:
    """The Laplace log-likelihood at given points: coefficients, then the lower factor of the random effects' covariance."""
    data = LaplaceData(df, [spec], levels)
    (model,) = data.models
    try:
        ahead = np.eye(model.p)
        ahead[0, 1:], ahead[1:, 1:] = model.mean, np.diag(model.spread)
        standard = []
        for point in np.array(points, dtype=float):
            factor = lower_factor(point[model.p :])
            if model.q == 2:
                j = model.slope - 1
                moved = np.array([[1.0, model.mean[j]], [0.0, model.spread[j]]]) @ factor
                # the lower factor of the same covariance
                factor = np.linalg.qr(moved.T)[1].T
            standard.append(np.concatenate([ahead @ point[: model.p], factor[np.tril_indices(model.q)]]))
        values, _ = data.evaluate({0: np.array(standard)})[0]
    finally:
        data.close()
    return df.sparkSession.createDataFrame([(k, -float(v)) for k, v in enumerate(values)], "point int, loglik double")
