"""Minimisers that ask for many parameter points at once.

Each request is one Spark job, so points are batched: a whole finite-difference
stencil, or all step lengths of a line search.
"""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np

Values = Callable[[np.ndarray], np.ndarray]
Minimum = tuple[np.ndarray, float, np.ndarray, bool]

STEP_LENGTHS = np.array([1.0, 0.5, 0.25, 0.1, 0.02])


def root(slopes: Values, low: float, high: float, points: int = 17, rounds: int = 40) -> float:
    """Zero of a function rising from negative to positive, by repeated subdivision."""
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        rising = np.flatnonzero(slopes(grid[1:-1]) > 0)
        first = int(rising[0]) + 1 if len(rising) else points - 1
        low, high = grid[first - 1], grid[first]
        if high - low <= 1e-13 * high:
            break
    return float((low + high) / 2)


def _descent(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Newton direction with the curvature made positive."""
    values, vectors = np.linalg.eigh((hessian + hessian.T) / 2)
    floor = 1e-8 * max(np.abs(values).max(), 1e-12)
    return -vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), floor))


def newton_values(evaluate: Values, start: np.ndarray, h: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, bool]:
    """Newton's method with all derivatives from batches of values."""
    search = value_steps(start, h, rounds)
    points = next(search)
    while True:
        try:
            points = search.send(evaluate(points))
        except StopIteration as end:
            return end.value


def _stencil(x: np.ndarray, h: float) -> np.ndarray:
    """The point, its neighbours along each axis and at the corners of each pair of axes."""
    eye = np.eye(len(x)) * h
    points = [x]
    for i in range(len(x)):
        points += [x + eye[i], x - eye[i]]
    for i, j in _corners(len(x)):
        points += [x + eye[i] + eye[j], x - eye[i] - eye[j], x + eye[i] - eye[j], x - eye[i] + eye[j]]
    return np.array(points)


def _corners(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i + 1, k)]


def value_steps(start: np.ndarray, h: float = 1e-3, rounds: int = 40) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, bool]]:
    """The same as a generator that asks for values at points.

    Each request holds the stencil around the full Newton step and the shorter
    steps, so a round that accepts the full step costs a single one.
    """
    x, k = start.copy(), len(start)
    f = yield _stencil(x, h)
    for _ in range(rounds):
        gradient = np.array([(f[1 + 2 * i] - f[2 + 2 * i]) / (2 * h) for i in range(k)])
        hessian = np.diag([(f[1 + 2 * i] - 2 * f[0] + f[2 + 2 * i]) / h**2 for i in range(k)])
        for c, (i, j) in enumerate(_corners(k)):
            a = f[1 + 2 * k + 4 * c : 5 + 2 * k + 4 * c]
            hessian[i, j] = hessian[j, i] = (a[0] + a[1] - a[2] - a[3]) / (4 * h**2)
        step = _descent(gradient, hessian)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        ahead = _stencil(x + step, h)
        got = yield np.vstack([ahead, x + STEP_LENGTHS[1:, None] * step])
        trial = np.append(got[0], got[len(ahead) :])
        best = int(np.argmin(trial))
        if trial[best] > f[0] - 1e-11 * abs(f[0]):
            if trial[best] < f[0]:
                x = x + STEP_LENGTHS[best] * step
            return x, True
        x = x + STEP_LENGTHS[best] * step
        if np.abs(STEP_LENGTHS[best] * step).max() < 1e-7:
            return x, True
        f = got[: len(ahead)] if best == 0 else (yield _stencil(x, h))
    return x, False


def newton_steps(start: np.ndarray, rounds: int = 60) -> Generator[tuple[np.ndarray, bool], tuple[np.ndarray, np.ndarray, np.ndarray | None], Minimum]:
    """Newton's method.

    A generator that asks for values and gradients at points, and their Hessians
    or not: many searches can then share each evaluation.  A full step that gains
    what the curvature promises, or nearly so, costs one request; else shorter
    steps are tried too and the best is taken.  Returns the minimiser, its value,
    the Hessian there and whether it converged.
    """
    x = start.copy()
    shorter = STEP_LENGTHS[1:, None]
    f, g, hessian = _only((yield x[None], True))
    stalled = 0
    for _ in range(rounds):
        step = _descent(g, hessian)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        small = np.abs(step).max() < 1e-5 and np.abs(g @ step) < 1e-9 * max(1.0, abs(f) * 1e-4)
        if small:
            return x + step, f, hessian, True
        if stalled == 2:
            return x, f, hessian, True
        ahead = _only((yield (x + step)[None], True))
        promised = -(g @ step + step @ hessian @ step / 2)
        if 0 < NEARLY * promised <= f - ahead[0]:
            gain, x, (f, g, hessian) = f - ahead[0], x + step, ahead
        else:
            short, _, _ = yield x + shorter * step, False
            best = int(np.argmin(short))
            if ahead[0] < f and ahead[0] <= short[best]:
                gain, x, (f, g, hessian) = f - ahead[0], x + step, ahead
            elif short[best] < f:
                gain, x = f - short[best], x + shorter[best] * step
                f, g, hessian = _only((yield x[None], True))
            else:
                return x, f, hessian, bool(np.abs(step).max() < 1e-4)
        stalled = stalled + 1 if gain < 1e-6 else 0
    return x, f, hessian, False


# Share of what the curvature promises from which a full step is not compared with shorter ones.
NEARLY = 0.9


def _only(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    return float(found[0][0]), found[1][0], found[2][0]


def side_by_side(evaluate: Callable[[dict], dict], searches: list[Generator]) -> list:
    """What the searches return; each round answers the requests of all that go on at once."""
    asked = {k: next(search) for k, search in enumerate(searches)}
    found = {}
    while asked:
        for k, answer in evaluate(asked).items():
            try:
                asked[k] = searches[k].send(answer)
            except StopIteration as end:
                found[k] = end.value
                del asked[k]
    return [found[k] for k in range(len(searches))]
