"""The Laplace objective of some groups of a logistic mixed model, with its gradient and Hessian.

With spherical effects v, b = Lv, and A = I + L'HL for H = sum w z z', a group
adds ``l(v) - log det A / 2`` at the mode v of ``l``.  Derivatives in a direction
are those of the linear predictor, E = x + z'B with B the move of the modes, so
everything is a sum of row weights times products of x, z and E.  The second
derivative of the mode enters through u = A^-1 dG/dv alone (G = -log det A / 2):
the Hessian is that of ``l + G + u' dl/dv`` along the moving modes, u held fixed.

z is 1 and, with a random slope, one of the predictors: products of z are powers.
A predictor that is constant within its groups, as those of a participant are,
enters through sums of each group; only the others are multiplied row by row.
"""

from __future__ import annotations

import numpy as np

from trialstats.models.logit import log1p_exp, logistic

MODE_STEPS = 100
# Error of a mode; as Newton's steps converge, the square of the last one.
MODE_TOLERANCE = 1e-9


def _inverse(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and determinants of symmetric one by one or two by two matrices, the last axis being the groups."""
    if len(a) == 1:
        return 1 / a, a[0, 0]
    det = a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
    return np.array([[a[1, 1], -a[0, 1]], [-a[1, 0], a[0, 0]]]) / det, det


class Groups:
    """Complete groups: predictors by kind, trials, successes, number of rows of each group.

    ``constant`` (predictors x groups, with the intercept) and ``free`` (predictors x
    rows) come with their places among the p predictors; ``z`` is the column of the
    random slope, whose place is ``slope``.
    """

    def __init__(self, constant: np.ndarray, constant_at: list[int], free: np.ndarray, free_at: list[int], z: np.ndarray | None, slope: int | None, m: np.ndarray, s: np.ndarray, counts: np.ndarray):
        self.constant, self.constant_at, self.free, self.free_at, self.slope = constant, constant_at, free, free_at, slope
        self.m, self.s, self.counts = m, s, counts
        self.starts = np.cumsum(counts) - counts
        self.q = 1 if z is None else 2
        self.p = len(constant_at) + len(free_at) + self.q - 1
        self.powers = [None] if z is None else [None, z, z * z, z * z * z]

    def predictors(self) -> np.ndarray:
        """All of them, rows x p."""
        x = np.empty((self.p, len(self.m)))
        x[self.constant_at] = self._rows(self.constant)
        x[self.free_at] = self.free
        if self.q == 2:
            x[self.slope] = self.powers[1]
        return x.T

    def _add(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=-1)

    def _rows(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.counts, axis=-1)

    def _moment(self, values: np.ndarray, power: int) -> np.ndarray:
        return self._add(values if power == 0 else values * self.powers[power])

    def _moments(self, values: np.ndarray, order: int) -> np.ndarray:
        """Sums of values times powers of z, up to those in z x ... x z."""
        return np.array([self._moment(values, n) for n in range(order * (self.q - 1) + 1)])

    def _tensor(self, moments: np.ndarray, order: int) -> np.ndarray:
        """The moments as sums of values times z x ... x z."""
        return moments[np.indices((self.q,) * order).sum(axis=0)]

    def _freely(self, values: np.ndarray, power: int) -> np.ndarray:
        """Sums of values times a power of z and the free predictors."""
        return self._add(self.free * (values if power == 0 else values * self.powers[power]))

    def _along(self, effects: np.ndarray) -> np.ndarray:
        """z'b of every row for b (q x ... x groups)."""
        out = self._rows(effects[0])
        if self.q == 2:
            out += self._rows(effects[1]) * self.powers[1]
        return out

    def evaluate(self, beta: np.ndarray, factor: np.ndarray, v: np.ndarray, curved: bool) -> tuple[np.ndarray, np.ndarray]:
        """[objective, gradient, upper triangle of the Hessian if asked for], summed, and the modes, searched from ``v`` (q x groups)."""
        q, p, slope = self.q, self.p, self.slope
        fixed = self._rows(beta[self.constant_at] @ self.constant)
        if self.free_at:
            fixed = fixed + beta[self.free_at] @ self.free
        if q == 2:
            fixed = fixed + beta[slope] * self.powers[1]
        eye = np.eye(q)[:, :, None]

        def at(v: np.ndarray) -> tuple:
            eta = fixed + self._along(factor @ v)
            mu = logistic(eta)
            trials = self.m * mu
            resid, w = self.s - trials, trials * (1 - mu)
            r, h = self._moments(resid, 1), self._tensor(self._moments(w, 2), 2)
            turned = np.einsum("ba,bcg->acg", factor, h)
            return eta, mu, resid, w, r, h, turned, *_inverse(eye + np.einsum("acg,cd->adg", turned, factor))

        eta, mu, resid, w, r, h, turned, inverse, det = at(v)
        for _ in range(MODE_STEPS):
            step = np.einsum("abg,bg->ag", inverse, factor.T @ r - v)
            length = np.abs(step).max(axis=0)
            v = v + step * np.minimum(1.0, 2.0 / np.maximum(length, 1e-300))
            eta, mu, resid, w, r, h, turned, inverse, det = at(v)
            if length.max() ** 2 < MODE_TOLERANCE:
                break
        value = (self.s * eta - self.m * log1p_exp(eta)).sum() - 0.5 * (v * v).sum() - 0.5 * np.log(det).sum()

        skew = w * (1 - 2 * mu)
        third = self._moments(skew, 3)
        t = self._tensor(third, 3)
        weight = np.einsum("ab,bcg,dc->adg", factor, inverse, factor)
        tau = np.einsum("abg,abcg->cg", weight, t)
        pull = np.einsum("abg,bg->ag", weight, tau)
        # z'Wz and z'W tau of every row
        spread = self._rows(weight[0, 0])
        if q == 2:
            spread += self._rows(2 * weight[0, 1]) * self.powers[1] + self._rows(weight[1, 1]) * self.powers[2]
        along = self._along(pull)
        score = resid - 0.5 * skew * spread + 0.5 * w * along
        slopes = np.empty(p)
        slopes[self.constant_at] = self.constant @ self._add(score)
        if self.free_at:
            slopes[self.free_at] = self.free @ score
        if q == 2:
            slopes[slope] = score @ self.powers[1]
        gradient = [slopes]

        # Directions of the factor: the modes' moves and those of the effects.
        places = [(k, j) for k in range(q) for j in range(k + 1)]
        moves, shifts = [], []
        for k, j in places:
            drive = -turned[:, k] * v[j]
            drive[j] += r[k]
            move = np.einsum("abg,bg->ag", inverse, drive)
            shift = factor @ move
            shift[k] += v[j]
            bent = np.einsum("ag,ag->g", inverse[j], turned[:, k])
            gradient.append([(r[k] * v[j] - bent - 0.5 * (tau * shift).sum(axis=0)).sum()])
            moves.append(move)
            shifts.append(shift)
        out = np.concatenate([[value], *gradient])
        if not curved:
            return out, v

        # Moves (q x directions x groups) of the modes and of the effects.
        second = [h[0, 0], *([h[0, 1], h[1, 1]] if q == 2 else [])]
        cross = np.empty((q, p, len(self.counts)))
        for a in range(q):
            cross[a, self.constant_at] = self.constant * second[a]
            if self.free_at:
                cross[a, self.free_at] = self._freely(w, a)
            if q == 2:
                cross[a, slope] = second[a + 1]
        back = np.einsum("abg,cb->acg", inverse, factor)
        move = np.concatenate([-np.einsum("abg,bpg->apg", back, cross), np.stack(moves, axis=1)], axis=1)
        shift = np.concatenate([-np.einsum("abg,bpg->apg", weight, cross), np.stack(shifts, axis=1)], axis=1)

        # E is level + z times tilt, and the free predictors themselves.
        level, tilt = shift[0].copy(), shift[1].copy() if q == 2 else None
        level[self.constant_at] += self.constant
        if q == 2:
            tilt[slope] += 1
        omega = -w - 0.5 * w * (1 - 6 * mu * (1 - mu)) * spread + 0.5 * skew * along
        sums = self._moments(omega, 2)
        hessian = (level * sums[0]) @ level.T
        if q == 2:
            mixed = (level * sums[1]) @ tilt.T
            hessian += mixed + mixed.T + (tilt * sums[2]) @ tilt.T
        if self.free_at:
            row = self._freely(omega, 0) @ level.T
            if q == 2:
                row += self._freely(omega, 1) @ tilt.T
            hessian[self.free_at] += row
            hessian[:, self.free_at] += row.T
            hessian[np.ix_(self.free_at, self.free_at)] += (self.free * omega) @ self.free.T
        bends = []
        for n in range(2 * q - 1):
            bends.append(third[n] * level + (third[n + 1] * tilt if q == 2 else 0))
            if self.free_at:
                bends[n][self.free_at] += self._freely(skew, n)
        bend = self._tensor(np.array(bends), 2)
        flat = move.reshape(q, move.shape[1], -1)
        for a in range(q):
            hessian -= flat[a] @ flat[a].T
        # sums of w z E, u, and the change of A
        held = np.einsum("abg,bkg->akg", h, shift)
        held[:, :p] += cross
        u = -0.5 * np.einsum("abg,bg->ag", back, tau)
        force = r - 0.5 * tau + 0.5 * np.einsum("abg,bg->ag", h, pull)
        change = np.einsum("ba,bckg,cd->adkg", factor, bend, factor, optimize=True)
        for t_at, (k, j) in enumerate(places):
            at = p + t_at
            row = move[j] @ force[k] - held[k] @ u[j]
            for b in range(q):
                row -= bend[b, k] @ back[j, b]
            hessian[at] += row
            hessian[:, at] += row
            for s_at, (l, i) in enumerate(places):
                hessian[at, p + s_at] -= (h[k, l] * inverse[i, j]).sum()
            # L'H dL has the column k of L'H in its column j; A changes by it and its transpose
            change[:, j, at] += turned[:, k]
            change[j, :, at] += turned[:, k]
        solved = np.einsum("acg,cbkg->abkg", inverse, change)
        for a in range(q):
            for b in range(q):
                hessian += 0.5 * solved[a, b] @ solved[b, a].T
        return np.concatenate([out, hessian[np.triu_indices(len(hessian))]]), v
