"""Panel random effects: feasible GLS with Swamy-Arora variance components.

The components for panels of unequal length follow Baltagi and Chang (1994);
for equal lengths they are the usual ones.  Everything needed is in the group
cross-products of the mixed model, and quasi-demeaning is the same correction
at the estimated variance ratio.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from trialstats.models.lmm import GroupMoments
from trialstats.models.spec import Fit, Levels, ModelSpec, scaled_inverse, with_aliased


def fit_panel(df: DataFrame, spec: ModelSpec, levels: Levels | None = None) -> Fit:
    """outcome ~ fixed with a random effect per ``spec.group``."""
    with GroupMoments(df, spec, levels) as data:
        p, n, groups = data.p, data.n, data.groups
        means = data.weighted(lambda zz: 1.0 / zz)
        sums = data.weighted(lambda zz: np.ones_like(zz))
        idiosyncratic = _within_variance(data, means)
        # Between regression of group means weighted by group size.
        between_inverse = scaled_inverse(means[:p, :p])
        between_beta = between_inverse @ means[:p, p]
        between_rss = means[p, p] - means[:p, p] @ between_beta
        spread = n - np.trace(between_inverse @ sums[:p, :p])
        individual = max((between_rss - (groups - p) * idiosyncratic) / spread, 0.0)
        ratio = individual / idiosyncratic
        correction = data.weighted(lambda zz: ratio / (1.0 + ratio * zz))
        inverse, beta, rss = data.generalised(correction)
        s2 = rss / (n - p)
        stats = {
            "sigma": math.sqrt(idiosyncratic),
            "group_sd": math.sqrt(individual),
            "groups": groups,
            # Share removed from each observation when all panels are of average length.
            "theta": 1.0 - 1.0 / math.sqrt(1.0 + ratio * n / groups),
        }
        return with_aliased(Fit(spec, data.terms, beta, s2 * inverse, n, stats=stats), data.all_terms)


def _within_variance(data: GroupMoments, means: np.ndarray) -> float:
    """Residual variance of the regression on deviations from group means,
    using the predictors that vary within groups."""
    within = data.gram - means
    p = data.p
    varying = [j for j in range(1, p) if within[j, j] > 1e-10 * max(data.gram[j, j], 1e-300)]
    rss = within[p, p]
    if varying:
        inverse = scaled_inverse(within[np.ix_(varying, varying)])
        rss -= within[varying, p] @ inverse @ within[varying, p]
    return rss / (data.n - data.groups - len(varying))
