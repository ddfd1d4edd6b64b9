"""Rows of logistic mixed models: one scan of the trials for any number of specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats import runtime
from trialstats.models.spec import Levels, ModelSpec, factor_levels, predictor_columns


class SharedRows:
    """Trials with weight ``m`` and the sum ``s`` of the outcome.

    Trials of the same group that agree in every predictor of the models are
    merged and written to the shared folder once.
    """

    def __init__(self, df: DataFrame, specs: list[ModelSpec], levels: Levels | None = None):
        if len({(s.group, s.outcome, s.family) for s in specs}) != 1:
            raise ValueError("models of one grid must share group, outcome and family")
        first = specs[0]
        self.levels = factor_levels(df, sorted({n for s in specs for n in s.fixed}), levels)
        columns = {t: c for s in specs for t, c in predictor_columns(s.fixed, self.levels).items()}
        #: Place of each term's column t0, t1, ...
        self.where = {t: i for i, t in enumerate(columns)}
        self.names = [f"t{i}" for i in range(len(columns))]
        base = df.select(
            F.col(first.group).alias("g"),
            F.col(first.outcome).cast("double").alias("y"),
            *[c.alias(name) for name, c in zip(self.names, columns.values(), strict=True)],
        ).dropna(subset=["g", "y"])
        merged = base.groupBy("g", *self.names).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("y").alias("s"))
        self.table = runtime.stored(merged, "grid")

    def terms(self, names: tuple[str, ...]) -> list[str]:
        """Terms of some predictors, in their order."""
        return list(predictor_columns(names, self.levels))
