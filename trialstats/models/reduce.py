"""Sum the output of a numpy kernel over the rows of a frame.

The frame holds sufficient statistics: one row per covariate pattern or per
group size.  If a checked row count shows it is small, the kernel runs on a
local copy; otherwise it runs in every task, which returns one vector, and Spark
adds the vectors up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest number of statistic rows brought to the driver.
LOCAL_ROWS = 20_000

Kernel = Callable[[np.ndarray], np.ndarray]


def sum_over_frame(frame: DataFrame, kernel: Kernel) -> np.ndarray:
    """Sum over all tasks of ``kernel`` applied to Arrow batches of the numeric ``frame``."""
    columns = frame.columns

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = kernel(batch[columns].to_numpy(dtype=float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "part": total})

    parts = frame.mapInPandas(per_task, "at long, part double")
    sums = parts.groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(len(sums))
    for row in sums:
        out[row["at"]] = row["part"]
    return out


class SumOverRows:
    """Numeric rows, kept on the cluster unless they are few."""

    def __init__(self, frame: DataFrame | np.ndarray, local_rows: int = LOCAL_ROWS):
        if isinstance(frame, np.ndarray):
            self._frame, self._local, self.rows = None, frame, len(frame)
            return
        self.columns = frame.columns
        self._frame = frame.select(*[F.col(c).cast("double").alias(c) for c in frame.columns]).persist()
        self.rows = self._frame.count()
        self._local: np.ndarray | None = None
        if self.rows <= local_rows:
            self._local = self._frame.toPandas().to_numpy(dtype=float).reshape(self.rows, len(self.columns))
            self._frame.unpersist()

    def __enter__(self) -> "SumOverRows":
        return self

    def __exit__(self, *exc) -> None:
        if self._frame is not None:
            self._frame.unpersist()

    def sum(self, kernel: Kernel) -> np.ndarray:
        """``kernel`` maps (rows, columns) to a vector; returns the sum over all rows."""
        if self._local is not None:
            return kernel(self._local)
        return sum_over_frame(self._frame, kernel)
