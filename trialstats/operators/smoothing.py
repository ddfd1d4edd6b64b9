"""Local linear smoothing from binned moments.

The rows are reduced once to the count, means and centred cross-products of each
bin of the predictor.  Around every evaluation point, the centre of a bin that has
rows, a straight line is fitted with tricube weights; each bin adds its moments,
shifted to the point, with the weight of its own mean.  The spread of values inside
bins is kept, only the weight is shared by a bin's rows, so narrower bins come as
near as wanted to the fit from single rows.  The second shuffle carries one row for
each bin and point within reach, whatever the number of rows.

Defined cases: rows with a NULL or NaN on either side are left out; where all values
within reach coincide the point gets their weighted mean; groups may be NULL; no rows
give no points.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Below this share of its terms a determinant is rounding only.
FLAT = 1e-12


def binned_moments(df: DataFrame, x: str, y: str, width: float, by: list[str]) -> DataFrame:
    """Count, means and centred products of each bin; map-side sums, one small row for each bin."""
    pair = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    whole = pair.filter(~(F.isnan("__x") | F.isnan("__y")) & F.col("__x").isNotNull() & F.col("__y").isNotNull())
    n = F.count(F.lit(1))
    return whole.groupBy(*by, F.floor(F.col("__x") / width).alias("__bin")).agg(
        n.alias("__n"), F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"),
        (F.var_pop("__x") * n).alias("__xx"), (F.covar_pop("__x", "__y") * n).alias("__xy"),
    )


def local_linear(df: DataFrame, x: str, y: str, bandwidth: float, width: float, by: list[str] | None = None) -> DataFrame:
    """(by, ``x``, fit, slope, n): the smoothed ``y`` at bin centres and the rows within ``bandwidth`` bins of them."""
    if not (width > 0 and bandwidth >= width):
        raise ValueError("bins have a positive width, at most the bandwidth")
    by = by or []
    reach = math.ceil(bandwidth / width)
    bins = binned_moments(df, x, y, width, by)
    placed = bins.withColumn("__at", F.explode(F.sequence(F.col("__bin") - reach, F.col("__bin") + reach)))
    centre = (F.col("__at") + 0.5) * F.lit(float(width))
    away = F.col("__mx") - centre
    part = F.abs(away) / float(bandwidth)
    weighted = placed.withColumns({"__d": away, "__w": F.when(part < 1, F.pow(1 - F.pow(part, 3), 3)).otherwise(0.0)})
    w, n, d = F.col("__w"), F.col("__n"), F.col("__d")
    sums = weighted.filter((w > 0) | (F.col("__at") == F.col("__bin"))).groupBy(*by, "__at").agg(
        F.sum(w * n).alias("s0"), F.sum(w * n * d).alias("s1"), F.sum(w * (F.col("__xx") + n * d * d)).alias("s2"),
        F.sum(w * n * F.col("__my")).alias("t0"), F.sum(w * (F.col("__xy") + n * F.col("__my") * d)).alias("t1"),
        F.sum(n).alias("n"), F.max(F.col("__at") == F.col("__bin")).alias("own"),
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    flat = det <= FLAT * F.col("s0") * F.col("s2")
    fit = F.when(flat, F.col("t0") / F.col("s0")).otherwise((F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det)
    slope = F.when(~flat, (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / det)
    return sums.filter("own").select(*by, centre.alias(x), fit.alias("fit"), slope.alias("slope"), "n")
