"""Exact quantiles in two scans, without sorting or shuffling the column.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a first scan makes a KLL sketch, which brackets every wanted rank; a second
one counts the rows between the brackets and writes the distinct values inside
them, with their counts, to the shared folder.  That table is narrowed by
histograms until few values are left.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.runtime import held

# Histogram bins per range and round, and the number of values small enough to read off.
BINS = 256
READ_OFF = 50_000
# Items of the sketch: some 400 kB for a task, ranks within 0.0004 of the rows.
SKETCH = 1 << 14


def order_statistics(
    df: DataFrame, column: str, ranks_of, read_off: int = READ_OFF, sketch: int = SKETCH, slack: float = 1.5
) -> dict[int, float]:
    """Values at 0-based ranks of the sorted column, without NULL and NaN.

    ``ranks_of`` receives the row count and returns the wanted ranks.  Brackets reach
    ``slack`` times the sketch's 99 % error to either side.  The result is exact
    whatever the sketch says: a rank that misses its bracket is looked for in the
    rows between brackets, which takes further scans.
    """
    value = F.col(column).cast("double")
    rows = df.select(value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    n, summary = rows.agg(F.count("value"), F.kll_sketch_agg_double("value", F.lit(sketch))).first()
    if not n:
        return {}
    wanted = sorted(set(ranks_of(int(n))))
    error = slack * 2.296 / sketch**0.9021 if n > sketch else 0.0
    placed = rows.withColumn("rng", _place(F.col("value"), brackets := _brackets(df, summary, int(n), wanted, error)))
    inside = F.when(F.col("rng") % 2 == 1, F.col("value"))
    counts = placed.groupBy("rng", inside.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    found: dict[int, float] = {}
    with held(counts, "quantiles") as table:
        ranges, below = {}, 0
        distinct, weight = {}, {}
        for rng, cnt, values in table.groupBy("rng").agg(F.sum("cnt"), F.count("value")).orderBy("rng").collect():
            distinct[rng], weight[rng] = values, cnt
            here = [r for r in wanted if below <= r < below + cnt]
            if here:
                ranges[rng] = (*_limits(brackets, rng), below, here)
            below += cnt
        _search(table, {k: r for k, r in ranges.items() if k % 2}, sum(distinct[k] for k in ranges), read_off, found)
        missed = {k: r for k, r in ranges.items() if not k % 2}
        if missed:
            between = placed.filter(F.col("rng").isin(list(missed))).withColumn("cnt", F.lit(1))
            _search(between, missed, sum(weight[k] for k in missed), read_off, found)
    return found


def _brackets(df: DataFrame, summary, n: int, wanted: list[int], error: float) -> list[tuple[float, float]]:
    """Disjoint value ranges, in order, that should hold the wanted ranks."""
    one = df.sparkSession.createDataFrame([(summary,)], "sketch binary")
    at = [min(max((r + side) / n, 0.0), 1.0) for r in wanted for side in (-n * error, 1 + n * error)]
    values = one.select(F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, at)))).first()[0]
    out: list[tuple[float, float]] = []
    for low, high in sorted(zip(values[::2], values[1::2], strict=True)):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _place(value: Column, brackets: list[tuple[float, float]], first: int = 0) -> Column:
    """2 i + 1 inside bracket i, 2 i between it and the one before, by a decision tree."""
    if not brackets:
        return F.lit(2 * first)
    half = len(brackets) // 2
    low, high = brackets[half]
    return (
        F.when(value < low, _place(value, brackets[:half], first))
        .when(value <= high, F.lit(2 * (first + half) + 1))
        .otherwise(_place(value, brackets[half + 1 :], first + half + 1))
    )


def _limits(brackets: list[tuple[float, float]], rng: int) -> tuple[float, float]:
    number, inside = divmod(rng, 2)
    if inside:
        return brackets[number]
    return brackets[number - 1][1] if number else -math.inf, brackets[number][0] if number < len(brackets) else math.inf


def _search(frame: DataFrame, ranges: dict, left: int, read_off: int, found: dict[int, float]) -> None:
    """Values of the wanted ranks of (lowest value, highest value, rows below, wanted ranks) by range id."""
    narrower = True
    for k in [k for k, (low, high, _, _) in ranges.items() if low == high]:
        low, _, _, wanted = ranges.pop(k)
        found.update(dict.fromkeys(wanted, float(low)))
    if ranges:
        frame = frame.filter(F.col("rng").isin(list(ranges)))
    while ranges:
        # Where bins can't tell values apart any more, few distinct ones are left.
        if left <= read_off or not narrower:
            _read_off(frame, ranges, found)
            break
        frame, ranges, left, narrower = _narrow(frame, ranges, found)


def _read_off(frame: DataFrame, ranges: dict, found: dict[int, float]) -> None:
    table = frame.groupBy("rng", "value").agg(F.sum("cnt").alias("cnt")).toArrow()
    rng, value, cnt = (table.column(c).to_numpy() for c in table.column_names)
    for number, (_, _, below, wanted) in ranges.items():
        inside = rng == number
        order = np.argsort(value[inside])
        upto = below + np.cumsum(cnt[inside][order])
        places = np.searchsorted(upto, wanted, side="right")
        found.update(zip(wanted, value[inside][order][places].tolist(), strict=True))


def _narrow(frame: DataFrame, ranges: dict, found: dict[int, float]):
    """One histogram round: keep only the bins that hold a wanted rank."""
    spark = frame.sparkSession
    table = spark.createDataFrame(
        [(k, float(lo) / 2, float(hi) / 2 - float(lo) / 2) for k, (lo, hi, _, _) in ranges.items()],
        "rng int, half double, width double",
    )
    # Halves, as the distance of two values near the limits is no double.
    place = F.try_divide(F.col("value") / 2 - F.col("half"), F.col("width"))
    place = F.when(F.isnan(place) | place.isNull(), 0.0).otherwise(place)
    bin_no = F.least(F.lit(BINS - 1), F.floor(place * BINS)).cast("int")
    binned = frame.join(F.broadcast(table), "rng").select("rng", "value", "cnt", bin_no.alias("bin"))
    histogram = (
        binned.groupBy("rng", "bin")
        .agg(F.sum("cnt").alias("cnt"), F.count("value").alias("values"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        .orderBy("rng", "bin")
        .collect()
    )
    kept, below, narrowed, left, narrower = [], {}, {}, 0, True
    for row in histogram:
        _, _, base, wanted = ranges[row["rng"]]
        start = below.get(row["rng"], base)
        below[row["rng"]] = start + row["cnt"]
        inside = [r for r in wanted if start <= r < start + row["cnt"]]
        if not inside:
            continue
        if row["lo"] == row["hi"]:
            found.update({r: row["lo"] for r in inside})
            continue
        narrower = narrower and (row["lo"], row["hi"]) != ranges[row["rng"]][:2]
        narrowed[len(kept)] = (row["lo"], row["hi"], start, inside)
        kept.append((row["rng"], row["bin"], len(kept)))
        left += row["values"]
    if not kept:
        return frame, {}, 0, True
    keep = F.broadcast(spark.createDataFrame(kept, "rng int, bin int, next int"))
    remaining = binned.join(keep, ["rng", "bin"]).select("value", "cnt", F.col("next").alias("rng"))
    return remaining, narrowed, left, narrower


def quantiles(df: DataFrame, column: str, probabilities: list[float], **options) -> dict[float, float]:
    """Linear interpolation between the two neighbouring order statistics."""
    place: dict[float, tuple[int, int, float]] = {}

    def ranks(n: int) -> list[int]:
        for p in probabilities:
            at = (n - 1) * p
            place[p] = (math.floor(at), math.ceil(at), at - math.floor(at))
        return [r for low, high, _ in place.values() for r in (low, high)]

    values = order_statistics(df, column, ranks, **options)
    return {p: values[lo] + (values[hi] - values[lo]) * f for p, (lo, hi, f) in place.items()}


def qq_grid(points: int) -> list[float]:
    """Evenly spaced plotting positions (i - 0.5) / points."""
    return [(i - 0.5) / points for i in range(1, points + 1)]


def qq_points(df: DataFrame, column: str, points: int = 49, **options) -> DataFrame:
    """Sample quantiles against standard normal quantiles, one row per plotting position."""
    sample = quantiles(df, column, qq_grid(points), **options)
    normal = NormalDist()
    return df.sparkSession.createDataFrame(
        [(p, normal.inv_cdf(p), float(v)) for p, v in sample.items()],
        "prob double, normal_quantile double, sample_quantile double",
    )
