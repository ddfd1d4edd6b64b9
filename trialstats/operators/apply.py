"""Any summary of any group by states that merge, so that no group sits in one task.

A ``Summary`` turns some rows of a group into a state (a list of numbers of any
length), merges two states of a group and turns the last one into result rows.
Every task keeps one state for each group it meets (at most HELD groups at a
time), so what is shuffled is states.  They are merged in streams sorted by
group, first spread over SALTS parts of a group, then whole.

Rows come in any order and in any cuts; ``merge`` must not depend on either.
NULL and NaN keys are groups of their own.  Value columns reach ``state`` as
pandas columns, NULL as NaN or None.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

State = Sequence[float]
HELD = 20_000
SALTS = 32


@dataclass(frozen=True)
class Summary:
    """``schema`` describes the tuples of ``finish``, as a DDL string or a StructType."""

    state: Callable[[pd.DataFrame], State]
    merge: Callable[[State, State], State]
    finish: Callable[[State], list[tuple]]
    schema: str | T.StructType


def group_apply(df: DataFrame, by: list[str], columns: list[str], how: Summary) -> DataFrame:
    """The rows of ``how`` for every group of ``by``: the keys, then the columns of its schema."""
    result = T.StructType.fromDDL(how.schema) if isinstance(how.schema, str) else how.schema
    if not by:
        raise ValueError("group_apply needs a grouping column")
    taken = set(by) & set(result.names)
    if taken:
        raise ValueError(f"names of groups and of results clash: {sorted(taken)}")
    width = len(by)
    keys = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(by)])
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], *[F.col(c).alias(c) for c in dict.fromkeys(columns)])
    held = T.StructType([*keys, T.StructField("state", T.ArrayType(T.DoubleType()))])
    salted = rows.mapInArrow(_partial(how, width, to_arrow_schema(held)), held).withColumn("salt", F.spark_partition_id() % SALTS)
    for last in (False, True):
        parts = [F.col(k) for k in keys.names] + ([] if last else [F.col("salt")])
        sorted_rows = salted.repartition(*parts).sortWithinPartitions(*parts).select(*held.names)
        out = T.StructType([*keys, *result]) if last else held
        salted = sorted_rows.mapInArrow(_merged(how, width, to_arrow_schema(out), last), out)
    return salted.toDF(*by, *result.names)


def _codes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """A number for each row, equal where all keys are."""
    code = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[:width]:
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1]
    return code


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _partial(how: Summary, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, State] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes(batch, width)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
            keys = [c.take(pa.array(order[starts])).to_pylist() for c in batch.columns[:width]]
            values = batch.select(batch.schema.names[width:]).to_pandas().take(order)
            for key, a, b in zip(zip(*keys, strict=True), starts, [*starts[1:], len(order)], strict=True):
                state = how.state(values.iloc[a:b])
                held[key] = how.merge(held[key], state) if key in held else state
            if len(held) >= HELD:
                yield _batch([(*k, [float(x) for x in s]) for k, s in held.items()], schema)
                held = {}
        yield _batch([(*k, [float(x) for x in s]) for k, s in held.items()], schema)

    return run


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _merged(how: Summary, width: int, schema: pa.Schema, last: bool):
    """One row for each run of equal keys; of rows sorted by them, only the current state is held."""

    def rows_of(key: tuple, state: State) -> list[tuple]:
        return [(*key, *row) for row in how.finish(state)] if last else [(*key, [float(x) for x in state])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            keys = zip(*[c.to_pylist() for c in batch.columns[:width]], strict=True)
            for at, more in zip(keys, batch.column(width).to_pylist(), strict=True):
                if key is not None and _same(key, at):
                    state = how.merge(state, more)
                    continue
                if key is not None:
                    out += rows_of(key, state)
                key, state = at, more
            yield _batch(out, schema)
        if key is not None:
            yield _batch(rows_of(key, state), schema)

    return run


def regression(x: str, y: str) -> Summary:
    """Least squares of y on x over complete pairs: n, slope, intercept, correlation (NULL where undefined)."""

    def state(rows: pd.DataFrame) -> State:
        a, b = rows[x].to_numpy(float), rows[y].to_numpy(float)
        whole = ~(np.isnan(a) | np.isnan(b))
        a, b = a[whole], b[whole]
        if not len(a):
            return [0.0] * 6
        dx, dy = a - a.mean(), b - b.mean()
        return [len(a), a.mean(), b.mean(), dx @ dx, dx @ dy, dy @ dy]

    def merge(s: State, t: State) -> State:
        if not s[0] or not t[0]:
            return t if not s[0] else s
        n, dx, dy = s[0] + t[0], t[1] - s[1], t[2] - s[2]
        f = s[0] * t[0] / n
        return [n, s[1] + dx * t[0] / n, s[2] + dy * t[0] / n, s[3] + t[3] + f * dx * dx, s[4] + t[4] + f * dx * dy, s[5] + t[5] + f * dy * dy]

    def finish(s: State) -> list[tuple]:
        n, mx, my, xx, xy, yy = s
        slope = xy / xx if xx > 0 else None
        return [(int(n), slope, None if slope is None else my - slope * mx, xy / (xx * yy) ** 0.5 if xx > 0 and yy > 0 else None)]

    return Summary(state, merge, finish, "n long, slope double, intercept double, correlation double")


def shape(column: str) -> Summary:
    """n, mean, and the skewness and kurtosis (3 for a normal variable) of the values that are there."""

    def state(rows: pd.DataFrame) -> State:
        v = rows[column].to_numpy(float)
        v = v[~np.isnan(v)]
        if not len(v):
            return [0.0] * 5
        d = v - v.mean()
        return [len(v), v.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum()]

    def merge(s: State, t: State) -> State:
        if not s[0] or not t[0]:
            return t if not s[0] else s
        n, d = s[0] + t[0], t[1] - s[1]
        mean = s[1] + d * t[0] / n
        moved = []
        for m, mu, second, third, fourth in (s, t):
            e = mu - mean
            moved.append((second + m * e**2, third + 3 * e * second + m * e**3, fourth + 4 * e * third + 6 * e**2 * second + m * e**4))
        return [n, mean, *(p + q for p, q in zip(*moved, strict=True))]

    def finish(s: State) -> list[tuple]:
        n, mean, second, third, fourth = s
        if not n:
            return [(0, None, None, None)]
        spread = second > 0
        return [(int(n), mean, n**0.5 * third / second**1.5 if spread else None, n * fourth / second**2 if spread else None)]

    return Summary(state, merge, finish, "n long, mean double, skewness double, kurtosis double")
