"""Means and centred cross-products as states that merge.

A state is (n, mean, product of deviations from that mean) of some rows.  Every
task makes one for each block of rows, in two steps (a mean, then a correction
of it from the deviations), so a column far from zero keeps its digits and no
earlier look at the data is needed.  States merge exactly: products add up, and
the means' deviations from the common mean add the rest.

Rows that lack the same columns share a state, whose missing means are NaN.  A
model with some of the columns merges the states that have them all, so any
number of models, each on its own complete rows, come from one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats import runtime
from trialstats.models.reduce import LOCAL_ROWS

# Rows of a block when states are made for each group.
BLOCK_ROWS = 50_000
# Tasks that merge the states of all others before the driver does.
MERGERS = 16
# States worked on at a time when groups are put together.
GROUPS = 4_000
KIND = "n double, mean array<double>, product array<double>"

Make = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class State:
    n: float
    mean: np.ndarray
    product: np.ndarray

    def pick(self, use: list[int]) -> State:
        return State(self.n, self.mean[use], self.product[np.ix_(use, use)])

    @property
    def spread(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.product), 0.0, None) / max(self.n, 1.0))

    def gram(self) -> np.ndarray:
        """Cross-products of [1, columns less their means]."""
        k = len(self.mean)
        out = np.zeros((k + 1, k + 1))
        out[0, 0] = self.n
        out[1:, 1:] = self.product
        return out


def merge(n: np.ndarray, mean: np.ndarray, product: np.ndarray) -> State:
    """One state of several, given as stacked arrays."""
    total = n.sum()
    base = mean[0]
    centre = base + (n @ (mean - base)) / total
    apart = mean - centre
    return State(float(total), centre, product.sum(axis=0) + (apart * n[:, None]).T @ apart)


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    out = np.empty((len(flat), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = out[:, j, i] = flat
    return out


def block_states(x: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, n, mean, product) for rows of equal code that lack the same columns; products as upper triangles."""
    rows, k = x.shape
    missing = np.isnan(x)
    keys = np.zeros(rows, np.int64) if codes is None else codes.astype(np.int64)
    if missing.any():
        _, pattern = np.unique(np.packbits(missing, axis=1), axis=0, return_inverse=True)
        pattern = pattern.reshape(-1)
        keys = keys * (pattern.max() + 1) + pattern
    i, j = np.triu_indices(k)
    if not (keys != keys[0]).any():  # one state for all rows
        starts, count, gaps = np.zeros(1, int), np.array([float(rows)]), missing[:1]
        values = np.where(missing, 0.0, x)
        mean = values.mean(axis=0, keepdims=True)
        apart = values - mean
        off = apart.mean(axis=0, keepdims=True)
        product = (apart.T @ apart)[i, j][None, :]
        order = np.arange(rows)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[starts, rows]).astype(float)
        gaps = missing[order[starts]]
        values = np.where(missing, 0.0, x)[order]
        mean = np.add.reduceat(values, starts, axis=0) / count[:, None]
        apart = values - np.repeat(mean, count.astype(int), axis=0)
        off = np.add.reduceat(apart, starts, axis=0) / count[:, None]
        product = np.add.reduceat(apart[:, i] * apart[:, j], starts, axis=0)
    product = product - off[:, i] * off[:, j] * count[:, None]
    mean = np.where(gaps, np.nan, mean + off)
    code = np.zeros(len(starts), np.int64) if codes is None else codes[order[starts]]
    return code, count, mean, np.where(gaps[:, i] | gaps[:, j], np.nan, product)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _stacked(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _grouped(columns: list[str]):
    """States for each group of about BLOCK_ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK_ROWS:
                yield from states(held)
                held, size = [], 0
        if size:
            yield from states(held)

    def states(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held).combine_chunks()
        keys = block.column("g").combine_chunks().dictionary_encode()
        x = np.column_stack([block.column(c).to_numpy() for c in columns]).astype(float)
        code, n, mean, product = block_states(x, keys.indices.to_numpy())
        out = pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code)), pa.array(n), _lists(mean), _lists(product)], ["g", "n", "mean", "product"])
        for at in range(0, len(out), 10_000):
            yield out.slice(at, 10_000)

    return run


class _Merged:
    """States by the columns they lack, merged as they come."""

    def __init__(self) -> None:
        self.parts: dict[bytes, list] = {}

    def add(self, n: np.ndarray, mean: np.ndarray, product: np.ndarray) -> None:
        lacks = np.packbits(np.isnan(mean), axis=1)
        for pattern in np.unique(lacks, axis=0):
            at = (lacks == pattern).all(axis=1)
            new = [n[at], mean[at], _square(product[at], mean.shape[1])]
            old = self.parts.get(pattern.tobytes())
            if old is not None:
                new = [np.concatenate(pair) for pair in zip((np.array([old.n]), old.mean[None], old.product[None]), new, strict=True)]
            self.parts[pattern.tobytes()] = merge(*new)

    def batch(self) -> pa.RecordBatch:
        states = list(self.parts.values())
        i, j = np.triu_indices(len(states[0].mean))
        return pa.RecordBatch.from_arrays(
            [pa.array([s.n for s in states]), _lists(np.array([s.mean for s in states])), _lists(np.array([s.product[i, j] for s in states]))], ["n", "mean", "product"]
        )


def _whole(columns: list[str]):
    """One state for each set of missing columns in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for batch in batches:
            if len(batch):
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
                merged.add(*block_states(x)[1:])
        if merged.parts:
            yield merged.batch()

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged = _Merged()
    for batch in batches:
        if len(batch):
            merged.add(batch.column("n").to_numpy(zero_copy_only=False), *(_stacked(batch.column(c), len(batch)) for c in ("mean", "product")))
    if merged.parts:
        yield merged.batch()


def _collected(states: DataFrame) -> list[State]:
    """States of all tasks, merged by MERGERS tasks first: what comes to the driver does not grow with their number."""
    table = states.repartition(MERGERS).mapInArrow(_together, KIND).toArrow()
    merged = _Merged()
    for batch in table.to_batches():
        if len(batch):
            merged.add(batch.column("n").to_numpy(zero_copy_only=False), *(_stacked(batch.column(c), len(batch)) for c in ("mean", "product")))
    return list(merged.parts.values())


def overall(frame: DataFrame) -> list[State]:
    """A state for each set of columns that rows of the numeric frame lack."""
    return _collected(frame.mapInArrow(_whole(frame.columns), KIND))


def complete(states: list[State], use: list[int]) -> State | None:
    """The state of the rows that have all the columns; None if there are none."""
    fit = [s.pick(use) for s in states if not np.isnan(s.mean[use]).any()]
    return merge(np.array([s.n for s in fit]), np.array([s.mean for s in fit]), np.array([s.product for s in fit])) if fit else None


class GroupStates:
    """States for each group, written once; every model of a grid is cut from them."""

    def __init__(self, keyed: DataFrame, local_rows: int = LOCAL_ROWS):
        """`keyed` has the group g and numeric columns."""
        columns = [c for c in keyed.columns if c != "g"]
        kind = keyed.schema["g"].dataType.simpleString()
        # A state is many times as large as a row, so a group's rows come together first; the rows of a large group may lie in several tasks.
        dealt = keyed.hint("rebalance", "g").sortWithinPartitions("g")
        self.table = runtime.stored(dealt.mapInArrow(_grouped(columns), f"g {kind}, {KIND}"), "states")
        self.states = _collected(self.table.select("n", "mean", "product"))
        self.size = self.table.count()
        self._local = self.table.toArrow().to_batches() if self.size <= local_rows else None

    def rows(self, use: list[int], centre: np.ndarray, scale: np.ndarray, make: Make, width: int) -> np.ndarray | DataFrame:
        """What `make` returns for the groups' cross-products of [1, (columns - centre) / scale] over their complete rows.

        `make` takes some groups at a time (groups x size x size) and returns rows
        of `width` numbers.  Few groups are worked on here, many where they are.
        """
        run = _by_group(use, centre, scale, make, width)
        if self._local is not None:
            keyed = pa.Table.from_batches(self._local, schema=self.table.limit(0).toArrow().schema).sort_by("g") if self._local else None
            parts = [_stacked(b.column("row"), len(b)) for b in run(iter(keyed.combine_chunks().to_batches()))] if keyed is not None else []
            return np.concatenate(parts) if parts else np.zeros((0, width))
        dealt = self.table.repartition("g").sortWithinPartitions("g")
        made = dealt.mapInArrow(run, "row array<double>")
        return made.select(*[F.col("row")[i].alias(f"r{i}") for i in range(width)])


def _by_group(use: list[int], centre: np.ndarray, scale: np.ndarray, make: Make, width: int):
    """Over states sorted by group, in pieces that end with a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, len(batch), GROUPS):
                held.append(batch.slice(at, GROUPS))
                size += len(held[-1])
                if size < GROUPS:
                    continue
                block = pa.Table.from_batches(held).combine_chunks()
                codes = _codes(block)
                last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
                if last:
                    yield from rows(block.slice(0, last), codes[:last])
                held, size = block.slice(last).to_batches(), len(block) - last
        if size:
            block = pa.Table.from_batches(held).combine_chunks()
            yield from rows(block, _codes(block))

    def rows(block: pa.Table, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = block.column("n").to_numpy()
        mean, product = (_stacked(block.column(c).combine_chunks(), len(block)) for c in ("mean", "product"))
        whole = ~np.isnan(mean[:, use]).any(axis=1)
        if not whole.any():
            return
        n, codes, k = n[whole], codes[whole], mean.shape[1]
        apart = (mean[whole][:, use] - centre) / scale
        sums = np.empty((len(n), len(use) + 1, len(use) + 1))
        sums[:, 0, 0] = n
        sums[:, 0, 1:] = sums[:, 1:, 0] = n[:, None] * apart
        inner = _square(product[whole], k)[:, use][:, :, use] / scale[:, None] / scale[None, :]
        sums[:, 1:, 1:] = inner + n[:, None, None] * apart[:, :, None] * apart[:, None, :]
        out = make(np.add.reduceat(sums, np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]), axis=0))
        yield pa.RecordBatch.from_arrays([_lists(out)], ["row"])

    return run


def _codes(block: pa.Table) -> np.ndarray:
    return block.column("g").combine_chunks().dictionary_encode().indices.to_numpy()


# A column counts as determined by those before it if it keeps less than this share of its sum of squares.
ALIASED = 1e-12
# Sum of squares of a constant, relative to its own size.
CONSTANT = 1e-26


def independent(state: State, columns: int) -> list[int]:
    """Those of the first columns that neither are constant nor follow from earlier ones, by elimination in their order."""
    own = np.diag(state.product)[:columns]
    size = state.n * state.mean[:columns] ** 2
    scale = np.where(own > CONSTANT * size, np.sqrt(np.where(own > 0, own, 1.0)), np.inf)
    left = state.product[:columns, :columns] / scale[:, None] / scale[None, :]
    kept = []
    for k in range(columns):
        if np.isfinite(scale[k]) and own[k] > 0 and left[k, k] > ALIASED:
            kept.append(k)
            left = left - np.outer(left[:, k], left[k]) / left[k, k]
    return kept
