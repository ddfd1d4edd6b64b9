"""Sums over many groups for linear models with a random slope.

A group enters a model through Z'[1 X y] alone, of which Z'Z is a part: the sums
of the columns and their products with the slope.  Models that are complete in
the same rows share the sums, and those with the same slope its products, so one
row of numbers for each group serves a whole grid.  Rows of different tasks add
up.  They are written once, some thousand groups to a block, and each round of
the models' searches is one job over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialstats.models.moments import GROUPS, MERGERS, _codes, _lists, _square, _stacked, complete

# Bytes of rows that one task holds to be worked on.
TASK_BYTES = 64_000_000
# Up to this many tasks their sums are added on the driver.
FEW_TASKS = 64


class Shares:
    """Models that are complete in the same rows: their columns, what standardises them and their slopes."""

    def __init__(self, models: list, rows, start: int):
        self.columns = sorted({c for m in models for c in m.needed})
        state = complete(rows.groups.states, self.columns)
        self.centre, self.scale = state.mean.copy(), np.ones(len(self.columns))
        for m in models:  # columns that take part have the same mean and spread in all of them
            at = [self.columns.index(c) for c in m.use]
            self.centre[at], self.scale[at] = m.mean, m.spread
        self.slopes = sorted({m.use[m.slope - 1] for m in models})
        self.start, self.size = start, 1 + len(self.columns)
        self.end = start + self.size * (1 + len(self.slopes))

    def places(self, model) -> tuple[list[int], list[int]]:
        """Where a row has the sums of the model's [1, X, y], and their products with its slope."""
        own = np.array([0, *[1 + self.columns.index(c) for c in model.use]])
        return (self.start + own).tolist(), (self.start + self.size * (1 + self.slopes.index(model.use[model.slope - 1])) + own).tolist()

    def plain(self) -> tuple:
        return self.columns, self.centre, self.scale, [self.columns.index(c) for c in self.slopes]


def _shared(models: list, rows) -> tuple[list[Shares], list[int]]:
    """The shares, and which one each model belongs to."""
    sets = [tuple(k for k, s in enumerate(rows.groups.states) if not np.isnan(s.mean[m.needed]).any()) for m in models]
    kinds = list(dict.fromkeys(sets))
    shares, start = [], 0
    for kind in kinds:
        shares.append(Shares([m for m, own in zip(models, sets, strict=True) if own == kind], rows, start))
        start = shares[-1].end
    return shares, [kinds.index(own) for own in sets]


def slope_rows(models: list, rows) -> tuple[DataFrame, str]:
    """Blocks of the groups' rows, to be written, and a name for them."""
    shares, _ = _shared(models, rows)
    width = shares[-1].end
    table = rows.groups.table
    kind = table.schema["g"].dataType.simpleString()
    # Set and not left to adaptive execution, which would join a few megabytes into one task.
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-rows.groups.size * width * 8 // TASK_BYTES))
    cut = table.mapInArrow(_cut([s.plain() for s in shares], width), f"g {kind}, row array<double>")
    return cut.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_blocks, "block binary"), "slopes"


def _cut(shares: list[tuple], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), GROUPS):
                part = batch.slice(at, GROUPS)
                n = part.column("n").to_numpy(zero_copy_only=False)
                mean, product = (_stacked(part.column(c), len(part)) for c in ("mean", "product"))
                product = _square(product, mean.shape[1])
                row = np.concatenate([sums(n, mean, product, *s) for s in shares], axis=1)
                assert row.shape[1] == width
                yield pa.RecordBatch.from_arrays([part.column("g"), _lists(row)], ["g", "row"])

    def sums(n, mean, product, columns, centre, scale, slopes) -> np.ndarray:
        apart = (mean[:, columns] - centre) / scale
        rows = [np.column_stack([n, n[:, None] * apart])]
        for k in slopes:
            inner = product[:, columns[k]][:, columns] / scale[k] / scale
            rows.append(np.column_stack([n * apart[:, k], inner + n[:, None] * apart[:, [k]] * apart]))
        out = np.concatenate(rows, axis=1)
        out[np.isnan(mean[:, columns]).any(axis=1)] = 0.0
        return out

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each group's rows, which come one after the other, some thousand groups at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block(part: pa.Table, codes: np.ndarray) -> pa.RecordBatch:
        row = _stacked(part.column("row").combine_chunks(), len(part))
        found = np.add.reduceat(row, np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["block"])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < GROUPS:
            continue
        part = pa.Table.from_batches(held).combine_chunks()
        codes = _codes(part)
        last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
        if last:
            yield block(part.slice(0, last), codes[:last])
        held, size = part.slice(last).to_batches(), len(part) - last
    if size:
        part = pa.Table.from_batches(held).combine_chunks()
        yield block(part, _codes(part))


class SlopeSums:
    """Sums over the blocks, for any of the models at any of their covariance factors."""

    def __init__(self, table: DataFrame, models: list, rows):
        shares, of = _shared(models, rows)
        self.table, self.width = table, shares[-1].end
        self.places = [shares[k].places(m) for k, m in zip(of, models, strict=True)]
        self.slopes = [m.slope for m in models]
        self.groups: dict[int, int] = {}

    def corrections(self, asked: dict[int, list[np.ndarray]]) -> dict[int, list[tuple[float, np.ndarray]]]:
        """For each relative covariance factor L of each model: the log-determinant of I + L'Z'ZL summed
        over groups, and the part of the cross-products explained by the groups."""
        task = _sums({k: (*self.places[k], self.slopes[k], factors) for k, factors in asked.items()}, self.width)
        made = self.table.mapInArrow(task, "model int, sums array<double>")
        if made.rdd.getNumPartitions() > FEW_TASKS:
            made = made.repartition(MERGERS).mapInArrow(_added, "model int, sums array<double>")
        total: dict[int, np.ndarray] = {}
        _add(total, made.toArrow().to_batches())
        out = {}
        for k, factors in asked.items():
            width = len(self.places[k][0])
            self.groups[k] = int(round(total[k][0]))
            found = []
            for flat in total[k][1:].reshape(len(factors), -1):
                square = np.empty((width, width))
                i, j = np.triu_indices(width)
                square[i, j] = square[j, i] = flat[1:]
                found.append((float(flat[0]), square))
            out[k] = found
        return out


def _add(total: dict[int, np.ndarray], batches) -> None:
    for batch in batches:
        for k, sums in zip(batch.column("model").to_pylist(), batch.column("sums"), strict=True):
            own = sums.values.to_numpy(zero_copy_only=False)
            total[k] = total[k] + own if k in total else own.copy()


def _rows(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), _lists(own[None])], ["model", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    _add(total, batches)
    yield from _rows(total)


def _sums(asked: dict[int, tuple], width: int):
    """The per-partition function; closes over plain data only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in batch.column("block"):
                rows = np.frombuffer(block.as_buffer(), float).reshape(-1, width)
                for k, own in asked.items():
                    found = sums(rows, *own)
                    total[k] = total[k] + found if k in total else found
        yield from _rows(total)

    def sums(rows: np.ndarray, plain: list[int], sloped: list[int], slope: int, factors) -> np.ndarray:
        one, two = np.ascontiguousarray(rows[:, plain].T), np.ascontiguousarray(rows[:, sloped].T)
        n, b, c = one[0], one[slope], two[slope]
        i, j = np.triu_indices(len(plain))
        products = [one[i] * one[j], one[i] * two[j] + one[j] * two[i], two[i] * two[j]]
        logdet, weights = [], [[], [], []]
        for f in factors:
            (l0, _), (l1, l2) = f
            a00, a01, a11 = 1 + n * l0 * l0 + 2 * b * l0 * l1 + c * l1 * l1, b * l0 * l2 + c * l1 * l2, 1 + c * l2 * l2
            det = a00 * a11 - a01 * a01
            logdet.append(np.log(det).sum())
            weights[0].append(l0 * l0 * a11 / det)
            weights[1].append((l0 * l1 * a11 - l0 * l2 * a01) / det)
            weights[2].append((l1 * l1 * a11 - 2 * l1 * l2 * a01 + l2 * l2 * a00) / det)
        explained = sum(np.array(w) @ p.T for w, p in zip(weights, products, strict=True))
        return np.concatenate([[np.count_nonzero(n)], np.column_stack([logdet, explained]).ravel()])

    return run
