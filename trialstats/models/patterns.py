"""Rows of logistic mixed models in blocks that serve every model of a grid.

A block holds some complete groups, or a piece of groups that are spread over
tasks.  Columns that are constant within its groups are kept once for each group;
rows of a group that agree in the others that a model has are merged.  Models
that differ only in constant columns share the merged rows.  Numbers are kept as
places in a table of those that occur.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trialstats.models.laplace import Groups
from trialstats.models.moments import KIND, _lists

SCHEMA = f"hot boolean, block binary, {KIND}"


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur, and the place of each value among them."""
    table, codes = np.unique(values, return_inverse=True)
    return table, codes.astype(np.min_scalar_type(max(len(table) - 1, 0)))


def _merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows that brings equal keys together, and where each run of equal ones begins."""
    key, size = keys[0].astype(np.int64), int(keys[0].max()) + 1
    for code in keys[1:]:
        width = int(code.max()) + 1
        if size > 2**62 // width:
            table, key = np.unique(key, return_inverse=True)
            size = len(table)
        key, size = key * width + code, size * width
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _states(x: np.ndarray, m: np.ndarray, s: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Trials, means and centred products of the columns and the share of successes, for each set of missing columns."""
    missing = np.isnan(x)
    lacks, of = np.unique(np.packbits(missing, axis=0), axis=1, return_inverse=True)
    values = np.vstack([np.where(missing, 0.0, x), s / m])
    i, j = np.triu_indices(len(values))
    for k in range(lacks.shape[1]):
        at = np.flatnonzero(of.reshape(-1) == k)
        own, weight = values[:, at], m[at]
        n = weight.sum()
        mean = own @ weight / n
        apart = own - mean[:, None]
        off = apart @ weight / n
        product = (apart * weight) @ apart.T - np.outer(off, off) * n
        gap = np.append(missing[:, at[0]], False)
        yield n, np.where(gap, np.nan, mean + off), np.where(gap[i] | gap[j], np.nan, product[i, j])


def blocks(columns: list[str], models: list[list[int]], chunk_rows: int):
    """Blocks and the states of their rows, from rows sorted by ``hot`` and ``g``; ``models`` has the columns of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, chunk_rows):
            hot = chunk.column("hot").to_numpy()
            codes = _group_codes(chunk)
            x = np.array([chunk.column(c).to_numpy() for c in columns], dtype=float).reshape(len(columns), len(chunk))
            m, s = chunk.column("m").to_numpy(), chunk.column("s").to_numpy()
            yield _batch([bool(hot[0] >= 0)], [pickle.dumps(_block(x, m, s, codes, hot, models), protocol=5)], [None], None, None)
            found = list(_states(x, m, s))
            yield _batch([None] * len(found), [None] * len(found), [n for n, _, _ in found], np.array([mean for _, mean, _ in found]), np.array([product for _, _, product in found]))

    return run


def _batch(hot: list, block: list, n: list, mean: np.ndarray | None, product: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(block), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(hot, pa.bool_()), pa.array(block, pa.binary()), pa.array(n, pa.float64()), none if mean is None else _lists(mean), none if product is None else _lists(product)],
        ["hot", "block", "n", "mean", "product"],
    )


def _group_codes(chunk: pa.Table) -> np.ndarray:
    """Number of each row's group; groups lie together."""
    keys = chunk.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
    return np.cumsum(np.r_[0, keys[1:] != keys[:-1]])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The partition in pieces of about ``rows`` rows that end with a group; those of spread-out groups (hot >= 0) may be cut anywhere."""
    held: list[pa.RecordBatch] = []
    size = 0

    def pieces(chunk: pa.Table, whole: bool) -> tuple[list[pa.Table], pa.Table]:
        """What can go, and what waits for the rest of its group."""
        cold = int((chunk.column("hot").to_numpy() < 0).sum())
        codes = _group_codes(chunk)
        out, at = [], 0
        ends = np.append(np.flatnonzero(codes[1:cold] != codes[: cold - 1]) + 1, cold) if cold else np.zeros(0, int)
        if not whole and cold == len(chunk):
            ends = ends[:-1]
        for k, end in enumerate(ends):
            if end - at >= rows or k == len(ends) - 1:
                out.append(chunk.slice(at, end - at))
                at = int(end)
        if cold < len(chunk):
            for at in range(cold, len(chunk), rows):
                out.append(chunk.slice(at, min(rows, len(chunk) - at)))
            at = len(chunk)
        return out, chunk.slice(at)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        out, rest = pieces(pa.Table.from_batches(held).combine_chunks(), False)
        yield from out
        held, size = rest.to_batches(), len(rest)
    if size:
        yield from pieces(pa.Table.from_batches(held).combine_chunks(), True)[0]


def _block(x: np.ndarray, m: np.ndarray, s: np.ndarray, codes: np.ndarray, hot: np.ndarray, models: list[list[int]]) -> dict:
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    first = x[:, starts]
    like = first[:, codes]
    constant = ((x == like) | (np.isnan(x) & np.isnan(like))).all(axis=1)
    # A column that lacks values has their place among the others; its rows are not used by models that have it.
    packed = {c: _packed(x[c]) for c in np.flatnonzero(~constant).tolist()}
    missing = np.isnan(x)
    sets: dict[tuple, int] = {}
    made, of = [], []
    for own in models:
        varying = tuple(c for c in own if not constant[c])
        gone = missing[own].any(axis=0)
        key = (varying, gone.tobytes() if gone.any() else None)
        if key not in sets:
            sets[key] = len(made)
            made.append(_set(np.flatnonzero(~gone), varying, codes, packed, m, s))
        of.append(sets[key])
    return {"hot": hot[starts] if hot[0] >= 0 else None, "constant": {c: first[c] for c in np.flatnonzero(constant).tolist()}, "sets": made, "of": of}


def _set(rows: np.ndarray, varying: tuple[int, ...], codes: np.ndarray, packed: dict, m: np.ndarray, s: np.ndarray) -> dict | None:
    if not len(rows):
        return None
    order, starts = _merged([codes[rows], *[packed[c][1][rows] for c in varying]])
    at = rows[order[starts]]
    groups, counts = np.unique(codes[at], return_counts=True)
    return {
        "groups": groups.astype(np.int32),
        "counts": counts.astype(np.int32),
        "m": _packed(np.add.reduceat(m[rows[order]], starts)),
        "s": _packed(np.add.reduceat(s[rows[order]], starts)),
        "columns": {c: (packed[c][0], packed[c][1][at]) for c in varying},
    }


def opened(block: dict, model: int, columns: list[int], mean: np.ndarray, spread: np.ndarray, slope: int | None) -> tuple[Groups, np.ndarray] | None:
    """The groups of a model, predictors standardised and the intercept first, and their places in the block; None without rows."""
    own = block["sets"][block["of"][model]]
    if own is None:
        return None
    (tm, cm), (ts, cs) = own["m"], own["s"]
    counts = own["counts"]
    constant, constant_at, free, free_at, z = [np.ones(len(counts))], [0], [], [], None
    for k, c in enumerate(columns):
        if c in own["columns"]:
            table, codes = own["columns"][c]
            values = ((table - mean[k]) / spread[k])[codes]
            if k + 1 != slope:
                free.append(values)
                free_at.append(k + 1)
        else:
            values = (block["constant"][c][own["groups"]] - mean[k]) / spread[k]
            if k + 1 != slope:
                constant.append(values)
                constant_at.append(k + 1)
            else:
                values = np.repeat(values, counts)
        if k + 1 == slope:
            z = values
    rows = np.array(free).reshape(len(free), len(cm))
    return Groups(np.array(constant), constant_at, rows, free_at, z, slope, tm[cm], ts[cs], counts), own["groups"]
