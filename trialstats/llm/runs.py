"""Runs: stretches of words that repeat with a period, found by the branching-tandem test on a suffix array.

A run is a stretch with smallest period q, at least max(LEAST, TIMES * q) words
long, that no neighbouring word extends.  Every run ends with one branching
square of its period: two equal neighbouring strings of q words at i and
i + q, whose suffixes agree in exactly q words.  They therefore lie in different
children of the interval of depth q of the LCP array.

For every LCP interval of depth q, the suffixes of all its children but the
largest are tested: is the suffix q words on (ISA[i + q]), or q words back
(ISA[i - q]), in the interval and in another child?  Each suffix is in a smaller
child at most log2(n) times.  A square found is rotated to the left as far as its
first word equals the one before it, a power of two at a time by the names that
prefix doubling gave to windows.  Squares that become the same stretch are one
run, with the least period among them.  Intervals are two numbers in the sorted
array (its nearest smaller values); no tree is built.

Texts are mapped where they lie, in pieces of about a megabyte, all arrays of a
piece at once; words of different texts never compare equal.  There is no
shuffle, and a lost task is repeated from its own rows.  Memory follows the
longest text: about 400 bytes for each of its words.

Defined cases: null and empty texts and texts of blanks have no words and no
runs; doc_id is not looked at, so rows without one or with the same one are like
any other; repeated rows give repeated rows; very long texts are never cut; an
empty table gives no rows; extra columns are passed on, and `detect` replaces
columns named like its own.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialstats.llm.words import first_words, hash_words, mix, pieces, words

LEAST = 24
TIMES = 3
WORD_GAPS = r"[ \t\n\x0B\f\r]+"


class Suffixes(NamedTuple):
    order: np.ndarray  # suffix array
    place: np.ndarray  # its inverse
    lcp: np.ndarray  # words that order[k - 1] and order[k] have in common; 0 for k = 0
    names: list[np.ndarray]  # names[k][i]: a number for the 2^k symbols from i on, equal for equal windows


def suffixes(symbols: np.ndarray) -> Suffixes:
    """Prefix doubling in which only suffixes that still tie are sorted again; the last symbol must be unique."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    name = np.empty(n, np.int64)
    name[order] = head
    split = np.where(new, 0, -1)  # the doubling step that told order[k - 1] and order[k] apart
    names = [name]
    step = 1
    active = _ties(new)
    while len(active):
        name = names[-1].copy()
        at = order[active]
        base = name[at]
        key = name[at + step]
        sort = np.lexsort((key, base))
        at, base, key = at[sort], base[sort], key[sort]
        order[active] = at
        fresh = np.r_[True, (base[1:] != base[:-1]) | (key[1:] != key[:-1])]
        begun = np.r_[True, base[1:] != base[:-1]]
        name[at] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        split[active[fresh & ~begun]] = len(names)
        names.append(name)
        step *= 2
        active = active[_ties(fresh)]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    for level in range(1, len(names)):
        pairs = np.flatnonzero(split == level)
        a, b = order[pairs - 1], order[pairs]
        common = np.zeros(len(pairs), np.int64)
        for k in range(level - 1, -1, -1):
            same = names[k][a + common] == names[k][b + common]
            common += same.astype(np.int64) << k
        lcp[pairs] = common
    return Suffixes(order, place, lcp, names)


def _ties(new: np.ndarray) -> np.ndarray:
    """Members of groups of two and more, given where groups begin."""
    return np.flatnonzero(~(new & np.r_[new[1:], True]))


def _nearest(lcp: np.ndarray, at: np.ndarray, back: bool, equal: bool) -> np.ndarray:
    """The nearest index before or after `at` with a smaller value (or an equal one too); there must be one.

    Steps by powers of two over tables of window minima.
    """
    n = len(lcp)
    tables = [lcp]
    while 2 << (len(tables) - 1) <= n:
        low, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(low[:-half], low[half:]))
    value = lcp[at] + (0 if not equal else 1)
    to = at.copy()
    for k in range(len(tables) - 1, -1, -1):
        size, table = 1 << k, tables[k]
        begin = to - size if back else to + 1
        fits = (begin >= 0) & (begin + size <= n)
        free = fits & (table[np.where(fits, begin, 0)] >= value)
        to = np.where(free, begin if back else to + size, to)
    return to - 1 if back else to + 1


def squares(s: Suffixes, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching squares whose period is at most longest[start]."""
    none = np.zeros(0, np.int64)
    marks = np.flatnonzero(s.lcp > 0)
    marks = marks[s.lcp[marks] <= longest[s.order[marks]]]
    if not len(marks):
        return none, none
    depth = s.lcp[marks]
    fence = np.r_[s.lcp, 0]  # a smaller value behind the last
    left = _nearest(fence, marks, True, False)
    right = _nearest(fence, marks, False, False)
    child = _nearest(fence, marks, True, True)  # the child before the mark begins here
    # boundaries of one interval follow each other in the order of (left, right); the last child ends it
    by = np.lexsort((marks, right, left))
    marks, depth, left, right, child = marks[by], depth[by], left[by], right[by], child[by]
    last = np.r_[(left[1:] != left[:-1]) | (right[1:] != right[:-1]), True]
    interval = np.r_[0, np.cumsum(last)[:-1]]
    begin, end = np.r_[child, marks[last]], np.r_[marks, right[last]]
    owner = np.r_[interval, interval[last]]
    size = end - begin
    # all children but the largest of each interval
    rank = np.lexsort((begin, -size, owner))
    largest = rank[np.r_[True, owner[rank][1:] != owner[rank][:-1]]]
    small = np.ones(len(size), bool)
    small[largest] = False
    begin, end, owner, size = begin[small], end[small], owner[small], size[small]
    low, high, q = left[last][owner], right[last][owner], depth[last][owner]
    if not len(size):
        return none, none
    each = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[each]
    i, q, low, high, begin, end = s.order[k], q[each], low[each], high[each], begin[each], end[each]
    found = []
    for other, start in ((i + q, i), (i - q, i - q)):
        there = (other >= 0) & (other < len(s.order))
        at = s.place[np.where(there, other, 0)]
        hit = there & (at >= low) & (at < high) & ((at < begin) | (at >= end))
        found.append((start[hit], q[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def rotated(s: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far the squares can be moved to the left, one equal word after the other."""
    at = start.copy()
    for k in range(len(s.names) - 1, -1, -1):
        size, name = 1 << k, s.names[k]
        fits = at >= size
        back = np.where(fits, at - size, 0)
        at = np.where(fits & (name[back] == name[back + period]), back, at)
    return at


def runs(symbols: np.ndarray, row: np.ndarray, count: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period.

    `symbols` are the words of all texts of a piece, each text followed by a
    symbol that occurs once; row is the text of each, count its words.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < max(least, times):
        return none, none, none
    s = suffixes(symbols)
    start, period = squares(s, count[row] // times)
    end = start + 2 * period
    start = rotated(s, start, period)
    keep = end - start >= np.maximum(least, times * period)
    start, end, period = start[keep], end[keep], period[keep]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _text_runs(texts: pa.Array, least: int, times: int) -> tuple[list[int], list[list[dict]], list[str]]:
    """Words, runs and the text without repeats, of each text."""
    w = words(texts)
    at = first_words(w)
    count = np.diff(at)
    n = len(count)
    # a symbol of its own after each text; words of different texts differ
    place = np.arange(len(w.row)) + w.row
    row = np.repeat(np.arange(n), count + 1)
    symbols = np.empty(len(w.row) + n, np.uint64)
    symbols[place] = mix(hash_words(w) + (w.row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    begin = at[:-1] + np.arange(n)
    symbols[begin + count] = (np.uint64(1) << np.uint64(63)) + np.arange(n, dtype=np.uint64)
    start, end, period = runs(symbols, row, count, least, times)
    owner = row[start]
    found: list[list[dict]] = [[] for _ in range(n)]
    gone: dict[int, np.ndarray] = {}
    for r, a, b, q in zip(owner.tolist(), (start - begin[owner]).tolist(), (end - begin[owner]).tolist(), period.tolist()):
        found[r].append({"start": a, "length": b - a, "period": q})
        gone.setdefault(r, np.zeros(count[r], bool))[a + q : b] = True
    data = w.data.tobytes()
    left = []
    for r, (a, b) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist())):
        own = data[a:b].split()
        if r in gone:
            own = [own[k] for k in np.flatnonzero(~gone[r]).tolist()]
        left.append(b" ".join(own).decode("utf-8"))
    return count.tolist(), found, left


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def detect(docs: DataFrame, column: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The table with n_words, runs (start, length and period, by start and period) and collapsed,
    the text without the repeats: what a run holds after its first period is dropped."""
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                n, found, left = _text_runs(piece.column(column), least, times)
                own = [pa.array(n, pa.int64()), pa.array(found, RUNS), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + own, [*kept, "n_words", "runs", "collapsed"])

    return docs.select(*kept).mapInArrow(found, f"{kinds}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or in a tenth of all documents one whose words repeat with a period from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    own = F.filter(F.split(text, WORD_GAPS), lambda x: x != "")

    def repeat(state: Column) -> Column:
        n = F.size(state["own"])
        a = (state["g"] % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + state["g"] % 8))).cast("int")
        return F.transform(state["own"], lambda word, i: F.when(i < a, word).otherwise(F.get(state["own"], a + (i - a) % p)))

    # the words are split once: a lambda's argument is a value
    of = F.transform(F.array(F.struct(own.alias("own"), F.floor(h / 10).alias("g"))), repeat)
    return F.when((h % 10 == 0) & text.rlike(r"[^ \t\n\x0B\f\r]"), F.array_join(of[0], " ")).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every text, a tenth of the texts made periodic first."""
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), planted(F.col("doc_id"), F.col("text")).alias("text")))
    # exact: lengths and periods are compared as fractions
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda top, r: F.when(top.isNull() | better(r, top), r).otherwise(top))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") == 0, F.lit("")).otherwise(F.concat(listed, F.lit("\n"))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
