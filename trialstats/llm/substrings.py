"""Substring dedup: suffix automata of reference shards, and matching statistics of the texts streamed past them.

A window is WINDOW consecutive words of one document.  A word goes if a window
over it has a word sequence that also starts earlier (smaller doc_id, or same
document and earlier).  Every document is both text and reference, so a
reference shard can't be sent to all texts: that work would grow with the
square of the corpus.  Instead texts are cut at minimizers so that equal windows
meet in the same shard, and each shard's automaton gets only what can match it.

1. The least hash among the GRAM-word sequences in a window is its minimizer.
   Consecutive windows with the same minimizer in the same place form a segment
   (at most 32 words).  Equal windows have equal minimizers.
2. Minimizers are counted, combined in each task first; segments whose minimizer
   occurs once hold no repeated window and go no further (a bitmap of fixed size
   keeps most of them from being written).  Minimizers with over 1/2**HOT_BITS
   of all occurrences are cut into single windows, which spreads them.
3. Segments with equal words (128-bit digest) form a class; all but its first
   have an earlier copy as a whole.  The first ones, where a minimizer has
   several classes, go to the shard of their minimizer in order of (document,
   start).  A shard bundles minimizers up to SHARD words, and its suffix
   automaton grows segment by segment: a segment is streamed for matching
   statistics, windows that match WINDOW words or more have an earlier copy, and
   then the segment is added.

Memory is bounded by SHARD words, one minimizer's classes, and one text.
Defined cases: null and empty texts have no words and keep nothing (digest of the
empty text); rows equal in doc_id and text count as one document; rows with the
same doc_id and other texts are ordered by the text's hash; a null doc_id comes
first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from trialstats.llm.bitmap import bitmap, marked
from trialstats.llm.store import partitions, stored
from trialstats.llm.words import Words, first_words, hash_words, mix, pieces, rolled, signed, words

WINDOW = 20
GRAM = 8
HOT_BITS = 14
COUNTED = 1 << 21
SHARD = 50_000


class Segments(NamedTuple):
    w: Words
    h: np.ndarray
    minimizer: np.ndarray
    first: np.ndarray  # first word
    windows: np.ndarray  # windows, so WINDOW - 1 words more


def segments(texts: pa.Array) -> Segments:
    w = words(texts)
    h = hash_words(w)
    n = len(h) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Segments(w, h, none.view(np.uint64), none, none)
    value = rolled(h, GRAM)
    place = np.arange(len(value))
    width, span = WINDOW - GRAM + 1, 1
    while span < width:  # leftmost least gram of ever wider stretches
        step = min(span, width - span)
        left = value[:-step] <= value[step:]
        place = np.where(left, place[:-step], place[step:])
        value = np.where(left, value[:-step], value[step:])
        span += step
    whole = np.flatnonzero(w.row[WINDOW - 1 :] == w.row[:n])
    if not len(whole):
        return Segments(w, h, none.view(np.uint64), none, none)
    new = np.r_[True, (place[whole][1:] != place[whole][:-1]) | (w.row[whole][1:] != w.row[whole][:-1])]
    at = np.flatnonzero(new)
    return Segments(w, h, mix(value[whole[at]]), whole[at], np.diff(np.r_[at, len(whole)]))


def digests(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words first..first + count."""
    out = []
    for odd, salt in ((0x9E3779B97F4A7C15, 0), (0xD6E8FEB86659FD93, 0xABCDEF)):
        inverse = pow(odd, -1, 1 << 64)
        n = len(h) + 1
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, odd, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum(mix(h + np.uint64(salt)) * down[:-1])]
        out.append(mix((total[first + count] - total[first]) * up[first] + count.astype(np.uint64)))
    return out[0], out[1]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def combined() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(count.astype(np.int64))], ["minimizer", "count"])

    for batch in batches:
        for piece in pieces(batch):
            held.append(segments(piece.column("text")).minimizer)
            size += len(held[-1])
            if size >= COUNTED:
                yield combined()
                held, size = [], 0
    if size:
        yield combined()


PLACES = "minimizer long, c1 long, c2 long, doc_id long, t long, start int, windows int"


def _cut(bits, hot, bodies: bool):
    """PLACES of the segments whose minimizer is in the bitmap, and if asked for their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = bits.value, hot.value
        for batch in batches:
            for piece in pieces(batch):
                s = segments(piece.column("text"))
                keep = np.flatnonzero(marked(known, signed(s.minimizer)))
                if not len(keep):
                    continue
                minimizer, first, windows = s.minimizer[keep], s.first[keep], s.windows[keep]
                if len(often):
                    at = np.minimum(np.searchsorted(often, minimizer), len(often) - 1)
                    single = often[at] == minimizer
                    each = np.where(single, windows, 1)
                    minimizer, first = np.repeat(minimizer, each), np.repeat(first, each)
                    nth = np.arange(len(first)) - np.repeat(np.cumsum(each) - each, each)
                    one = np.repeat(single, each)
                    first = first + np.where(one, nth, 0)
                    windows = np.where(one, 1, np.repeat(windows, each))
                c1, c2 = digests(s.h, first, windows + WINDOW - 1)
                if len(often):
                    minimizer = np.where(one, mix(minimizer ^ c1), minimizer)
                row = s.w.row[first]
                start = first - first_words(s.w)[row]
                low, high = s.w.start[first], s.w.end[first + windows + WINDOW - 2]
                rows = pa.array(row)
                columns = [pa.array(signed(minimizer)), pa.array(signed(c1)), pa.array(signed(c2)), piece.column("doc_id").take(rows), piece.column("t").take(rows), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))]
                names = ["minimizer", "c1", "c2", "doc_id", "t", "start", "windows"]
                if bodies:
                    data = s.w.data.tobytes()
                    columns.append(pa.array([data[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary()))
                    names.append("body")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


class Automaton:
    """Suffix automaton of several word sequences, added one after the other."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def matches(self, sequence: list[bytes]) -> list[int]:
        """Matching statistics: how many words up to each one occur together in what was added."""
        out, at, size = [], 0, 0
        for word in sequence:
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                size += 1
            out.append(size)
        return out

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state that `word` leads to from `at`, with exactly length[at] + 1 words."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word)
            last = new


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by (minimizer, document, start): runs of windows that an earlier segment holds."""
    shard, size, last = Automaton(), 0, None
    for batch in batches:
        out = []
        columns = (batch.column(k).to_pylist() for k in ("minimizer", "doc_id", "t", "start", "body"))
        for minimizer, doc, t, start, body in zip(*columns):
            if minimizer != last and size > SHARD:
                shard, size = Automaton(), 0
            last = minimizer
            sequence = body.split()
            run = None
            for end, length in enumerate(shard.matches(sequence)):
                if length >= WINDOW:
                    if run is None:
                        run = end - WINDOW + 1
                elif run is not None:
                    out.append((doc, t, start + run, end - WINDOW + 1 - run))
                    run = None
            if run is not None:
                out.append((doc, t, start + run, len(sequence) - WINDOW + 1 - run))
            shard.add(sequence)
            size += len(sequence)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "t", "start", "windows"])


def repeated_windows(plain: DataFrame) -> DataFrame:
    """(doc_id, t, start, windows): runs of windows with an earlier equal one.  `plain` has doc_id, t, text."""
    spark = plain.sparkSession
    counted = stored(plain.select("text").mapInArrow(_counts, "minimizer long, count long").groupBy("minimizer").agg(F.sum("count").alias("count")).where("count > 1"), "minimizers")
    total = counted.agg(F.sum("count")).first()[0] or 0
    # at most 2**HOT_BITS of them
    often = np.sort(np.array([r[0] for r in counted.where(F.col("count") > max(total >> HOT_BITS, WINDOW)).select("minimizer").collect()], np.int64).view(np.uint64))
    share = spark.sparkContext.broadcast
    cut = stored(plain.mapInArrow(_cut(share(bitmap(counted.select("minimizer"))), share(often), False), PLACES), "segments")
    place = F.struct("doc_id", "t", "start")
    classes = stored(cut.groupBy("c1", "c2", "minimizer").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "classes")
    again = cut.select("c1", "c2", "doc_id", "t", "start", "windows").join(classes.where("copies > 1").select("c1", "c2", "first"), ["c1", "c2"]).where(place != F.col("first"))
    several = stored(classes.groupBy("minimizer").agg(F.count("*").alias("classes")).where("classes > 1").select("minimizer"), "several")
    firsts = classes.join(several, "minimizer").select("c1", "c2", "first.*")
    # a second pass over the texts brings the words of these alone; windows of frequent minimizers are not among them
    bodies = plain.mapInArrow(_cut(share(bitmap(several)), share(often), True), f"{PLACES}, body binary")
    firsts = bodies.join(stored(firsts, "firsts"), ["c1", "c2", "doc_id", "t", "start"], "left_semi")
    ordered = firsts.repartition(partitions(spark), "minimizer").sortWithinPartitions("minimizer", "doc_id", "t", "start")
    first_runs = ordered.select("minimizer", "doc_id", "t", "start", "body").mapInArrow(_streamed, "doc_id long, t long, start int, windows int")
    return again.select("doc_id", "t", "start", "windows").unionAll(first_runs)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            w = words(piece.column("text"))
            at = first_words(w)
            data = w.data.tobytes()
            n, gone, kept, spans = [], [], [], piece.column("runs").to_pylist()
            for i in range(piece.num_rows):
                a, b = int(at[i]), int(at[i + 1])
                change = np.zeros(b - a + 1, np.int64)
                for run in spans[i] or ():
                    change[run["start"]] += 1
                    change[run["start"] + run["windows"] + WINDOW - 1] -= 1
                stay = a + np.flatnonzero(np.cumsum(change)[:-1] == 0)
                n.append(b - a)
                gone.append(b - a - len(stay))
                kept.append(b" ".join([data[x:y] for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist())]).decode())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by blanks."""
    low = F.lit(-(1 << 63))
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = plain.select(F.coalesce("id", low).alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    runs = stored(repeated_windows(plain).distinct(), "runs").groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    joined = plain.join(stored(runs, "lists"), ["doc_id", "t"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string").withColumn("doc_id", F.when(F.col("doc_id") != low, F.col("doc_id")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
