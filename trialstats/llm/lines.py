"""Line dedup: near-equal lines by MinHash, exact checks, and one line kept of each component.

Lines are cut at line feeds and trimmed; blank lines stay.  Equal lines are one
(by a 64-bit hash); a line is the set of its sequences of SHINGLE characters (a
shorter line is one shingle).  Its signature has BANDS x ROWS places, filled in
rounds: in each round every shingle takes part with a value in one place drawn
for it, later rounds with larger values, until no place is empty; the last rounds
go through the places in turn (fast similarity sketching, Dahlgaard et al. 2017).
A place holds the least value drawn for it, so two lines agree there with a
chance that is their Jaccard similarity.  It is one scheme for all lengths: a
long line needs one round or two, a short one more, and what a round adds never
changes what an earlier one filled.  At a similarity of 0.75 two lines meet in a
band with a chance of 0.989, and all meet again by one bit for each place, the
sketch: candidates whose sketches differ in more than APART bits (3 standard
deviations for a pair at 0.75) are not compared.

Lines that meet in a band are candidates.  A task sends its bands' rows in blocks,
each for a range of bands; the tasks that read them hold one range at a time.  The
lines' places go with them: by id the first that a task has of a line, so that a line
in all documents is a row for each task; every other place of it is a repeat.  First,
in a band of at most ALL lines all candidates are compared, in a larger one each line
with the least line of its band and with its neighbour there; what these exact
comparisons link forms components.  Then, in larger bands where several components are
left, every line that has a candidate in another component is taken with its text to
one task for the band, which compares across components until they are joined; no pair
is sent anywhere.  A band of more than CROWD lines is dealt in blocks of about CROWD,
and every two blocks that can hold two components meet in a task of their own, so
that all its candidates are compared there as well: the work grows with the square
of the lines that are not of its largest components.  The links of the first round and
then those between its components go through a distributed union-find, and the line that comes first (by doc_id and line number)
stays of each component.  Intermediate tables are deleted when the last step that
reads them is written.

Defined cases: null and empty texts have no lines and stay as they are; very long
texts and lines are worked on whole; rows equal in doc_id and text count as one
document; a null doc_id comes first; equal lines at one place cannot be, so there
are no ties; an empty table gives no rows; extra columns pass through
`deduplicated`, which uses none of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from trialstats.llm.bitmap import bitmap, marked, parted
from trialstats.llm.blocks import BUCKETS, HELD, SCHEMA, buckets, dealt, filled, packed
from trialstats.llm.components import components
from trialstats.llm.store import lasting, partitions, passing, stored
from trialstats.llm.words import SPACE, hashed, pieces, raw

SHINGLE = 5
BANDS, ROWS = 12, 4
PLACES = BANDS * ROWS
# a pair at 0.75 differs in 6 of 48 bits on average, with a standard deviation of 2.3
APART = 13
CROWD = 4096
# bands of so many lines are compared side by side
FEW = 24
# in bands of so many lines all candidates are pairs at once
ALL = 6
# bytes of text worked on at a time: arrays of eight bytes for each stay in a processor's cache
STRETCH = 1 << 17
SEEN = 1 << 20
# bytes of lines that are compared at a time
TOGETHER = 1 << 20
LOW = -(1 << 63)


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, then (row, number, first byte, byte after) of every line that isn't blank, trimmed."""
    data, offsets = raw(texts)
    feed = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], feed + 1)
    begin = begin[begin < len(data)]
    end = np.r_[begin[1:], len(data)]
    row = np.searchsorted(offsets, begin, "right") - 1
    feeds = np.searchsorted(feed, begin) - np.searchsorted(feed, offsets[:-1])[row]
    # a line feed between two lines belongs to neither; the end of a text may have none
    if len(begin):
        begin, end = _trimmed(data, begin, end)
    keep = end > begin
    return data, row[keep], feeds[keep], begin[keep], end[keep]


def _trimmed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch begins and ends without the blanks around it."""
    begin, end = begin.copy(), end.copy()
    for _ in range(4):  # as many as most lines have
        end -= (end > begin) & SPACE[data[end - 1]]
        begin += (end > begin) & SPACE[data[np.minimum(begin, len(data) - 1)]]
    more = np.flatnonzero((end > begin) & (SPACE[data[end - 1]] | SPACE[data[np.minimum(begin, len(data) - 1)]]))
    if len(more):
        inside = np.flatnonzero(~SPACE[data])
        low, high = np.searchsorted(inside, begin[more]), np.searchsorted(inside, end[more])
        some = high > low
        end[more[~some]] = begin[more[~some]]
        begin[more[some]], end[more[some]] = inside[low[some]], inside[high[some] - 1] + 1
    return begin, end


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """`words.mix` in place."""
    shifted = x >> np.uint64(30)
    x ^= shifted
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=shifted)
    x ^= shifted
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=shifted)
    x ^= shifted
    return x


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, zeros after the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))


def line_ids(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line: the sum of its words of eight bytes, each mixed with its place.

    All words of all lines at once, so that one long line costs no more than many short ones."""
    if not len(a):
        return np.zeros(0, np.int64)
    size = b - a
    count = (size + 7) >> 3
    ends = np.cumsum(count)
    nth = np.arange(ends[-1]) - np.repeat(ends - count, count)
    word = _eight(data)[np.repeat(a, count) + (nth << 3)]
    word[ends - 1] &= _BYTES[size - ((count - 1) << 3)]
    word += (nth + 1).view(np.uint64) * _ODD
    total = np.add.reduceat(_mix(word), ends - count)
    return _mix(total ^ (size.astype(np.uint64) * _ODD)).view(np.int64)


_EMPTY = np.iinfo(np.uint32).max
_STEP = np.uint64(0xD6E8FEB86659FD93)


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the SHINGLE characters from each character on (of what follows, near the end), and the places of the
    bytes that begin no character."""
    rest = np.flatnonzero((data & 0xC0) == 0x80)
    if not len(rest):
        return _mix(_eight(data)[:-1] & _BYTES[SHINGLE]), rest
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # up to 255 a character is a byte here; sequences with others get a hash of their code points
    h = _eight(points.astype(np.uint8))[:-1] & _BYTES[SHINGLE]
    large = points > 255
    if large.any():
        near = large.copy()
        for k in range(1, SHINGLE):
            near[:-k] |= large[k:]
        at = np.flatnonzero(near)
        own = np.zeros(len(at), np.uint64)
        points = np.concatenate([points, np.zeros(SHINGLE - 1, np.uint32)])
        for k in range(SHINGLE):
            own *= _ODD
            own += points[at + k]
        h[at] = own | np.uint64(1 << 63)
    return _mix(h), rest


def shingles_of(data: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all lines (in the order of their places) one after the other, and where each line's begin (and the end)."""
    every, rest = characters(data)
    begin, end = (a - np.searchsorted(rest, a), b - np.searchsorted(rest, b)) if len(rest) else (a, b)
    count = np.maximum(end - begin - SHINGLE + 1, 1)
    inside = np.zeros(len(every) + 1, np.int8)
    inside[begin] = 1
    np.subtract.at(inside, begin + count, 1)
    out = every[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    starts = np.r_[0, np.cumsum(count)]
    short = np.flatnonzero(end - begin < SHINGLE)
    out[starts[short]] = _mix(ids[short].view(np.uint64).copy())
    return out, starts


_TURNS = np.arange(2 * PLACES, dtype=np.uint64) * _STEP


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """PLACES values for each line."""
    n = len(starts) - 1
    out = np.full((n, PLACES), _EMPTY, np.uint32)
    flat = out.reshape(-1)
    active = np.arange(n)
    for turn in range(2 * PLACES):
        count = starts[active + 1] - starts[active]
        ends = np.cumsum(count)
        at = shingles if len(active) == n else shingles[np.arange(ends[-1]) - np.repeat(ends - count - starts[active], count)]
        drawn = _mix(at + _TURNS[turn]) if turn else at
        value = (drawn & np.uint64((1 << 25) - 1)).astype(np.uint32) | np.uint32(turn << 25)
        place = ((drawn >> np.uint64(32)) * np.uint64(PLACES) >> np.uint64(32)).astype(np.int64) if turn < PLACES else turn - PLACES
        np.minimum.at(flat, np.repeat(active * PLACES, count) + place, value)
        active = active[(out[active] == _EMPTY).any(axis=1)]
        if not len(active):
            break
    return out


_SALT = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019)


def bands_of(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each band of each line, and the line's sketch."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(_SALT, (len(signature), BANDS)).copy()
    for k in range(ROWS):
        keys = _mix(keys ^ parts[:, :, k])
    bits = (signature & 1).astype(np.int64) << np.arange(PLACES)
    return keys.view(np.int64), bits.sum(axis=1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, id, sketch) of the lines of a task, each signed once (but for more than SEEN of them); of texts that have
    a doc_id and t also (id, doc_id, t, line_no) of every line."""
    seen: set[int] = set()
    for batch in batches:
        for piece in pieces(batch, limit=STRETCH):
            data, row, number, a, b = lines(piece.column("text"))
            ids = line_ids(data, a, b)
            if "doc_id" in piece.schema.names:
                doc, t = (piece.column(k).to_numpy()[row] for k in ("doc_id", "t"))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, doc, t, number.astype(np.int64)))], ["id", "doc_id", "t", "line_no"])
            ids, first = np.unique(ids, return_index=True)
            own = ids.tolist()
            new = np.fromiter((k not in seen for k in own), bool, len(own))
            ids, first = ids[new], first[new]
            if not len(ids):
                continue
            if len(seen) < SEEN:
                seen.update(own)
            order = np.argsort(first)
            ids, first = ids[order], first[order]
            keys, sketch = bands_of(signatures(*shingles_of(data, a[first], b[first], ids)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(sketch, BANDS))], ["band", "id", "sketch"])


def _blocked(bands, spread: int):
    """The rows of `bands` in blocks, a bucket being a range of bands; most bands have one line.

    Places of lines have `spread` buckets more, by id, and as many for those of repeats, by document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in bands(batches):
            if "line_no" in batch.schema.names:
                held.append(np.stack(batch.columns, axis=1))
                size += len(batch)
                if size >= HELD:
                    yield from placed(np.concatenate(held))
                    held, size = [], 0
            else:
                own = np.stack([batch.column(k).to_numpy() for k in ("band", "id", "sketch")], axis=1)
                yield buckets(own[:, 0], spread), own
        if held:
            yield from placed(np.concatenate(held))

    def placed(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # a line's first place here; the others go, wherever its very first is
        places, first = _first_places(places)
        yield buckets(places[first, 0], spread) + np.uint64(spread), places[first]
        again = np.ascontiguousarray(places[~first, 1:])
        yield buckets(_mix(again[:, 1].view(np.uint64) ^ again[:, 0].view(np.uint64) * _ODD), spread) + np.uint64(2 * spread), again

    return lambda batches: packed(rows(batches))


def _first_places(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (id, doc_id, t, line_no) sorted, each once, and which of them are the first of their id."""
    places = places[np.lexsort(places.T[::-1])]
    places = places[np.r_[True, (places[1:] != places[:-1]).any(axis=1)][: len(places)]]
    return places, np.r_[True, places[1:, 0] != places[:-1, 0]][: len(places)]


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= APART


MET = "band long, id long, sketch long, n long, other long, doc_id long, t long, line_no int"


def _met(spread: int):
    """Of blocks sorted by bucket: (id, other) to be compared, and (band, id, sketch, n) of the lines of a band of
    n > ALL that have to be compared with more than these; (id, doc_id, t, line_no) of each line's first place, and
    without id the places of its repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, values in filled(batches):
            if bucket < spread:
                yield _filled_up(_of_bucket(values.reshape(-1, 3)))
            elif bucket < 2 * spread:
                places, first = _first_places(values.reshape(-1, 4))
                yield _of_places(places[:, 1:], pa.array(places[:, 0], mask=~first))
            else:
                yield _of_places(values.reshape(-1, 3), pa.nulls(len(values) // 3, pa.int64()))

    return run


def _filled_up(rows: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([*rows.columns, none, none, none.cast(pa.int32())], [*rows.schema.names, "doc_id", "t", "line_no"])


def _of_places(rows: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    none, (doc, t, number) = pa.nulls(len(rows), pa.int64()), np.ascontiguousarray(rows.T)
    columns = [none, ids, none, none, none, pa.array(doc), pa.array(t), pa.array(number.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["band", "id", "sketch", "n", "other", "doc_id", "t", "line_no"])


def _of_bucket(rows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(rows[:, 0])
    band = rows[order, 0]
    same = band[1:] == band[:-1]
    rows = rows[order[np.r_[False, same] | np.r_[same, False]]]
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # a line that several tasks signed
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)]]
    band, ids, sketch = np.ascontiguousarray(rows.T)
    start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]][: len(band)])
    size = np.diff(np.r_[start, len(band)])
    first, n = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(band)) - first
    # each line with those before it; in larger bands with the least and the one before
    left, right = [], []
    for back in range(1, ALL):
        at = np.flatnonzero((place >= back) & ((n <= ALL) | (back == 1)))
        left.append(at)
        right.append(at - back)
    at = np.flatnonzero((n > ALL) & (place > 1))
    left, right = np.concatenate([*left, at]), np.concatenate([*right, first[at]])
    hit = _close(sketch[left], sketch[right])
    a, b = ids[left[hit]], ids[right[hit]]
    # of a band that is compared whole later, only lines with a candidate
    many = n > CROWD
    small = np.flatnonzero((n > ALL) & ~many)
    if len(small):
        for i, j in _across(band[small], sketch[small], ids[small]):
            many[small[i]] = many[small[j]] = True
    columns = [np.r_[np.zeros(len(a), np.int64), band[many]], np.r_[a, ids[many]], np.r_[np.zeros(len(a), np.int64), sketch[many]], np.r_[np.zeros(len(a), np.int64), n[many]]]
    other = pa.concat_arrays([pa.array(b), pa.nulls(int(many.sum()), pa.int64())])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), other], ["band", "id", "sketch", "n", "other"])


def alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Of two sorted sets."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    every = np.concatenate((x, y))
    every.sort()
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both >= threshold * (len(x) + len(y) - both)


def line_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each line, sorted; made for all lines at once."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    a = np.r_[0, ends[:-1]]
    ids = np.zeros(len(texts), np.int64)
    short = np.flatnonzero(ends - a < 4 * SHINGLE)  # only lines below SHINGLE characters need theirs
    ids[short] = hashed(data, a[short], ends[short]).view(np.int64)
    shingles, starts = shingles_of(data, a, ends, ids)
    sets = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = shingles[a:b]
        own.sort()
        sets.append(own[np.r_[True, own[1:] != own[:-1]]])
    return sets


def _checked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([len(x) + len(y) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())])
            cuts = np.unique(np.r_[0, np.searchsorted(size, np.arange(1, (size[-1] if len(size) else 0) // TOGETHER + 1) * TOGETHER) + 1, len(size)])
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(at, to - at)
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                ids, where = np.unique(np.r_[a, b], return_inverse=True)
                texts: list[bytes] = [b""] * len(ids)
                for k, text in zip(where.tolist(), part.column("left").to_pylist() + part.column("right").to_pylist()):
                    texts[k] = text
                sets = line_sets(texts)
                keep = [alike(sets[i], sets[j], threshold) for i, j in zip(where[: len(a)].tolist(), where[len(a) :].tolist())]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bands_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by band in batches that end with a band."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        band = batch.column("band").to_numpy()
        if held and held[-1].column("band")[-1].as_py() != band[0]:
            yield _one(held)
            held = []
        cut = int(np.flatnonzero(np.r_[True, band[1:] != band[:-1]])[-1])
        if cut:
            yield _one([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _across(band: np.ndarray, sketch: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of one band and different components, the closest of a block first."""
    start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    size = np.diff(np.r_[start, len(band)])
    # rows of small bands: each with the one before it, the second before it and so on
    place = np.arange(len(band)) - np.repeat(start, size)
    rows = np.flatnonzero(np.repeat(size <= FEW, size))
    found = []
    for back in range(1, FEW):
        rows = rows[place[rows] >= back]
        if not len(rows):
            break
        bits = np.bitwise_count(sketch[rows] ^ sketch[rows - back])
        hit = (bits <= APART) & (g[rows] != g[rows - back])
        found.append((rows[hit], rows[hit] - back, bits[hit]))
    if found:
        i, j, bits = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(bits, kind="stable")
        yield i[order], j[order]
    for first, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
        own, of = sketch[first : first + n], g[first : first + n]
        for at in range(0, n, 1024):
            rows = slice(at, at + 1024)
            bits = np.bitwise_count(own[rows, None] ^ own[None, : at + 1024])
            bits[of[rows, None] == of[None, : at + 1024]] = 255
            i, j = np.nonzero(bits <= APART)
            i, j = i[j < i + at], j[j < i + at]
            order = np.argsort(bits[i, j], kind="stable")
            yield i[order] + at + first, j[order] + first


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each band the lines that have a candidate in another component."""
    for batch in _bands_whole(batches):
        band, sketch, g = (batch.column(k).to_numpy() for k in ("band", "sketch", "g"))
        hit = np.zeros(len(g), bool)
        for i, j in _across(band, sketch, g):
            hit[i] = hit[j] = True
        if hit.any():
            yield batch.filter(pa.array(hit))


def _joined(threshold: float):
    """The links of components, found by exact comparisons of a band's candidates not joined yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict[int, int] = {}  # of components that links of this task joined

        def top(k: int) -> int:
            while (up := over.get(k, k)) != k:
                over[k] = k = over.get(up, up)
            return k

        for batch in _bands_whole(batches):
            band, sketch, g = (batch.column(k).to_numpy() for k in ("band", "sketch", "g"))
            sets: dict[int, np.ndarray] = {}
            text, links = batch.column("line"), []
            for rows, columns in _across(band, sketch, g):
                # the sets that this block needs, a stretch of them at once
                need = [k for k in np.unique(np.concatenate((rows, columns))).tolist() if k not in sets]
                for at in range(0, len(need), 256):
                    part = need[at : at + 256]
                    sets.update(zip(part, line_sets(text.take(pa.array(part)).to_pylist())))
                for i, j in zip(rows.tolist(), columns.tolist()):
                    x, y = top(int(g[i])), top(int(g[j]))
                    if x == y:
                        continue
                    if alike(sets[i], sets[j], threshold):
                        over[max(x, y)] = min(x, y)
                        links.append((max(g[i], g[j]), min(g[i], g[j])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"])

    return run


def _line_texts(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch):
                data, _, _, a, b = lines(piece.column("text"))
                ids = line_ids(data, a, b)
                out = []
                for k in np.flatnonzero(marked(bits, ids)).tolist():
                    if int(ids[k]) not in seen:
                        if len(seen) < SEEN:
                            seen.add(int(ids[k]))
                        out.append((int(ids[k]), data[a[k] : b[k]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["id", "line"])

    return run


def _texts(plain: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the given lines: one pass over the texts, most others left out by a bitmap of fixed size."""
    sent = plain.sparkSession.sparkContext.broadcast(bitmap(ids.select("id")))
    made = plain.select("text").mapInArrow(_line_texts(sent), "id long, line binary").join(ids.select("id").distinct(), "id", "left_semi")
    return stored(made.dropDuplicates(["id"]), "lines")


def _linked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("left")), texts.select(F.col("id").alias("b"), F.col("line").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_checked(threshold), "a long, b long")


def _by_band(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "band").sortWithinPartitions("band", "id")


def _blocks(crowd: DataFrame) -> DataFrame:
    """The rows of crowded bands (with their number n) once for every two blocks that meet; these share a band of their own.

    A component of CROWD lines and more in a band has blocks of its own, which need not meet each other."""
    sizes = crowd.groupBy("band", "g").agg(F.count("*").alias("size"))
    own = F.col("size") >= CROWD
    part = F.when(own, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CROWD))).otherwise(F.pmod(F.xxhash64("g"), F.ceil(F.col("n") / CROWD)))
    dealt = stored(crowd.join(sizes, ["band", "g"]).select("band", "id", "sketch", "g", F.xxhash64(F.when(own, F.col("g")), part).alias("block")), "dealt")
    blocks = dealt.groupBy("band", "block").agg(F.min("g").alias("low"), F.max("g").alias("high"))
    blocks = stored(blocks, "blocks")
    other = blocks.select("band", F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    # a block of a single component needs no task for itself, nor for one with the same component
    apart = (F.least("low", "other_low") < F.greatest("high", "other_high")) & (F.col("block") <= F.col("other"))
    met = blocks.join(other, "band").where(apart).select("band", "block", "other", F.xxhash64("band", "block", "other").alias("pair"))
    met = met.select("band", "pair", F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return dealt.join(stored(met, "pairs"), ["band", "block"]).select(F.col("pair").alias("band"), "id", "sketch", "g")


def _candidates(plain: DataFrame) -> DataFrame:
    """What lines meet in bands and, if the texts have a doc_id and t, where they are: one pass over the texts."""
    spread = BUCKETS * partitions(plain.sparkSession)
    return stored(dealt(plain.mapInArrow(_blocked(_bands, spread), SCHEMA)).mapInArrow(_met(spread), MET), "bands")


def line_components(plain: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of lines linked to others, by id."""
    return _components_of(plain, _candidates(plain), threshold)


def _components_of(plain: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    pair = met.where("other is not null").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    pairs = stored(pair.distinct(), "pairs")
    members = met.where("band is not null and other is null").select("band", "id", "sketch", "n")
    # the lines of both rounds of comparisons, in one pass over the texts
    texts = _texts(plain, pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(members.select("id")))
    first = stored(_linked(pairs, texts, threshold), "links")
    groups = stored(components(first), "groups")
    # what is left: candidates in different components of one band
    placed = members.join(groups, members["id"] == groups["node"], "left").select("band", "id", "sketch", "n", F.coalesce("component", "id").alias("g"))
    if not members.where(F.col("n") > CROWD).isEmpty():
        placed = stored(placed, "placed")
        placed = placed.where(F.col("n") <= CROWD).drop("n").unionByName(_blocks(placed.where(F.col("n") > CROWD)))
    rest = stored(_by_band(placed.select("band", "id", "sketch", "g")).mapInArrow(_apart, "band long, id long, sketch long, g long"), "rest")
    second = _by_band(rest.join(texts, "id")).select("band", "id", "sketch", "g", "line").mapInArrow(_joined(threshold), "a long, b long")
    over = components(second).select(F.col("node").alias("g"), F.col("component").alias("least"))
    groups = groups.select("node", F.col("component").alias("g"))
    # a line without a link of the first round is a component of its own
    alone = over.join(groups.select("g"), "g", "left_anti").select(F.col("g").alias("node"), F.col("least").alias("component"))
    return groups.join(over, "g", "left").select("node", F.coalesce("least", "g").alias("component")).unionAll(alone)


def _plain(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def dropped(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, t, gone): the numbers of the lines that go from each document; t is the text's hash, a null doc_id LOW."""
    with passing(docs.sparkSession):
        plain = _plain(docs)
        met = _candidates(plain)
        found = _components_of(plain, met, threshold)
        places = met.where("line_no is not null").select("id", "doc_id", "t", "line_no")
        # a repeat goes, whatever its line is linked to; of lines linked to others all but the first go
        place = F.struct("doc_id", "t", "line_no")
        linked = stored(places.join(found, places["id"] == found["node"]).select("component", place.alias("place")), "linked")
        kept = linked.groupBy("component").agg(F.min("place").alias("kept"))
        gone = linked.join(kept, "component").where(F.col("place") != F.col("kept")).select("place.*")
        gone = gone.unionAll(places.where("id is null").select("doc_id", "t", "line_no"))
        return lasting(gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "gone")


def deduplicated(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents (all columns) without the lines that go, and n_lines_removed; texts may become empty.

    Only documents that may lose lines are sent to the join; the others stay where they are."""
    gone = dropped(docs, threshold).select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), "gone")
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    some, others = parted(docs, F.xxhash64(doc_id), gone.select(F.xxhash64("__d").alias("hash")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = some.withColumn("__d", doc_id).withColumn("__t", F.xxhash64(text))
    joined = keyed.join(gone, ["__d", "__t"], "left")
    # the text is split once: a lambda's argument is a value
    cut = F.transform(F.array(F.split("text", "\n")), lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone")), lambda k: F.get(own, k)))
    changed = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(cut[0], "\n"))
    cleaned = joined.withColumn("text", changed).withColumn("n_lines_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    return cleaned.select(*docs.columns, "n_lines_removed").unionAll(others.withColumn("n_lines_removed", F.lit(0).cast("long")).select(*docs.columns, "n_lines_removed"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_sha256 of the text that stays."""
    clean = deduplicated(docs.select("doc_id", "text"))
    # most lines begin with a character above the blanks; the others are looked through
    full = lambda line: (line >= "!") | line.rlike(r"[^ \t\n\x0B\f\r]")
    left = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), full))
    return clean.select(
        F.col("doc_id").cast("long").alias("doc_id"), (left + F.col("n_lines_removed")).cast("long").alias("n_lines"),
        F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
