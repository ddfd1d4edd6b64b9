"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor folder.

Every line of every file, and the file as a whole, is compared with short
licence statements: words (lower case, without punctuation at their ends) are
hashed into SLOTS, weighted by inverse document frequency over all files, and
the cosine to each template is computed for lines that share a word with one.  A
file's own licence is that of its best line from `line_min` on; it is a licence
file if the file as a whole reaches `file_min`.

So are notices of several lines, of whatever line breaks and comment marks: a
window of the notice's number of words goes over every file that has enough of
its words, and counts from `line_min` on like a line.  A file that as a whole
(each word once) reaches `line_min` with a notice or a whole licence text is a
licence file too, named by the notice in it if there is one.  An
SPDX-License-Identifier tag counts like a line with cosine 1, by the first
licence it names; "-only", "-or-later" and "+" are left off.

A file without a licence of its
own inherits from the licence file in the nearest folder above or beside it: the
folders (not the files) are joined with their ancestors.

Defined cases: null and empty texts have no licence of their own; equal cosines
go to the template that comes first; several licence files in a folder: the
better cosine, then the lesser path, counts; a null path inherits nothing;
repeated rows give a row each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from trialstats.llm.notices import NOTICES, SPDX, TEXTS
from trialstats.llm.store import stored
from trialstats.llm.words import Words, hashed, pieces, words

SLOTS = 1 << 14
# fixed values: usual one-line licence statements
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)
NAMES = tuple(dict.fromkeys([n for n, _ in (*TEMPLATES, *NOTICES, *TEXTS)] + list(SPDX)))
MARKS = ("#", "##", "//", "///", "/*", "/**", "*", "**", "*/", "--", ";", ";;", "%", "<!--", "-->", "!", "rem", "dnl")  # of comments
TAG = re.compile(r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)", re.I)
_TAGGED = {n.lower(): n for n in SPDX}
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()[]")] = True


def slots(texts: pa.Array) -> tuple[Words, np.ndarray]:
    w = words(texts, lower=True)
    start, end = w.start.copy(), w.end.copy()
    if len(start):
        end -= (end - start > 1) & _PUNCTUATION[w.data[end - 1]]
        start += (end - start > 1) & _PUNCTUATION[w.data[start]]
    return w, (hashed(w.data, start, end) >> np.uint64(50)).astype(np.int64)


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for piece in pieces(batch):
            w, slot = slots(piece.column("text"))
            seen += np.bincount(np.unique(w.row * SLOTS + slot) % SLOTS, minlength=SLOTS)
            rows += piece.num_rows
    at = np.r_[np.flatnonzero(seen), SLOTS]
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.r_[seen, rows][at])], ["slot", "n"])


def inverse_frequency(files: DataFrame) -> np.ndarray:
    n = np.zeros(SLOTS + 1)
    for slot, count in files.select("text").mapInArrow(_frequency, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        n[slot] = count
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def unmarked(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, and row and slot of those that are no mark of a comment."""
    w, slot = slots(texts)
    keep = ~np.isin(slot, slots(pa.array([" ".join(MARKS)]))[1])
    return w, w.row[keep], slot[keep]


def template_matrix(idf: np.ndarray, templates: tuple = TEMPLATES, once: bool = False) -> np.ndarray:
    w, slot = slots(pa.array([t for _, t in templates]))
    out = np.zeros((SLOTS, len(templates)))
    np.add.at(out, (slot, w.row), 1.0)
    out = np.minimum(out, 1) if once else out
    out *= idf[:, None]
    return out / np.linalg.norm(out, axis=0)


def cosines(part: np.ndarray, slot: np.ndarray, parts: int, idf: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Cosine of every part (line or file) with every template."""
    pairs, count = np.unique(part * SLOTS + slot, return_counts=True)
    part, slot = pairs // SLOTS, pairs % SLOTS
    weight = count * idf[slot]
    norm = np.sqrt(np.bincount(part, weight * weight, parts))
    some = np.flatnonzero(templates[slot].any(1))
    out = np.zeros((parts, templates.shape[1]))
    for k in range(templates.shape[1]):
        out[:, k] = np.bincount(part[some], weight[some] * templates[slot[some], k], parts)
    return out / np.maximum(norm, 1e-12)[:, None]


def noticed(row: np.ndarray, slot: np.ndarray, rows: int, idf: np.ndarray, notices: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the best cosine of a notice with as many consecutive words, and which notice; 0 below `least`."""
    best, of = np.zeros(rows), np.zeros(rows, np.int64)
    pairs = np.unique(row * SLOTS + slot)
    at, which = pairs // SLOTS, pairs % SLOTS
    some = notices[which].any(1)
    at, which = at[some], which[some]
    for k, size in enumerate(sizes.tolist()):
        t = notices[:, k]
        enough = np.bincount(at, t[which] ** 2, rows) >= least * least - 1e-9  # no window has a larger cosine than the root
        if not enough.any():
            continue
        mine = enough[row]
        r, s = row[mine], slot[mine]
        last = np.minimum(np.arange(len(r)) + size, np.searchsorted(r, r, "right"))
        dot = np.r_[0, np.cumsum(idf[s] * t[s])]
        low = np.r_[0, np.cumsum(idf[s] ** 2)]  # less than the norm if a word repeats
        start = np.flatnonzero(dot[last] - dot[:-1] >= least * np.sqrt(np.maximum(low[last] - low[:-1], 0)) - 1e-9)
        for begin in range(0, len(start), 1000):  # bounds the memory
            some_starts = start[begin : begin + 1000]
            many = last[some_starts] - some_starts
            part = np.repeat(np.arange(len(some_starts)), many)
            word = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + some_starts[part]
            like = cosines(part, s[word], len(some_starts), idf, t[:, None])[:, 0]
            top = np.zeros(rows)
            np.maximum.at(top, r[some_starts], like)
            better = (top >= least) & (top > best + 1e-12)
            best[better], of[better] = top[better], k
    return best, of


def tagged(texts: pa.Array) -> dict[int, int]:
    """Row -> licence in NAMES, of the texts with an SPDX tag of a known licence."""
    out = {}
    for row in np.flatnonzero(pa.compute.match_substring(texts, "spdx-license-identifier:", ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
        for tag in TAG.findall(texts[row].as_py()):
            name = _TAGGED.get(re.sub(r"(-only|-or-later|\+)$", "", tag.lower()))
            if name:
                out[row] = NAMES.index(name)
                break
    return out


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, templates, notices, sizes, texts, line_min = sent.value
        named = lambda known: np.array([NAMES.index(n) for n, _ in known])
        for batch in batches:
            for piece in pieces(batch):
                n = piece.num_rows
                w, slot = slots(piece.column("text"))
                ends = np.flatnonzero(w.data == 10)
                cut = np.union1d(w.offsets[1:-1], ends + 1)  # where lines begin, but the first
                line = np.searchsorted(cut, w.start, "right")
                by_line = cosines(line, slot, len(cut) + 1, idf, templates)
                best, of = by_line.max(1), by_line.argmax(1)
                line_row = np.searchsorted(w.offsets, np.r_[0, cut], "right") - 1
                line_row = np.minimum(line_row, n - 1)
                order = np.lexsort((-np.arange(len(best)), best, line_row))
                last = np.flatnonzero(np.r_[line_row[order][1:] != line_row[order][:-1], True])
                own, which = np.zeros(n), np.zeros(n, np.int64)
                own[line_row[order[last]]], which[line_row[order[last]]] = best[order[last]], of[order[last]]
                whole = cosines(w.row, slot, n, idf, templates)
                file_of, file_like = whole.argmax(1), whole.max(1)
                which = named(TEMPLATES)[which]
                file_of = named(TEMPLATES)[file_of]
                _, row, slot = unmarked(piece.column("text"))
                like, notice = noticed(row, slot, n, idf, notices, sizes, line_min)
                better = like > own
                own[better], which[better] = like[better], named(NOTICES)[notice[better]]
                for k, name in tagged(piece.column("text")).items():
                    if own[k] < 1 - 1e-9:
                        own[k], which[k] = 1, name
                pairs = np.unique(row * SLOTS + slot)
                whole = cosines(pairs // SLOTS, pairs % SLOTS, n, idf, texts)
                text_like, text_of = whole.max(1), named((*NOTICES, *TEXTS))[whole.argmax(1)]
                text_of = np.where(like >= line_min, named(NOTICES)[notice], text_of)
                is_text = text_like >= line_min
                better = is_text & (text_like > file_like)
                file_like[better], file_of[better] = text_like[better], text_of[better]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("path"), pa.array(which.astype(np.int32)), pa.array(own), pa.array(file_of.astype(np.int32)), pa.array(file_like), pa.array(is_text)],
                    ["doc_id", "path", "line_licence", "line_cosine", "file_licence", "file_cosine", "is_text"],
                )

    return run


def folder_of(path: Column) -> Column:
    """The path up to its last slash; the root is ''."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def ancestors(folder: Column) -> Column:
    """The folder, its parents and the root, each with its depth."""
    names = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(names)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, F.lit(1), k), "/").alias("folder")),
    )


def inherited(files: DataFrame) -> DataFrame:
    """(folder, from_folder, licence): for every folder the licence of the nearest one above it or itself.

    `files` has folder, path, licence_file, file_cosine, file_licence."""
    better = F.struct(-F.col("file_cosine"), "path", "file_licence")
    given = files.where("licence_file and folder is not null").groupBy("folder").agg(F.min(better)["file_licence"].alias("licence"))
    folders = files.where("folder is not null").select("folder").distinct()
    above = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("up")).select("folder", "up.depth", F.col("up.folder").alias("from_folder"))
    found = above.join(stored(given.withColumnRenamed("folder", "from_folder"), "given"), "from_folder")
    nearest = F.max(F.struct("depth", "from_folder", "licence"))
    return found.groupBy("folder").agg(nearest.alias("n")).select("folder", "n.from_folder", "n.licence")


def scan(files: DataFrame, line_min: float = 0.8, file_min: float = 0.5) -> DataFrame:
    """doc_id, path, own_licence, cosine, licence_file, inherited_from, licence.  `files` has doc_id, path and text."""
    plain = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    idf = inverse_frequency(plain)
    sent = files.sparkSession.sparkContext.broadcast((
        idf, template_matrix(idf), template_matrix(idf, NOTICES), np.array([len(unmarked(pa.array([t]))[1]) for _, t in NOTICES]), template_matrix(idf, (*NOTICES, *TEXTS), once=True), line_min,
    ))
    kinds = "doc_id long, path string, line_licence int, line_cosine double, file_licence int, file_cosine double, is_text boolean"
    scanned = plain.mapInArrow(_scan(sent), kinds).withColumn("folder", folder_of(F.col("path"))).withColumn("licence_file", F.col("is_text") | (F.col("file_cosine") >= file_min))
    scanned = stored(scanned, "licences")
    up = stored(inherited(scanned), "folders")
    name = lambda k: F.get(F.array(*[F.lit(t) for t in NAMES]), k)
    own = F.when(F.col("line_cosine") >= line_min, name(F.col("line_licence"))).when(F.col("licence_file"), name(F.col("file_licence")))
    joined = scanned.join(up, "folder", "left").withColumn("own_licence", own)
    return joined.select(
        "doc_id", "path", "own_licence", F.round("line_cosine", 9).alias("cosine"), "licence_file",
        F.when(F.col("own_licence").isNull(), F.col("from_folder")).alias("inherited_from"), F.coalesce("own_licence", name(F.col("licence"))).alias("licence"),
    )
