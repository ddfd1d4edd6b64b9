"""Merkle manifest of a dataset: a persistent 16-ary tree of row digests, with a version for each tampered row.

A leaf is the digest of a row's fields, each written as its UTF-8 byte count,
a colon and the value, a null as `-`.  The leaves of a source ascend by doc_id;
every RUN consecutive nodes, the last run possibly fewer, become the digest of
their joined hex text until one is left, the subroot.  Subroots ordered by
source, null first and bytewise, become the root in the same way.

Nodes are worked on in aligned blocks of BLOCK = RUN^DEPTH, so a task reduces a
block by DEPTH levels and sends on one node; a source of 10^11 rows takes three
such rounds.  On the way down each block gets its frame: for every level above
it, the hex text before and after its ancestor in the ancestor's run.  That is
all a leaf needs of the rest of the tree.

The tree is persistent.  A tampered leaf makes a version of it: only the nodes
on the leaf's path are copied, DEPTH of them inside the block and then one for
each level of the frame, in the task that holds the block; every other node is
shared with the tree as it was.  The last copy is the version's root.  Versions
are spread over all blocks of leaves, so that no upper block gathers them.

Ranks of leaves come from a sort by range of (source, doc_id, digest); rows that
agree in all of them are one row with a count while they are sorted, so a hot
source or a hot doc_id is split like any other.

Defined cases: null and empty texts differ (`-` and `0:`); rows with a null
doc_id come first in their source; rows of one doc_id are ordered by digest, and
rows that agree in every field get consecutive places; a null source is a source
of its own; very long texts are hashed whole in the row's own task; an empty
table gives no rows; extra columns, whatever their names, are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialstats.llm.store import partitions, stored

RUN = 16
DEPTH = 3
BLOCK = RUN**DEPTH
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# group that all subroots belong to in the tree above the sources
TOP = ""
FRAME = "array<struct<before: string, after: string>>"
FRAME_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(fields: list[Column]) -> Column:
    def written(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[written(c) for c in fields]), 256)


def group_of(source: Column) -> Column:
    """A source as a key that is never null and sorts like it."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def lower_cased(docs: DataFrame) -> Column:
    """The digest of the row with A-Z of its text lower-cased, where 5 divides crc32(doc_id); else null."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    fields = [docs[f] if f != "text" else F.translate(docs["text"], UPPER, LOWER) for f in FIELDS]
    return F.when(hit, digest(fields))


def leaves(docs: DataFrame, tampered: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """g (the source's key), doc_id, digest, changed: one row for each row of the table."""
    changed = tampered(docs) if tampered else F.lit(None).cast("string")
    return docs.select(group_of(docs["source"]).alias("g"), docs["doc_id"].cast("long").alias("doc_id"), digest([docs[f] for f in FIELDS]).alias("digest"), changed.alias("changed"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of every row in its group within this task's sorted rows."""
    group, at = None, 0
    for batch in batches:
        places = []
        for g, n in zip(batch.column("g").to_pylist(), batch.column("n").to_pylist()):
            if g != group:
                group, at = g, 0
            places.append(at)
            at += n
        yield batch.append_column("place", pa.array(places, pa.int64()))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with idx, the place of each in its group by `order`, and total, the size of the group.

    Every column must be in `order`, apart from g; equal rows are counted before they are sorted.
    """
    spark = rows.sparkSession
    same = rows.groupBy("g", *order).agg(F.count("*").alias("n"))
    dealt = same.repartitionByRange(partitions(spark), "g", *order).sortWithinPartitions("g", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = stored(dealt.mapInArrow(_counted, f"{schema}, place long").withColumn("part", F.spark_partition_id()), "placed")
    sums = placed.groupBy("g", "part").agg(F.sum("n").alias("held"))
    by = Window.partitionBy("g")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and task: as many as there are groups, and tasks besides
    sums = stored(sums.select("g", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.sum("held").over(by).alias("total")), "bases")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    found = placed.join(sums, ["g", "part"]).select("g", *order, "place", "base", "total", copies.alias("copy"))
    return found.select("g", *order, (F.col("base") + F.col("place") + F.col("copy")).alias("idx"), "total")


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def levels(digests: list[str], total: int) -> list[str]:
    """The levels of a block as joined hex text, its own digests first: DEPTH more, or up to the one node of a group that fits in."""
    out = ["".join(digests)]
    while len(out) <= DEPTH and not (total <= BLOCK and len(out[-1]) == HEX):
        low = out[-1]
        out.append("".join(hashed(low[a : a + RUN * HEX]) for a in range(0, len(low), RUN * HEX)))
    return out


def path(up: list[str], k: int) -> list[tuple[str, str]]:
    """(before, after) of node k and its ancestors in a block."""
    out = []
    for level in up[:-1]:
        run = k // RUN * RUN * HEX
        out.append((level[run : k * HEX], level[(k + 1) * HEX : run + RUN * HEX]))
        k //= RUN
    return out


def copied(leaf: str, frame: list[tuple[str, str]]) -> list[str]:
    """The nodes of the version that this leaf makes: itself and a copy of each ancestor."""
    out = [leaf]
    for before, after in frame:
        out.append(hashed(before + out[-1] + after))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one (g, block) after the other; a block has at most BLOCK nodes and one frame."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = row["g"], row["block"]
            if at != key and held:
                yield held
                held = []
            key = at
            held.append(row)
    if held:
        yield held


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One node for each block."""
    out = []
    for rows in _blocks(batches):
        total = rows[0]["total"]
        top = levels([r["digest"] for r in rows], total)[-1]
        out.append((rows[0]["g"], rows[0]["block"], top, -(-total // BLOCK)))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["g", "idx", "digest", "total"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a block together and in order; a frame, if there is one, has idx -1 and so comes first."""
    return rows.repartition(partitions(rows.sparkSession), "g", "block").sortWithinPartitions("g", "block", "idx")


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("long"))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (g, idx, digest, total) of each round from the bottom up; the last has one node for each group."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        up = _dealt(_with_block(out[-1].select("g", "idx", "digest", "total"))).mapInArrow(_reduced, "g string, idx long, digest string, total long")
        out.append(stored(up, "nodes"))
    return out


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a block with its frame: its own path in the block, then the block's frame."""
    for rows in _blocks(batches):
        head, nodes = rows[0], rows[1:]
        up = levels([r["digest"] for r in nodes], nodes[0]["total"])
        frames = [[{"before": b, "after": a} for b, a in path(up, k)] + (head["frame"] or []) for k in range(len(nodes))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["g"] for r in nodes], pa.string()), pa.array([r["idx"] for r in nodes], pa.int64()), pa.array(frames, FRAME_ARROW), pa.array([head["subroot"]] * len(nodes), pa.string()), pa.array([head["root"]] * len(nodes), pa.string())],
            ["g", "idx", "frame", "subroot", "root"],
        )


def _below(nodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Nodes and the frames of their blocks in one table, dealt by block."""
    blank = {c: F.lit(None).cast(kind) for c, kind in nodes.dtypes if c not in ("g", "idx")}
    heads = frames.select("g", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "frame", "subroot", "root", *[c.alias(k) for k, c in blank.items()])
    body = _with_block(nodes).select("*", F.lit(None).cast(FRAME).alias("frame"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    return _dealt(body.unionByName(heads))


def frames_of(up: list[DataFrame], top: DataFrame) -> DataFrame:
    """Frames of the blocks of the lowest nodes (g, idx = block, frame, subroot, root), from those of the groups' last nodes."""
    at = top
    for nodes in reversed(up[1:-1]):
        at = stored(_below(nodes, at).mapInArrow(_framed, f"g string, idx long, frame {FRAME}, subroot string, root string"), "frames")
    return at


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf with its proof and the nodes that its version copies."""
    names = ["g", "doc_id", "idx", "leaf", "subroot", "root", "proof_sha256", "tampered", "path"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]
    for rows in _blocks(batches):
        head, nodes = rows[0], rows[1:]
        up = levels([r["digest"] for r in nodes], nodes[0]["total"])
        rest = [(f["before"], f["after"]) for f in head["frame"] or []]
        shared: dict[int, tuple[list[tuple[str, str]], bytes]] = {}
        out = []
        for k, r in enumerate(nodes):
            parent = k // RUN
            if parent not in shared:  # what the leaves of a run have in common
                above = path(up[1:], parent) + rest if len(up) > 1 else rest
                shared = {parent: (above, "".join(b + a for b, a in above).encode("ascii"))}
            above, proof = shared[parent]
            own = path(up[:2], k)
            siblings = hashlib.sha256("".join(b + a for b, a in own).encode("ascii"))
            siblings.update(proof)
            version = copied(r["changed"] or r["digest"], own + above)
            out.append((r["g"], r["doc_id"], r["idx"], r["digest"], head["subroot"], head["root"], siblings.hexdigest(), r["changed"] is not None, version))
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names)


def tree(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of nodes below the subroots (from `leaves`), and of those above them."""
    below = rounds(stored(ranked(rows, ["doc_id", "digest", "changed"]), "leaves"))
    last = below[-1]
    sources = ranked(last.select(F.lit(TOP).alias("g"), F.col("g").alias("source"), "digest"), ["source", "digest"])
    above = rounds(stored(sources, "sources"))
    return below, above


def versions(docs: DataFrame, tampered: Callable[[DataFrame], Column] | None = lower_cased) -> DataFrame:
    """A row for each row of the table: its place in the tree and the path its version copies.

    g, doc_id, idx, leaf, subroot, root, proof_sha256 (of the untouched tree),
    tampered, path (digests from the tampered leaf to the version's root; of a
    row that isn't tampered, those of the tree itself).  `tampered` gives the
    digest of a row's altered fields, null for rows left alone.
    """
    below, above = tree(leaves(docs, tampered))
    top = above[-1].select("g", "idx", F.array().cast(FRAME).alias("frame"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    blocks = frames_of(above, top)
    # the frame of each subroot: its path among the subroots
    at = _below(above[0].select("g", "idx", "digest", "total"), blocks).mapInArrow(_framed, f"g string, idx long, frame {FRAME}, subroot string, root string") if len(above) > 1 else top
    names = above[0].select("idx", F.col("source").alias("of"), F.col("digest").alias("own"))
    subs = stored(at.join(names, "idx").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "frame", F.col("own").alias("subroot"), "root"), "subroots")
    framed = frames_of(below, subs)
    rows = below[0].select("g", "idx", "digest", "total", "doc_id", "changed")
    kinds = "g string, doc_id long, idx long, leaf string, subroot string, root string, proof_sha256 string, tampered boolean, path array<string>"
    return _below(rows, framed).mapInArrow(_versions, kinds)


def manifest(docs: DataFrame) -> DataFrame:
    """source_key, n_rows, subroot, root: what is published of a dataset."""
    below, above = tree(leaves(docs))
    sizes = below[0].groupBy("g").agg(F.max("total").alias("n_rows"))
    root = above[-1].first()
    found = above[0].select(F.col("source").alias("g"), F.col("digest").alias("subroot")).join(sizes, "g")
    return found.select(F.col("g").alias("source_key"), "n_rows", "subroot", F.lit(root and root["digest"]).alias("root"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_copied."""
    found = versions(docs)
    folded = F.element_at("path", -1)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"), F.size("path").cast("long").alias("n_copied"))
