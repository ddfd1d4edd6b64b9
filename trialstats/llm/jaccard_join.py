"""N-gram Jaccard join by a token-group matrix.

Every document becomes the set of its distinct five-word shingles (64-bit
hashes).  Two documents link when 100 * |A n B| >= 75 * |A u B|; the result is
the component of each document.  All steps are exact.

1. Equal sets are one node.  The shingles met most often (at most HOT of them)
   go to the end of a global order that is otherwise the order of the hashes;
   any order is right, this one keeps shared passages out of what follows.
2. With this order, two linked nodes share a shingle among the first quarter of
   each (more exactly: the first seventh of the smaller).  Only these prefixes
   are shuffled, and only shingles of at least two nodes go on.
3. Groups: each node is compared with the few nodes that lead most of its shared
   shingles, if they lead many; linked nodes form groups of similar documents.
   Nodes without a link so far form loose groups, by the node that leads most of
   their shared shingles.
4. Matrix: for each group (in chunks of CHUNK shingles' worth of members) the
   union of its members' prefixes.  A node (the query) has with any member of a
   group at most as many prefix shingles in common as with the union; groups
   whose count cannot reach the threshold for the sizes in them stay closed,
   the others are opened and the query counted against all members at once.
   Queries are the members of the smaller of two groups; those of a loose group
   also ask their own group, without the matrix.

Only whether nodes are connected is asked, so no pairs inside a group of linked
nodes are made.  Defined cases: without words or text a document is empty and alone; with
fewer than five words its whole sequence is one shingle; equal texts link;
repeated rows give a row each; a row with null doc_id takes part and reports the
component's smallest id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from trialstats.llm.bitmap import bitmap, marked
from trialstats.llm.blocks import BUCKETS, SCHEMA, buckets, dealt, packed, whole
from trialstats.llm.components import components
from trialstats.llm.store import lasting, partitions, passing, stored
from trialstats.llm.words import PIECE_BYTES, first_words, hash_words, mix, pieces, rolled, signed, words

SIZE = 5
HOT = 1 << 18
COUNTED = 1 << 22  # shingles counted at a time in a task
LEADERS = 3
LIKELY = 0.4
CHUNK = 1 << 16
QUERIES = 512
MARKS = 1 << 24


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(texts, lower=True)
    h = hash_words(w)
    at = first_words(w)
    every = rolled(h, size)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(mix(rolled(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        total = mix(tokens ^ np.uint64(0xC0FFEE)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(signed(mix(np.array([total], np.uint64)))[0])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _repeated(tokens: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.sort(np.concatenate(tokens))
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[start, len(flat)])
    keep = count > 1
    none = pa.nulls(int(keep.sum()), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, pa.array(signed(flat[start[keep]])), pa.array(count[keep])], ["doc_id", "n", "node", "token", "count"])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, node) of every document; (token, count) of what repeats among the documents of a stretch."""
    held, size = [], 0
    for batch in batches:
        for piece in pieces(batch):
            sets = shingle_sets(piece.column("text"))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), none, none], ["doc_id", "n", "node", "token", "count"])
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield _repeated(held)
                held, size = [], 0
    if size:
        yield _repeated(held)


def hot_tokens(counts: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with the largest counts, at most `most`, sorted, and log2 of their counts."""
    total = stored(counts.groupBy("token").agg(F.sum("count").alias("count")), "counts")
    level = F.floor(F.log2("count") * 8).cast("int")
    taken, least = 0, None
    for r in total.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).orderBy(F.desc("level")).collect():
        taken += r["tokens"]
        if taken > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    rows = total.where(level >= least).select("token", F.floor(F.log2("count")).cast("int").alias("level")).toArrow()
    token = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["level"].to_numpy().astype(np.int8)[order]


def _prefixes(hot, spread: int):
    """Blocks of (key, node): key is a shingle's upper 62 bits, then whether it is hot, then whether it indexes.
    A shingle's rows share a bucket, a hot one's one of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        token, level = hot.value
        often = np.zeros(MARKS, bool)
        often[(token & np.uint64(MARKS - 1)).astype(np.int64)] = True
        for batch in batches:
            for piece in pieces(batch):
                keys, nodes, seen = [], [], set()
                for s in shingle_sets(piece.column("text")):
                    n = len(s)
                    if not n or (node := node_of(s)) in seen:
                        continue
                    if len(seen) < COUNTED:
                        seen.add(node)
                    late = np.zeros(n, np.int8)
                    maybe = np.flatnonzero(often[(s & np.uint64(MARKS - 1)).astype(np.int64)])
                    if len(maybe):
                        at = np.minimum(np.searchsorted(token, s[maybe]), len(token) - 1)
                        hit = token[at] == s[maybe]
                        late[maybe[hit]] = level[at[hit]] + 1
                        order = np.argsort(late, kind="stable")
                        s, late = s[order], late[order]
                    probe, index = n - (3 * n + 3) // 4 + 1, n - (6 * n + 6) // 7 + 1
                    key = (s[:probe] & ~np.uint64(3)) | ((late[:probe] > 0).astype(np.uint64) << np.uint64(1))
                    key[:index] |= np.uint64(1)
                    keys.append(key)
                    nodes.append(np.full(probe, node, np.int64))
                if keys:
                    key, node = np.concatenate(keys), np.concatenate(nodes)
                    salt = np.where(key & np.uint64(2), node.view(np.uint64) & np.uint64(63), np.uint64(0))
                    yield buckets(mix((key >> np.uint64(2)) + salt * np.uint64(0x9E3779B97F4A7C15)), spread), np.stack([signed(key), node], axis=1)

    return lambda batches: packed(run(batches))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole buckets: a row for each token and node, of tokens of several nodes or hot ones."""
    for rows in whole(batches, 2):
        order = np.argsort(rows[:, 0])
        token = rows[order, 0] >> 2
        same = token[1:] == token[:-1]
        rows = rows[order[np.r_[False, same] | np.r_[same, False] | ((rows[order, 0] & 2) > 0)]]
        # a node has one key for a token, so repeated rows are equal
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][: len(rows)]]
        key, node = rows[:, 0], rows[:, 1]
        token = key >> 2
        same = token[1:] == token[:-1]
        live = (np.r_[False, same] | np.r_[same, False])[: len(token)] | ((key & 2) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(token[live]), pa.array(node[live]), pa.array((key[live] & 1) > 0)], ["token", "node", "indexes"])


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), once for each of at least the given nodes: one pass over the texts, which leaves out
    most others by a bitmap of fixed size.  Hashes can't be compressed, so texts are sent, a third the size of their sets."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.select("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column("text"))
                some = np.flatnonzero([len(s) > 0 for s in sets])
                nodes = np.array([node_of(sets[k]) for k in some], np.int64)
                out = []
                for k in np.flatnonzero(marked(bits, nodes)):
                    if (node := int(nodes[k])) not in seen:
                        if len(seen) < COUNTED:
                            seen.add(node)
                        text = piece.column("text")[int(some[k])].as_py()
                        out.append((node, zlib.compress(text.encode(), 1)))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["node", "text"])

    return docs.mapInArrow(run, "node long, text binary").dropDuplicates(["node"])


def sets_sent(rows: pa.Table) -> list[np.ndarray]:
    """The sets of the rows' texts, made in pieces."""
    sets, held, size = [], [], 0
    for sent in rows.column("text").to_pylist():
        held.append(zlib.decompress(sent))
        size += len(held[-1])
        if size >= PIECE_BYTES:
            sets += shingle_sets(pa.array(held, pa.binary()).cast(pa.string()))
            held, size = [], 0
    return sets + shingle_sets(pa.array(held, pa.binary()).cast(pa.string()))


def _of_groups(links):
    """`links` of each group's rows: a table with the columns below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            if not len(batch):
                continue
            group = batch.column("group").to_numpy()
            cuts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)].tolist()
            for at, to in zip(cuts[:-1], cuts[1:]):
                if held and held[0].column("group")[0].as_py() != group[at]:
                    out += links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, to - at))
            if len(out) > 10_000:
                yield _links(out)
                out = []
        if held:
            out += links(pa.Table.from_batches(held))
        yield _links(out)

    return run


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def compared(docs: DataFrame, where: DataFrame, links) -> DataFrame:
    """(a, b): `links` of each group of `where` (group, node, component, member, asks) with the nodes' texts.

    A text is sent by its node once, and from there once to each of its groups."""
    where = stored(where.groupBy("group", "node").agg(F.min("component").alias("component"), F.max("member").alias("member"), F.max("asks").alias("asks")), "where")
    sent = where.join(texts_of(docs, where), "node").select("group", "node", "component", "member", "asks", "text")
    return sent.repartition(partitions(docs.sparkSession), "group").sortWithinPartitions("group").mapInArrow(_of_groups(links), "a long, b long")


def _with_leaders(rows: pa.Table) -> list[tuple[int, int]]:
    """Links of those who ask with the group's leader."""
    node, member, asks = (rows.column(k).to_numpy() for k in ("node", "member", "asks"))
    sets = sets_sent(rows)
    return [(int(node[i]), int(node[j])) for j in np.flatnonzero(member) for i in np.flatnonzero(asks) if i != j and alike(sets[i], sets[j])]


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; at most QUERIES or so of a leader b meet it in a group."""
    led_by = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts")), "led")
    group = F.xxhash64("b", "salt").alias("group")
    none = F.lit(0).cast("long").alias("component")
    asked = pairs.join(led_by, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    leaders = led_by.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = asked.select(group, F.col("a").alias("node"), none, F.lit(False).alias("member"), F.lit(True).alias("asks"))
    leaders = leaders.select(group, F.col("b").alias("node"), none, F.lit(True).alias("member"), F.lit(False).alias("asks"))
    return compared(docs, asked.unionAll(leaders), _with_leaders)


def led(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, place, b, likely): each node with the LEADERS nodes that lead most of its shared shingles, and
    whether they lead a share of LIKELY of its prefix.  A shingle is led by the node with the smallest share of
    shingles of its own.  What is left out here is found in the matrix."""
    alone = 1 - F.col("kept") / F.greatest(F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1, F.lit(1))
    rank = shared.groupBy("node").agg(F.count("*").alias("kept")).join(sizes, "node").select("node", "n", F.round(alone, 3).alias("alone"))
    rows = stored(shared.join(rank, "node"), "ranked")
    lead = stored(rows.groupBy("token").agg(F.min(F.struct("alone", "node", "n")).alias("lead")), "lead")
    pairs = rows.join(lead, "token").where("node <> lead.node and 4 * least(n, lead.n) >= 3 * greatest(n, lead.n)")
    counted = pairs.groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.count("*").alias("both"), F.first("n").alias("n"))
    prefix = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1
    ranked = counted.select("a", F.struct("both", "b", (F.col("both") >= LIKELY * prefix).alias("likely")).alias("leader"))
    best = F.slice(F.sort_array(F.collect_list("leader"), asc=False), 1, LEADERS)
    placed = ranked.groupBy("a").agg(best.alias("best")).select("a", F.posexplode("best").alias("place", "leader"))
    return placed.select("a", "place", "leader.b", "leader.likely")


def _opened(rows: pa.Table) -> list[tuple[int, int]]:
    """Links of those who ask with members of the group, enough to join all components that such links join."""
    out: list[tuple[int, int]] = []
    node, component, member, asks = (rows.column(k).to_numpy() for k in ("node", "component", "member", "asks"))
    members = np.flatnonzero(member)
    if not len(members) or not asks.any():
        return out
    every = sets_sent(rows)
    size = np.array([len(every[k]) for k in members])
    token, owner = np.concatenate([every[k] for k in members]), np.repeat(np.arange(len(members)), size)
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    over: dict[int, int] = {}  # of components that links found here joined

    def top(k: int) -> int:
        while (up := over.get(k, k)) != k:
            over[k] = k = over.get(up, up)
        return k

    for q in np.flatnonzero(asks).tolist():
        s, of = every[q], int(component[q])
        low = np.searchsorted(token, s, "left")
        count = np.searchsorted(token, s, "right") - low
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) - np.repeat(ends - count - low, count)
        both = np.bincount(owner[at], minlength=len(members))
        for k in members[(100 * both >= 75 * (len(s) + size - both)) & (component[members] != of)].tolist():
            x, y = top(of), top(int(component[k]))
            if x != y:
                over[max(x, y)] = min(x, y)
                out.append((int(node[q]), int(node[k])))
    return out


def opened(docs: DataFrame, shared: DataFrame, sizes: DataFrame, groups: DataFrame, leaders: DataFrame) -> DataFrame:
    """(a, b) links between nodes of different components, enough to connect all that are connected.

    groups: (node, component) of the nodes linked so far; leaders: (node, leader), at most one for a node."""
    # a loose node goes by its leader's component, or its leader, or itself; any way of grouping gives the same components
    above = leaders.join(groups.select(F.col("node").alias("leader"), F.col("component").alias("up")), "leader", "left").select("node", F.coalesce("up", "leader").alias("up"))
    placed = sizes.join(shared.select("node").distinct(), "node", "left_semi").join(groups, "node", "left").join(above, "node", "left")
    loose = F.xxhash64(F.coalesce("up", "node"), F.lit("loose"))
    placed = placed.select("node", "n", F.col("component").isNull().alias("loose"), F.coalesce("component", loose).alias("g"), F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "nodes")
    weight = stored(placed.groupBy("g").agg(F.count("*").alias("members"), F.ceil(F.sum("n") / CHUNK).alias("chunks")), "weight")
    placed = stored(placed.join(weight, "g").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "placed")
    rows = stored(shared.join(placed.drop("component", "loose"), "node"), "matrix")
    matrix = rows.groupBy("token", "g", "chunk").agg(F.max("members").alias("m2"), F.max("indexes").alias("i2"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    matrix = stored(matrix.withColumnRenamed("g", "g2").withColumnRenamed("chunk", "c2"), "matrix")
    smaller = (F.col("g") != F.col("g2")) & ((F.col("members") < F.col("m2")) | ((F.col("members") == F.col("m2")) & (F.col("g") < F.col("g2"))))
    fits = (4 * F.col("hi") >= 3 * F.col("n")) & (4 * F.col("n") >= 3 * F.col("lo"))
    met = rows.join(matrix, "token").where(smaller & fits)
    counted = met.groupBy("node", "n", "g2", "c2").agg(F.count("*").alias("both"), F.max(F.col("indexes") | F.col("i2")).alias("indexed"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # |A n B| <= both + ceil(3/4 max) - 1 must reach 3/7 (|A| + |B|); least over the sizes in the group
    least = F.greatest("lo", F.ceil(F.col("n") * 3 / 4))
    below = F.when(least <= F.col("n"), F.ceil((F.col("n") + least) * 3 / 7) - F.floor((3 * F.col("n") + 3) / 4) + 1).otherwise(F.lit(1 << 40))
    top = F.least("hi", F.floor(F.col("n") * 4 / 3))
    beyond = F.when(F.col("hi") > F.col("n"), F.floor((F.col("n") + top) * 3 / 7) - F.floor((3 * top + 3) / 4)).otherwise(F.lit(1 << 40))
    calls = counted.where("indexed").where(F.col("both") >= F.least(below, beyond)).select("node", "g2", "c2")
    within = placed.where("loose and members > 1").select("node", F.col("g").alias("g2"), F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))).alias("c2"))
    calls = stored(calls.unionByName(within), "calls")
    called = calls.groupBy("g2", "c2").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))
    called = stored(called, "called")
    members = placed.select("node", "component", F.col("g").alias("g2"), F.col("chunk").alias("c2")).join(called, ["g2", "c2"])
    asked = calls.join(placed.select("node", "component"), "node").join(called, ["g2", "c2"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    members = members.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))))
    meets = lambda rows, member: rows.select(F.xxhash64("g2", "c2", "salt").alias("group"), "node", "component", F.lit(member).alias("member"), F.lit(not member).alias("asks"))
    return compared(docs, meets(members, True).unionAll(meets(asked, False)), _opened)


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc_id, n, node) and components (node, component) of the nodes with links."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = stored(plain.mapInArrow(_profiles, "doc_id long, n long, node long, token long, count long"), "profiles")
    profiles = both.where("token is null").select("doc_id", "n", "node")
    with passing(spark):
        hot = spark.sparkContext.broadcast(hot_tokens(both.where("token is not null").select("token", "count")))
    texts = plain.select("text")
    blocks = texts.mapInArrow(_prefixes(hot, BUCKETS * partitions(spark)), SCHEMA)
    shared = stored(dealt(blocks).mapInArrow(_shared, "token long, node long, indexes boolean"), "shared")
    sizes = profiles.where("n > 0").groupBy("node").agg(F.max("n").alias("n"))
    with passing(spark):
        leaders = lasting(led(shared, sizes), "leaders")
    with passing(spark):
        near = lasting(verified(texts, leaders.where("likely").select("a", "b")), "links")
    groups = stored(components(near), "groups")
    links = opened(texts, shared, sizes, groups, leaders.where("place = 0").select(F.col("a").alias("node"), F.col("b").alias("leader")))
    return profiles, stored(components(near.union(links)), "components")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    profiles, found = linked(docs)
    least = profiles.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    of_node = stored(named.select("node", "component").join(ids, "component").select("node", "component_id"), "nodes")
    return profiles.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
