import hashlib
import zlib

from pyspark.sql import functions as F

from trialstats.llm import merkle

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for f in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[f]
        if v is None:
            out += "-"
            continue
        v = str(v)
        if lower and f == "text":
            v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
        out += f"{len(v.encode())}:{v}"
    return sha(out)


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[k : k + 16])) for k in range(0, len(low), 16)])
    return levels


def walk(levels, k):
    for level in levels[:-1]:
        run = k // 16 * 16
        yield level[run:k], level[k + 1 : run + 16]
        k //= 16


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = build([leaf(r) for r in sources[s]])
    top = build([trees[s][-1][0] for s in order])
    root = top[-1][0]
    out = []
    for at, s in enumerate(order):
        for k, r in enumerate(sources[s]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            d, proof = leaf(r, hit), ""
            for before, after in [*walk(trees[s], k), *walk(top, at)]:
                d = sha("".join(before) + d + "".join(after))
                proof += "".join(before) + "".join(after)
            out.append((r["doc_id"], trees[s][0][k], trees[s][-1][0], root, sha(proof), d, d == root))
    return out


def same(docs):
    want = sorted(brute([r.asDict() for r in docs.collect()]), key=repr)
    got = sorted((tuple(r) for r in merkle.report(docs).select(*NAMES).collect()), key=repr)
    assert got == want
    return got


def test_documents(documents):
    got = same(documents)
    assert {r[-1] for r in got} == {True, False}


def test_blocks_of_several_rounds(spark):
    """A source over two rounds of blocks, one of exactly a block, one just above it, one of a single row, many sources."""
    n = merkle.BLOCK
    ids = spark.range(17 * n + 18)
    source = F.when(F.col("id") == 0, F.lit("one")).when(F.col("id") <= n, F.lit("block")).when(F.col("id") <= 2 * n + 1, F.lit("more")).when(F.col("id") <= 2 * n + 50, F.concat(F.lit("s"), F.col("id"))).otherwise(F.lit("long"))
    docs = ids.select(F.col("id").alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.concat(F.lit("Text "), F.col("id") % 7).alias("text"))
    same(docs)


def test_odd_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, g string, idx string, digest string"
    rows = [
        (None, None, None, None, None, "x", "x", "x"), (None, "a", "en", 1, "Y", "x", "x", "x"), (5, None, "en", 0, "", "x", "x", "x"),
        (5, None, "en", 0, "", "x", "x", "x"), (5, None, "en", 0, "other", "x", "x", "x"), (6, "é", "de", 3, "É ß A", "x", "x", "x"),
        (7, "-", "en", 2, "B" * 200_000, "x", "x", "x"), (8, "=", "en", 2, "Q", "x", "x", "x"), (8, "", "en", 2, "Q", "x", "x", "x"),
    ] + [(9, "hot", "en", 1, "Same", "x", "x", "x")] * 300
    same(spark.createDataFrame(rows, schema))
    assert merkle.report(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame(rows[:1], schema)
    (r,) = merkle.report(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha("")
    same(one)


def test_versions_share_what_is_untouched(documents):
    """A version copies one node for each level, and no other version has them unless its leaf is the same."""
    rows = merkle.versions(documents).collect()
    depth = {len(r["path"]) for r in rows}
    assert max(depth) <= 5
    own = [r for r in rows if r["tampered"] and r["path"][0] != r["leaf"]]
    assert own and len({r["path"][-1] for r in own}) == len(own)
    assert all(r["path"][-1] == r["root"] for r in rows if not r["tampered"])


def test_manifest(documents):
    found = {r["source_key"]: r for r in merkle.manifest(documents).collect()}
    want = {r["subroot"] for r in merkle.report(documents).collect()}
    assert {r["subroot"] for r in found.values()} == want and sum(r["n_rows"] for r in found.values()) == documents.count()
