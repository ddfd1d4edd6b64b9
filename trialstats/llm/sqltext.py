"""SQL that DuckDB runs for the corpus queries that SQL can express."""

_WORDS = r"regexp_extract_all({text}, '[^ \t\n\x0B\f\r]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w WHERE len(words) >= 20)
),
again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM again),
places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS q FROM w),
kept AS (
  SELECT doc_id, count(*) AS m, string_agg(word, ' ' ORDER BY q) AS t
  FROM places ANTI JOIN covered USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(m, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT edges.b, reached.r FROM reached JOIN edges ON edges.a = reached.d
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT d AS doc_id, min(r) AS component_id FROM reached GROUP BY d) LEFT JOIN sizes USING (doc_id)
"""


def _bits(text: str) -> str:
    """The bits of an ASCII text, lowest first in each byte."""
    return f"list_transform(range(8 * length({text})), lambda k: (ascii(substr({text}, CAST(k // 8 + 1 AS INT), 1)) >> CAST(k % 8 AS INT)) & 1)"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({_bits(text)}, lambda b: CAST(b AS BIGINT))), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))))"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_SIDES = """coalesce(array_to_string(ds[1:idx % 16], ''), '') AS b, coalesce(array_to_string(ds[idx % 16 + 2:], ''), '') AS a"""

MERKLE = f"""
WITH RECURSIVE
rows_ AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
        CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
    FROM documents
),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS idx, count(*) OVER (PARTITION BY source) AS total FROM rows_
),
nodes(source, level, idx, digest, total) AS (
    SELECT source, 0, idx, leaf, total FROM leaves
    UNION ALL
    SELECT source, max(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(total) + 15) // 16
    FROM nodes WHERE total > 1 GROUP BY source, idx // 16
),
subs AS (
    SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS total FROM nodes WHERE total = 1
),
tops(level, idx, digest, total) AS (
    SELECT 0, idx, subroot, total FROM subs
    UNION ALL
    SELECT max(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(total) + 15) // 16
    FROM tops WHERE total > 1 GROUP BY idx // 16
),
runs AS (SELECT source, level, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM nodes GROUP BY ALL),
top_runs AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS ds FROM tops GROUP BY ALL),
walk(source, place, level, idx, total, d, proof) AS (
    SELECT source, idx, 0, idx, total, coalesce(changed, leaf), '' FROM leaves
    UNION ALL
    SELECT source, place, level + 1, idx // 16, (total + 15) // 16, sha256(b || d || a), proof || b || a
    FROM (SELECT w.*, {_SIDES} FROM walk w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.level = w.level AND r.run = w.idx // 16 WHERE w.total > 1)
),
climb(source, place, copies, level, idx, total, d, proof) AS (
    SELECT w.source, place, w.level, 0, s.idx, s.total, d, proof FROM walk w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source WHERE w.total = 1
    UNION ALL
    SELECT source, place, copies, level + 1, idx // 16, (total + 15) // 16, sha256(b || d || a), proof || b || a
    FROM (SELECT w.*, {_SIDES} FROM climb w JOIN top_runs r ON r.level = w.level AND r.run = w.idx // 16 WHERE w.total > 1)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified, CAST(copies + level + 1 AS BIGINT) AS n_copied
FROM climb c
JOIN leaves l ON l.source IS NOT DISTINCT FROM c.source AND l.idx = c.place
JOIN subs s ON s.source IS NOT DISTINCT FROM c.source
CROSS JOIN (SELECT digest AS root FROM tops WHERE total = 1)
WHERE c.total = 1
"""
