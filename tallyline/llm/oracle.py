"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

# A-Z only, as the contracts say; lower() would change other letters too.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{WORD}'), []) AS w FROM documents
), shingles AS (
    SELECT doc_id, CASE WHEN len(w) >= 5
        THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM words
), items AS (
    SELECT doc_id, unnest(s) AS item FROM shingles
), overlap AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM items x JOIN items y ON x.item = y.item AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM overlap JOIN shingles p ON p.doc_id = a JOIN shingles q ON q.doc_id = b
    WHERE 100 * common >= 85 * (len(p.s) + len(q.s) - common)
), reached(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.seen
), named AS (
    SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM shingles JOIN named USING (doc_id)
"""

CONTAINED_ITEMS = r"""
WITH texts AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
    SELECT kind, id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM texts
), shingles AS (
    SELECT kind, id, CASE WHEN len(w) >= 5
        THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM words
), items AS (
    SELECT kind, id, len(s) AS n, unnest(s) AS item FROM shingles
)
SELECT d.id AS doc_id, b.id AS item_id, b.n::INTEGER AS n_item, count(*)::INTEGER AS n_shared,
    count(*) / b.n::DOUBLE AS containment
FROM items d JOIN items b ON d.kind = 'd' AND b.kind = 'b' AND d.item = b.item
GROUP BY d.id, b.id, b.n
HAVING 100 * count(*) >= 80 * b.n
"""

SHARED_LINES = """
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents
), shared AS (
    SELECT trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5
), marked AS (
    SELECT doc_id, place, lines.line, shared.line IS NOT NULL AS gone
    FROM lines LEFT JOIN shared ON trim(lines.line) = shared.line
)
SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed,
    md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS clean_md5
FROM marked GROUP BY doc_id
"""

EXACT_TOPK = """
WITH whole AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

# The checksum bit by bit, for there is no function of this name.
CRC32 = """xor(list_reduce([ascii(x) FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, b: list_reduce(range(8)::BIGINT[],
    lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b::BIGINT)), 4294967295), 4294967295)"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


MERKLE_MANIFEST = f"""
WITH RECURSIVE rows AS (
    SELECT *, CASE WHEN crc32 % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS received FROM (
        SELECT doc_id, source, lang, n_chars, text, coalesce({CRC32}, 1) AS crc32 FROM documents
    )
), leaves AS (
    SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(front || {_field('text')}) AS leaf,
        sha256(front || {_field('received')}) AS other
    FROM (SELECT *, {_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} AS front FROM rows)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes(tree, level, place, h, size) AS (
    SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM placed
    UNION ALL
    SELECT tree, any_value(level) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(size) + 2) // 3
    FROM nodes WHERE size > 1 GROUP BY tree, place // 3
), subroots AS (
    SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE size = 1
), tops(level, place, h, size) AS (
    SELECT 0, place, subroot, count(*) OVER () FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(size) + 2) // 3
    FROM tops WHERE size > 1 GROUP BY place // 3
), rooted AS (
    SELECT placed.*, subroot, subroots.place AS upper, (SELECT h FROM tops WHERE size = 1) AS root,
        row_number() OVER () AS row_no
    FROM placed JOIN subroots USING (tree)
), steps AS (
    SELECT row_no, 0 AS part, level, string_agg(h, '' ORDER BY n.place) FILTER (n.place < r.place // power) AS before,
        string_agg(h, '' ORDER BY n.place) FILTER (n.place > r.place // power) AS after
    FROM (SELECT *, unnest(range(40)) AS up FROM rooted) r
    JOIN (SELECT *, (3::HUGEINT ** level)::BIGINT AS power FROM nodes WHERE size > 1) n
        ON n.tree = r.tree AND n.level = up AND n.place // 3 = r.place // power // 3
    GROUP BY ALL
), upper_steps AS (
    SELECT row_no, 1 AS part, level, string_agg(h, '' ORDER BY n.place) FILTER (n.place < r.upper // power) AS before,
        string_agg(h, '' ORDER BY n.place) FILTER (n.place > r.upper // power) AS after
    FROM (SELECT *, unnest(range(40)) AS up FROM rooted) r
    JOIN (SELECT *, (3::HUGEINT ** level)::BIGINT AS power FROM tops WHERE size > 1) n
        ON n.level = up AND n.place // 3 = r.upper // power // 3
    GROUP BY ALL
), ways AS (
    SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY part, level) AS step,
        coalesce(before, '') AS before, coalesce(after, '') AS after
    FROM (FROM steps UNION ALL FROM upper_steps)
), folds(row_no, step, h) AS (
    SELECT row_no, 0, other FROM rooted
    UNION ALL
    SELECT folds.row_no, folds.step + 1, sha256(before || h || after)
    FROM folds JOIN ways ON ways.row_no = folds.row_no AND ways.step = folds.step + 1
), proofs AS (
    SELECT row_no, sha256(coalesce(string_agg(before || after, '' ORDER BY step), '')) AS proof_sha256
    FROM rooted LEFT JOIN ways USING (row_no) GROUP BY row_no
), ends AS (
    SELECT row_no, arg_max(h, step) AS folded_root FROM folds GROUP BY row_no
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM rooted JOIN proofs USING (row_no) JOIN ends USING (row_no)
"""

ORACLE_SQL: dict[str, str] = {
    "op13_merkle_manifest": MERKLE_MANIFEST,
    "op5_exact_topk": EXACT_TOPK,
    "op4_contained_items": CONTAINED_ITEMS,
    "op9_shared_lines": SHARED_LINES,
    "op8_near_duplicates": NEAR_DUPLICATES,
}
