"""DuckDB twins of the training-data queries that SQL can state.

They are plain restatements of the contracts: exhaustive scores, every tree
level in full, every pair of sets that share a shingle.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: Lower-cases A-Z only.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE["op11_lexical_search"] = f"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERM}') AS ws FROM documents),
docs AS (SELECT d, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
asked AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
item_terms AS (
  SELECT q, item_id, term, count(*) AS c
  FROM (SELECT q, item_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERM}')) AS term FROM asked) GROUP BY ALL),
tf AS (
  SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(ws) AS term FROM docs)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, big_n),
gains AS (SELECT d, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l))) AS g FROM tf, total),
scores AS (
  SELECT q, item_id, d, doc_id, CAST(sum(c * w * g) AS BIGINT) AS score
  FROM item_terms JOIN weights USING (term) JOIN gains USING (term) GROUP BY ALL HAVING sum(c * w * g) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS "rank", doc_id, score
FROM scores QUALIFY "rank" <= 10
"""


def _field(name: str) -> str:
    value = f"CAST({name} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([_field('doc_id'), _field('source'), _field('lang'), _field('n_chars'), _field(text)])})"


#: crc32 of the decimal digits of doc_id: a byte at a time, each by eight shifts.
CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: ascii(b)::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf,
    CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS start
  FROM (SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf(LOWER.format("text"))} AS changed, {CRC} AS crc FROM documents)),
tree AS (
  SELECT lang, 0 AS level, pos, leaf AS node FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM tree
  GROUP BY lang, level, pos // 8
  HAVING (SELECT count(*) FROM leaves l WHERE l.lang IS NOT DISTINCT FROM tree.lang) > 8 ** level),
subroots AS (
  SELECT t.lang, node, row_number() OVER (ORDER BY encode(t.lang) NULLS FIRST) - 1 AS pos
  FROM tree t JOIN (SELECT lang, max(level) AS level FROM tree GROUP BY lang) m ON t.lang IS NOT DISTINCT FROM m.lang AND t.level = m.level),
upper_tree AS (
  SELECT 0 AS level, pos, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_tree
  GROUP BY level, pos // 8 HAVING (SELECT count(*) FROM subroots) > 8 ** level),
root AS (SELECT node AS root FROM upper_tree ORDER BY level DESC LIMIT 1),
nodes AS (
  SELECT lang, false AS up, level, pos, node FROM tree
  UNION ALL SELECT NULL, true, level, pos, node FROM upper_tree),
depth AS (SELECT lang, max(level) AS d FROM tree GROUP BY lang),
places AS (
  SELECT l.doc_id, l.lang, l.pos AS leaf_pos, false AS up, k AS level, k AS step, l.pos // CAST(8 ** k AS BIGINT) AS pos
  FROM leaves l JOIN depth ON l.lang IS NOT DISTINCT FROM depth.lang, LATERAL (SELECT unnest(range(d)) AS k)
  UNION ALL
  SELECT l.doc_id, l.lang, l.pos, true, k, d + k, s.pos // CAST(8 ** k AS BIGINT)
  FROM leaves l JOIN depth ON l.lang IS NOT DISTINCT FROM depth.lang JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang,
    LATERAL (SELECT unnest(range((SELECT max(level) FROM upper_tree))) AS k)),
proofs AS (
  SELECT p.lang, p.leaf_pos, p.step,
    coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos < p.pos), '') AS before,
    coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos > p.pos), '') AS after
  FROM places p JOIN nodes n ON n.up = p.up AND n.level = p.level AND n.pos // 8 = p.pos // 8 AND (p.up OR n.lang IS NOT DISTINCT FROM p.lang)
  GROUP BY p.lang, p.leaf_pos, p.step),
fold AS (
  SELECT lang, pos AS leaf_pos, 0::BIGINT AS step, start AS node FROM leaves
  UNION ALL
  SELECT f.lang, f.leaf_pos, f.step + 1, sha256(p.before || f.node || p.after)
  FROM fold f JOIN proofs p ON f.lang IS NOT DISTINCT FROM p.lang AND f.leaf_pos = p.leaf_pos AND f.step = p.step),
folded AS (SELECT lang, leaf_pos, arg_max(node, step) AS folded_root FROM fold GROUP BY ALL),
digest AS (SELECT lang, leaf_pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM proofs GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.node AS subroot, root, coalesce(g.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = root AS verified
FROM root, leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN folded f ON l.lang IS NOT DISTINCT FROM f.lang AND l.pos = f.leaf_pos
LEFT JOIN digest g ON l.lang IS NOT DISTINCT FROM g.lang AND l.pos = g.leaf_pos
"""

ORACLE["op13_minhash"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS grams
  FROM words),
keyed AS (SELECT doc_id, list_sort(grams) AS grams, min(doc_id) OVER (PARTITION BY list_sort(grams)) AS rep FROM sets),
reps AS (SELECT doc_id AS rep, len(grams) AS n, grams FROM keyed WHERE doc_id = rep AND len(grams) > 0),
entries AS (SELECT rep, n, unnest(grams) AS gram FROM reps),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM entries a JOIN entries b ON a.gram = b.gram AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT rep AS node, rep AS other FROM reps
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  doc_id = coalesce(component_id, doc_id) AS kept
FROM keyed LEFT JOIN comp ON len(grams) > 0 AND comp.node = keyed.rep
"""
