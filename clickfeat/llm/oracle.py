"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# crc32 by its table: one entry per byte value, folded over the id's decimal digits.
_CRC = """
crc_bits AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_bits),
"""


def crc32(digits: str) -> str:
    """Unsigned crc32 of an expression of decimal digits; needs the ``crc`` table in scope."""
    byte = f"list_transform(range(1, length({digits}) + 1), lambda i: ascii(substr({digits}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
WITH RECURSIVE {_CRC}
leaves AS (
  SELECT doc_id, lang, {_leaf("text")} AS h,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS claimed
  FROM documents, crc),
placed AS (
  SELECT *, coalesce('v' || lang, 'n') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, n, h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8),
trees AS (SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM trees
  UNION ALL
  SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8),
root AS (SELECT h AS root, level AS height FROM top WHERE n = 1),
steps AS (
  SELECT p.doc_id, m.level, m.pos AS p, m.pos = p.pos // (8 ** m.level)::BIGINT AS own, m.h
  FROM placed p JOIN nodes m ON m.tree = p.tree AND m.n > 1 AND m.pos // 8 = p.pos // (8 ** (m.level + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, t.height + m.level, m.pos, m.pos = t.pos // (8 ** m.level)::BIGINT, m.h
  FROM placed p JOIN trees t USING (tree) JOIN top m ON m.n > 1 AND m.pos // 8 = t.pos // (8 ** (m.level + 1))::BIGINT),
runs AS (
  SELECT doc_id, level, coalesce(string_agg(h, '' ORDER BY p) FILTER (NOT own), '') AS siblings,
    list(CASE WHEN own THEN NULL ELSE h END ORDER BY p) AS run
  FROM steps GROUP BY doc_id, level),
fold AS (
  SELECT doc_id, 0 AS level, claimed AS h FROM placed
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(list_reduce(list_prepend('', list_transform(r.run, lambda x: coalesce(x, f.h))), lambda a, b: a || b))
  FROM fold f JOIN runs r ON r.doc_id = f.doc_id AND r.level = f.level),
proofs AS (SELECT doc_id, sha256(string_agg(siblings, '' ORDER BY level)) AS proof_sha256 FROM runs GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM fold GROUP BY doc_id)
SELECT p.doc_id, p.h AS leaf, t.subroot, root.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.root AS verified
FROM placed p JOIN trees t USING (tree) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), root
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10
"""


def _windows(width: int) -> str:
    """CTEs: the words of each document, and the windows that also start in a document of smaller id."""
    return f"""
w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {width}], ' ') AS g FROM w, unnest(range(len(w) - {width - 1})) t(i)),
lowest AS (SELECT g, min(doc_id) AS lo FROM windows GROUP BY g),
hits AS (SELECT doc_id, i, lo FROM windows JOIN lowest USING (g) WHERE lo < doc_id)
"""


SUFFIX_TREES = f"""
WITH {_windows(13)},
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hits, range(13) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SPARSE_SUFFIX = f"""
WITH {_windows(50)},
runs AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hits),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + 50 - min(i))::BIGINT AS n_words, min(lo) AS first_doc_id FROM numbered GROUP BY doc_id, run
"""

NN_DESCENT = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, a.e) > 0 AND list_inner_product(b.e, b.e) > 0
    AND list_inner_product(a.e, b.e) >= 0.9 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) = vec_id AS kept
FROM v
"""

SQL = {
    "op1_nn_descent": NN_DESCENT,
    "op4_suffix_trees": SUFFIX_TREES,
    "op10_sparse_suffix": SPARSE_SUFFIX,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op13_merkle_manifest": MERKLE,
}
