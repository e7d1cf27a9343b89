"""SQL of those queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM windows JOIN twice USING (s)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def _components(links: str, nodes: str, key: str) -> str:
    """The least key that links reach, for `nodes(key)` and symmetric `links(u, v)`."""
    return f"""
reach(u, v) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT reach.u, links.v FROM reach JOIN {links} AS links ON reach.v = links.u),
component AS (SELECT u AS {key}, min(v) AS component_id FROM reach GROUP BY u)"""


NEAR_DOCUMENTS = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {WORDS}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS m, b.n AS n, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common WHERE 100 * shared >= 80 * (m + n - shared)),
{_components("links", "sets", "doc_id")}
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN component USING (doc_id)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
degree AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u),
{_components("links", "embeddings", "vec_id")}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

NEAREST = """
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, score
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) q
JOIN (SELECT vec_id, embedding::DOUBLE[] AS f FROM embeddings) c ON c.vec_id <> q.vec_id
CROSS JOIN LATERAL (SELECT list_cosine_similarity(e, f) AS score) QUALIFY rank <= 5
"""

EXACT = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM texts WINDOW g AS (PARTITION BY t)
"""

# The checksum of a text: byte by byte through a table that follows from the polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([c] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY c) AS t
  FROM (SELECT unnest(range(256)) AS c))"""


def _crc(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {codes}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) GROUP BY 1, 2),
hashed AS (SELECT w, c, {_crc("doc_id || ':' || w")} AS h FROM runs, crc_table WHERE length(w) >= 5),
words AS (
  SELECT w, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS w, c FROM hashed)
  WHERE length(w) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
places AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words),
holes AS (SELECT DISTINCT w, left(w, i - 1) || substr(w, i + 1) AS x FROM places),
masks AS (SELECT w, i, left(w, i - 1) || '?' || substr(w, i + 1) AS x FROM places),
shorter AS (SELECT h.w AS a, v.w AS b FROM holes h JOIN words v ON v.w = h.x),
near AS (
  SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
  UNION ALL SELECT m.w, o.w FROM masks m JOIN masks o ON m.i = o.i AND m.x = o.x AND m.w <> o.w),
found AS (
  SELECT a AS w, count(*) AS n_near, arg_min(b, row(-v.n, b)) AS best, max(v.n) AS best_n FROM near JOIN words v ON v.w = b GROUP BY 1),
forms AS (
  SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN found USING (w)),
steps(w, last) AS (SELECT w, w FROM forms UNION ALL SELECT s.w, f.form FROM steps s JOIN forms f ON f.w = s.last WHERE f.form IS NOT NULL),
ends AS (SELECT s.w, s.last AS root FROM steps s JOIN forms f ON f.w = s.last WHERE f.form IS NULL)
SELECT w AS word, form, root, n, n_near, form_n FROM forms JOIN ends USING (w)
"""
