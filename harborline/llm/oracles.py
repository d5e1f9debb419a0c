"""SQL that must give the rows of those corpus queries that SQL can express."""

from __future__ import annotations

# CRC-32 as a table: `v` of (k, b) is what byte b adds with k bytes behind it, and of (n, 256) what n bytes make of the
# start value. The checksum of a text is the exclusive or over its bytes.
_CRC = """
crc_bits(i, b, v) AS (
  SELECT 0, range, range FROM range(256)
  UNION ALL
  SELECT i + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE i < 8
),
crc_first AS (SELECT b, v FROM crc_bits WHERE i = 8),
crc_table(k, b, v) AS (
  SELECT 0::BIGINT, b, v FROM crc_first
  UNION ALL
  SELECT 0::BIGINT, 256, 4294967295
  UNION ALL
  SELECT t.k + 1, t.b, xor(f.v, t.v >> 8) FROM crc_table t JOIN crc_first f ON f.b = t.v & 255
  WHERE t.k < (SELECT max(strlen(s)) FROM crc_texts)
),
crc_bytes AS (
  SELECT s, strlen(s) AS n, ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT AS b, n - 1 - i AS k
  FROM (SELECT s, unnest(range(strlen(s))) AS i FROM crc_texts)
),
crc AS (
  SELECT c.s, xor(xor(bit_xor(t.v), any_value(e.v)), 4294967295) AS crc
  FROM crc_bytes c JOIN crc_table t ON t.k = c.k AND t.b = c.b JOIN crc_table e ON e.k = c.n AND e.b = 256
  GROUP BY c.s
)"""

IMPORTANCE_RESAMPLING = r"""
WITH RECURSIVE
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
),
words AS (
  SELECT side, r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    []) AS w
  FROM texts
),
grams AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM words
),
crc_texts AS (SELECT DISTINCT s FROM grams),""" + _CRC + """,
placed AS (SELECT g.side, g.r, c.crc % 10000 AS bucket, count(*) AS n FROM grams g JOIN crc c USING (s) GROUP BY ALL),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM placed GROUP BY bucket
),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts, totals
),
sums AS (
  SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
),
scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_features,
    coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    (('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM words w LEFT JOIN sums USING (r) WHERE w.side = 'd'
),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS fit
  FROM noisy
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank
FROM ranked"""

PREFIX_TRIE = """
WITH RECURSIVE
crc_texts AS (SELECT DISTINCT conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),""" + _CRC + """,
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
lists AS (
  SELECT conv_id, list(sha256(len(role) || ':' || role || text) ORDER BY pos) AS marks,
    list(strlen(text) ORDER BY pos) AS sizes
  FROM turns GROUP BY conv_id
),
joined AS (
  SELECT l.conv_id, list_concat(coalesce(b.marks[1:h], []), l.marks[h + 1:]) AS marks,
    list_concat(coalesce(b.sizes[1:h], []), l.sizes[h + 1:]) AS sizes
  FROM (SELECT lists.*, crc % 9 AS h FROM lists JOIN crc ON s = conv_id::VARCHAR) l
  LEFT JOIN lists b ON b.conv_id = l.conv_id - ((l.conv_id % 5) + 5) % 5
),
paths AS (
  SELECT conv_id, d AS depth, len(marks) AS length, sha256(array_to_string(marks[1:d], '')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(marks[1:d - 1], '')) END AS parent, coalesce(sizes[d], 0) AS size
  FROM (SELECT *, unnest(range(len(marks) + 1)) AS d FROM joined)
),
nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM paths GROUP BY depth, node
),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
tree AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
under(top, node) AS (
  SELECT node, node FROM tree
  UNION ALL
  SELECT u.top, t.node FROM under u JOIN tree t ON t.parent = u.node
),
sums AS (
  SELECT u.top, count(*) FILTER (t.n_children = 0) AS n_leaves, sum((t.n_convs - 1) * t.size)::BIGINT AS saved_tokens
  FROM under u JOIN tree t ON t.node = u.node GROUP BY u.top
)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens, t.ends_sha256
FROM tree t JOIN sums s ON s.top = t.node LEFT JOIN tree p ON p.node = t.parent"""
