"""DuckDB SQL of the operators that SQL can express."""

_SIZE = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"

# The same order, targets and cut as sparkwire.llm.mixing, with windows over whole sources.
_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, {_SIZE} AS size,
    coalesce(1.0 / (1.0 + CAST(4 * (length(text) - length(translate(text, '#*$%&|<>', ''))) AS DOUBLE) / greatest({_SIZE}, 1)), 1.0) AS w,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':17'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / w AS e FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
a AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, source_size * 3.0 AS lim FROM s),
b AS (SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER up, 0) AS left_words, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS rest_w
  FROM a WINDOW up AS (ORDER BY lim / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(left_words / rest_w, lim / w) AS level FROM b WHERE left_words / rest_w * w <= lim),
t AS (SELECT source, source_size, CAST(CASE WHEN level IS NULL THEN lim ELSE least(lim, level * w) END AS DOUBLE) AS target FROM b, l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
o AS (SELECT k.*, n.source_size, n.target, n.epochs, n.target - n.epochs * n.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY e, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, size, source_size, target, epochs, CAST(epochs * size + CASE WHEN before + size / 2.0 <= rest THEN size ELSE 0 END AS BIGINT) AS taken FROM o
"""

# Every pair of documents with a shingle in common is compared; components are the closure of the links.
_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS root FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.root = e.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.root, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.root, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

_COSINE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r AS (SELECT a AS node, b AS root FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.root, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.root, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""

_CRC32 = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST({c} AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST({c} AS VARCHAR), i, 1)) AS BIGINT))),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda z, i: xor(z >> 1, 3988292384 * (z & 1))))"""

# Prefixes are whole lists of turns, compared as such; a node's subtree is every prefix that begins with its list.
_TRIE = rf"""
WITH o AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 5 AS base, xor({_CRC32.format(c="c")}, 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM o)),
l AS (SELECT c, list(turn ORDER BY place) AS turns FROM o GROUP BY 1),
b AS (SELECT h.c, list_concat(coalesce(x.turns, [])[1:h.h], l.turns[h.h + 1:]) AS path FROM h JOIN l ON l.c = h.c LEFT JOIN l x ON x.c = h.base),
m AS (SELECT c, len(path) AS n, path[1:d] AS pre, d, len(path) = d AS is_end FROM b, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)),
n AS (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(pre[-1].t) END AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends FROM m GROUP BY pre, d),
k AS (SELECT x.*, (SELECT count(*) FROM n y WHERE y.d = x.d + 1 AND y.pre[1:x.d] = x.pre) AS n_children FROM n x),
s AS (SELECT a.pre, a.d, sum(z.bytes * (z.n_convs - 1)) AS saved, count(*) FILTER (WHERE z.n_children = 0) AS leaves
  FROM (SELECT pre, d, unnest(range(0, d + 1)) AS up, bytes, n_convs, n_children FROM k) z JOIN n a ON a.d = z.up AND a.pre = z.pre[1:z.up] GROUP BY 1, 2)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.pre = k.pre LEFT JOIN n p ON p.d = k.d - 1 AND p.pre = k.pre[1:k.d - 1]
"""

SQL: dict[str, str] = {"op1_minhash_near_dedup": _NEAR, "op2_collision_counting": _COSINE, "op8_source_mixing": _MIX, "op12_prefix_trie": _TRIE}
