"""DuckDB SQL for the queries of this subpackage that SQL can express."""

NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, CAST(min(r.y) AS BIGINT) AS component_id
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(sh)
"""

EXACT_TOPK = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, arg_min(v, x) AS v FROM (SELECT *, {'n': len(v), 'v': v} AS x FROM v) WHERE vec_id % 20 = 0 GROUP BY 1),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM r WHERE r <= 20
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A place is where a phrase's words stand one after another, counted from 0. Each word has blanks of its own, so texts split at a
#: phrase lose nothing of the next.
LICENSE_BASE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p(phrase, n, label) AS (VALUES (' gnu  general  public  license ', 4, 'gpl'), (' apache  license ', 2, 'apache'), (' cc  by ', 2, 'cc-by'), (' mit  license ', 2, 'mit')),
x AS (SELECT doc_id, len(ws) AS all_words, n, label, string_split(' ' || array_to_string(ws, '  ') || ' ', phrase) AS parts FROM w, p),
h AS (SELECT doc_id, label, len(parts) - 1 AS places, len(regexp_extract_all(parts[1], '[^ ]+')) AS lo, all_words - n - len(regexp_extract_all(parts[-1], '[^ ]+')) AS hi FROM x WHERE len(parts) > 1),
g AS (SELECT doc_id, CAST(sum(places) AS BIGINT) AS n_base, min(lo) AS first_word, max(hi) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""

MIX_BASE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
r AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0::DOUBLE * n AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM r),
l AS (SELECT max(((SELECT sum(n) FROM s) - caps) / ws) AS level FROM o)
SELECT doc_id, size, n AS source_size, round(least(cap, level * w), 4) AS target FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source, l
"""

#: crc32 of a decimal number bit by bit: a code is mixed in, -1 is one step.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

LM_BASE = rf"""
WITH w AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, list_append(regexp_extract_all({_LOWER}, '[^ 	-
]+'), NULL) AS ws FROM documents),
h AS (SELECT *, coalesce({_CRC32} % 7 = 2, FALSE) AS held_out FROM w),
t AS (SELECT doc_id, held_out, coalesce(unnest(ws), chr(10)) AS x FROM h),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), a AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, max(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (x), a GROUP BY 1, 2
"""

FINGERPRINT_BASE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(next, 1, length(t) // 2)) AS edited_sha256 FROM d
"""

SHARD_BASE = "SELECT CAST(40 AS BIGINT) AS shards, count(*) AS rows, CAST(sum(strlen(coalesce(text, '')) + 16) AS BIGINT) AS bytes, TRUE AS gapless FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": NGRAM_JACCARD_JOIN, "op7_exact_topk": EXACT_TOPK, "license_base": LICENSE_BASE, "mix_base": MIX_BASE, "lm_base": LM_BASE, "fingerprint_base": FINGERPRINT_BASE, "shard_base": SHARD_BASE}
