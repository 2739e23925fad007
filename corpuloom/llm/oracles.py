"""DuckDB SQL for the operators that SQL can express.

Not here: op5 (XXH64), op6 (tokenizer, linear program), op7 (tokenizer), op8 (keys are XXH64), op10
(a trained model), op12 (tokenizers), pipeline; tests hold those against plain versions.
"""

_WORD = r"[^\x20\x09-\x0D]+"
_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_VALUE = r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN = rf"(?i)(password|passwd|secret|token|api_?key){_VALUE}"
_USER = rf"(?i)(user_?name|user|login|account|client_id|access_key_id){_VALUE}"
_ENDPOINT = r"""(?i)(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"''<>]+"""

_KINDS = "['assign', 'access', 'hex', 'weak_assign', 'weak_access', 'user', 'endpoint']"

ORACLES: dict[str, str] = {}


def _hits(family: int, pattern: str) -> str:
    return f"""SELECT rid, {family} AS family, generate_subscripts(m, 1) AS i, unnest(m) AS x, unnest(g[1:len(m)]) AS gap
FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}'))"""


ORACLES["op1_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({_hits(0, _ASSIGN)} UNION ALL {_hits(1, 'AKIA[A-Z0-9]+')} UNION ALL {_hits(2, '[0-9a-f]{16,}')} UNION ALL {_hits(3, _USER)} UNION ALL {_hits(4, _ENDPOINT)}),
p AS (SELECT rid, family, length(x) AS n, sum(length(gap) + length(x)) OVER (PARTITION BY rid, family ORDER BY i)::INT AS e,
      CASE family WHEN 0 THEN length(regexp_extract(x, '{_ASSIGN}', 2)) WHEN 3 THEN length(regexp_extract(x, '{_USER}', 2)) ELSE length(x) END AS v FROM h),
q AS (SELECT rid, e - n AS s, e, CASE WHEN family = 0 AND v >= 12 THEN 0 WHEN family = 0 AND v >= 6 THEN 3 WHEN family = 1 AND v >= 18 THEN 1 WHEN family = 1 AND v >= 8 THEN 4
      WHEN family = 2 THEN 2 WHEN family = 3 AND v >= 3 THEN 5 WHEN family = 4 THEN 6 END AS rank FROM p),
r AS (SELECT * FROM q WHERE rank IS NOT NULL),
j AS (SELECT r.rid, r.rank, r.s, r.e, x.rank IN (0, 2, 3) AS secret,
             min(CASE WHEN x.e <= r.s THEN [r.s - x.e, 0, -x.s, -x.rank, x.s, x.e, x.rank] ELSE [x.s - r.e, 1, x.e, x.rank, x.s, x.e, x.rank] END) AS m
      FROM r JOIN r x ON x.rid = r.rid AND x.rank < 6 AND ((x.e <= r.s AND r.s - x.e <= 200) OR (x.s >= r.e AND x.s - r.e <= 200)) WHERE r.rank >= 3 GROUP BY ALL),
n AS (SELECT rid, rank, s, e, {_KINDS}[m[7] + 1] || ':' || m[5] || ':' || m[6] AS partner, secret FROM j
      WHERE CASE WHEN rank = 3 THEN NOT secret WHEN rank IN (4, 5) THEN secret ELSE true END),
k AS (SELECT rid, rank, s, e, '' AS partners FROM r WHERE rank < 3
      UNION ALL SELECT rid, rank, s, e, string_agg(partner, '+' ORDER BY secret DESC) FROM n GROUP BY rid, rank, s, e HAVING count(*) = CASE rank WHEN 6 THEN 2 ELSE 1 END),
o AS (SELECT rid, rank, s, {_KINDS}[rank + 1] || ':' || s || ':' || e AS w, partners FROM k),
a AS (SELECT rid, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank >= 3) AS n3,
      string_agg(w, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(w, ',' ORDER BY s, rank) AS spans,
      string_agg(w || '>' || partners, ',' ORDER BY s, rank) FILTER (rank >= 3) AS links FROM o GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n3, 0) AS n_linked, coalesce(links, '') AS links
FROM d LEFT JOIN a USING (rid)
"""

ORACLES["op2_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
o AS (SELECT k, min(doc_id) AS owner FROM g GROUP BY k),
m AS (SELECT doc_id, i FROM g JOIN o USING (k) WHERE owner < doc_id),
c AS (SELECT w.doc_id, word, j, coalesce(max(m.i) OVER (PARTITION BY w.doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) >= j - 49, false) AS gone
      FROM w LEFT JOIN m ON m.doc_id = w.doc_id AND m.i = w.j),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

ORACLES["op3_exact_dedup"] = rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_NORMAL} AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""

ORACLES["op4_source_mix"] = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE AS goal FROM s),
f AS (SELECT *, source_size * 2 / weight::DOUBLE AS full_level FROM w),
l AS (SELECT *, (goal - coalesce(sum(source_size * 2) OVER r, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0))::DOUBLE AS level FROM f
      WINDOW r AS (ORDER BY full_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN first_level IS NULL OR first_level > full_level THEN (source_size * 2)::DOUBLE ELSE first_level * weight END AS target
      FROM l CROSS JOIN (SELECT arg_min(level, full_level) AS first_level FROM l WHERE level <= full_level)),
u AS (SELECT *, ('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
      CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each FROM t),
k AS (SELECT d.*, u.source_size, u.target, u.u, u.each, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS place FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (floor(each * place + u) - floor(each * (place - 1) + u))::BIGINT * size AS taken,
       (floor(each * place + u) - floor(each * (place - 1) + u))::BIGINT AS copies, source FROM k
"""

ORACLES["op9_embedding_dedup"] = """
WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b
                     ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
c(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.v)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM embeddings JOIN c ON v = vec_id GROUP BY vec_id
"""

#: CRC-32 of a decimal number, byte by byte and bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT)"""

# Stretches come from places i and i + q of equal windows of 16 words (a run has one at least), q at most a third of the text.
ORACLES["op11_periodic_runs"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS o, {_CRC32} AS h FROM documents),
l AS (SELECT rid, doc_id, o, len(o)::BIGINT AS n, (h % 10 = 0 AND len(o) > 0) AS looped, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN looped THEN g % n END AS a FROM l),
p AS (SELECT *, CASE WHEN looped THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
x AS (SELECT rid, n, unnest(CASE WHEN looped THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END) AS word,
             unnest(range(0, n)) AS i FROM p),
w AS (SELECT rid, n, i, md5(string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS k FROM x WHERE n >= 24 QUALIFY i + 16 <= n),
e AS (SELECT w.rid, w.i, v.i - w.i AS q, w.i - row_number() OVER (PARTITION BY w.rid, v.i - w.i ORDER BY w.i) AS island
      FROM w JOIN w v ON v.rid = w.rid AND v.k = w.k AND v.i > w.i AND 3 * (v.i - w.i) <= w.n),
s AS (SELECT rid, q, min(i) AS s, count(*) + 15 + q AS len FROM e GROUP BY rid, q, island),
c AS (SELECT * FROM s WHERE len >= greatest(24, 3 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.rid = c.rid AND z.q < c.q AND c.q % z.q = 0 AND z.s <= c.s AND z.s + z.len >= c.s + c.len)),
b AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM r GROUP BY rid),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len::DOUBLE / q DESC, s, q) = 1),
g AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM r),
k AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS gone FROM x LEFT JOIN g ON g.rid = x.rid AND g.i = x.i GROUP BY x.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
       sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words, coalesce(gone, 0) AS n_dropped
FROM p LEFT JOIN b USING (rid) LEFT JOIN f USING (rid) LEFT JOIN k USING (rid)
"""

_BASE32 = "list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (10 * (i // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), lambda s, t: s || t)"

ORACLES["op13_warc_transactions"] = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, first_value(page_id) OVER w AS origin, row_number() OVER w > 1 AS again FROM p WINDOW w AS (PARTITION BY t ORDER BY page_id NULLS LAST))
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN origin END AS refers_to, 1 AS n_requests, nullif(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), '') AS target_uri
FROM r
"""
