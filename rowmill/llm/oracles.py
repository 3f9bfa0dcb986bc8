"""SQL, for DuckDB, of the queries that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id
FROM documents JOIN r ON documents.doc_id = r.x LEFT JOIN n ON n.doc_id = documents.doc_id GROUP BY documents.doc_id, n.n
"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {10 * k + 1}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT, 1)" for k in range(4) for j in range(8))
OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
k AS (SELECT *, CASE WHEN p + 19 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) END AS k FROM t),
a AS (SELECT *, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS again FROM k),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM a)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, d.w
"""

OP7 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
t AS (SELECT doc_id, unnest(range(1, octet_length(b) + 1)) AS p, octet_length(b) AS n, b FROM d),
k AS (SELECT doc_id, p, hex(b[p:p]) AS x, CASE WHEN p + 399 <= n THEN md5(b[p:p + 399]) END AS k FROM t),
a AS (SELECT doc_id, p, x, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS again FROM k),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM a),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 THEN 1 ELSE 0 END AS opens FROM c)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, coalesce(sum(opens), 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE gone = 0), ''))) AS kept_sha256
FROM d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id, d.b
"""
