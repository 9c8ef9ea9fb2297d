"""DuckDB SQL for the queries that SQL can express over whole tables."""

#: Words between ASCII white space, and between ASCII other than digits and letters.
PLAIN = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lists),
windows AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS win, count(*) OVER w AS n FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
judged AS (SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY n = 20, win ORDER BY doc_id, pos) > 1 AS again FROM windows),
marked AS (SELECT doc_id, pos, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM lists LEFT JOIN sums USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all({LOWER}, '{PLAIN}') AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS k, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lists),
runs AS (SELECT doc_id, k, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words),
sets AS (SELECT DISTINCT doc_id, s FROM runs WHERE pos <= greatest(k - 5, 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, regexp_extract_all({LOWER}, '{LETTERS}') AS ws FROM benchmark),
starts AS (SELECT item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) AS s FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s + 1 : s + 10], ' ') AS win FROM starts),
lists AS (SELECT doc_id, regexp_extract_all({LOWER}, '{LETTERS}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lists),
runs AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM words),
found AS (SELECT doc_id, pos, r.k, item_id FROM (SELECT doc_id, pos, k, array_to_string(run[1:k], ' ') AS win FROM runs, (SELECT DISTINCT k FROM windows) WHERE len(run) >= k) r JOIN windows USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lists LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""

WARC = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head,
  array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS b FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + substr(b, 5 * i + 1, 1)::INT * 16 + substr(b, 5 * i + 2, 1)::INT * 8 + substr(b, 5 * i + 3, 1)::INT * 4 + substr(b, 5 * i + 4, 1)::INT * 2 + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
FROM bits
"""

SQL = {"op1_substring_dedup": SUBSTRING_DEDUP, "op3_jaccard_join": JACCARD_JOIN, "op6_decontamination": DECONTAMINATION, "op8_warc": WARC}
