"""DuckDB SQL of the queries that SQL can express."""

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A-Z only, as the operators lower-case.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOWER.format(f"trim(line, {_TRIM})")

SQL: dict[str, str] = {}

SQL["op2_quality_rules"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE trim(line, {_TRIM}) <> '' GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d JOIN words USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
keyed AS (
  SELECT doc_id, host, {_KEY} AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM lines WHERE trim(line, {_TRIM}) <> ''),
sizes AS (SELECT host, count(DISTINCT doc_id) AS size FROM docs GROUP BY host),
above AS (
  SELECT host, key FROM keyed JOIN sizes USING (host) GROUP BY host, key, size
  HAVING count(DISTINCT doc_id) > 3 AND 100 * count(DISTINCT doc_id) > 2 * size),
lost AS (SELECT doc_id, sum(n) AS lost_words FROM keyed JOIN above USING (host, key) GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT (n_words - coalesce(lost_words, 0) < 50 OR 100 * (n_words - coalesce(lost_words, 0)) < 20 * n_words) AS kept
FROM base LEFT JOIN lost USING (doc_id)
"""

SQL["op4_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM words),
marked AS (
  SELECT p.doc_id, k, word, max(l.i) OVER (PARTITION BY p.doc_id ORDER BY k) AS last
  FROM places p LEFT JOIN late l ON l.doc_id = p.doc_id AND l.i = p.k),
kept AS (
  SELECT doc_id, count(*) FILTER (last > k - 50) AS n_removed,
    string_agg(word, ' ' ORDER BY k) FILTER (last IS NULL OR last <= k - 50) AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
  || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'
  || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Page-ID: ' || page || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""
_REPLICA = """SELECT page_id, sha256(r) AS sha, strlen(r) AS size, CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT page_id, {1} AS r FROM (SELECT *, CAST(page_id AS VARCHAR) AS page FROM {0}))"""
_DIGEST = "md5(page || ' ' || coalesce(url, ''))"

SQL["op8_warc_fixity"] = f"""
WITH kept AS (
  SELECT page_id, url,
    CASE WHEN page_id % 97 = 5 THEN html || chr(0) WHEN page_id % 193 = 7 THEN left(html, length(html) - 1) ELSE html END AS html
  FROM pages WHERE page_id % 389 <> 11),
copies AS (SELECT * FROM kept UNION ALL SELECT page_id + 1073741824, url, html FROM kept WHERE page_id % 499 = 13),
a AS ({_REPLICA.format("pages", _RECORD.format(_DIGEST))}),
b AS ({_REPLICA.format("copies", _RECORD.format(_DIGEST))})
SELECT coalesce(a.page_id, b.page_id) AS record, coalesce(a.page_id, b.page_id) // 1024 AS archive, a.start AS start_a, b.start AS start_b,
  coalesce(a.size, 0) AS size_a, coalesce(b.size, 0) AS size_b, coalesce(a.sha, '') AS sha_a, coalesce(b.sha, '') AS sha_b,
  CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.page_id = b.page_id WHERE a.sha IS DISTINCT FROM b.sha
"""

SQL["op10_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, i, line, {_KEY} AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, unnest(range(1, len(l) + 1)) AS i, l[i] AS line
        FROM documents)),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY doc_id
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL["op9_decontaminate"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, win)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL["license_phrases"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(0, len(w))) AS place, unnest(w) AS one FROM docs),
runs AS (
  SELECT doc_id, place, one || ' ' || lead(one) OVER d AS two, lead(one, 2) OVER d AS three, lead(one, 3) OVER d AS four
  FROM places WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
found AS (
  SELECT doc_id, place, CASE WHEN two = 'apache license' THEN 'apache' WHEN two = 'cc by' THEN 'cc-by' WHEN two = 'mit license' THEN 'mit' ELSE 'gpl' END AS label
  FROM runs WHERE two IN ('apache license', 'cc by', 'mit license') OR (two = 'gnu general' AND three = 'public' AND four = 'license')),
by_doc AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM found GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels
FROM docs LEFT JOIN by_doc USING (doc_id) LEFT JOIN named USING (doc_id)
"""
