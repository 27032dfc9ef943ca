"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), windows AS (
  SELECT rid, i, w[i:i + 7] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)
), twins AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM twins) GROUP BY rid
), figures AS (
  SELECT doc_id, text, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > n_words
    OR 10 * len(regexp_extract_all(text, '\p{{Lu}}')) > 4 * word_chars
    OR 10 * len(regexp_extract_all(text, '!')) > 3 * n_words
    OR 10 * len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) > 2 * n_words
    OR 10 * n_dup_lines > 5 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words AS rejected
  FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""

OP7 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::UBIGINT), 60, '0') AS h FROM documents
), p AS (
  SELECT rid, doc_id, bytes, d, substr(h, 1, d) AS prefix FROM (SELECT *, unnest(generate_series(0, 60)) AS d FROM d)
), s AS (
  SELECT *, sum(bytes) OVER w AS shard_bytes, count(*) OVER w AS n_docs FROM p WINDOW w AS (PARTITION BY d, prefix)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d) AS r FROM s WHERE shard_bytes <= 1048576 OR n_docs = 1
)
SELECT doc_id, bytes, prefix AS shard, d::INT AS depth, shard_bytes::BIGINT AS shard_bytes, n_docs FROM f WHERE r = 1
"""

# Base32 of a SHA-1: 160 bits as 32 groups of five.
OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i: lpad(bin(('0x' || hex[i + 1])::UTINYINT), 4, '0')), '') AS bits, max(page_id) OVER (PARTITION BY hex) AS first FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM b
"""
