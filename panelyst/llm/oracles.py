"""DuckDB SQL of those corpus queries that SQL expresses."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS h FROM d WHERE len(w) >= 13),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (h) WHERE lo < doc_id),
r AS (SELECT doc_id, list(j) AS js FROM c GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: md5(array_to_string(w[i:i + 2], ' ')))) AS h FROM d WHERE len(w) >= 3),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM k WHERE n > 1) GROUP BY 1),
f AS (SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines,
  length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 20 > word_chars OR word_chars > n_words * 20 OR word_chars < n_words * 2 OR n_repeat_words * 10 > n_words * 3 OR n_dup_lines * 10 > n_lines * 3 OR upper * 2 > letters OR letters * 2 < word_chars) AS kept
FROM b"""

_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents), b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS h FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: md5(array_to_string(w[i:i + n - 1], ' ')))) AS h FROM d, s WHERE len(w) >= n),
m AS (SELECT g.doc_id, g.n, g.i, p.item FROM g JOIN p USING (n, h)),
c AS (SELECT doc_id, count(DISTINCT j) AS hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY 1),
q AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)"""
