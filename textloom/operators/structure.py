"""Tags, content flags, brackets, sentences, numbers (survey 2.6 to 2.8)."""

_TAGS = "SELECT page_id, n, element_at_1(tags, n) AS tag FROM (SELECT page_id, tags, explode(sequence(1, size(tags))) AS n FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>', 0) AS tags FROM @pages) WHERE size(tags) > 0)"
_CHARS = "SELECT doc_id, n, element_at_1(cs, n) AS c FROM (SELECT doc_id, cs, explode(sequence(1, size(cs))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?s).', 0) AS cs FROM @documents) WHERE size(cs) > 0)"
_SENT = "SELECT doc_id, explode(regexp_extract_all(text, '[^.?!]+[.?!]', 0)) AS s FROM @documents"
_STEP = "CASE WHEN c IN ('(', '[', '{') THEN 1 WHEN c IN (')', ']', '}') THEN -1 ELSE 0 END"

QUERIES = {
    "tags": f"SELECT page_id, n, tag FROM ({_TAGS})",
    "tag_depth": f"SELECT page_id, n, CAST(sum(CASE WHEN rlike(tag, '^</') THEN -1 WHEN rlike(tag, '^<[a-zA-Z]') AND NOT rlike(tag, '/>$') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth FROM ({_TAGS})",
    "tag_counts": f"SELECT name, count(*) AS n FROM (SELECT regexp_extract(tag, '^</?([a-zA-Z0-9]+)', 1) AS name FROM ({_TAGS})) GROUP BY name",
    "content_flags": "SELECT doc_id, rlike(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS has_date, rlike(text, '[0-9]{2}:[0-9]{2}') AS has_time, rlike(text, '[0-9]+') AS has_number, rlike(text, 'https?://') AS has_url, rlike(text, '[A-Za-z0-9.]+@[a-z0-9]+') AS has_mail FROM @documents",
    "table_cells": "SELECT page_id, n, size(regexp_extract_all(line, '<t[dh]', 0)) AS cells, lag(size(regexp_extract_all(line, '<t[dh]', 0))) OVER (PARTITION BY page_id ORDER BY n) AS above FROM (SELECT page_id, n, element_at_1(split_lines(html), n) AS line FROM (SELECT page_id, html, explode(sequence(1, size(split_lines(html)))) AS n FROM @pages))",
    "first_char_above": "SELECT page_id, n, substr(line, 1, 1) AS first_char, lag(substr(line, 1, 1)) OVER (PARTITION BY page_id ORDER BY n) AS above FROM (SELECT page_id, n, element_at_1(split_lines(html), n) AS line FROM (SELECT page_id, html, explode(sequence(1, size(split_lines(html)))) AS n FROM @pages))",
    "bracket_depth": f"SELECT doc_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(max(CASE WHEN last = 1 THEN depth END) AS BIGINT) AS open_at_end FROM (SELECT doc_id, sum({_STEP}) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS last FROM ({_CHARS})) GROUP BY doc_id",
    "record_distance": f"SELECT doc_id, gap, count(*) AS votes FROM (SELECT doc_id, n - b1 AS gap, b1 - b2 AS g2, b2 - b3 AS g3 FROM (SELECT doc_id, n, lag(n, 1) OVER w AS b1, lag(n, 2) OVER w AS b2, lag(n, 3) OVER w AS b3 FROM ({_CHARS}) WINDOW w AS (PARTITION BY doc_id, c ORDER BY n))) WHERE gap = g2 AND g2 = g3 GROUP BY doc_id, gap",
    "distance_to_char": f"SELECT doc_id, CAST(sum(d) AS BIGINT) AS total, CAST(max(d) AS BIGINT) AS longest FROM (SELECT doc_id, least(n - max(CASE WHEN c = ' ' THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 255) AS d FROM ({_CHARS})) GROUP BY doc_id",
    "sentence_types": f"SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN rlike(s, '[?]$') THEN 1 ELSE 0 END) AS BIGINT) AS questions, CAST(sum(CASE WHEN rlike(s, '!$') THEN 1 ELSE 0 END) AS BIGINT) AS exclamations FROM ({_SENT}) GROUP BY doc_id",
    "sentence_words": f"SELECT doc_id, CAST(sum(size(regexp_extract_all(s, '[^ \\\\n]+', 0))) AS BIGINT) AS words, CAST(max(length(s)) AS BIGINT) AS longest FROM ({_SENT}) GROUP BY doc_id",
    "paragraph_counts": "SELECT doc_id, size(split_lines(text)) AS paragraphs, CAST(length(text) - length(replace(text, ',', '')) AS BIGINT) AS commas FROM @documents",
    "number_tracking": "SELECT doc_id, n, v, length(z) > length(y) OR (length(z) = length(y) AND z > y) AS rising, digits FROM (SELECT doc_id, n, v, length(v) AS digits, regexp_replace(v, '^0+', '') AS z, lag(regexp_replace(v, '^0+', '')) OVER (PARTITION BY doc_id ORDER BY n) AS y FROM (SELECT doc_id, n, element_at_1(vs, n) AS v FROM (SELECT doc_id, vs, explode(sequence(1, size(vs))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+', 0) AS vs FROM @documents) WHERE size(vs) > 0)))",
    "since_last_capital": "SELECT doc_id, n, n - max(CASE WHEN rlike(w, '^[A-Z]') THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM (SELECT doc_id, n, element_at_1(ws, n) AS w FROM (SELECT doc_id, ws, explode(sequence(1, size(ws))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\\\n]+', 0) AS ws FROM @documents) WHERE size(ws) > 0))",
    "word_history": "SELECT conv_id, turn, n, w, lag(w, 1) OVER (PARTITION BY conv_id, turn ORDER BY n) AS w1, lag(w, 2) OVER (PARTITION BY conv_id, turn ORDER BY n) AS w2 FROM (SELECT conv_id, turn, n, element_at_1(ws, n) AS w FROM (SELECT conv_id, turn, ws, explode(sequence(1, size(ws))) AS n FROM (SELECT conv_id, turn, regexp_extract_all(fold(text), '[a-z]+', 0) AS ws FROM @conversations) WHERE size(ws) > 0))",
    "leading_integer": "SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), 0) AS id FROM @pages",
    "discretise": "SELECT event_id, CAST(floor(1 + 65534 * (value / (value + 1))) AS BIGINT) AS q, CAST(greatest(-2047, least(2047, CAST(floor(value * 10) AS BIGINT))) AS BIGINT) AS clipped FROM @events WHERE value >= 0",
    "ilog": "SELECT o_orderkey, CAST(length(regexp_replace(bin_of(o_orderkey), '^0+', '')) - 1 AS BIGINT) AS ilog2, CAST(bit_count(o_orderkey) AS BIGINT) AS ones FROM @orders WHERE o_orderkey > 0",
}
