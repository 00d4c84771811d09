"""Lines, sections, blocks and predicates on them (survey 2.2)."""

LINES = "SELECT doc_id, CAST(n - 1 AS BIGINT) AS line_no, list_line AS line FROM (SELECT doc_id, n, element_at_1(split_lines(text), n) AS list_line FROM (SELECT doc_id, text, explode(sequence(1, size(split_lines(text)))) AS n FROM @documents))"

QUERIES = {
    "line_split": LINES,
    "line_split_stats": f"SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(max(length(line)) AS BIGINT) AS longest FROM ({LINES}) GROUP BY doc_id",
    "newline_offset": "SELECT doc_id, n, CAST(CASE WHEN n = 0 THEN 0 WHEN size(split_lines(text)) - 1 < n THEN length(text) ELSE length(array_join(slice_first(split_lines(text), n), 'x')) + 1 END AS BIGINT) AS at FROM (SELECT doc_id, text, explode(sequence(0, 4)) AS n FROM @documents)",
    "section_split": f"SELECT doc_id, line_no, CASE WHEN line_no < 1 THEN 'intro' WHEN line_no < 3 THEN 'main' ELSE 'coda' END AS section, length(line) AS n FROM ({LINES})",
    "section_restore_order": f"SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN line_no < 1 THEN 1 WHEN line_no < 3 THEN 0 ELSE 2 END, line_no) AS place FROM ({LINES})",
    "prefix_filter": f"SELECT doc_id, line_no FROM ({LINES}) WHERE line LIKE 'The %' OR line LIKE 'En %' OR line LIKE 'Le %' OR line LIKE 'Die %' OR line LIKE 'La %'",
    "numeric_tokens": "SELECT doc_id, tok FROM (SELECT doc_id, explode(regexp_extract_all(text, '[^ \\\\t\\\\n]+', 0)) AS tok FROM @documents) WHERE rlike(tok, '^[0-9-]+$')",
    "block_group": f"SELECT doc_id, block, count(*) AS n_lines, CAST(min(line_no) AS BIGINT) AS first_line FROM (SELECT doc_id, line_no, sum(CASE WHEN rlike(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_at FROM ({LINES})) t CROSS_APPLY GROUP BY doc_id, block".replace("t CROSS_APPLY GROUP BY doc_id, block", "GROUP BY doc_id, block_at").replace("doc_id, block, count", "doc_id, CAST(block_at AS BIGINT) AS block, count"),
    "regular_lines": f"SELECT doc_id, line_no, (length(line) BETWEEN 20 AND 400 AND rlike(line, '^[A-Z]')) AS regular FROM ({LINES})",
    "alphabet": "SELECT DISTINCT c FROM (SELECT explode(regexp_extract_all(text, '(?s).', 0)) AS c FROM @documents)",
    "alphabet_by_lang": "SELECT lang, count(DISTINCT c) AS n_symbols FROM (SELECT lang, explode(regexp_extract_all(text, '(?s).', 0)) AS c FROM @documents) GROUP BY lang",
    "class_histogram": "SELECT class, count(*) AS n FROM (SELECT CASE WHEN rlike(c, '[a-z]') THEN 'lower' WHEN rlike(c, '[A-Z]') THEN 'upper' WHEN rlike(c, '[0-9]') THEN 'digit' WHEN rlike(c, '[ \\\\n\\\\t]') THEN 'space' WHEN rlike(c, '[!-~]') THEN 'punct' ELSE 'other' END AS class FROM (SELECT explode(regexp_extract_all(text, '(?s).', 0)) AS c FROM @documents)) GROUP BY class",
    "raw_fallback": "SELECT doc_id, length(text) AS n, length(replace(text, ' the ', '')) AS enc, CASE WHEN length(replace(text, ' the ', '')) > length(text) - 50 THEN 'raw' ELSE 'coded' END AS kind FROM @documents",
    "text_ratio": "SELECT doc_id, octet_length(text) AS bytes, length(text) AS chars, CAST(octet_length(text) - length(text) AS BIGINT) AS extra, length(text) * 100 >= 95 * octet_length(text) AS mostly_ascii FROM @documents",
    "page_order": "SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY length(html) DESC, page_id) AS place, host FROM (SELECT page_id, html, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM @pages)",
}
