"""Reversible markup and metadata rewriting (survey 2.3)."""

#: Entity names and what stands for them behind the escape.
_FIRST = (("&amp;", "&&"), ("&quot;", '&"'), ("&lt;", "&<"), ("&gt;", "&>"))
_SECOND = (("&&quot;", '&&"'), ("&&nbsp;", "&&!"), ("&&ndash;", "&&*"), ("&&mdash;", "&&^"))


def chain(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


_SAFE = "html NOT LIKE '%&&%' AND html NOT LIKE '%&\"%' AND html NOT LIKE '%&<%' AND html NOT LIKE '%&>%'"
_CODE = "CAST(month(ts) * 31 + day(ts) - 32 AS BIGINT)"
_SECS = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second_of(ts) AS BIGINT)"
_TS = f"concat(lpad(CAST(year(ts) - 2001 AS VARCHAR_), 2, '0'), CAST({_CODE} AS VARCHAR_), ':', CAST({_SECS} AS VARCHAR_))".replace("VARCHAR_", "STRING")

QUERIES = {
    "entity_fold": f"SELECT page_id, {chain('html', _FIRST)} AS folded FROM @pages",
    "entity_fold_second": f"SELECT page_id, {chain(chain('html', _FIRST), _SECOND)} AS folded FROM @pages",
    "entity_round_trip": f"SELECT page_id, {chain(chain('html', _FIRST), [(b, a) for a, b in reversed(_FIRST)])} = html AS same FROM @pages WHERE {_SAFE}",
    "entity_counts": "SELECT page_id, CAST((length(html) - length(replace(html, '&amp;', ''))) / 5 AS BIGINT) AS n_amp, CAST((length(html) - length(replace(html, '&lt;', ''))) / 4 AS BIGINT) AS n_lt FROM @pages",
    "run_collapse": "SELECT page_id, " + chain(chain("html", [("{{{", "\x01"), ("[[[", "\x02")]), [("{{", "\x03"), ("[[", "\x04"), ("{", "{{"), ("[", "[["), ("\x03", "{"), ("\x04", "["), ("\x01", "{{{"), ("\x02", "[[[")]) + " AS collapsed FROM @pages",
    "close_tag_strip": "SELECT page_id, n, regexp_replace(regexp_replace(line, '^ *<', ''), '</[^<]*$', '') AS kept FROM (SELECT page_id, n, element_at_1(split_lines(h), n) AS line FROM (SELECT page_id, h, explode(sequence(1, size(split_lines(h)))) AS n FROM (SELECT page_id, replace(html, '><', concat('>', chr(10), '<')) AS h FROM @pages))) WHERE rlike(line, '^ *<[a-z0-9]+[^<>]*>[^<>]*</[a-z0-9]+>$')",
    "ts_code": f"SELECT event_id, {_TS} AS code FROM @events WHERE year(ts) BETWEEN 2001 AND 2100",
    "ts_decode": f"SELECT event_id, CAST(2001 + CAST(substr(code, 1, 2) AS BIGINT) AS BIGINT) AS y, CAST(floor(CAST(d AS BIGINT) / 31) + 1 AS BIGINT) AS mo, CAST(CAST(d AS BIGINT) % 31 + 1 AS BIGINT) AS dy, CAST(floor(CAST(s AS BIGINT) / 3600) AS BIGINT) AS h FROM (SELECT event_id, code, regexp_extract(code, '^..([0-9]*):', 1) AS d, regexp_extract(code, ':([0-9]*)$', 1) AS s FROM (SELECT event_id, {_TS} AS code FROM @events WHERE year(ts) BETWEEN 2001 AND 2100))",
    "id_delta": "SELECT user_id, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM @events",
    "id_from_delta": "SELECT user_id, event_id, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS restored FROM (SELECT user_id, ts, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM @events)",
    "pair_swap": "SELECT event_id, regexp_replace(concat(CAST(event_id + 10000000 AS STRING), ' ', CAST(user_id AS STRING), 'J', CAST(minute(ts) AS STRING)), '^([0-9]{8}) ([0-9]+J[0-9]+)$', '#2 #1') AS swapped FROM @events",
    "comment_move": "SELECT page_id, CASE WHEN length(html) < 768 AND (length(html) - length(replace(html, '<!--', ''))) = 4 THEN concat(regexp_replace(html, '<!--[^>]*-->', ''), regexp_extract(html, '<!--[^>]*-->', 0)) ELSE html END AS moved_html, (length(html) < 768 AND (length(html) - length(replace(html, '<!--', ''))) = 4) AS moved FROM @pages",
    "shredded_pages": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '://([^/?#]*)', 1) AS host, length(html) AS n FROM @pages",
}
