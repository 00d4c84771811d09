"""Context statistics, online predictors as windows, calibration and cost in bits (survey 2.9 to 2.11).

A count-based predictor's state before a row is a count over the rows before it, so exact online behaviour is a window.
Contexts reset at each document.
"""

from .structure import _CHARS

_CTX = f"SELECT doc_id, n, c, coalesce(lag(c, 1) OVER (PARTITION BY doc_id ORDER BY n), '') AS c1, coalesce(lag(c, 2) OVER (PARTITION BY doc_id ORDER BY n), '') AS c2 FROM ({_CHARS})"


def entropy(order: int) -> str:
    ctx = ["''", "c1", "concat(c2, c1)"][order]
    return f"SELECT doc_id, CAST(sum(k) AS BIGINT) AS n, round(sum(k * ln(total * 1.0 / k)) / ln(2.0) / sum(k), 6) AS bits FROM (SELECT doc_id, ctx, k, sum(k) OVER (PARTITION BY doc_id, ctx) AS total FROM (SELECT doc_id, {ctx} AS ctx, c, count(*) AS k FROM ({_CTX}) GROUP BY doc_id, {ctx if order else 'doc_id'}, c)) GROUP BY doc_id"


def kt(order: int, key: str = "doc_id") -> str:
    """Cost of each document under the estimator (n_cs + 0.5) / (n_c + 0.5 * V) of what came before."""
    ctx = ["''", "c1", "concat(c2, c1)"][order]
    each = f"SELECT x.doc_id, x.n, -ln((row_number() OVER (PARTITION BY x.doc_id, x.ctx, x.c ORDER BY x.n) - 0.5) / (row_number() OVER (PARTITION BY x.doc_id, x.ctx ORDER BY x.n) - 1 + 0.5 * v.v)) / ln(2.0) AS bits FROM (SELECT doc_id, n, c, {ctx} AS ctx FROM ({_CTX})) x JOIN (SELECT doc_id, count(DISTINCT c) AS v FROM ({_CHARS}) GROUP BY doc_id) v ON x.doc_id = v.doc_id"
    return f"SELECT doc_id, count(*) AS n, sum(bits) AS bits FROM ({each}) GROUP BY doc_id"


_WORDS = "SELECT doc_id, n, element_at_1(ws, n) AS w FROM (SELECT doc_id, ws, explode(sequence(1, size(ws))) AS n FROM (SELECT doc_id, regexp_extract_all(fold(text), '[a-z]+', 0) AS ws FROM @documents) WHERE size(ws) > 0)"
_MATCH = f"SELECT doc_id, n, w, lag(w) OVER (PARTITION BY doc_id, w1, w2 ORDER BY n) AS guess FROM (SELECT doc_id, n, w, lag(w, 1) OVER (PARTITION BY doc_id ORDER BY n) AS w1, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY n) AS w2 FROM ({_WORDS})) WHERE w2 IS NOT NULL"

QUERIES = {
    "entropy_order0": entropy(0),
    "entropy_order1": entropy(1),
    "entropy_order2": entropy(2),
    "kt_cost_order0": f"SELECT doc_id, n, round(bits, 4) AS bits FROM ({kt(0)})",
    "kt_cost_order1": f"SELECT doc_id, n, round(bits, 4) AS bits FROM ({kt(1)})",
    "bits_per_char_by_lang": f"SELECT lang, round(sum(bits) / sum(n), 5) AS bpc FROM ({kt(1)}) k JOIN @documents d ON k.doc_id = d.doc_id GROUP BY lang",
    "direct_mean": "SELECT event_type, event_id, round(coalesce(avg(CASE WHEN value > 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5), 6) AS p FROM @events",
    "match_hits": f"SELECT doc_id, count(guess) AS tried, CAST(sum(CASE WHEN guess = w THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM ({_MATCH}) GROUP BY doc_id",
    "match_runs": f"SELECT doc_id, min(n) AS start, count(*) AS length FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM ({_MATCH}) WHERE guess = w) GROUP BY doc_id, island",
    "indirect_context": f"SELECT w1, guess_right, count(*) AS n FROM (SELECT doc_id, w AS w1, coalesce(guess = w, FALSE) AS guess_right FROM ({_MATCH})) GROUP BY w1, guess_right",
    "calibration_table": "SELECT bucket, count(*) AS n, round(avg(hit), 6) AS rate FROM (SELECT CAST(floor(p * 10) AS BIGINT) AS bucket, hit FROM (SELECT coalesce(avg(CASE WHEN value > 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) AS p, CASE WHEN value > 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hit FROM @events)) GROUP BY bucket",
    "move_to_front": "SELECT a.user_id, a.event_id, count(DISTINCT b.event_type) AS distinct_before FROM @events a LEFT JOIN @events b ON a.user_id = b.user_id AND b.event_id < a.event_id GROUP BY a.user_id, a.event_id",
    "linear_trend": "SELECT user_id, count(*) AS n, round(regr_slope(value, event_id), 8) AS slope FROM @events GROUP BY user_id HAVING count(*) > 2",
    "separator_guard": "SELECT source, CAST(sum(length(text)) AS BIGINT) AS total, CAST(sum(length(text) - length(replace(text, '.', ''))) AS BIGINT) AS hits, CASE WHEN sum(length(text)) < 1000 THEN 'too small' WHEN sum(length(text) - length(replace(text, '.', ''))) * 1600 BETWEEN sum(length(text)) AND sum(length(text)) * 64 THEN 'ok' ELSE 'bad' END AS verdict FROM @documents GROUP BY source",
    "score_total": "SELECT source, count(*) AS members, CAST(sum(n_chars) + 2 * max(n_chars) AS BIGINT) AS score FROM @documents GROUP BY source",
}
