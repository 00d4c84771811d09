"""Places in lines, numbers in texts, quantised histories and sparse matches (survey 2.5, 2.8 and 2.9), with SQL written apart."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table
from .kernels import earlier, per_text

#: Characters since the last line break, at most.
FAR = 99
#: Which words before a word make up a key of the sparse matches; 1 is the one just before.
SPARSE = ((1, 3), (2,), (2, 3), (1, 2, 3))
LARGEST = 2**64 - 1


def line_bounds(chars: np.ndarray) -> list[tuple[int, int, int]]:
    """(line, start, end) of each line, the break not counted."""
    end = np.r_[np.flatnonzero(chars == 10), len(chars)]
    return list(zip(range(len(end)), np.r_[0, end[:-1] + 1].tolist(), end.tolist(), strict=True))


def line_places(chars: np.ndarray) -> list[tuple[int, int]]:
    """The sum and the largest of the characters' places in their lines; a line break is the last of its line."""
    place, broken = np.arange(len(chars)), np.r_[False, chars[:-1] == 10]
    since = np.minimum(place - np.maximum.accumulate(np.where(broken, place, 0)), FAR)
    return [(int(since.sum()), int(since.max()))]


def quantised(chars: np.ndarray) -> list[tuple[int, int]]:
    """(context, n): eighths of the first 256 code points, three in a row, with how often; all others are in the last eighth."""
    q = np.minimum(chars, 255) // 32
    keys, n = np.unique(q[:-2] * 64 + q[1:-1] * 8 + q[2:], return_counts=True)
    return list(zip(keys.tolist(), n.tolist(), strict=True))


def words(text: str) -> np.ndarray:
    """A number for each run of ASCII letters, lower-cased."""
    return np.unique(np.array(re.findall("[a-z]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), object).astype(str), return_inverse=True)[1]


def sparse_matches(numbers: np.ndarray) -> list[tuple[str, int, int]]:
    """(key, tried, hits): how often the word after the last place of the same key is the next word again."""
    out, kinds = [], int(numbers.max(initial=0)) + 1
    for back in SPARSE:
        far = max(back)
        if len(numbers) > far:
            key = np.zeros(len(numbers) - far, np.int64)
            for b in back:
                key = np.unique(key * kinds + numbers[far - b : len(numbers) - b], return_inverse=True)[1]
            order = np.argsort(key, kind="stable")
            guess = np.full(len(key), -1)
            same = key[order][1:] == key[order][:-1]
            guess[order[1:][same]] = numbers[far:][order[:-1][same]]
            out.append(("".join(map(str, back)), int((earlier(key) > 0).sum()), int((guess == numbers[far:]).sum())))
    return out


def leading_number(c: Column) -> Column:
    """What white space, a sign and digits at the beginning say, as a 64-bit number: 0 without digits, null beyond 64 bits."""
    digits = F.regexp_extract(c, r"^[ \t-\r]*([+-]?[0-9]+)", 1)
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.try_cast("bigint"))


def exact_number(c: Column) -> Column:
    """An unsigned 64-bit number that is all of the text; null for any other text, and for a larger number."""
    significant = F.regexp_replace(c, "^0+(?=.)", "")
    number = significant.try_cast("decimal(38,0)")
    return F.when(c.rlike("^[0-9]+$") & (F.length(significant) <= 20) & (number <= F.lit(str(LARGEST)).cast("decimal(38,0)")), number.cast("decimal(20,0)"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _numbers(s: SparkSession, d: str) -> DataFrame:
    rows = _docs(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[ \t]*[+-]?[0-9]+[a-z]?"), 0)).alias("n", "t"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), leading_number(F.col("t")).alias("leading"), exact_number(F.trim("t")).cast("string").alias("exact"))


def _before_semicolon(s: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("([0-9]*);"), 1)
    return table(s, d, "pages").select("page_id", F.size(found).alias("n"), F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x)).alias("digits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "line_bounds": lambda s, d: per_text(_docs(s, d), ["doc_id"], "line long, start long, end long", line_bounds),
    "line_places": lambda s, d: per_text(_docs(s, d), ["doc_id"], "total long, furthest long", line_places),
    "quantised_history": lambda s, d: per_text(_docs(s, d), ["doc_id"], "context long, n long", quantised),
    "sparse_match": lambda s, d: per_text(_docs(s, d), ["doc_id"], "key string, tried long, hits long", sparse_matches, words),
    "number_parse": _numbers,
    "digits_before_semicolon": _before_semicolon,
}
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> ''"
_FEED = "SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS ws FROM documents)"
_BACK = ", ".join(f"lag(w, {b}) OVER (PARTITION BY doc_id ORDER BY i) AS w{b}" for b in (1, 2, 3))


def _sparse(back: tuple[int, ...]) -> str:
    keys = ", ".join(f"w{b}" for b in back)
    return f"SELECT doc_id, '{''.join(map(str, back))}' AS key, count(guess) AS tried, count(*) FILTER (guess = w) AS hits FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id, {keys} ORDER BY i) AS guess FROM f WHERE w{max(back)} IS NOT NULL) GROUP BY doc_id"


ORACLES = {
    "line_bounds": f"SELECT doc_id, line, stop - length(t) AS start, stop AS \"end\" FROM (SELECT doc_id, line, t, (sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line))::BIGINT - 1 AS stop FROM ({_LINES}))",
    "line_places": f"""SELECT doc_id, sum(CASE WHEN k <= {FAR + 1} THEN k * (k - 1) // 2 ELSE {FAR * (FAR + 1) // 2} + {FAR} * (k - {FAR + 1}) END)::BIGINT AS total, max(least(k - 1, {FAR})) AS furthest
 FROM (SELECT doc_id, length(t) + CASE WHEN line < n - 1 THEN 1 ELSE 0 END AS k FROM ({_LINES})) WHERE k > 0 GROUP BY doc_id""",
    "quantised_history": """SELECT doc_id, context, count(*) AS n FROM (SELECT doc_id, lag(q, 2) OVER w * 64 + lag(q) OVER w * 8 + q AS context
 FROM (SELECT doc_id, least(unicode(unnest(cs)), 255) // 32 AS q, unnest(generate_series(1, len(cs))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents))
 WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE context IS NOT NULL GROUP BY doc_id, context""",
    "sparse_match": f"WITH f AS (SELECT *, {_BACK} FROM ({_FEED})) " + " UNION ALL ".join(_sparse(back) for back in SPARSE),
    "number_parse": r"""SELECT doc_id, n, CASE WHEN regexp_extract(t, '([+-]?[0-9]+)', 1) = '' THEN 0 ELSE TRY_CAST(regexp_extract(t, '([+-]?[0-9]+)', 1) AS BIGINT) END AS leading,
 CASE WHEN regexp_matches(trim(t), '^[0-9]+$') THEN TRY_CAST(trim(t) AS UBIGINT)::VARCHAR END AS exact
 FROM (SELECT doc_id, unnest(ts) AS t, unnest(generate_series(0, len(ts) - 1)) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[ \t]*[+-]?[0-9]+[a-z]?') AS ts FROM documents))""",
    "digits_before_semicolon": "SELECT page_id, len(x) AS n, list_sum(list_prepend(0, list_transform(x, lambda v: length(v)))) AS digits FROM (SELECT page_id, regexp_extract_all(html, '([0-9]*);', 1) AS x FROM pages)",
}
