"""Inverses and side streams: trailing blocks, shredded pages, decoded tokens, stripped escapes (survey 2.3 and 2.4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sql import plan
from ..sources import table
from . import dictionary, markup


def stripped(c: Column) -> Column:
    """Folded text without the escape before a quote or an angle bracket."""
    return F.regexp_replace(c, '&(["<>])', "$1")


def trailing(lines: DataFrame, pattern: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(body, side) of (key, at, line): from a key's first line that matches ``pattern``, at ``least`` or later, lines go aside.

    ``at`` counts from 0. A null line matches nothing. Keys without such a line stay whole.
    """
    first = lines.where((F.col("at") >= least) & F.col("line").rlike(pattern)).groupBy("key").agg(F.min("at").alias("from"))
    split = lines.join(first, "key", "left").withColumn("aside", F.coalesce(F.col("at") >= F.col("from"), F.lit(False)))
    return split.where("not aside").select("key", "at", "line"), split.where("aside").select("key", (F.col("at") - F.col("from")).alias("at"), "line")


def put_back(body: DataFrame, side: DataFrame) -> DataFrame:
    """The inverse of :func:`trailing`: side lines go behind their key's body."""
    length = body.groupBy("key").agg(F.count("*").alias("n"))
    back = side.join(length, "key", "left").select("key", (F.col("at") + F.coalesce("n", F.lit(0))).alias("at"), "line")
    return body.unionByName(back)


#: Lines that a page's trailing block begins with, and the first line that may do so.
TRAILING, LEAST = "^</?(article|footer|nav)|^<p>Co", 4


def _page_lines(s: SparkSession, d: str) -> DataFrame:
    """A line begins at each block of a page."""
    parts = F.split(F.regexp_replace("html", "<(p|article|footer|h1|nav)>", "\n<$1>"), "\n")
    return table(s, d, "pages").select(F.col("page_id").alias("key"), F.posexplode(parts).alias("at", "line"))


def _side(s: SparkSession, d: str) -> DataFrame:
    return trailing(_page_lines(s, d), TRAILING, LEAST)[1].select(F.col("key").alias("page_id"), F.col("at").cast("long").alias("at"), "line")


def _restored(s: SparkSession, d: str) -> DataFrame:
    back = put_back(*trailing(_page_lines(s, d), TRAILING, LEAST))
    return back.select(F.col("key").alias("page_id"), F.col("at").cast("long").alias("at"), "line")


def shredded(pages: DataFrame) -> DataFrame:
    """(page_id, head, title, tail): a page without a title is all head, and its title is null."""
    found = F.regexp_instr("html", F.lit("<title>[^<]*</title>"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    cut = pages.select("page_id", "html", found.alias("f"), title.alias("t"))
    behind = F.col("f") + 7 + F.length("t")
    return cut.select(
        "page_id", F.when(F.col("f") > 0, F.expr("substring(html, 1, f - 1)")).otherwise(F.col("html")).alias("head"), F.when(F.col("f") > 0, F.col("t")).alias("title"),
        F.when(F.col("f") > 0, F.col("html").substr(behind + 8, F.length("html"))).otherwise("").alias("tail"),
    )


def rebuilt(parts: DataFrame) -> DataFrame:
    whole = F.when(F.col("title").isNull(), F.col("head")).otherwise(F.concat("head", F.lit("<title>"), "title", F.lit("</title>"), "tail"))
    return parts.select("page_id", whole.alias("html"))


def token_codes(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, mark, code, raw): of each token its case, its codeword, or its letters where the dictionary lacks it."""
    tokens = plan(dictionary.QUERIES["tokens_cased"])(s, d)
    codes = plan(dictionary.QUERIES["codeword"])(s, d).select(F.col("tok").alias("word"), "code")
    low = tokens.withColumn("word", F.lower("tok"))
    return low.join(codes, "word", "left").select("doc_id", "n", "mark", "code", F.when(F.col("code").isNull(), F.col("word")).alias("raw"))


def decoded(codes: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, n, tok) of :func:`token_codes`; ``words`` is (code, word). An unknown code stands for no letters."""
    whole = F.coalesce("raw", "word", F.lit(""))
    cased = F.when(F.col("mark") == "upper", F.upper(whole)).when(F.col("mark") == "cap", F.concat(F.upper(F.substring(whole, 1, 1)), F.expr("substring(coalesce(raw, word, ''), 2)"))).otherwise(whole)
    return codes.join(words, "code", "left").select("doc_id", "n", cased.alias("tok"))


def _decoded(s: SparkSession, d: str) -> DataFrame:
    words = plan(dictionary.QUERIES["codeword"])(s, d).select("code", F.col("tok").alias("word"))
    return decoded(token_codes(s, d), words)


_FOLDED = markup.QUERIES["entity_fold"].replace("@pages", "pages")
_BROKEN = "string_split(regexp_replace(html, '<(p|article|footer|h1|nav)>', chr(10) || '<\\1>', 'g'), chr(10))"
_LINES = f"SELECT page_id, i - 1 AS \"at\", ls[i] AS line FROM (SELECT page_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT page_id, {_BROKEN} AS ls FROM pages))"
QUERIES = {
    "escape_strip": lambda s, d: plan(markup.QUERIES["entity_fold"])(s, d).select("page_id", stripped(F.col("folded")).alias("stripped")),
    "trailing_side": _side,
    "trailing_restore": _restored,
    "shredded_restore": lambda s, d: rebuilt(shredded(table(s, d, "pages"))),
    "token_decode": _decoded,
}
ORACLES = {
    "escape_strip": f"SELECT page_id, replace(replace(replace(folded, '&\"', '\"'), '&<', '<'), '&>', '>') AS stripped FROM ({_FOLDED})",
    "trailing_side": f"WITH l AS ({_LINES}), f AS (SELECT page_id, min(\"at\") AS f FROM l WHERE \"at\" >= {LEAST} AND regexp_matches(line, '{TRAILING}') GROUP BY page_id) SELECT page_id, \"at\" - f AS \"at\", line FROM l JOIN f USING (page_id) WHERE \"at\" >= f",
    "trailing_restore": _LINES,
    "shredded_restore": "SELECT page_id, html FROM pages",
    "token_decode": "SELECT doc_id, n, toks[n] AS tok FROM (SELECT doc_id, toks, unnest(generate_series(1, len(toks))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z]?[a-z]+|[A-Z]+', 0) AS toks FROM documents))",
}
