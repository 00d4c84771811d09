"""Word types, UTF-8 widths, routed lines, content words and similar sentences (survey 2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import table
from .dictionary import _CENSUS
from .records import LINES

#: English function words by kind.
ARTICLES = ("a", "an", "the")
PRONOUNS = ("he", "her", "him", "his", "i", "it", "its", "me", "my", "our", "she", "their", "them", "they", "us", "we", "you", "your")
CONJUNCTIONS = ("and", "as", "because", "but", "if", "or", "that", "than", "while")
ADPOSITIONS = ("at", "by", "for", "from", "in", "of", "on", "to", "with")
AUXILIARIES = ("are", "be", "been", "can", "had", "has", "have", "is", "may", "must", "was", "were", "will")
#: Endings that mark a type.
ENDINGS = {
    "plural": "[^s]s$", "past": "ed$", "gerund": "ing$", "adverb": "ly$", "superlative": "est$", "comparative": "er$",
    "noun": "(ness|ment|tion|ity|ship|ism)$", "adjective": "(ful|ous|ive|al|able|ible|ic|less)$",
}
PREFIXES = {"negated": "^(un|in|im|dis|non)", "repeated": "^re"}
HISTORY, LIKE = 64, 50


def _in(words: tuple[str, ...], column: str = "tok") -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


_KINDS = {"article": ARTICLES, "pronoun": PRONOUNS, "conjunction": CONJUNCTIONS, "adposition": ADPOSITIONS, "auxiliary": AUXILIARIES}
_FLAGS = [f"{_in(w)} AS {k}" for k, w in _KINDS.items()] + [f"length(tok) > 4 AND rlike(tok, '{p}') AS {k}" for k, p in (ENDINGS | PREFIXES).items()]
_FUNCTION = tuple(w for words in _KINDS.values() for w in words)
_FEED = "SELECT doc_id, n, element_at_1(ws, n) AS w FROM (SELECT doc_id, ws, explode(sequence(1, size(ws))) AS n FROM (SELECT doc_id, regexp_extract_all(fold(text), '[a-z]+', 0) AS ws FROM @documents) WHERE size(ws) > 0)"
_ROUTE = "CASE WHEN rlike(line, '^(https?://|\\\\[\\\\[)') THEN 'link' WHEN rlike(line, '^([|]|[{][|])') THEN 'table' WHEN rlike(line, '^[*#:;-]') THEN 'list' WHEN line = '' THEN 'blank' ELSE 'prose' END"

#: Plans as text, for both engines.
QUERIES = {
    "word_types": f"SELECT tok, cnt, {', '.join(_FLAGS)} FROM ({_CENSUS})",
    "utf8_widths": "SELECT doc_id, octet_length(c) AS width, count(*) AS n FROM (SELECT doc_id, explode(regexp_extract_all(text, '(?s).', 0)) AS c FROM @documents) GROUP BY doc_id, octet_length(c)",
    "line_routes": f"SELECT doc_id, route, count(*) AS n, CAST(min(line_no) AS BIGINT) AS first_line FROM (SELECT doc_id, line_no, {_ROUTE} AS route FROM ({LINES})) GROUP BY doc_id, route",
    "content_words": f"SELECT doc_id, n, w, before IS NOT NULL AND {_in(ARTICLES, 'before')} AS noun_here FROM (SELECT doc_id, n, w, lag(w) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM ({_FEED})) WHERE NOT {_in(_FUNCTION, 'w')}",
}


def similar_sentences(docs: DataFrame, history: int = HISTORY, least: int = LIKE) -> DataFrame:
    """(doc_id, sn, similar, overlap): of the ``history`` sentences before each, the one that holds most of its words.

    Only sentences of more than half as many words, and no more, are asked; ties go to the lower place in a ring of
    ``history``; under ``least`` percent of the words, a sentence has no row. Words are ASCII letters, lower-cased; each of
    a sentence's words counts, repeated ones too. Null and empty texts have no sentences.
    """
    cut = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^.?!]+[.?!]"), 0)).alias("sn", "s"))
    folded = F.translate("s", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = cut.select("doc_id", "sn", F.regexp_extract_all(folded, F.lit("[a-z]+"), 0).alias("w"))
    past = Window.partitionBy("doc_id").orderBy("sn").rowsBetween(-history, -1)
    rows = rows.withColumn("h", F.collect_list(F.struct("sn", "w")).over(past)).withColumn("k", F.size("w"))
    fits = F.filter("h", lambda x: (F.size(x["w"]) > F.floor(F.col("k") / 2)) & (F.size(x["w"]) <= F.col("k")))
    scored = F.transform(fits, lambda x: F.struct(F.size(F.filter("w", lambda v: F.array_contains(x["w"], v))).alias("o"), (-(x["sn"] % history)).alias("slot"), x["sn"].alias("sn")))
    best = rows.select("doc_id", F.col("sn").cast("long"), "k", F.array_max(scored).alias("b")).where((F.col("b.o") > 0) & (F.col("b.o") * 100 >= least * F.col("k")))
    return best.select("doc_id", "sn", F.col("b.sn").cast("long").alias("similar"), F.col("b.o").cast("long").alias("overlap"))


def _similar(s: SparkSession, d: str) -> DataFrame:
    return similar_sentences(table(s, d, "documents"))


FRAMES = {"similar_sentence": _similar}
ORACLES = {
    "similar_sentence": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^.?!]+[.?!]') AS ss FROM documents),
s AS (SELECT doc_id, i - 1 AS sn, regexp_extract_all(translate(ss[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS w FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM t)),
p AS (SELECT a.doc_id, a.sn, b.sn AS "similar", len(list_filter(a.w, lambda x: list_contains(b.w, x))) AS overlap, len(a.w) AS k FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.sn BETWEEN a.sn - {HISTORY} AND a.sn - 1 WHERE len(b.w) <= len(a.w) AND len(b.w) > len(a.w) // 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sn ORDER BY overlap DESC, "similar" % {HISTORY}) AS best FROM p)
SELECT doc_id, sn, "similar", overlap FROM r WHERE best = 1 AND overlap > 0 AND overlap * 100 >= {LIKE} * k""",
}
