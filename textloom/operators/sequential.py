"""Operators that need Python: mapped over single documents, or over distinct tokens that are joined back (survey's tier P)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coding, lockstep
from ..sources import table


def mapped(f, kind: str):
    """A vectorised column function of one value; null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore")

    return run


def mapped_together(f, kind: str):
    """A vectorised column function of the values of a batch, all at once; null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        some = values.dropna()
        return pd.Series(f(some.tolist()), some.index, dtype=object).reindex(values.index)

    return run


def round_trip(texts: list[bytes]) -> list[dict]:
    """Whether the range coder gives back each text, and its code's length; a text is encoded once."""
    codes = lockstep.range_encode(texts)
    return [{"same": back == text, "n_bytes": len(code)} for text, code, back in zip(texts, codes, lockstep.range_decode(codes), strict=True)]


def _raw(c: str) -> Column:
    return F.col(c).cast("binary")


_LANGUAGES = ("german", "french", "english")


def stemmed_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, n, tok, english, german, french): each distinct token is stemmed once."""
    tokens = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}']+"), 0)).alias("n", "tok"))
    kinds = tokens.select("tok").distinct()
    for name in _LANGUAGES:
        kinds = kinds.withColumn(name, mapped(getattr(coding, f"stem_{name}"), "string")("tok"))
    return tokens.join(kinds, "tok")


def language_vote(docs: DataFrame, words: int = 64, least: int = 4) -> DataFrame:
    """(doc_id, n, language): the language whose stemmer altered most of the last ``words`` words; ties go to the later of
    German, French, English; a language needs ``least`` hits."""
    from pyspark.sql import Window

    recent = Window.partitionBy("doc_id").orderBy("n").rowsBetween(1 - words, 0)
    hits = [F.sum((F.col(k) != F.col("tok")).cast("int")).over(recent).alias(f"n_{k}") for k in _LANGUAGES]
    rows = stemmed_tokens(docs).select("doc_id", "n", *hits)
    best = F.greatest(*[f"n_{k}" for k in _LANGUAGES])
    name = F.lit("unknown")
    for k in _LANGUAGES:
        name = F.when((F.col(f"n_{k}") == best) & (best >= least), k).otherwise(name)
    return rows.select("doc_id", "n", name.alias("language"))


def numeric_entities(c: Column) -> Column:
    """``&#NNN;`` of numbers over 255 becomes its character."""
    import html
    import re

    return mapped(lambda s: re.sub(r"&#([1-9][0-9]*);", lambda m: html.unescape(m[0]) if 255 < int(m[1]) < 0x110000 else m[0], s), "string")(c)


def _round_trips(docs: DataFrame) -> DataFrame:
    """(doc_id, same, n_bytes); a null text has neither."""

    @F.pandas_udf("same boolean, n_bytes long")
    def run(values: pd.Series) -> pd.DataFrame:
        some = values.dropna()
        return pd.DataFrame(round_trip(some.tolist()), some.index, ["same", "n_bytes"]).astype(object).reindex(values.index)

    return docs.select("doc_id", run(_raw("text")).alias("x")).select("doc_id", "x.same", "x.n_bytes")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES = {
    "stem_tokens": lambda s, d: stemmed_tokens(_docs(s, d)).groupBy("english").agg(F.count("*").alias("n")),
    "language_vote": lambda s, d: language_vote(_docs(s, d)).groupBy("doc_id", "language").agg(F.count("*").alias("n")),
    "text_segments": lambda s, d: _docs(s, d).select("doc_id", F.explode(mapped(lambda b: [{"kind": k, "start": a, "length": n} for k, a, n in coding.segments(b)], "array<struct<kind:string,start:long,length:long>>")(_raw("text"))).alias("x")).select("doc_id", "x.*"),
    "bracket_context": lambda s, d: _docs(s, d).select("doc_id", mapped(lambda t: max(coding.brackets(t), default=0), "long")("text").alias("deepest_context")),
    "ppm_cost": lambda s, d: _docs(s, d).select("doc_id", mapped(coding.ppm_bits, "double")(_raw("text")).alias("bits")),
    "dmc_cost": lambda s, d: _docs(s, d).select("doc_id", mapped_together(lockstep.dmc_bits, "double")(_raw("text")).alias("bits")),
    "mixer_cost": lambda s, d: _docs(s, d).select("doc_id", mapped_together(lockstep.mixed_bits, "double")(_raw("text")).alias("bits")),
    "range_coder_round_trip": lambda s, d: _round_trips(_docs(s, d)),
    "varint_bytes": lambda s, d: table(s, d, "orders").select("o_orderkey", mapped(lambda x: coding.varint(int(x)).hex(), "string")("o_orderkey").alias("code")),
    "numeric_entities": lambda s, d: table(s, d, "pages").select("page_id", numeric_entities(F.col("html")).alias("folded")),
}
