"""The ordered queries as prefix scans: same rows as their SQL, but no group, however large, is one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import scan, smaller_later
from ..sources import table


def _places(s: SparkSession, d: str) -> DataFrame:
    return scan(table(s, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], number="pos", lags={"before": "n_chars"})


def labelled(s: SparkSession, d: str) -> DataFrame:
    """(source, doc_id, pos, n_chars, label): label counts the falling runs of ``n_chars`` that ended before the row."""
    rows = _places(s, d).withColumn("rises", F.coalesce((F.col("n_chars") >= F.col("before")).cast("long"), F.lit(0)))
    return scan(rows, ["source"], ["pos"], sums={"label": "rises"})


def _run_labels_inverse(s: SparkSession, d: str) -> DataFrame:
    rows = labelled(s, d).withColumn("falling", -F.col("n_chars"))
    return scan(rows, ["source"], ["label", "falling", "pos"], number="place").select("source", "doc_id", F.col("place").cast("int"))


def _block_sort(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("source", "doc_id", F.substring("text", 20, 40).alias("head"))
    return scan(rows, ["source"], ["head", "doc_id"], number="place").select("source", "doc_id", "place")


def _block_sort_whole(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("source", "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "^[^\\n]*\\n?[^\\n]*\\n?", "").alias("key"))
    return scan(rows, ["source"], ["key", "doc_id"], number="place").select("source", "doc_id", "place")


def _revid_rank(s: SparkSession, d: str) -> DataFrame:
    return scan(_places(s, d), ["source"], ["n_chars", "pos"], number="k").select("source", "doc_id", (F.col("k") - 1).alias("r"))


def _longest_regular_run(s: SparkSession, d: str) -> DataFrame:
    rows = _places(s, d).where(F.col("n_chars").between(200, 4000)).select("source", "pos")
    runs = scan(rows, ["source"], ["pos"], number="k").groupBy("source", (F.col("pos") - F.col("k")).alias("island")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    best = runs.groupBy("source").agg(F.max(F.struct("n", -F.col("first_pos"))).alias("b"))
    return best.select("source", (-F.col("b.col2")).alias("first_pos"), F.col("b.n").alias("n"))


def _reorder_plan(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "labels").select(F.col("doc_id").alias("id"), (-F.col("quality")).alias("worse"))
    rows = table(s, d, "documents").select("source", "doc_id").join(labels, F.col("doc_id") == F.col("id"), "left")
    rows = rows.select("source", "doc_id", F.when(F.col("id").isNull(), 1).otherwise(0).alias("part"), F.coalesce("worse", F.lit(1)).alias("worse"))
    return scan(rows, ["source"], ["part", "worse", "doc_id"], number="place").select("source", "doc_id", "part", "place")


def _page_order(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), (-F.length("html")).alias("shorter"))
    return scan(rows, ["host"], ["shorter", "page_id"], number="place").select("page_id", "host", "place")


def _class_plan(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("event_type", "event_id", "value")
    by_id = scan(rows, ["event_type"], ["event_id"], number="k").select("event_type", "event_id", "k")
    by_value = scan(rows, ["event_type"], ["value", "event_id"], number="k").select("event_type", F.col("event_id").alias("partner"), "k")
    return by_id.join(by_value, ["event_type", "k"]).select("event_type", "event_id", "partner")


def _used_ranks(s: SparkSession, d: str) -> DataFrame:
    group = lambda c: (F.col(c) % 50).alias("g")
    used = scan(table(s, d, "orders").select("o_custkey", group("o_custkey")).distinct(), ["g"], ["o_custkey"], number="j")
    rank = scan(table(s, d, "customer").select("c_custkey", "c_acctbal", group("c_custkey")), ["g"], ["c_acctbal", "c_custkey"], number="j")
    return used.join(rank, ["g", "j"]).select("o_custkey", "c_custkey")


def _digits(s: SparkSession, d: str, by: str, new: str) -> DataFrame:
    return smaller_later(table(s, d, "documents").select(by, "doc_id", "n_chars"), [by], ["doc_id"], "n_chars", new).select(by, "doc_id", new)


def _hits(s: SparkSession, d: str, key: str) -> DataFrame:
    """Events with n and s: how many of the key came up to this one, and how many of them were hits."""
    rows = table(s, d, "events").select("event_id", "event_type", "user_id", "ts", F.when(F.col("value") > 50, 1).otherwise(0).cast("long").alias("hit"))
    return scan(rows, [key], ["ts", "event_id"], number="n", sums={"s": "hit"}).withColumn("p", F.coalesce(F.try_divide(F.col("s") - F.col("hit"), F.col("n") - 1), F.lit(0.5)))


def _direct_mean(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "event_type").select("event_type", "event_id", F.round("p", 6).alias("p"))


def _calibration(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "user_id").groupBy(F.floor(F.col("p") * 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("rate"))


def bit_history(s: SparkSession, d: str) -> DataFrame:
    """(event_type, event_id, n0, n1, last): of the hits of a key before an event, the zeros, the ones and the last one."""
    rows = _hits(s, d, "event_type").drop("p")
    rows = scan(rows, ["event_type"], ["ts", "event_id"], lags={"last": "hit"})
    return rows.select("event_type", "event_id", (F.col("n") - 1 - F.col("s") + F.col("hit")).alias("n0"), (F.col("s") - F.col("hit")).alias("n1"), "last")


def _id_delta(s: SparkSession, d: str) -> DataFrame:
    rows = scan(table(s, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], lags={"before": "event_id"})
    return rows.select("user_id", "ts", "event_id", (F.col("event_id") - F.coalesce("before", F.lit(0))).alias("delta"))


def _id_from_delta(s: SparkSession, d: str) -> DataFrame:
    return scan(_id_delta(s, d), ["user_id"], ["ts", "event_id"], sums={"restored": "delta"}).select("user_id", "event_id", "restored")


def _move_to_front(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("user_id", "event_id", "event_type")
    first = scan(rows, ["user_id", "event_type"], ["event_id"], number="k").withColumn("fresh", (F.col("k") == 1).cast("long"))
    return scan(first, ["user_id"], ["event_id"], sums={"kinds": "fresh"}).select("user_id", "event_id", (F.col("kinds") - F.col("fresh")).alias("distinct_before"))


def _move_to_front_rank(s: SparkSession, d: str) -> DataFrame:
    """Distinct types of the user since the type's last event; at a first event, all types the user had before.

    With places from 1 and ``prev`` the place of the type's last event, 0 without, the types in between are the events there
    whose own ``prev`` is at most that: all events between, less those before that have a larger ``prev``.
    """
    rows = scan(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], number="pos")
    rows = scan(rows, ["user_id", "event_type"], ["pos"], lags={"prev": "pos"}).withColumn("prev", F.coalesce("prev", F.lit(0)))
    rows = rows.select("user_id", "event_id", "pos", "prev", (-F.col("pos")).alias("back"), (-F.col("prev")).alias("nearer"))
    rows = smaller_later(rows, ["user_id"], ["back"], "nearer", "larger")
    return rows.select("user_id", "event_id", (F.col("pos") - 1 - F.col("prev") - F.col("larger")).alias("rank"))


def _asof_last(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", F.col("event_id")).alias("click"))
    rows = scan(rows, ["user_id"], ["ts", "event_id"], maxes={"top": "click"})
    return scan(rows, ["user_id"], ["ts", "event_id"], lags={"last_click": "top"}).select("user_id", "event_id", "last_click")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    rows = scan(table(s, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], lags={"before": "ts"})
    rows = rows.withColumn("opens", F.when(F.expr("ts <= before + INTERVAL '30' MINUTE"), 0).otherwise(1).cast("long"))
    return scan(rows, ["user_id"], ["ts", "event_id"], sums={"session": "opens"}).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def within(rows: DataFrame, keys: list[str], at: str, reach: int, new: str) -> DataFrame:
    """``rows`` with how many rows of the key lie in (at, at + reach]; ``at`` is a long.

    A row goes to its own slice of length ``reach`` and, as a partner only, to the one before: a task holds two slices of a
    key, never a whole key, and no pairs are made. Columns that begin with ``_w`` are reserved; a null ``at`` gives 0.
    """
    own = F.floor(F.col(at) / F.lit(reach)).cast("long")
    both = rows.withColumn("_ws", own).withColumn("_wb", F.explode(F.array(F.col("_ws"), F.col("_ws") - 1)))
    return both.selectExpr(
        "*", f"count({at}) OVER (PARTITION BY {', '.join(keys)}, _wb ORDER BY {at} RANGE BETWEEN 1 FOLLOWING AND {reach} FOLLOWING) AS {new}"
    ).where("_ws <=> _wb").drop("_ws", "_wb")


def _range_join(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return within(rows, ["user_id"], "at", 3_600_000_000, "within_hour").select("user_id", "event_id", "within_hour")


QUERIES = {
    "run_labels": lambda s, d: labelled(s, d).select("source", "doc_id", "label"),
    "run_labels_inverse": _run_labels_inverse,
    "run_lengths": lambda s, d: labelled(s, d).groupBy("source", "label").agg(F.count("*").alias("n")),
    "block_sort": _block_sort,
    "block_sort_whole": _block_sort_whole,
    "revid_rank": _revid_rank,
    "longest_regular_run": _longest_regular_run,
    "reorder_plan": _reorder_plan,
    "restore_order": lambda s, d: scan(table(s, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], number="place"),
    "page_order": _page_order,
    "class_plan": _class_plan,
    "used_ranks": _used_ranks,
    "lehmer_small": lambda s, d: _digits(s, d, "source", "smaller_later"),
    "lehmer_codes": lambda s, d: _digits(s, d, "lang", "code"),
    "direct_mean": _direct_mean,
    "calibration_table": _calibration,
    "bit_history": bit_history,
    "id_delta": lambda s, d: _id_delta(s, d).drop("ts"),
    "id_from_delta": _id_from_delta,
    "move_to_front": _move_to_front,
    "move_to_front_rank": _move_to_front_rank,
    "asof_last": _asof_last,
    "session_window": _sessions,
    "range_join": _range_join,
}
_HIT = "CASE WHEN value > 50 THEN 1 ELSE 0 END"
_BEFORE = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_USES = "SELECT *, coalesce(lag(pos) OVER (PARTITION BY user_id, event_type ORDER BY pos), 0) AS prev FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)"
#: SQL of those that have no plan as text.
ORACLES = {
    "move_to_front_rank": f"SELECT a.user_id, a.event_id, count(DISTINCT b.event_type) AS rank FROM ({_USES}) a LEFT JOIN ({_USES}) b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.pos > a.prev AND b.pos < a.pos GROUP BY a.user_id, a.event_id",
    "block_sort_whole": r"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY regexp_replace(coalesce(text, ''), '^[^\n]*\n?[^\n]*\n?', ''), doc_id) AS place FROM documents",
    "lehmer_codes": "SELECT a.lang, a.doc_id, count(b.doc_id) AS code FROM documents a LEFT JOIN documents b ON a.lang = b.lang AND b.doc_id > a.doc_id AND b.n_chars < a.n_chars GROUP BY a.lang, a.doc_id",
    "bit_history": f"SELECT event_type, event_id, count(*) {_BEFORE} - coalesce(sum({_HIT}) {_BEFORE}, 0)::BIGINT AS n0, coalesce(sum({_HIT}) {_BEFORE}, 0)::BIGINT AS n1, lag({_HIT}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS last FROM events",
}
