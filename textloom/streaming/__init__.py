"""Structured Streaming over the events table: windows with watermarks, deduplication, and a keyed online predictor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table
from ..sources.shared import shared_dir


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(rows: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def distinct_events(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")


def running_mean(rows: DataFrame) -> DataFrame:
    """(event_type, n, mean): a predictor's state for each key, updated with every batch; a null value is in n, not in the mean."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, batches, state):
        import pandas as pd

        n, known, total = state.get if state.exists else (0, 0, 0.0)
        for b in batches:
            n, known, total = n + len(b), known + int(b["value"].notna().sum()), total + float(b["value"].sum())
        state.update((n, known, total))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [total / known if known else None]})

    return rows.groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, mean double", "n long, known long, total double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, name: str, key: list[str] | None = None) -> DataFrame:
    """What a stream gives once it has read all there is, as a table in the shared folder, where its state lies too.

    Each batch is a folder of its own, so a batch that is run again replaces itself. In mode complete the last batch counts,
    in mode update the last row of each ``key``, in mode append every row.
    """
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in key]), "batch").alias("last")).select(*key, "last.*")
    return rows.select(*stream.columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_tumbling": lambda s, d: drained(tumbling(events(s, d)), "complete", "stream_tumbling"),
    "stream_sliding": lambda s, d: drained(sliding(events(s, d)), "complete", "stream_sliding"),
    "stream_sessions": lambda s, d: drained(sessions(events(s, d)), "complete", "stream_sessions"),
    "stream_distinct": lambda s, d: drained(distinct_events(events(s, d)), "append", "stream_distinct"),
    "stream_running_mean": lambda s, d: drained(running_mean(events(s, d)), "update", "stream_running_mean", ["event_type"]).withColumn("mean", F.round("mean", 6)),
}
#: What the streams give in the end, as SQL over the whole table.
ORACLES = {
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '30' MINUTE, ts) - unnest([0, 30]) * INTERVAL '1' MINUTE AS start FROM events) GROUP BY start",
    "stream_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN ts <= before + INTERVAL '30' MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s",
    "stream_running_mean": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "stream_distinct": "SELECT event_id, user_id FROM events",
}
