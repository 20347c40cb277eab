"""Structured Streaming over the events table.

Each query reads the table as a stream, takes all that is there, and gives what
the stream has written to a folder that all executors share; progress is kept
there too, so a broken run goes on where it was. An event's time is `ts`, in the
session's time zone, as a watermark needs a time with a zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tessera.plans.registry import query
from tessera.scratch import folder
from tessera.sources import table

#: How late an event may come.
DELAY = "10 minutes"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, at most 8 files at a time. The path is a pattern, as a stream takes a plain path for a folder, and the table may be one file."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def appended(stream: DataFrame, name: str, before: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What the stream gives in append mode, until all that is there has been read."""
    spark, path = stream.sparkSession, folder(stream.sparkSession, name)
    out = before(stream)
    running = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def updated(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The latest row of each key of what the stream gives in update mode. A batch's rows are written under its number, so one that is run twice counts once."""
    spark, path = stream.sparkSession, folder(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return latest.select("row.*")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows in update mode: open windows are told too, and told again when they change."""
    counts = events(spark, sf_dir).withWatermark("at", DELAY).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return updated(counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n_events", "total"), "hourly", ["hour", "event_type"])


@query("""WITH s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
SELECT user_id, min(ts) AS began, count(*) AS n_events FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in append mode: each is told once, when the watermark has passed its end."""
    sessions = events(spark, sf_dir).withWatermark("at", DELAY).groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n_events"))
    return appended(sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n_events"), "sessions")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come twice are told once; ids are remembered as long as the watermark needs."""
    twice = events(spark, sf_dir).unionAll(events(spark, sf_dir))
    return appended(twice.withWatermark("at", DELAY).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"), "once")


def count_funnels(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Purchases of a user that follow a view and then a click, other events between them or not."""
    step, done = state.get if state.exists else (0, 0)
    rows = pd.concat([b[["at", "event_id", "event_type"]] for b in batches]).sort_values(["at", "event_id"])
    for kind in rows["event_type"]:
        if kind == ("view", "click", "purchase")[step]:
            step = (step + 1) % 3
            done += step == 0
    state.update((step, done))
    yield pd.DataFrame({"user_id": [key[0]], "n_funnels": [done]})


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('view', 'click', 'purchase')),
f AS (SELECT user_id, 0 AS i, 0 AS step, 0 AS done FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT f.user_id, e.i, CASE WHEN e.event_type = ['view', 'click', 'purchase'][f.step + 1] THEN (f.step + 1) % 3 ELSE f.step END,
    f.done + CASE WHEN f.step = 2 AND e.event_type = 'purchase' THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, max(done)::BIGINT AS n_funnels FROM f GROUP BY ALL""")
def stream_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of one's own: where each user stands between view, click and purchase. Only these go to the state; a user's state is two numbers."""
    rows = events(spark, sf_dir).select("user_id", "at", "event_id", "event_type")
    made = rows.groupBy("user_id").applyInPandasWithState(count_funnels, "user_id long, n_funnels long", "step long, done long", "update", GroupStateTimeout.NoTimeout)
    return updated(made, "funnels", ["user_id"])


@query("""SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 30 MINUTE
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_clicks_to_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two streams within half an hour; watermarks on both let old rows go."""
    clicks = events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("at").alias("clicked")).withWatermark("clicked", DELAY)
    purchases = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "at").withWatermark("at", DELAY)
    met = clicks.join(purchases, F.expr("u = user_id and at >= clicked and at <= clicked + interval 30 minutes"))
    return appended(met.select("click_id", "purchase_id"), "clicks")
