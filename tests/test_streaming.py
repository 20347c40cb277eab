"""Streams in several batches, with late and repeated rows."""

import datetime

from pyspark.sql import functions as F

from tessera.streaming import events as streams

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def rows_at(*minutes):
    return [(i, START + datetime.timedelta(minutes=m), 1, kind) for i, m, kind in minutes]


def write(spark, path, batches):
    """A file for each batch, in order."""
    path.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, at timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(path / f"{k}"))
    return spark.readStream.schema("event_id long, at timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(path / "*"))


def test_late_rows_are_left_out_and_repeats_told_once(spark, tmp_path):
    # the watermark is 110 minutes after the second batch and holds for late rows one batch on: what comes at 20 minutes then is too late, at 115 isn't
    batches = [rows_at((1, 0, "view"), (2, 5, "view")), rows_at((3, 120, "view"), (1, 0, "view")), rows_at((5, 115, "view"), (3, 120, "view")), rows_at((4, 20, "view")), rows_at((6, 300, "view"))]
    stream = write(spark, tmp_path / "a", batches)
    counts = stream.withWatermark("at", streams.DELAY).groupBy(F.window("at", "10 minutes").alias("w")).agg(F.collect_set("event_id").alias("ids"))
    got = streams.appended(counts.select((F.unix_timestamp("w.start") - int(START.timestamp())).alias("s"), "ids"), "late")
    assert {(r.s // 60, tuple(sorted(r.ids))) for r in got.collect()} == {(0, (1, 2)), (110, (5,)), (120, (3,))}
    once = streams.appended(stream.withWatermark("at", streams.DELAY).dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "once")
    assert sorted(r.event_id for r in once.collect()) == [1, 2, 3, 5, 6]


def test_own_state_goes_on_from_batch_to_batch(spark, tmp_path):
    kinds = [(1, 0, "view"), (2, 1, "error"), (3, 2, "click"), (4, 3, "click"), (5, 4, "purchase"), (6, 5, "purchase"), (7, 6, "view"), (8, 7, "click"), (9, 8, "purchase")]
    stream = write(spark, tmp_path / "b", [rows_at(*kinds[k : k + 2]) for k in range(0, 9, 2)])
    made = stream.groupBy("user_id").applyInPandasWithState(streams.count_funnels, "user_id long, n_funnels long", "step long, done long", "update", "NoTimeout")
    assert [tuple(r) for r in streams.updated(made, "funnels", ["user_id"]).collect()] == [(1, 2)]


def test_click_outcomes_by_timers(spark, tmp_path):
    """Several batches, late rows, a stop and a start again; what is decided leaves the state."""
    from tessera.streaming import outcomes

    first = [
        rows_at((1, 0, "click"), (2, 10, "click"), (3, 12, "purchase"), (4, 1, "view")),
        rows_at((5, 5, "purchase"), (6, 44, "click"), (7, 45.5, "click")),  # a purchase that comes after a later one
        rows_at((8, 75.5, "purchase"), (9, 74.01, "purchase")),
    ]
    second = [
        rows_at((10, 20, "purchase"), (11, 90, "click")),  # too late for what is decided
        rows_at((12, 3, "click"), (13, 200, "click")),  # a late click is left out
        rows_at((14, 500, "purchase")),
        rows_at((15, 900, "purchase")),
    ]
    where, out, progress = tmp_path / "rows", str(tmp_path / "out"), str(tmp_path / "progress")
    where.mkdir()
    state = []

    def run(batches, at):
        for k, rows in enumerate(batches, at):
            spark.createDataFrame(rows, "event_id long, at timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(where / f"{k}"))
        stream = spark.readStream.schema("event_id long, at timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(str(where / "*"))
        with outcomes.state_store(spark):
            q = outcomes.outcomes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        state.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
        return sorted((r.click_id, r.purchase_id) for r in spark.read.schema(outcomes.SCHEMA).parquet(out).collect())

    before = spark.conf.get(outcomes.PROVIDER)
    assert run(first, 0) == [(1, 5), (2, 3)]
    assert run(second, 3) == [(1, 5), (2, 3), (6, None), (7, 9), (11, None), (13, None)]
    assert spark.conf.get(outcomes.PROVIDER) == before
    assert state[-1] < max(state)


def test_click_outcomes_of_many_users_are_few_rows_of_state(spark, tmp_path):
    """SQL's rows with users that are null and times that differ by microseconds; state grows with time, not with users."""
    import random

    import duckdb

    from tessera.plans.registry import ORACLES, QUERIES
    from tessera.streaming import outcomes

    r = random.Random(3)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.choice([r.randint(0, 150), 150 * r.random()]), microseconds=r.randint(0, 3))
    rows = [(i, at(), r.choice([None, 7, 7, r.randint(0, 3000), r.randint(0, 3000)]), r.choice(["click", "purchase", "view"])) for i in range(6000)]
    rows += [(6000, datetime.datetime(2024, 1, 1, 4), 7, "view"), (6001, datetime.datetime(2024, 1, 1, 2, 20), 7, "click"), (6002, None, 7, "click")]
    rows += [(6003, datetime.datetime(2024, 1, 1, 0, 20, 0, 700), -9, "click"), (6004, datetime.datetime(2024, 1, 1, 0, 20, 0, 600), -9, "purchase"), (6005, datetime.datetime(2024, 1, 1, 0, 50, 0, 701), -9, "purchase")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLES["stream_click_outcomes"]).fetchall()
    got = [tuple(x) for x in QUERIES["stream_click_outcomes"](spark, str(tmp_path)).select("user_id", "click_id", "purchase_id").collect()]
    assert len(want) > 1000 and sorted(got, key=repr) == sorted(want, key=repr) and (-9, 6003, None) in got

    with outcomes.state_store(spark):
        q = outcomes.outcomes(streams.events(spark, str(tmp_path))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert 0 < most < 6 * 4 * outcomes.SHARDS  # hours of clicks and purchases, and a few timers in two tables, whatever the number of users
