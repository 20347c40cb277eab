"""The library's own operators: odd rows, hot keys, and plain versions."""

import datetime
import itertools
import random
import time
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  it has all queries registered
from tessera.operators import neighbours, overlaps, running, sessions, sketches
from tessera.plans.registry import ORACLES, QUERIES
from tessera.scratch import CLEANUP
from tessera.sources import load, save

START = datetime.datetime(2024, 1, 1)


def minutes(m):
    return START + datetime.timedelta(minutes=m)


def plan_of(df):
    return df._jdf.queryExecution().toString()


# neighbours


def plain_neighbours(queries, base, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    fine = lambda v: bool(v) and None not in v and np.isfinite(v).all() and any(v)
    out = []
    for i, v in queries:
        if i is not None and fine(v):
            near = sorted((-round(float(unit(v) @ unit(w)), 9), j) for j, w in base if j is not None and j != i and fine(w) and len(w) == len(v))
            out += [(i, r, j, -c) for r, (c, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 64, 2048])
def test_neighbours_equal_all_cosines(spark, chunk):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=16).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # equal vectors tie
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0, None] * 8), (304, [float("nan")] * 16), (305, [float("inf")] * 16), (306, [1.0] * 4), (307, [2.0] * 4), (None, rows[0][1]), (308, [1e300] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.top_neighbours(df, df, 5, chunk=chunk)
    assert sorted((x.id, x["rank"], x.neighbour, round(x.cosine, 9)) for x in out.collect()) == [(i, k, j, round(c, 9)) for i, k, j, c in plain_neighbours([x if x[0] != 308 else (308, [1.0] * 16) for x in rows], [x if x[0] != 308 else (308, [1.0] * 16) for x in rows], 5)]
    assert "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def test_neighbours_of_few_and_of_repeated_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, v string")
    none = make([])
    some = make([(1, [1.0, 0.0], 5, "x"), (1, [1.0, 0.0], 6, "y"), (2, [0.0, 1.0], 7, "z")])
    assert neighbours.top_neighbours(none, some, 3).count() == neighbours.top_neighbours(some, none, 3).count() == 0
    got = sorted((x.id, x["rank"], x.neighbour, x.cosine) for x in neighbours.top_neighbours(some, some, 3).collect())
    assert got == [(1, 1, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 1, 0.0)]


def test_neighbours_send_no_vector_to_every_block(spark, monkeypatch):
    """Several slices of the base, near ties beyond single precision; vectors aren't copied for each block of the other side."""
    monkeypatch.setattr(neighbours, "SLICE", 3000)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(500 + i, [1.0, 1e-4 * i, *[0.0] * 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [tuple(x) for x in df.collect()]
    out = neighbours.top_neighbours(df, df, 6, chunk=16)
    assert sorted((x.id, x["rank"], x.neighbour, round(x.cosine, 9)) for x in out.collect()) == [(i, k, j, round(c, 9)) for i, k, j, c in plain_neighbours(rows, rows, 6)]
    assert "explode" not in plan_of(out)


# running totals


def check_running(spark, rows, partitions):
    df = spark.createDataFrame(rows, "id long, key double, price decimal(14,2), n int")
    out = running.running(df, ["-key"], ["id"], {"total": "price", "count": "n"}, partitions=partitions)
    got = {x.id: x for x in out.collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    total, count, keys = Decimal(0), 0, []
    for place, (i, key, price, n) in enumerate(order, 1):
        total, count = total + (price or 0), count + (n or 0)
        if not keys or keys[-1][0] != key:
            keys.append((key, place))
        assert (got[i].row_number, got[i]["rank"], got[i].dense_rank, got[i].total, got[i]["count"]) == (place, keys[-1][1], len(keys), total, count)
    return out


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_running_totals_equal_one_window(spark, partitions):
    r = random.Random(partitions)
    rows = [(i, r.choice([None, 0.0, -0.0, 1.5, 2.0, r.random()]), r.choice([None, Decimal(r.randint(-999, 99999)) / 100]), r.choice([None, 1, -2])) for i in range(600)]
    out = check_running(spark, rows, partitions)
    assert partitions == 1 or "SinglePartition" not in plan_of(out)
    check_running(spark, [(i, 7.0, Decimal("0.01"), 1) for i in range(300)], partitions)  # one tie over all ranges


def test_running_totals_split_a_hot_key(spark):
    """A key of all rows is cut by `then`: no range has more than a small share."""
    df = spark.range(20_000).select("id", F.lit(1).alias("key"))
    out = running.running(df, ["key"], ["id"], {}, partitions=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000 and out.agg(F.max("rank"), F.max("row_number")).first()[:] == (1, 20_000)


def test_running_totals_of_little(spark):
    assert running.running(spark.createDataFrame([], "a long"), ["a"], [], {"t": "a"}).collect() == []
    with pytest.raises(TypeError, match="exact"):
        running.running(spark.createDataFrame([(1.0,)], "a double"), ["a"], [], {"t": "a"})
    with pytest.raises(ValueError, match="there already"):
        running.running(spark.createDataFrame([(1, 2)], "a long, rank long"), ["a"], [], {})
    big = spark.createDataFrame([(i, 2**62 // 10) for i in range(30)], "a long, b long")
    with pytest.raises(Exception, match="18 digits"):
        running.running(big, ["a"], [], {"t": "b"}).collect()


# sessions


def plain_sessions(rows, gap):
    out = []
    key = lambda x: (x[0] is not None, x[0] or 0)
    for user, own in itertools.groupby(sorted((x for x in rows if x[1] is not None), key=lambda x: (key(x), x[1])), key=lambda x: x[0]):
        for _, t in own:
            if out and out[-1][0] == user and (t - out[-1][2]).total_seconds() < gap:
                out[-1] = (user, out[-1][1], t, out[-1][3] + 1)
            else:
                out.append((user, t, t, 1))
    return out


def test_sessions_equal_gaps(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, minutes(r.randint(0, 3000) / 2), minutes(30 * r.randint(0, 60))])) for _ in range(900)]
    rows += [(9, minutes(0)), (9, minutes(30)), (9, minutes(59.9)), (9, minutes(60 * 24 * 400)), (9, datetime.datetime(1969, 12, 31, 23, 50)), (9, datetime.datetime(1970, 1, 1, 0, 10))]
    df = spark.createDataFrame(rows, "user long, ts timestamp_ntz")
    want = plain_sessions(rows, 1800)
    assert sorted(map(repr, ((x.user, x.began, x.ended, x.n_rows) for x in sessions.sessions(df, ["user"], "ts", 1800).collect()))) == sorted(map(repr, want))
    got = sessions.with_session(df, ["user"], "ts", 1800).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.began == next((b for u, b, e, _ in want if u == x.user and x.ts and b <= x.ts <= e), None)
    assert sessions.sessions(df.limit(0), ["user"], "ts", 1800).collect() == []


def test_sessions_of_a_busy_user_are_summed_up_before_the_shuffle(spark):
    """90 % of rows are one user's; what any task of the shuffle reads is bins."""
    df = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(7).alias("user"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000).alias("ts"))
    made = sessions.sessions(df.repartition(4), ["user"], "ts", 1800)
    assert made.where("user = 7").agg(F.sum("n_rows"), F.count("*")).first()[:] == (90_000, 1)
    plan = plan_of(made)
    assert "partial_min" in plan
    bins = df.where("user = 7").select(F.floor(F.unix_micros("ts") / 1_800_000_000)).distinct().count()
    assert bins < 60  # of the busy user's 90,000 rows


# overlaps


def check_overlaps(spark, a, b, keyed):
    make = lambda rows: spark.createDataFrame(rows, "id long, key long, f timestamp_ntz, t timestamp_ntz")
    keys = (("key",), ("key",)) if keyed else ((), ())
    made = overlaps.overlap_join(make(a), make(b), ("f", "t"), ("f", "t"), *keys)
    got = sorted((x.left_row.id, x.right_row.id) for x in made.collect())
    good = lambda x: x[2] is not None and x[3] is not None and x[2] <= x[3]
    assert got == sorted((x[0], y[0]) for x in a for y in b if good(x) and good(y) and x[2] <= y[3] and y[2] <= x[3] and (not keyed or (x[1] is not None and x[1] == y[1])))
    assert "Cartesian" not in plan_of(made) and "NestedLoop" not in plan_of(made)
    return got


@pytest.mark.parametrize("keyed", [False, True])
def test_overlaps_equal_all_pairs(spark, keyed):
    r = random.Random(8)

    def rows(n):
        out = []
        for i in range(n):
            f = minutes(r.randint(-100_000, 100_000) / 3)
            out.append((i, r.choice([1, 2, None]), f, f + datetime.timedelta(seconds=r.choice([0, 1, 60, 3600, 86_400, 10**7, 3 * 10**8]))))
        return out + [(n, 1, None, minutes(5)), (n + 1, 1, minutes(5), None), (n + 2, 1, minutes(9), minutes(5)), (n + 3, 1, minutes(5), minutes(5)), (n + 4, 1, minutes(4), minutes(5)), (n + 5, 1, minutes(5), minutes(6)), (n + 5, 1, minutes(5), minutes(6))]

    assert len(check_overlaps(spark, rows(120), rows(100), keyed)) > 500
    assert check_overlaps(spark, [], rows(5), keyed) == []


def test_an_interval_is_few_rows_whatever_its_length(spark):
    df = spark.createDataFrame([(i, minutes(0), minutes(10**i)) for i in range(8)], "id long, f timestamp_ntz, t timestamp_ntz")
    placed = overlaps._placed(df, "f", "t", "left")
    levels = sorted(r.left_level for r in placed.collect())
    cells = overlaps._cells(placed, "left", levels, []).groupBy("left_row.id").count().collect()
    assert max(r["count"] for r in cells) <= 2 * len(levels)


def test_instants_are_sent_once_for_each_length_of_cells(spark):
    """Many instants and lengths on the left, minutes on the right: hardly more rows are sent than there are."""
    left = [(i, None, minutes(i % 700), minutes(i % 700 + (0 if i % 20 else 1.7 ** (i % 14)))) for i in range(1500)]
    right = [(i, None, minutes(7 * i), minutes(7 * i + 1 + i % 40)) for i in range(100)]
    make = lambda rows: spark.createDataFrame(rows, "id long, key long, f timestamp_ntz, t timestamp_ntz")
    a, b = overlaps._dealt(make(left), make(right), ("f", "t"), ("f", "t"), (), ())
    assert a.count() < 1.5 * 1500 and b.count() < 9 * 100
    assert len(check_overlaps(spark, left, right, False)) > 1000


def test_begins_are_no_rows_of_their_own_where_both_sides_have_one_length(spark):
    left = [(i, None, minutes(i % 700), minutes(i % 700 + (0 if i % 4 else 40))) for i in range(600)]
    right = [(i, None, minutes(7 * i), minutes(7 * i + 1 + i % 40)) for i in range(100)]
    make = lambda rows: spark.createDataFrame(rows, "id long, key long, f timestamp_ntz, t timestamp_ntz")
    a, b = overlaps._dealt(make(left), make(right), ("f", "t"), ("f", "t"), (), ())
    cell = lambda at: at.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000 // 2**29  # noqa: E731  an eighth of 2^32 microseconds, the longest intervals' level
    assert (a.count(), b.count()) == tuple(sum(cell(t) - cell(f) + 1 for *_, f, t in rows) for rows in (left, right))
    assert len(check_overlaps(spark, left, right, False)) > 1000


def shuffled_bytes(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_"))


def test_shuffles_of_sessions_go_before_they_are_joined(spark, tmp_path):
    """The files of a stored result's own shuffles would stay beside it and the join's until the driver collects its garbage."""
    spark.range(200_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 10)").alias("ts"), (F.col("id") * 7919 % 5000).alias("user_id"), F.when(F.col("id") % 500 == 0, "error").otherwise("view").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    setting = spark.conf.get(CLEANUP, None)
    before = shuffled_bytes(spark)
    made = QUERIES["sessions_during_errors"](spark, str(tmp_path))
    until = time.time() + 20
    while shuffled_bytes(spark) - before > 100_000 and time.time() < until:
        time.sleep(0.2)
    assert shuffled_bytes(spark) - before <= 100_000
    assert spark.conf.get(CLEANUP, None) == setting
    assert made.count() > 1000


# formats and queries on odd rows


ODD_TEXTS = [None, "", " ", " pad ", "a\nb", "x\ry", "\r\n", "\\N", "\\E", "\\", "\\\\", "\\n", "\\\\n", "\\1", "\1", "\0011", "\\\1", "\0", '"', '""', 'a"b,c', ",", "é日本👍", "\t", "'", "#", "\\\n\\", " ", "null", "NULL", "\\0\\\\1\1"]


@pytest.mark.parametrize("form", ["csv", "json", "orc", "parquet"])
def test_texts_come_back_as_written(spark, tmp_path, form):
    texts = list(ODD_TEXTS)
    texts += ["\\" * a + c + "\\" * b for a in range(4) for b in range(3) for c in ("n", "\n", "1", "\1", "E", "N", "0", "\0")]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id long, text string, `odd name` string").coalesce(1)
    save(df, str(tmp_path / form), form)
    got = {x.id: (x.text, x["odd name"]) for x in load(spark, str(tmp_path / form), form, df).collect()}
    assert got == {i: (t, t) for i, t in enumerate(texts)}
    alone = df.select("text")
    save(alone, str(tmp_path / f"{form}-alone"), form)
    assert sorted(map(repr, (x.text for x in load(spark, str(tmp_path / f"{form}-alone"), form, alone).collect()))) == sorted(map(repr, texts))


def test_events_without_a_time_count_once(spark, tmp_path):
    rows = [(1, None, 5), (2, None, 6), (3, None, 6), (4, minutes(0), 5), (5, minutes(1), 5), (6, minutes(1440), 5), (7, minutes(1441.5), None), (8, None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(ORACLES["events_in_last_day"]).fetchall()
    got = QUERIES["events_in_last_day"](spark, str(tmp_path)).select("event_id", "user_id", "n_before").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ranks_of_a_hot_day(spark, tmp_path):
    """All orders on one day, few prices: SQL's ranks, and no task that has most of them."""
    rows = spark.range(6000).select(F.col("id").alias("o_orderkey"), F.lit(START).cast("timestamp_ntz").alias("o_orderdate"), (F.col("id") % 3).cast("string").alias("o_orderpriority"), (F.col("id") % 7).cast("double").alias("o_totalprice"))
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = QUERIES["ranks_of_the_day"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['ranks_of_the_day']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_sketches_are_not_kept_for_every_customer(spark):
    plan = plan_of(QUERIES["approximate_orders"](spark, "/root/testdata/sf0.001"))
    for line in plan.split("\n"):
        assert not ("approx_count_distinct" in line and "keys=[o_orderpriority" in line and "o_custkey" in line.split("functions=")[0])


# sketches


def test_stored_sketches_keep_their_bounds(spark, tmp_path):
    """Merged from hours, and from merged halves: the stated errors hold."""
    n, distinct = 300_000, 60_000
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 200_000)  # 17 hours of one day
    rows = spark.range(n).select(at.alias("ts"), F.pmod(F.xxhash64("id"), F.lit(distinct)).alias("user"), ((F.col("id") * 7919) % n).cast("double").alias("value"))
    save(sketches.hourly(rows, "ts", [], "user", "value"), str(tmp_path / "hours"))
    hours = spark.read.parquet(str(tmp_path / "hours"))
    ranks = (0.01, 0.25, 0.5, 0.9, 0.999)
    day = sketches.merged(hours, [F.to_date("hour").alias("day")], ranks).first()
    exact = rows.agg(F.count_distinct("user")).first()[0]
    assert hours.count() == 17 and day.n_rows == n
    assert abs(day.n_distinct / exact - 1) < 4 * 1.04 / 2 ** (sketches.LG_K / 2)
    assert all(abs(q / n - r) < 4 * 1.7 / sketches.KLL_K**0.9 for q, r in zip(day.quantiles, ranks, strict=True))
    assert "count(distinct" not in plan_of(sketches.merged(hours, [F.to_date("hour").alias("day")]))


def test_sketches_of_nulls_and_of_nothing(spark):
    rows = spark.createDataFrame([(minutes(0), "a", None, None), (minutes(1), "a", None, None), (None, "a", 1, 1.0), (minutes(70), None, 5, 2.0), (minutes(71), None, 5, None)], "ts timestamp_ntz, k string, user long, value double")
    out = {x.k: x for x in sketches.merged(sketches.hourly(rows, "ts", ["k"], "user", "value"), [F.col("k")], (0.5,)).collect()}
    assert {k: (x.n_rows, x.n_distinct, x.quantiles) for k, x in out.items()} == {"a": (2, 0, [None]), None: (2, 1, [2.0])}
    assert sketches.merged(sketches.hourly(rows.limit(0), "ts", ["k"], "user", "value"), [F.col("k")]).collect() == []


def test_days_from_sketches_are_exact_beyond_the_sketches(spark, tmp_path):
    """More users and numbers a day than the sketches keep, equal numbers, nulls, odd numbers, and rows without a time."""
    n = 60_000
    at = F.when(F.col("id") % 1000 != 7, F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3_000_000)).cast("timestamp_ntz")  # two days
    number = F.expr("case when id % 10 = 3 then null when id % 10 < 3 then 0.25 when id % 999 = 0 then double('NaN') when id % 998 = 0 then double('Infinity') else pmod(xxhash64(id), 1000003) / 1000003 end")
    rows = spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), F.expr("if(id % 11 = 0, null, pmod(xxhash64(id, 1), 20000))").alias("user_id"), number.alias("value"))
    few = spark.createDataFrame([(n, minutes(10**4), None, None), (n + 1, minutes(2 * 10**4), 1, 1.5)], "event_id long, ts timestamp_ntz, user_id long, value double")
    rows.unionAll(few).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES["days_from_stored_sketches"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['days_from_stored_sketches']})").fetchall()
    assert len(want) == 6 and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
