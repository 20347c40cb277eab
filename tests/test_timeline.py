"""Rows before and after, periods and filled series against plain versions; hot keys, odd rows."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import timeline

START = datetime.datetime(2024, 1, 1)


def at(m):
    return None if m is None else START + datetime.timedelta(minutes=m)


def plain_periods(rows):
    """rows: key, minute, order, state."""
    out = []
    for key in {r[0] for r in rows}:
        last = {}
        for _, m, o, s in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], (r[2] is not None, r[2] or 0), (r[3] is not None, r[3] or ""))):
            last[m] = s
        changes = [(m, s) for k, (m, s) in enumerate(last.items()) if k == 0 or s != list(last.values())[k - 1]]
        out += [(key, s, at(m), at(n[0]) if n else None) for (m, s), n in zip(changes, [*changes[1:], None], strict=True)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(k, at(m), o, s) for k, m, o, s in rows], "k string, at timestamp_ntz, o int, state string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def changes():
    r = random.Random(5)
    rows = [(r.choice("abcdefgh"), r.randrange(4000), r.randrange(3), r.choice(["x", "y", None])) for _ in range(300)]
    rows += [("hot", m, 0, "xy"[m // 7 % 2]) for m in range(0, 3000, 2)] + [("hot", 9000, 1, "x")]  # most of all rows, and a long gap
    rows += [(None, 5, 1, "x"), (None, 6, 1, "x"), (None, 7, 1, "y"), ("a", None, 1, "x"), ("t", 1, 1, "x"), ("t", 1, 1, "y"), ("t", 1, None, "z")]
    return rows + rows[:50]  # repeated rows


@pytest.mark.parametrize("block_seconds", [60, 3600, 10**7])
def test_periods_equal_plain_ones(spark, changes, block_seconds):
    got = timeline.periods(frame(spark, changes), ["k"], "at", ["state"], ("o",), block_seconds)
    assert got.columns == ["k", "state", "valid_from", "valid_to"]
    assert rows_of(got) == plain_periods(changes)


def test_a_batch_may_come_again_and_one_period_holds_at_a_time(spark, changes):
    df = frame(spark, changes)
    once = timeline.periods(df, ["k"], "at", ["state"], ("o",))
    assert rows_of(timeline.periods(df.unionAll(df), ["k"], "at", ["state"], ("o",))) == rows_of(once)
    now = timeline.valid_at(once, F.lit(at(10**6)))
    assert now.count() == now.select("k").distinct().count() == once.select("k").distinct().count()
    assert timeline.valid_at(once, F.lit(at(-1))).count() == 0
    assert timeline.periods(df.limit(0), ["k"], "at", ["state"]).count() == 0
    with pytest.raises(ValueError, match="valid_to"):
        timeline.periods(df.withColumnRenamed("state", "valid_to"), ["k"], "at", ["valid_to"])


def plain_filled(rows, step):
    out = []
    for key in {r[0] for r in rows}:
        cells = {}
        for _, m, v in (r for r in rows if r[0] == key and r[1] is not None and r[2] is not None):
            cells[m // step] = max(v, cells.get(m // step, v))
        known = sorted(cells)
        for c, d in itertools.zip_longest(known, known[1:]):
            out.append((key, at(c * step), True, *[cells[c]] * 4))
            for x in range(c + 1, d or 0):
                a, b = cells[c], cells[d]
                out.append((key, at(x * step), False, a, b, round(a + (b - a) * ((x - c) / (d - c)), 9), a if x - c <= d - x else b))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_cells", [3, 64, timeline.BLOCK_CELLS])
def test_filled_series_equal_plain_ones(spark, block_cells):
    r = random.Random(8)
    rows = [(r.choice("abcd"), r.randrange(0, 3000), r.choice([1.0, 2.5, 7.0, None])) for _ in range(200)]
    rows += [("hot", m, float(m % 11)) for m in range(0, 1200, 5)] + [("hot", 6000, 1.0)]  # a gap of many blocks
    rows += [(None, 0, 1.0), (None, 100, 3.0), ("a", None, 9.0), ("n", 5, None), ("one", 7, 4.0), ("one", 7, 4.0)]
    df = spark.createDataFrame([(k, at(m), v) for k, m, v in rows], "k string, t timestamp_ntz, v double")
    got = timeline.filled(df, ["k"], "t", F.max("v"), 600, block_cells).withColumn("linear", F.round("linear", 9))
    assert got.columns == ["k", "at", "known", "previous", "following", "linear", "nearest"]
    assert rows_of(got) == plain_filled(rows, 10)
    assert timeline.filled(df.limit(0), ["k"], "t", F.max("v"), 600).count() == 0


def test_a_hot_key_is_spread_over_its_blocks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), (F.col("id") % 5).alias("s"))
    made = timeline.beside(df.withColumn("_block", F.floor(F.unix_seconds("t") / 3600)), ["k"], "_block", ["t"], ["s"])
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1
    assert max(sizes) < 15_000
    assert made.where("_beside is null").count() == 1
    assert made.where("_beside.s != pmod(s - 1, 5)").count() == 0
