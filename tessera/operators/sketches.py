"""Sketches that are stored and merged: distinct counts and quantiles of any span from those of its hours.

A row for each hour and key holds a count, an HLL sketch of distinct values and a
KLL sketch of a number's quantiles. Spans are merged from these rows alone; the
rows they came from aren't read again, so a day of any number of rows costs 24.
Merging is associative: sketches of sketches are as good as those of all rows.

Error bounds: distinct counts by the HLL sketch of 2^LG_K cells have a relative
standard error of 1.04 / sqrt(2^LG_K), 0.8 %, and hardly any below a tenth of the
cells, which are then kept as a list; ranks of quantiles by KLL of KLL_K are off
by 1.7 / KLL_K^0.9 or so of all rows, 0.1 %, and exact up to KLL_K rows.

Nulls are left out of both sketches; a span without values has 0 distinct values
and null quantiles. Rows without a time are in no hour.

Where the figures must be exact, no sketch of a fixed size will do: `save_exact`
stores beside the sketches the distinct values of each hour and how often each
number occurs in it, and `merged_exact` counts in these. The sketches then say near
which numbers a quantile lies. Only the numbers there are sorted, 2 % or so of a
span's; all are counted, so what a sketch is off by costs time, not exactness.
Rows without a time are a span of their own there, as in SQL's GROUP BY.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import save

LG_K, KLL_K = 14, 4096
#: How far from a rank, as a share of all rows, the numbers are that bound what is sorted for it: ten times the error of KLL_K.
MARGIN = 0.01


def hourly(rows: DataFrame, time_col: str, keys: list[str], distinct_col: str, value_col: str) -> DataFrame:
    """hour, keys, n_rows, distinct_sketch, value_sketch."""
    timed = rows.where(F.col(time_col).isNotNull())
    return _sketched(timed, time_col, keys, distinct_col, value_col)


def _hour(time_col: str) -> Column:
    return F.date_trunc("hour", F.col(time_col).cast("timestamp")).alias("hour")


def _sketched(rows: DataFrame, time_col: str, keys: list[str], distinct_col: str, value_col: str) -> DataFrame:
    return rows.groupBy(_hour(time_col), *keys).agg(F.count("*").alias("n_rows"), F.hll_sketch_agg(distinct_col, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value_col).cast("double"), KLL_K).alias("value_sketch"))


def merged(hours: DataFrame, by: list[Column], ranks: tuple[float, ...] = (0.5,)) -> DataFrame:
    """The columns `by`, n_rows, n_distinct (estimate) and quantiles (array, in the order of ranks) of stored hours."""
    made = hours.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("value_sketch").alias("_v"))
    empty = F.kll_sketch_get_n_double("_v") == 0
    quantiles = F.array(*(F.when(~empty, F.kll_sketch_get_quantile_double("_v", F.lit(r))) for r in ranks))
    return made.withColumns({"n_distinct": F.hll_sketch_estimate("_d"), "quantiles": quantiles}).drop("_d", "_v")


def save_exact(rows: DataFrame, time_col: str, distinct_col: str, value_col: str, path: str) -> None:
    """Hours with their sketches, (hour, user) without repeats, and (hour, value, n), each in a folder of path."""
    save(_sketched(rows, time_col, [], distinct_col, value_col), f"{path}/sketches")
    save(rows.select(_hour(time_col), F.col(distinct_col).alias("item")).where("item is not null").distinct(), f"{path}/items")
    values = rows.select(_hour(time_col), F.col(value_col).cast("double").alias("value")).where("value is not null")
    save(values.groupBy("hour", "value").agg(F.count("*").alias("n")), f"{path}/values")


def merged_exact(spark: SparkSession, path: str, span: Column, ranks: tuple[str, ...] = ("0.5",)) -> DataFrame:
    """span, n_rows, n_distinct and quantiles as in `merged`, exact. Ranks are decimals in text; a quantile is the first number with at least
    that share of the span's up to it."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").withColumn("span", span)
    near = sorted({min(max(float(r) + by, 0.0), 1.0) for r in ranks for by in (-MARGIN, MARGIN)})
    spans = merged(read("sketches"), [F.col("span")], tuple(near)).select("span", "n_rows", F.col("quantiles").alias("near"))
    distinct = read("items").select("span", "item").distinct().groupBy("span").agg(F.count("*").alias("n_distinct"))

    def beside(left: DataFrame, right: DataFrame, *on: str, how: str = "inner") -> DataFrame:
        made = left.join(right.withColumnsRenamed({c: f"_{c}" for c in on}), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on)), how)
        return made.drop(*(f"_{c}" for c in on))

    values = read("values").groupBy("span", "value").agg(F.sum("n").alias("n"))
    part = F.coalesce(F.size(F.filter("near", lambda x: x < F.col("value"))), F.lit(0))
    values = beside(values, F.broadcast(spans.select("span", "near")), "span", how="left").select("span", "value", "n", part.alias("part"))  # a row for each span is sent
    of_span = Window.partitionBy("span")
    parts = values.groupBy("span", "part").agg(F.sum("n").alias("in_part"))
    parts = parts.withColumns({"up_to": F.sum("in_part").over(of_span.orderBy("part")), "all": F.sum("in_part").over(of_span)})
    target = lambda r: F.greatest(F.ceil(F.col("all").cast("decimal(20,0)") * F.lit(Decimal(r))).cast("long"), F.lit(1))
    wanted = F.posexplode(F.array(*(target(r) for r in ranks))).alias("place", "target")
    wanted = parts.select("*", wanted).where("target <= up_to and target > up_to - in_part").select("span", "part", "place", (F.col("target") - F.col("up_to") + F.col("in_part")).alias("target"))

    met = beside(values, F.broadcast(wanted), "span", "part")  # a row for each span and rank is sent
    up_to = F.sum("n").over(Window.partitionBy("span", "place").orderBy("value"))
    found = met.withColumn("up_to", up_to).where("up_to >= target").groupBy("span", "place").agg(F.min("value").alias("value"))
    found = found.groupBy("span").agg(*(F.max(F.when(F.col("place") == i, F.col("value"))).alias(f"q{i}") for i in range(len(ranks))))

    out = beside(beside(spans, distinct, "span", how="left"), found, "span", how="left")
    return out.select("span", "n_rows", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), F.array(*(F.col(f"q{i}") for i in range(len(ranks)))).alias("quantiles"))
