"""Scalar functions: text, dates, numbers, JSON and arrays, and functions of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import revenue_by_flag, share_of_group, size_code, words_of
from tessera.sources import table

from .registry import money, query


def bins_of(rows: DataFrame, size: int) -> int:
    """Bins of about `size` rows, 8 at least."""
    return max(8, -(-rows.count() // size))


@query(r"""SELECT p_partkey, regexp_extract(p_name, '([A-Za-z]+)', 1) AS word, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS masked, split_part(p_brand, '#', 2) AS brand_no,
  lpad(p_partkey::VARCHAR, 8, '0') AS padded, reverse(p_brand) AS backwards, concat_ws('/', p_brand, p_type) AS path, strpos(p_type, 'A')::INT AS place, replace(trim(p_name), ' ', '_') AS joined FROM part""")
def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_extract("p_name", "([A-Za-z]+)", 1).alias("word"), F.regexp_replace("p_type", "[AEIOU]", "*").alias("masked"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.reverse("p_brand").alias("backwards"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.instr("p_type", "A").alias("place"), F.replace(F.trim("p_name"), F.lit(" "), F.lit("_")).alias("joined"),
    )


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, quarter(o_orderdate)::INT AS quarter, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS due, last_day(o_orderdate::DATE) AS month_end,
  dayofweek(o_orderdate)::INT AS weekday, strftime(o_orderdate, '%Y/%m/%d') AS written, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days FROM orders""")
def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.trunc(day, "month").alias("month"), F.quarter("o_orderdate").alias("quarter"), F.add_months(day, 1).alias("due"), F.last_day(day).alias("month_end"),
        (F.dayofweek("o_orderdate") - 1).alias("weekday"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("written"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
    )


@query("""SELECT l_linenumber, count(*) AS n_items, sum(floor(l_quantity / 7))::DOUBLE AS sevens, sum(l_quantity::BIGINT % 5)::BIGINT AS rest, max(greatest(l_quantity, 20)) AS most, sum(CASE WHEN l_discount = 0 THEN NULL ELSE 1 END)::BIGINT AS n_cut,
  max(round(sqrt(l_quantity), 6)) AS root, max(power(l_quantity, 2)) AS square, min(abs(l_quantity - 25)) AS gap, sum(ceil(l_extendedprice / 1000)::BIGINT)::BIGINT AS thousands FROM lineitem GROUP BY ALL""")
def item_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number functions; a division by zero is a null."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        F.count("*").alias("n_items"), F.sum(F.floor(q / 7)).cast("double").alias("sevens"), F.sum(q.cast("long") % 5).alias("rest"), F.max(F.greatest(q, F.lit(20.0))).alias("most"), F.count(F.try_divide(F.lit(1.0), F.col("l_discount"))).alias("n_cut"),
        F.max(F.round(F.sqrt(q), 6)).alias("root"), F.max(F.pow(q, F.lit(2))).alias("square"), F.min(F.abs(q - 25)).alias("gap"), F.sum(F.ceil(F.col("l_extendedprice") / 1000)).alias("thousands"),
    )


@query("""SELECT event_type, props->>'$.k' AS k, count(*) AS n_events FROM events GROUP BY ALL""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, parsed with a stated schema."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.from_json("props", "k string")["k"].alias("k")).agg(F.count("*").alias("n_events"))


@query("""SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment))) AS segments, len(list(c_custkey))::INT AS n_customers, list_aggregate(list_transform(list(c_custkey), lambda x: x * 2), 'sum')::BIGINT AS doubled,
  len(list_filter(list(c_custkey), lambda x: x % 3 = 0))::INT AS thirds, list_contains(list(c_mktsegment), 'BUILDING') AS builds FROM customer GROUP BY ALL""")
def nation_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higher-order functions on arrays of a nation's customers. Arrays are of bins of some thousands of customers, whose figures are added up, so that no nation is one row's."""
    customers = table(spark, sf_dir, "customer")
    bins = F.pmod(F.xxhash64("c_custkey"), F.lit(bins_of(customers, 8192)))
    t = customers.groupBy("c_nationkey", bins.alias("bin")).agg(F.collect_list("c_custkey").alias("keys"), F.collect_set("c_mktsegment").alias("segments"))
    t = t.select(
        "c_nationkey", "segments", F.size("keys").alias("n_customers"), F.aggregate(F.transform("keys", lambda x: x * 2), F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"),
        F.size(F.filter("keys", lambda x: x % 3 == 0)).alias("thirds"), F.array_contains("segments", "BUILDING").alias("builds"),
    )
    segments = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort("segments")))))  # sets of a few segments
    return t.groupBy("c_nationkey").agg(segments.alias("segments"), F.sum("n_customers").cast("int").alias("n_customers"), F.sum("doubled").alias("doubled"), F.sum("thirds").cast("int").alias("thirds"), F.bool_or("builds").alias("builds"))


@query("""SELECT p_partkey, p_brand || '-' || CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END || p_size::VARCHAR AS code FROM part""")
def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function in pandas, by Arrow batches."""
    return table(spark, sf_dir, "part").select("p_partkey", size_code("p_brand", "p_size").alias("code"))


@query("""SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)) / 1000, 0) AS thousands FROM lineitem GROUP BY ALL""")
def revenue_by_own_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate in pandas, run for each salted part of a group, then summed, so that no group is gathered in one task."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.pmod(F.xxhash64("l_orderkey"), F.lit(64)).alias("salt")).agg(revenue_by_flag("l_extendedprice", "l_discount").alias("part"))
    return parts.groupBy("l_returnflag").agg(F.round(F.sum("part") / 1000, 0).alias("thousands"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS share FROM lineitem""")
def shares_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped map in pandas; an order has few items, and orders are handed over many at a time."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    bins = items.withColumn("bin", F.pmod(F.xxhash64("l_orderkey"), F.lit(bins_of(items, 65_536))))  # of some ten thousand items, whatever the table
    return bins.groupBy("bin").applyInPandas(share_of_group, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, share double")


@query("""SELECT word, place::INT AS place, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS place FROM part) GROUP BY ALL""")
def words_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of one's own, joined laterally."""
    spark.udtf.register("words_of", words_of)
    words = words_of(F.col("p_name").outer())
    return table(spark, sf_dir, "part").lateralJoin(words).groupBy("word", "place").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus, count(*) AS n_orders, sum(o_totalprice::DECIMAL(14,2))::DOUBLE AS total FROM orders GROUP BY ALL""")
def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum(money("o_totalprice")).cast("double").alias("total"))
