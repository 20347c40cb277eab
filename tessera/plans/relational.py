"""Relational queries over the star schema, events and text tables.

Sums of money are exact decimals, cast to double at the end, so that no result
depends on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.sessions import sessions as sessionise
from tessera.sources import table

from .registry import money, query


def revenue() -> Column:
    return F.sum(money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue")


REVENUE = "sum(l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS revenue"


@query(f"""SELECT n_name, year(o_orderdate)::INT AS order_year, {REVENUE}, count(*) AS n_items
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY ALL""")
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1999-01-01'")
    joined = orders.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").alias("order_year")).agg(revenue(), F.count("*").alias("n_items"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(14,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(14,2))::DOUBLE AS sum_price,
  min(l_discount) AS min_discount, max(l_tax) AS max_tax, count(*) AS n_items, count(DISTINCT l_suppkey) AS n_suppliers
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then aggregates, one of them over distinct values."""
    items = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-01'")
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"),
        F.min("l_discount").alias("min_discount"), F.max("l_tax").alias("max_tax"), F.count("*").alias("n_items"), F.count_distinct("l_suppkey").alias("n_suppliers"),
    )


@query("""SELECT o_orderpriority, count(*) AS n_orders FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL""")
def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join."""
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(sum(l_quantity::DECIMAL(14,2)), 0)::DOUBLE AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def items_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer join; the items are summed before the join, so only one row per order is dealt out."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(money("l_quantity")).alias("q"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("q", F.lit(0)).cast("double").alias("quantity"))


@query("""SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::INT AS any_status, grouping(o_orderpriority)::INT AS any_priority,
  count(*) AS n_orders FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("any_status"), F.grouping("o_orderpriority").cast("int").alias("any_priority"), F.count("*").alias("n_orders"))


@query("""SELECT o_custkey, o_orderkey, rank::INT AS rank, days::INT AS days FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER w AS rank, date_diff('day', lead(o_orderdate) OVER w, o_orderdate) AS days
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey)) WHERE rank <= 3""")
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest orders of each customer and the days since the one before. The first filter is a rank limit, which Spark
    applies before the shuffle too, so a customer with many orders sends four rows from each task."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey")
    few = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.row_number().over(w).alias("rank")).where("rank <= 4")
    days = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lead("o_orderdate").over(w)))
    return few.select("o_custkey", "o_orderkey", "rank", days.alias("days")).where("rank <= 3")


@query("""SELECT event_id, user_id, (count(*) OVER w)::BIGINT AS n_before FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def events_in_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range frame over time. Each event is in the window of its day, and of the next day for others to count, so that a busy user's history isn't one task's.
    Events without a time count those without a time."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400)
    own = F.struct(day.alias("day"), F.lit(True).alias("own"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.explode(F.when(day.isNull(), F.array(own)).otherwise(F.array(own, F.struct((day + 1).alias("day"), F.lit(False).alias("own"))))).alias("in"))
    w = Window.partitionBy("user_id", "in.day").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return rows.select("event_id", "user_id", F.count("*").over(w).alias("n_before"), "in.own").where("own").drop("own")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL""")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n_events", "n_users")


@query("""SELECT user_id, min(ts) AS began, count(*) AS n_events FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: a user's events less than 30 minutes apart, from bins that are summed up before the shuffle, so that a busy user isn't one task's."""
    return sessionise(table(spark, sf_dir, "events"), ["user_id"], "ts", 1800).select("user_id", "began", F.col("n_rows").alias("n_events"))


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM
(SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def click_after_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each click with the user's latest purchase, by a sort of both within the user's day; the last purchase of the days
    before comes from one row for each day, so that a busy user's history isn't one task's."""
    events = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select("event_id", "user_id", "ts", "event_type", F.to_date("ts").alias("day"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", F.col("event_type").desc()).rowsBetween(Window.unboundedPreceding, 0)
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    days = events.groupBy("user_id", "day").agg(F.max_by(purchase, F.when(purchase.isNotNull(), F.struct("ts", "event_id"))).alias("last"))
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("user_id", "day", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    clicks = events.select("event_id", "user_id", "day", "event_type", F.last(purchase, ignorenulls=True).over(w).alias("today")).where("event_type = 'click'")
    return clicks.join(days, ["user_id", "day"]).select("event_id", F.coalesce("today", "carried").alias("purchase_id"))


@query("""SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def purchases_soon_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: ten-minute bins as a second key, so that a busy user's events aren't all paired and not one task's."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).alias("bin"))
    a = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("from"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    b = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts", "bin")
    return a.join(b, ["user_id", "bin"]).where(F.expr("ts > `from` and ts <= `from` + interval 10 minutes")).select("click_id", "purchase_id")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL""")
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot with stated values, so that no pass over the data finds them."""
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0)


@query("""(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def nations_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations."""
    key = lambda name, column: table(spark, sf_dir, name).select(F.col(column).alias("nation"))
    return key("customer", "c_nationkey").intersect(key("supplier", "s_nationkey")).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("""SELECT p_brand, upper(substr(p_name, 1, 3)) AS head, length(p_name)::INT AS n_chars, p_partkey,
  CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class
FROM part WHERE p_type LIKE '%A%' AND p_size IN (1, 5, 9, 20, 33)""")
def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates and text functions."""
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, sf_dir, "part").where(F.col("p_type").like("%A%") & F.col("p_size").isin(1, 5, 9, 20, 33)).select("p_brand", F.upper(F.substring("p_name", 1, 3)).alias("head"), F.char_length("p_name").alias("n_chars"), "p_partkey", size.alias("size_class"))


@query("""SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20""")
def richest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report."""
    return table(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("""SELECT l_shipdate, n_items, (sum(n_items) OVER (ORDER BY l_shipdate ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::BIGINT AS week FROM
(SELECT l_shipdate, count(*) AS n_items FROM lineitem GROUP BY ALL)""")
def weekly_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row frame over one series: days are counted first, so the window without a key has a row for each day."""
    days = table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n_items"))
    return days.withColumn("week", F.sum("n_items").over(Window.orderBy("l_shipdate").rowsBetween(-6, 0)))
