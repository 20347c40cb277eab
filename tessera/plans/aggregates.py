"""Grouping sets, unpivot, exact and approximate statistics, windows, and set operations on bags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.running import running
from tessera.sources import table

from .registry import money, query


@query("""SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n_orders, sum(o_totalprice::DECIMAL(14,2))::DOUBLE AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_orders"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("""SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS ship_year, count(*) AS n_items FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus, year(l_shipdate)), ())""")
def item_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year"))
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linestatus"), F.col("ship_year")], []]
    return items.groupingSets(sets, "l_returnflag", "l_linestatus", "ship_year").agg(F.count("*").alias("n_items"))


@query("""WITH t AS (SELECT l_returnflag, sum(l_quantity::DECIMAL(14,2))::DOUBLE AS quantity, sum(l_extendedprice::DECIMAL(14,2))::DOUBLE AS price, count(*)::DOUBLE AS items FROM lineitem GROUP BY ALL)
SELECT l_returnflag, 'quantity' AS measure, quantity AS value FROM t UNION ALL SELECT l_returnflag, 'price', price FROM t UNION ALL SELECT l_returnflag, 'items', items FROM t""")
def item_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivot, after the aggregate."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(money("l_quantity")).cast("double").alias("quantity"), F.sum(money("l_extendedprice")).cast("double").alias("price"), F.count("*").cast("double").alias("items"))
    return t.unpivot("l_returnflag", ["quantity", "price", "items"], "measure", "value")


@query("""SELECT l_linestatus, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median, quantile_cont(l_quantity, 0.9) AS q9, round(stddev_samp(l_quantity), 6) AS spread, round(var_pop(l_quantity), 6) AS variance
FROM lineitem GROUP BY ALL""")
def quantity_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles: quantities have few distinct values, which are counted, not sorted."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.percentile(q, 0.25).alias("q1"), F.median(q).alias("median"), F.percentile(q, 0.9).alias("q9"), F.round(F.stddev_samp(q), 6).alias("spread"), F.round(F.var_pop(q), 6).alias("variance"))


@query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, true AS customers_near, true AS median_near FROM orders GROUP BY ALL""")
def approximate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts and quantiles, beside exact figures that tell whether they are within 5 % and 2 % of ranks."""
    orders = table(spark, sf_dir, "orders")
    # apart from the exact count: beside it, a sketch would be kept and shuffled for every distinct customer
    made = orders.groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.01).alias("about"), F.percentile_approx("o_totalprice", 0.5, 1000).alias("middle"), F.count("*").alias("n"))
    exact = orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"))
    below = orders.join(F.broadcast(made), "o_orderpriority").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") <= F.col("middle")).alias("below"))  # five priorities
    near = lambda a, b, most: F.abs(a - b) <= most * b
    return made.join(exact, "o_orderpriority").join(below, "o_orderpriority").select("o_orderpriority", "n_customers", near(F.col("about"), F.col("n_customers"), 0.05).alias("customers_near"), near(F.col("below"), F.col("n") / 2, 0.04).alias("median_near"))


@query("""SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS quarter,
  round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS reached FROM orders WINDOW w AS (PARTITION BY o_orderdate ORDER BY o_orderpriority)""")
def ranks_of_the_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks among the orders of a day. Those by priority come from counts of (day, priority), made before the shuffle; quarters by price from
    places in one running order of all days, less those of the days before: so no day is one task's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    counts = orders.groupBy("o_orderdate", "o_orderpriority").agg(F.count("*").alias("n"))
    of_day = Window.partitionBy("o_orderdate")
    by_priority = of_day.orderBy("o_orderpriority")
    reached = F.sum("n").over(by_priority.rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select("o_orderdate", "o_orderpriority", (reached - F.col("n") + 1).alias("place"), F.row_number().over(by_priority).cast("long").alias("dense"), reached.alias("reached_n"), F.sum("n").over(of_day).alias("of_day"))
    placed = running(orders, ["o_orderdate", "-o_totalprice"], ["o_orderkey"], {}).select("o_orderkey", "o_orderdate", "o_orderpriority", "row_number")
    days = counts.groupBy("o_orderdate").agg(F.sum("n").alias("n"))
    before = running(days, ["o_orderdate"], [], {"up_to": "n"}).select(F.col("o_orderdate").alias("day"), (F.col("up_to") - F.col("n")).alias("before"))
    both = placed.join(ranks, ["o_orderdate", "o_orderpriority"]).join(before, F.col("o_orderdate") == F.col("day"))
    each, more, at = F.expr("of_day div 4"), F.col("of_day") % 4, F.col("row_number") - F.col("before")
    quarter = F.when(at <= more * (each + 1), F.expr("(row_number - before - 1) div (of_day div 4 + 1) + 1")).otherwise(more + F.expr("(row_number - before - of_day % 4 * (of_day div 4 + 1) - 1) div greatest(of_day div 4, 1) + 1"))
    share = F.when(F.col("of_day") > 1, (F.col("place") - 1) / (F.col("of_day") - 1)).otherwise(0.0)
    return both.select("o_orderkey", "place", "dense", quarter.alias("quarter"), F.round(share, 9).alias("share"), F.round(F.col("reached_n") / F.col("of_day"), 9).alias("reached"))


@query("""SELECT event_id, lag(event_type) OVER w AS before, first_value(event_id) OVER w AS first_of_day, last_value(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_of_day,
  nth_value(event_id, 2) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_of_day FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)""")
def steps_of_the_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analytic windows over a user's events of a day, so that no window holds a user's whole history."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.first("event_id").over(w).alias("first_of_day"),
        F.last("event_id").over(whole).alias("last_of_day"), F.nth_value("event_id", 2).over(whole).alias("second_of_day"),
    )


@query("""SELECT 'union' AS operation, nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) GROUP BY ALL
UNION ALL SELECT 'union all', nation, count(*) FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL
UNION ALL SELECT 'intersect all', nation, count(*) FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT ALL SELECT s_nationkey FROM supplier) GROUP BY ALL
UNION ALL SELECT 'except all', nation, count(*) FROM (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY ALL""")
def bags_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, and the set operations on bags."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal"), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    some, c = c.where("c_acctbal > 9000").select("nation"), c.select("nation")
    made = {"union": c.union(s).distinct(), "union all": c.union(s), "intersect all": some.intersectAll(s), "except all": some.exceptAll(s)}
    parts = [df.groupBy("nation").agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "nation", "n") for name, df in made.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("""SELECT w AS began, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events, LATERAL (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS w FROM range(4) t(k)) GROUP BY ALL""")
def sliding_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of an hour, each quarter of an hour."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users")).select(F.col("w.start").cast("timestamp_ntz").alias("began"), "n_events", "n_users")
