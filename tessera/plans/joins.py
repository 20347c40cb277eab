"""Outer, theta and lateral joins, and correlated subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import table

from .registry import money, query


@query("""SELECT coalesce(c.nation, s.nation) AS nation, c.n AS n_customers, s.n AS n_suppliers FROM
(SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY ALL) c
FULL JOIN (SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY ALL) s ON c.nation = s.nation""")
def rich_customers_and_indebted_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of two counts, each made before the join."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nation", "full")


@query("""SELECT p_partkey, r.n AS n_returned FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 GROUP BY ALL) r
RIGHT JOIN (SELECT p_partkey FROM part WHERE p_size IS NOT NULL AND p_brand IS NOT NULL) ON l_partkey = p_partkey""")
def returns_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right outer join; parts without returns have a null."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").groupBy("l_partkey").agg(F.count("*").alias("n_returned"))
    parts = table(spark, sf_dir, "part").where(F.col("p_size").isNotNull() & F.col("p_brand").isNotNull())
    return returned.join(parts, F.col("l_partkey") == F.col("p_partkey"), "right").select("p_partkey", "n_returned")


@query("""SELECT a.n_name AS nation, b.n_name AS other, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
JOIN region ON r_regionkey = a.n_regionkey""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi join with a theta condition beside it."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("nation")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("other"))
    return a.join(b, "n_regionkey").where("a < b").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("nation", "other", "r_name")


@query("""SELECT band, count(*) AS n_orders, sum(o_totalprice::DECIMAL(14,2))::DOUBLE AS total FROM orders
JOIN (VALUES ('low', 0, 100000), ('middle', 100000, 300000), ('high', 300000, 100000000)) b (band, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY ALL""")
def orders_by_price_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join without an equal key: the bands are three rows, so each order meets them in place."""
    bands = spark.createDataFrame([("low", 0, 100_000), ("middle", 100_000, 300_000), ("high", 300_000, 100_000_000)], "band string, lo long, hi long")
    met = table(spark, sf_dir, "orders").join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi")))
    return met.groupBy("band").agg(F.count("*").alias("n_orders"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 2) WHERE c_acctbal > 5000""")
def largest_orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lateral join; Catalyst turns the limit into a rank within the customer."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(2)
    return table(spark, sf_dir, "customer").where("c_acctbal > 5000").lateralJoin(orders.select("o_orderkey", "o_totalprice")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE 2 * o_totalprice::DECIMAL(14,2) > (SELECT 3 * sum(o_totalprice::DECIMAL(14,2)) / count(*) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderstatus = 'F')""")
def orders_above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated scalar subquery: orders of more than one and a half times the average of the customer's finished ones."""
    inner = table(spark, sf_dir, "orders").alias("i").where((F.col("i.o_custkey") == F.col("o.o_custkey").outer()) & (F.col("i.o_orderstatus") == "F"))
    average = inner.select(3 * F.sum(money("i.o_totalprice")).cast("double") / F.count("*")).scalar()
    return table(spark, sf_dir, "orders").alias("o").where(2 * money("o.o_totalprice") > average).select("o_orderkey", "o_custkey")


@query("""SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_discount >= 0.1)
AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9990)""")
def suppliers_by_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated EXISTS and NOT EXISTS, planned as semi and anti join."""
    items = table(spark, sf_dir, "lineitem").where((F.col("l_suppkey") == F.col("s_suppkey").outer()) & (F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.1))
    rich = table(spark, sf_dir, "customer").where((F.col("c_nationkey") == F.col("s_nationkey").outer()) & (F.col("c_acctbal") > 9990))
    return table(spark, sf_dir, "supplier").where(items.exists() & ~rich.exists()).select("s_suppkey")
