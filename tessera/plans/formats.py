"""Tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import folder
from tessera.sources import archives, load, save, table

from .registry import query

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _round_trip(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    orders, path = table(spark, sf_dir, "orders"), folder(spark, form)
    save(orders, path, form)
    return load(spark, path, form, orders)


@query(ORDERS)
def orders_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv")


@query(ORDERS)
def orders_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "json")


@query(ORDERS)
def orders_as_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "orc")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n_orders FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL")
def orders_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a folder for each status; the filter then skips whole folders."""
    path = folder(spark, "folders")
    save(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), path, by=("o_orderstatus",))
    return spark.read.parquet(path).where("o_orderstatus in ('F', 'P')").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n_orders"))


@query("SELECT doc_id, source, octet_length(encode(text)) AS size, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def documents_as_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as members of tar archives, named source/doc_id, written and read back."""
    archives.register(spark)
    path = folder(spark, "archives")
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.concat_ws("/", "source", "doc_id").alias("name"), F.col("text").alias("data"))
    texts.write.format("archives").mode("append").save(path)
    back = spark.read.format("archives").schema("name string, data binary, size long").load(path)
    return back.select(F.regexp_extract("name", r"\d+$", 0).cast("long").alias("doc_id"), F.nullif(F.regexp_replace("name", r"/?\d+$", ""), F.lit("")).alias("source"), "size", F.sha2("data", 256).alias("digest"))
