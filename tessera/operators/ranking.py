"""PageRank of a graph of weighted links.

A node's rank is (1 - damping) / n, plus damping times what its links bring: each
node gives its rank to its targets by weight. A node without links out gives its rank
to all alike. That needs no sum in each round: up to a factor, ranks solve
y = 1/n + damping * (what links bring), and are y over its sum. Rounds go on until
y is known to be within `tolerance` of its sum (the last change times
damping / (1 - damping) bounds the error, in the sum of absolute differences).

Links are dealt by source once and stay there; a round sends a row for each node to
them, and their sums by target, which tasks make before the shuffle, back. A hub's
links are dealt in parts, each of at most max(2^16, links / 4096), so there are at
most 4096 hubs, and their list is the only thing that is broadcast. Each round's
ranks are written to the shared folder, and the round before the last is deleted. The
driver gets two sums a round.

Repeated links add their weights; a link to oneself is a link. Links with a null
end, or a weight that is null, not above 0 or not finite, are left out, and so are
null nodes. An empty graph gives an empty result.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import scratch

#: Links that a part has at most, and hubs that there are at most.
PART_LINKS, MOST_HUBS = 1 << 16, 4096


def page_rank(links: DataFrame, source: str, target: str, weight: str | None = None, nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-10, part_links: int = PART_LINKS) -> DataFrame:
    """id, rank of each node of the links, and of `nodes` (its first column) if given. Ranks add up to 1."""
    if not 0 <= damping < 1 or not 1e-13 <= tolerance < 1:
        raise ValueError("damping is at least 0 and below 1, tolerance at least 1e-13 and below 1")
    spark = links.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    some = links.select(F.col(source).alias("source"), F.col(target).alias("target"), w.alias("w")).where("source is not null and target is not null and w > 0 and w < double('infinity')")
    edges = some.groupBy("source", "target").agg(F.sum("w").alias("w")).persist(StorageLevel.DISK_ONLY)  # read by the counts and the deal; a lost part is made again
    every = edges.select(F.col("source").alias("id")).unionAll(edges.select("target"))
    if nodes is not None:
        every = every.unionAll(nodes.select(F.col(nodes.columns[0]).alias("id")).where("id is not null"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("gives"), F.count("*").alias("n_links"))
    split = max(part_links, -(-edges.count() // MOST_HUBS))
    parts = F.ceil(F.col("n_links") / split).cast("int")
    start = every.select("id", F.lit(None).cast("double").alias("gives"), F.lit(0).alias("parts")).unionAll(out.select("id", "gives", parts))
    start = start.groupBy("id").agg(F.max("gives").alias("gives"), F.max("parts").alias("parts"))
    hubs = out.where(F.col("n_links") > split).select(F.col("id").alias("source"), parts.alias("parts"))  # at most MOST_HUBS, as each has more than 1/MOST_HUBS of all links
    part = F.pmod(F.xxhash64("target"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = edges.join(F.broadcast(hubs), "source", "left").select("source", part.alias("part"), "target", "w").repartition("source", "part").persist(StorageLevel.DISK_ONLY)
    path = scratch.folder(spark, "ranks")
    n = _stored(start.select("id", "gives", "parts", F.lit(1.0).alias("y"), F.lit(0.0).alias("change")), f"{path}/0").count()
    if not n:
        dealt.unpersist()
        edges.unpersist()
        return start.select("id", F.lit(None).cast("double").alias("rank"))
    ranks, error, done = spark.read.parquet(f"{path}/0"), math.inf, 0
    while error > tolerance:
        done += 1
        ranks = _stored(_round(ranks, dealt, damping), f"{path}/{done}")
        change, total = ranks.agg(F.sum("change"), F.sum("y")).first()
        error = change * damping / (1 - damping) / total
        if done > 1:
            scratch.remove(spark, f"{path}/{done - 2}")
    dealt.unpersist()
    edges.unpersist()
    return ranks.select("id", (F.col("y") / F.lit(total)).alias("rank"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _round(ranks: DataFrame, dealt: DataFrame, damping: float) -> DataFrame:
    """id, gives, parts, y (n times the y above) and its change of the next round. Nodes and what they get are added up in one shuffle."""
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    givers = ranks.where("parts > 0").select(F.col("id").alias("source"), each_part.alias("part"), (F.col("y") / F.col("gives")).alias("unit"))
    nothing: Column = F.lit(None)
    got = givers.join(dealt, ["source", "part"]).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("unit") * F.col("w")).alias("got"))
    both = ranks.select("id", "gives", "parts", "y", F.lit(0.0).alias("got")).unionAll(got.select("id", nothing.cast("double"), nothing.cast("int"), nothing.cast("double"), "got"))
    added = both.groupBy("id").agg(F.max("gives").alias("gives"), F.max("parts").alias("parts"), F.max("y").alias("old"), F.sum("got").alias("got"))
    return added.withColumn("y", 1 + damping * F.col("got")).select("id", "gives", "parts", "y", F.abs(F.col("y") - F.col("old")).alias("change"))
