"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialise


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) of the graph with edges a, b over nodes 0 to n - 1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    on = np.flatnonzero(label != np.arange(n))
    return on, label[on]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (id, component): the least id of each node's component, for nodes with an edge other than the least ones.

    A hub's edges are never gathered: each round takes a minimum per node and
    joins it back. Each half of a round is a written table, deleted when the next one
    is there. Self links and nulls are dropped.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        large = materialise(_large_star(e), "stars")  # read three times; else its plan would be written out for each
        drop(e)
        e = materialise(_small_star(large), "stars")
        drop(large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def unlinked(held: DataFrame, most_rows: int, most_weight: int) -> DataFrame:
    """What is left to compare in groups once links between some of their members are known.

    held (key, rep, n, comp, ...): members of groups, their weights and components so far -> the same columns
    and minor, minor_chunks, all_chunks, of the groups that more than one component holds, as a written table.
    minor: outside the group's largest component. A chunk has about most_rows and most_weight.
    """
    by_comp = held.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    by_key = by_comp.groupBy("key").agg(F.max(F.struct("rows", "weight", "comp")).alias("major"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.count("*").alias("comps")).where("comps > 1")
    chunks = lambda rows, weight: F.ceil(F.greatest(rows / most_rows, weight / most_weight)).cast("int")
    by_key = by_key.select("key", F.col("major.comp").alias("major"), chunks(F.col("rows") - F.col("major.rows"), F.col("weight") - F.col("major.weight")).alias("minor_chunks"), chunks(F.col("rows"), F.col("weight")).alias("all_chunks"))
    by_key = materialise(by_key, "open")  # as a table, so that Spark can split a large group's part of the join
    return materialise(held.join(by_key, "key").withColumn("minor", F.col("comp") != F.col("major")).drop("major"), "unlinked")


def dealt(rest: DataFrame) -> DataFrame:
    """unlinked() rows for each task that compares them: key, i, j name the task of chunk i of the minor members, its rows with minor_side, and chunk j of all members."""
    chunk = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = [c for c in rest.columns if not c.endswith("_chunks")]
    minor = rest.where("minor").select(*cols, F.lit(True).alias("minor_side"), chunk(F.col("minor_chunks")).alias("i"), every("all_chunks").alias("j"))
    whole = rest.select(*cols, F.lit(False).alias("minor_side"), chunk(F.col("all_chunks")).alias("j"), every("minor_chunks").alias("i"))
    return minor.unionByName(whole)


def leaders(held: DataFrame, n: int) -> DataFrame:
    """held (key, rep, ...) -> key, to: for each key the first n of its rows, as structs, in as many orders by hash of rep; the same rep comes first for many keys. A written table."""
    firsts = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), *held.columns)).alias(f"l{k}") for k in range(n)]
    return materialise(held.groupBy("key").agg(*firsts).select("key", F.explode(F.array(*(f"l{k}" for k in range(n)))).alias("to")), "leaders")
