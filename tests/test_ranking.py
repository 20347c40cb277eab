"""PageRank against a dense solution."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking


def dense(links, extra=(), damping=0.85):
    fine = [(a, b, w) for a, b, w in links if a is not None and b is not None and w is not None and 0 < w < float("inf")]
    ids = sorted({a for a, _, _ in fine} | {b for _, b, _ in fine} | set(extra))
    at, n = {i: k for k, i in enumerate(ids)}, len(ids)
    m = np.zeros((n, n))
    for a, b, w in fine:
        m[at[b], at[a]] += w
    sums = m.sum(0)
    m = np.where(sums > 0, m / np.where(sums > 0, sums, 1), 1 / n)
    x = np.linalg.solve(np.eye(n) - damping * m, np.full(n, (1 - damping) / n))
    return dict(zip(ids, x, strict=True))


def ranks(spark, links, part_links=ranking.PART_LINKS, **options):
    df = spark.createDataFrame(links, "a long, b long, w double")
    return {r.id: r["rank"] for r in ranking.page_rank(df, "a", "b", "w", part_links=part_links, **options).collect()}


def random_links():
    r = random.Random(3)
    links = [(r.randrange(40), r.randrange(50), r.choice([0.5, 1.0, 3.0])) for _ in range(150)]
    links += [(7, k, 1.0) for k in range(60)]  # a hub
    links += [(k, 7, 2.0) for k in range(30)] * 2  # repeated links, and a target of most
    return [*links, (5, 5, 1.0), (None, 3, 1.0), (3, None, 1.0), (200, 201, 0.0), (202, 203, None), (204, 205, -1.0), (206, 207, float("nan")), (208, 209, float("inf"))]


@pytest.mark.parametrize("part_links", [7, ranking.PART_LINKS])  # with the hub in nine parts, and whole
def test_ranks_equal_the_dense_solution(spark, part_links):
    want = dense(random_links(), damping=0.5)  # fewer rounds than 0.85 takes
    got = ranks(spark, random_links(), part_links, damping=0.5, tolerance=1e-9)
    assert got.keys() == want.keys()
    assert sum(abs(got[i] - want[i]) for i in want) < 1e-9
    assert abs(sum(got.values()) - 1) < 1e-12


def test_small_graphs(spark):
    assert ranks(spark, []) == {}
    assert ranks(spark, [(1, 1, 1.0)]) == {1: 1.0}
    one_way = ranks(spark, [(1, 2, 1.0)])
    assert one_way == pytest.approx(dense([(1, 2, 1.0)]), abs=1e-10)
    nodes = spark.createDataFrame([(1, "x"), (9, "y"), (9, "z"), (None, "w")], "node long, id string")
    assert ranks(spark, [(1, 2, 1.0)], nodes=nodes) == pytest.approx(dense([(1, 2, 1.0)], [9]), abs=1e-10)
    assert ranks(spark, [], nodes=nodes) == {1: 0.5, 9: 0.5}
    assert ranks(spark, [(1, 2, 1.0)], damping=0.0) == {1: 0.5, 2: 0.5}
    with pytest.raises(ValueError, match="tolerance"):
        ranks(spark, [(1, 2, 1.0)], tolerance=0.0)


def test_names_and_weights(spark):
    df = spark.createDataFrame([("x", "y", 5, "a"), ("x", "z", 5, "b")], "id string, rank string, y int, source string")
    got = {r.id: r["rank"] for r in ranking.page_rank(df, "id", "rank").collect()}
    assert got["y"] == got["z"] > got["x"]
    assert {r.id for r in ranking.page_rank(df.withColumn("w", F.lit(2)), "rank", "id", "w").collect()} == {"x", "y", "z"}
