"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors to 16 Gaussian coordinates, scaled by a width,
and decodes them to two E8 lattice points, which name a cell. A vector is held in
its own cell and probes PROBES cells next to it in one of the two points, those
nearest to it, and some next to it in both; two vectors meet where one's cell is
held or probed by the other. Narrow cells hold fewer unlike vectors and need more
tables: PLANS has the tables with which simulation misses fewer than one in a
thousand pairs at cosine 0.95, the hardest case, and the plan that compares least
is taken for the number of vectors. So recall is the same at every size and
unlike vectors don't fill cells as their number grows.

Equal vectors are one class. Cells with few members give pairs. The members of
crowded cells are paired with LEADERS of the cell; once the links found so far
have made components, only cells with several components are left, whose members
outside the largest one are compared to all, chunk by chunk, by matrix products
inside a task. The links of each vector are counted inside its component, again
chunk by chunk, so that each pair is compared once and no list of pairs is ever
made. No cell and no vector has a cap. All links are decided by the same sum of
products in double precision.

Results per row: vec_id, n_links (other vectors linked directly), component_id
(least vec_id reachable), kept (vec_id = component_id). Vectors that are null,
empty, zero, or hold null or non-finite components link with nothing, as do rows
with a null id (null component, not kept). Vectors of different length aren't
linked. Rows that repeat an id are one node; the links of its vectors are added
up. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .components import connected_components, dealt, forest, leaders, unlinked
from .storage import keep, materialise
from .text import U, mix

PROBES = 16
CELLS = 1 + PROBES + len(lattice.TOGETHER)
#: Width of cells, tables, and the odds (as a power of 1/2) that unlike vectors are held in one cell.
PLANS = ((1.6, 7, 20.3), (1.4, 10, 21.6), (1.2, 16, 24.1), (1.0, 35, 29.6), (0.9, 53, 31.2))
#: Pairs that few members give at most; cells with more are crowded. Leaders of a crowded cell. Vectors of a chunk.
CROWDED, LEADERS, CHUNK = 1024, 4, 512


def plan(n: int) -> tuple[float, int]:
    """Width and tables for n vectors: the least of what is dealt out and what meets by chance."""
    width, tables, _ = min(PLANS, key=lambda p: p[1] * CELLS * (n + n**2 * 2.0 ** -p[2]))
    return width, tables


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = batch.column(1).flatten().fill_null(np.nan).to_numpy()
        units: list[bytes | None] = [None] * len(sizes)
        of = np.repeat(sizes, sizes)
        for d in np.unique(sizes[sizes > 0]).tolist():
            rows, x = np.flatnonzero(sizes == d), flat[of == d].reshape(-1, d)
            most = np.abs(x).max(axis=1)  # nan where one is
            good = np.isfinite(most) & (most > 0)
            x = x[good] / most[good, None]  # so that squares neither overflow nor vanish
            x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f8")
            for i, v in zip(rows[good].tolist(), x, strict=True):
                units[i] = v.tobytes()
        prints = [None if u is None else xxhash.xxh3_128_digest(u) for u in units]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "print", "unit"])


def _matrix(units: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)


def _cells(width: float, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        factors = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(16)], dtype=U)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, units = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                sizes = np.array([len(u) // 8 for u in units])
                for d in np.unique(sizes).tolist():
                    if d not in made:
                        made[d] = np.random.default_rng(d).normal(size=(tables, d, 16)) / width
                    some = np.flatnonzero(sizes == d)
                    x = _matrix([units[i] for i in some])
                    for t in range(tables):
                        found = lattice.cells(x @ made[d][t], PROBES)
                        keys = mix((np.rint(2 * found).astype(np.int64).view(U) * factors).sum(axis=2, dtype=U) + U(t * 0x10001 + d * 0x1000003)).view(np.int64)
                        base = np.zeros(keys.shape, bool)
                        base[:, 0] = True
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[some], CELLS)), pa.array(base.ravel())], ["key", "rep", "base"])

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit vectors, row by row."""
    return np.einsum("ij,ij->i", x, y)


def are_near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of x is linked to each of y: as cosines() says, which decides what a matrix product leaves open."""
    c = x @ y.T
    near = c >= threshold
    i, j = np.nonzero(np.abs(c - threshold) < 1e-9)
    near[i, j] = cosines(x[i], y[j]) >= threshold
    return near


def _cell_links(threshold: float):
    """Links between the minor members of one chunk and all members of another of a cell."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["minor_side"].to_numpy()
        ids, comp, x = pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), _matrix(pdf["unit"].tolist())
        i, j = np.nonzero(are_near(x[side], x[~side], threshold) & (comp[side, None] != comp[~side]))
        names, node = np.unique(np.concatenate([ids[side][i], ids[~side][j]]), return_inverse=True)
        u, v = forest(node[: len(i)], node[len(i) :], len(names))
        return pd.DataFrame({"u": names[u], "v": names[v]}, dtype="int64")

    return links


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                size = np.array([len(p) if len(p) == len(q) else 0 for p, q in zip(a, b, strict=True)])
                near = np.zeros(len(size), bool)
                for d in np.unique(size[size > 0]).tolist():
                    some = np.flatnonzero(size == d)
                    near[some] = cosines(_matrix([a[i] for i in some]), _matrix([b[i] for i in some])) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["u", "v"])

    return run


def _count_links(threshold: float):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["component", "bi", "bj"]):
            apart = g["bi"].iloc[0] != g["bj"].iloc[0]
            x, copies, chunk = _matrix(g["unit"].tolist()), g["copies"].to_numpy(), g["chunk"].to_numpy()
            near = are_near(x, x, threshold)
            if apart:
                near &= chunk[:, None] != chunk
            else:
                np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"id": g["rep"].to_numpy(), "links": near @ copies}))
        return pd.concat(out)

    return count


def _blocks(df: DataFrame, size: str, by: str) -> DataFrame:
    """Each row once for every pair of chunks its chunk is in: chunk, bi, bj."""
    df = df.withColumn("chunks", F.ceil(F.col(size) / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(by), "chunks").cast("int"))
    return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"bi": F.least("chunk", "other"), "bj": F.greatest("chunk", "other")})


def embedding_dedup(embeddings: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """embeddings -> vec_id, n_links, component_id, kept; see the module's text. PLANS hold for thresholds of 0.95 or more; others are an error, as recall would fall."""
    if not 0.95 <= threshold <= 1:
        raise ValueError("the threshold must be 0.95 to 1")
    source = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    vectors = keep(source.mapInArrow(_unit, "vec_id long, print binary, unit binary"))
    valid, others = vectors.where("print is not null and vec_id is not null"), vectors.where("print is null or vec_id is null")
    classes = valid.groupBy("print").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    classes = materialise(classes, "classes")  # as a table, so that Spark can split a large class's part of the joins
    members = materialise(valid.join(classes, "print").select("vec_id", "rep", "copies").unionAll(others.select("vec_id", F.lit(None).cast("long"), F.lit(None).cast("long"))), "members", small=True)
    firsts = valid.join(classes.withColumnRenamed("print", "p"), (F.col("print") == F.col("p")) & (F.col("vec_id") == F.col("rep"))).select("rep", "copies", "unit")
    reps = keep(firsts.dropDuplicates(["rep", "unit"]))

    rows = keep(reps.select("rep", "unit").mapInArrow(_cells(*plan(reps.count())), "key long, rep long, base boolean"))
    sizes = rows.groupBy("key").agg(F.count_if("base").alias("held"), F.count("*").alias("size")).where("held > 0 and size > 1")
    live = keep(rows.join(sizes, "key"))
    few = live.where(F.col("held") * F.col("size") <= CROWDED)
    a = few.where("base").select(F.col("key").alias("k"), F.col("rep").alias("a"))
    met = a.join(few.select("key", F.col("rep").alias("b"), "base"), (F.col("k") == F.col("key")) & F.when(F.col("base"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    many = live.where(F.col("held") * F.col("size") > CROWDED).select("key", "rep", F.lit(1).alias("n")).distinct()
    many = materialise(many, "crowded", small=True)
    stars = many.join(leaders(many, LEADERS), "key").where(F.col("rep") != F.col("to.rep"))
    pairs = materialise(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).unionAll(stars.select(F.least("rep", "to.rep"), F.greatest("rep", "to.rep"))).distinct(), "pairs")
    for t in (live, rows, vectors):
        t.unpersist()
    left, right = reps.select(F.col("rep").alias("u"), F.col("unit").alias("x")), reps.select(F.col("rep").alias("v"), F.col("unit").alias("y"))
    found = connected_components(pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(_verify(threshold), "u long, v long"))
    held = many.join(found, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    rest = unlinked(held, CHUNK, CHUNK)
    if not rest.isEmpty():
        more = materialise(dealt(rest).join(reps.select("rep", "unit"), "rep").groupBy("key", "i", "j").applyInPandas(_cell_links(threshold), "u long, v long"), "more")
        if not more.isEmpty():
            found = connected_components(found.toDF("u", "v").unionAll(more))

    in_component = found.unionAll(found.select("component", "component").distinct()).toDF("rep", "component")
    sized = in_component.join(in_component.groupBy("component").agg(F.count("*").alias("size")), "component").join(reps, "rep")
    blocks = _blocks(sized, "size", "rep")
    tasks = max(1, found.count() // 2048)
    # whole small components share tasks; a chunk pair of a larger one is a task
    blocks = blocks.withColumn("task", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")))
    counted = blocks.groupBy("task", F.col("chunks") == 1, "bi", "bj").applyInPandas(_count_links(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    counted = materialise(counted, "counted")
    reps.unpersist()

    linked = members.where("rep is not null").join(found.withColumnRenamed("id", "f"), F.col("rep") == F.col("f"), "left").join(counted, F.col("rep") == F.col("id"), "left")
    component = F.coalesce("component", "rep")
    linked = linked.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return linked.unionAll(members.where("rep is null").select("vec_id", F.lit(0).cast("long"), "vec_id", F.col("vec_id").isNotNull()))
