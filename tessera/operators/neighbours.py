"""Exact nearest neighbours by cosine: blocked matrix products, the best k of a slice, merged.

Queries and base rows are packed into blocks of at most CHUNK rows, which are
written to executors' disks once: a block of queries to a part, base blocks of about
SLICE bytes to a slice. Each task reads one part and one slice, block by block, and
multiplies them; it passes on the best k of each query alone. So all pairs are
compared, but disk holds each vector a few times and k candidates a slice for each
query, not a copy for each block of the other side. No task holds more than its
queries, a slice of base blocks and a product.

Products are made in single precision. Pairs that by its error bound may be among
the best k so far get their cosine in double precision, and these are what is ranked.

Vectors that are null, empty, zero or hold null or non-finite components have no
neighbours and are none, as are rows with a null id. Vectors of different length
aren't compared. A row isn't its own neighbour: base rows with the query's id are
left out. Queries that repeat an id are one only if their vectors are equal, too;
repeated base rows are a neighbour each. Cosines are rounded to DIGITS digits
before they are ranked, so that equal vectors tie whatever block they are in;
ties go to the lesser id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

CHUNK, SLICE, DIGITS = 2048, 64_000_000, 9
BLOCK = "d int, ids binary, prints binary, single boolean, vectors binary"


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (floats stay so, other numbers become doubles), print, d."""
    v = F.col(vector_col)
    v = v if dict(rows.dtypes)[vector_col] == "array<float>" else v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    out = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)
    return out.withColumns({"print": F.xxhash64("v"), "d": F.size("v")})


def _pack(chunk: int):
    """Blocks of at most `chunk` rows of vectors of one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[pd.DataFrame]] = {}

        def block(d: int) -> pd.DataFrame:
            rows = pd.concat(kept.pop(d))
            v = np.stack(rows["v"].to_list())
            return pd.DataFrame([(d, rows["id"].to_numpy().tobytes(), rows["print"].to_numpy().tobytes(), v.dtype == np.float32, v.tobytes())], columns=["d", "ids", "prints", "single", "vectors"])

        for batch in batches:
            for d, rows in batch.groupby("d"):
                while len(rows):
                    room = chunk - sum(map(len, kept.setdefault(d, [])))
                    kept[d].append(rows[:room])
                    rows = rows[room:]
                    if sum(map(len, kept[d])) == chunk:
                        yield block(d)
        for d in list(kept):
            yield block(d)

    return run


def _plain(block: Row) -> Row:
    return Row(**{c: bytes(x) if isinstance(x, bytearray) else x for c, x in block.asDict().items()})


def _opened(block: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and unit vectors, in double and in single precision."""
    x = np.frombuffer(block.vectors, np.float32 if block.single else np.float64).reshape(-1, block.d).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.frombuffer(block.ids, np.int64), x, x.astype(np.float32)


class _Best:
    """The first k of a block of queries among the blocks met so far, ties by id."""

    def __init__(self, queries: Row, k: int):
        self.k, self.prints = k, np.frombuffer(queries.prints, np.int64)
        self.ids, self.exact, self.rough = _opened(queries)
        self.off = (queries.d + 8) * 2.0**-23 + 10.0**-DIGITS  # more than a product in single precision and the rounding can be off
        self.least = np.full(len(self.ids), -np.inf)  # of the first k
        self.found: list[tuple[np.ndarray, ...]] = []
        self.merge()

    def meet(self, others: np.ndarray, exact: np.ndarray, rough: np.ndarray) -> None:
        about = self.rough @ rough.T
        (same,) = np.nonzero(np.isin(self.ids, others))
        if len(same):
            about[same] = np.where(self.ids[same, None] == others, np.float32(-np.inf), about[same])
        bound = self.least - self.off
        (new,) = np.nonzero(np.isneginf(bound))
        if len(new) and len(others) > self.k:
            bound[new] = np.partition(about[new], -self.k, axis=1)[:, -self.k] - 2 * self.off
        q, o = np.divmod(np.flatnonzero(about >= np.maximum(bound, -2).astype(np.float32)[:, None]), len(others))
        if not len(q):
            return
        value = np.concatenate([np.einsum("nd,nd->n", self.exact[q[i : i + CHUNK]], exact[o[i : i + CHUNK]]) for i in range(0, len(q), CHUNK)])
        self.found.append((q, others[o], np.round(value, DIGITS) + 0.0))
        if np.isneginf(self.least).any() or sum(len(x[0]) for x in self.found[1:]) > len(self.ids) * self.k // 2:
            self.merge()

    def merge(self) -> None:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        q, o, value = map(np.concatenate, zip(empty, *self.found, strict=True))
        order = np.lexsort((o, -value, q))
        q, o, value = q[order], o[order], value[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        self.least[q[place == self.k - 1]] = value[place == self.k - 1]
        some = place < self.k
        self.found = [(q[some], o[some], value[some])]

    def packed(self) -> tuple[bytearray, ...]:
        self.merge()
        q, o, value = self.found[0]
        return tuple(bytearray(x.tobytes()) for x in (self.ids[q], self.prints[q], o, value))


def _compare(k: int):
    def run(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple[bytearray, ...]]:
        best: dict[tuple, _Best] = {}
        for queries, base in pairs:
            if queries.d == base.d:
                of = queries.d, queries.ids, queries.prints
                if of not in best:
                    best[of] = _Best(queries, k)
                best[of].meet(*_opened(base))
        for x in best.values():
            yield x.packed()

    return run


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield pd.DataFrame({c: np.frombuffer(x, np.float64 if c == "cosine" else np.int64) for c, x in zip(("id", "print", "neighbour", "cosine"), row, strict=True)})


def top_neighbours(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """id, rank (from 1), neighbour, cosine: the k rows of base nearest to each query."""
    left, right = _valid(queries, id_col, vector_col), _valid(base, id_col, vector_col)
    n_left = max(1, math.ceil(left.count() / chunk))
    n_right = max(1, math.ceil((right.agg(F.sum(F.col("d") * (4 if dict(right.dtypes)["v"] == "array<float>" else 8))).first()[0] or 0) / SLICE))
    # Read by many tasks, as Python's own bytes; a lost part is made again, and Spark frees all when nothing refers to it.
    packed = lambda rows, n: rows.mapInPandas(_pack(chunk), BLOCK).rdd.map(_plain).coalesce(n).persist(StorageLevel.DISK_ONLY)
    parts = packed(left.repartition(n_left, "id").dropDuplicates(["id", "print"]), n_left)
    slices = packed(right.repartition(n_right, "id"), n_right)
    met = parts.cartesian(slices).mapPartitions(_compare(k))
    met = queries.sparkSession.createDataFrame(met, "ids binary, prints binary, others binary, cosines binary").mapInPandas(_unpacked, "id long, print long, neighbour long, cosine double")
    first = Window.partitionBy("id", "print").orderBy(F.desc("cosine"), F.asc("neighbour"))
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "cosine")
