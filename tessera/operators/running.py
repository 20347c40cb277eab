"""Running totals and ranks over a whole table, without one task for it.

A window without a key sends all rows to one task. Here rows are dealt into
ranges of the order, each range is sorted by its task, which sums it up in one
row (rows, keys, totals, first and last key), and the driver, which gets one such
row for each range, turns these into what lies before each range. A second pass
over the ranges adds it to their own running figures. Ties that span ranges,
however many, go on across them, as a range is cut by the order and `then`.

Null values add nothing. Null keys come first, as one tie. An empty table gives
an empty result. Totals are exact: only whole numbers and decimals can be summed,
and totals beyond 18 digits are an error. Rows that are equal in `order` and
`then` get their places in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Totals may not reach this.
MOST = 10**18


def _scale(kind: T.DataType, name: str) -> int:
    if isinstance(kind, T.DecimalType):
        return kind.scale
    if isinstance(kind, T.IntegralType):
        return 0
    raise TypeError(f"{name}: only whole numbers and decimals have exact totals, not {kind.simpleString()}")


def _values(batch: pa.RecordBatch, at: int, n: int) -> np.ndarray:
    """Whole numbers to sum, one row a column."""
    return np.stack([batch.column(at + k).to_numpy() for k in range(n)]) if n else np.zeros((0, batch.num_rows), np.int64)


def _summary(width: int, n: int):
    """part, key and n values from column `width` on -> a row for the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        rows = keys = tail = 0
        totals = [0] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(width)[0].as_py()
            key = batch.column(width + 1).to_numpy()
            new = np.append(rows == 0 or key[0] != last, key[1:] != key[:-1])
            first = int(key[0]) if first is None else first
            starts = np.flatnonzero(new)
            tail = len(key) - int(starts[-1]) if len(starts) else tail + len(key)
            rows, keys, last = rows + len(key), keys + len(starts), int(key[-1])
            totals = [t + int(v.astype(object).sum()) for t, v in zip(totals, _values(batch, width + 2, n), strict=True)]
            if any(abs(t) >= MOST for t in totals):
                raise OverflowError("a total is beyond 18 digits")
        if rows:
            yield pa.RecordBatch.from_pylist([{"part": part, "n_rows": rows, "n_keys": keys, "first": first, "last": last, "tail": tail, "totals": totals}], pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("n_rows", "n_keys", "first", "last", "tail")), ("totals", pa.list_(pa.int64()))]))

    return run


def _before(summaries: list) -> dict[int, tuple[int, int, int | None, int, list[int]]]:
    """By range: rows, keys and totals before it, the key just before it and the place where that key's rows begin."""
    out, rows, keys, last, start = {}, 0, 0, None, 0
    totals: list[int] = [0] * len(summaries[0].totals) if summaries else []
    for s in summaries:
        out[s.part] = rows, keys, last, start, totals
        goes_on = last is not None and last == s["first"]
        if not (goes_on and s.n_keys == 1):
            start = rows + s.n_rows - s.tail + 1
        rows, keys, last, totals = rows + s.n_rows, keys + s.n_keys - goes_on, s["last"], [a + b for a, b in zip(totals, s.totals, strict=True)]
        if any(abs(t) >= MOST for t in totals):
            raise OverflowError("a total is beyond 18 digits")
    return out


def _numbered(width: int, n: int, before: dict, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = keys = start = 0
        last, totals = None, np.zeros(n, np.int64)
        fresh = True
        for batch in batches:
            if not batch.num_rows:
                continue
            if fresh:
                rows, keys, last, start, at_start = before[batch.column(width)[0].as_py()]
                totals, fresh = np.array(at_start, np.int64), False
            key = batch.column(width + 1).to_numpy()
            new = np.append(last is None or key[0] != last, key[1:] != key[:-1])
            place = rows + 1 + np.arange(len(key))
            rank = np.maximum.accumulate(np.where(new, place, start))
            dense = keys + np.cumsum(new)
            running = totals[:, None] + np.cumsum(_values(batch, width + 2, n), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(place), pa.array(rank), pa.array(dense), *map(pa.array, running)], names)
            rows, keys, last, start = int(place[-1]), int(dense[-1]), key[-1], int(rank[-1])
            totals = running[:, -1]

    return run


def _sort_key(name: str) -> Column:
    return F.desc_nulls_last(name[1:]) if name.startswith("-") else F.asc_nulls_first(name)


def _tie_key(df: DataFrame, order: list[str]) -> Column:
    """A hash that tells keys apart that stand next to each other."""
    parts = []
    for name in (o.removeprefix("-") for o in order):
        c = F.col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            c = c + 0.0  # -0.0 ties with 0.0
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def running(df: DataFrame, order: list[str], then: list[str], totals: dict[str, str], partitions: int | None = None) -> DataFrame:
    """df with row_number, rank and dense_rank by the columns `order` (`then` settles the places of ties; a leading "-" means
    descending, nulls last), and for each name of `totals` the running total of a column. partitions: ranges; Spark's number of shuffle partitions if not given."""
    names = ["row_number", "rank", "dense_rank"]
    if clash := {*names, *totals} & set(df.columns):
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")
    scales = [_scale(df.schema[c].dataType, c) for c in totals.values()]
    values = [F.coalesce((F.col(c) * F.lit(10**k).cast("decimal(19,0)") if k else F.col(c)).cast("long"), F.lit(0).cast("long")).alias(f"_value{i}") for i, (c, k) in enumerate(zip(totals.values(), scales, strict=True))]
    by = [_sort_key(o) for o in (*order, *then)]
    dealt = df.repartitionByRange(*([partitions] if partitions else []), *by).sortWithinPartitions(*by)
    dealt = dealt.select(*df.columns, F.spark_partition_id().alias("_part"), _tie_key(df, order).alias("_key"), *values).persist(StorageLevel.DISK_ONLY)  # read twice; a lost part is made again from its range
    width, n = len(df.columns), len(totals)
    found = dealt.mapInArrow(_summary(width, n), "part int, n_rows long, n_keys long, first long, last long, tail long, totals array<long>").collect()
    before = _before(sorted(found, key=lambda s: s.part))
    made = [f"_total{i}" for i in range(n)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in (*names, *made))])
    out = dealt.mapInArrow(_numbered(width, n, before, schema.names), schema)
    exact = [F.col(c).cast("decimal(19,0)") * F.lit(f"0.{'0' * (k - 1)}1").cast(f"decimal({k + 1},{k})") if k else F.col(c) for c, k in zip(made, scales, strict=True)]
    return out.select(*df.columns, *names, *(c.alias(name) for c, name in zip(exact, totals, strict=True)))
