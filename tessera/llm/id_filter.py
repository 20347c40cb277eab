"""A bit set that passes all rows with given ids, and few others. It has about eight bits an id, from 2**LEAST_BITS to 2**MOST_BITS (8 MB packed); beyond 8 million ids more rows pass, never fewer."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, CHUNK_BITS = 23, 26, 18


def size_for(n: int) -> int:
    """Bits of the number of a bit, for n ids."""
    return min(MOST_BITS, max(LEAST_BITS, (8 * n - 1).bit_length()))


def id_filter(ids: DataFrame, column: str, size: int) -> DataFrame:
    """One row for each chunk of the set of 2**size bits: chunk, bits (as binary of bytes 0 or 1 packed). Tasks' sets are united by 256, then those by 256 again, so 16 million tasks leave 256 rows of a chunk."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << size, bool)
        for batch in batches:
            held[batch.column(0).to_numpy()] = True
        parts = held.reshape(-1, 1 << CHUNK_BITS)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(np.packbits(parts[k]).tobytes(), 1) for k in some.tolist()], pa.binary())], ["chunk", "bits"])

    def unite(pdf):
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in pdf["bits"]])
        return pdf.iloc[:1].assign(salt=pdf["salt"].iloc[0] // 256, bits=[zlib.compress(total.tobytes(), 1)]).astype({"salt": "int32"})

    parts = ids.select(place(F.col(column), size)).mapInArrow(collect, "chunk int, bits binary").select("chunk", (F.spark_partition_id() / 256).cast("int").alias("salt"), "bits")
    for _ in range(2):
        parts = parts.groupBy("chunk", "salt").applyInPandas(unite, "chunk int, salt int, bits binary")
    return parts


def place(c: Column, size: int) -> Column:
    """Of a long: its bits folded by exclusive or, which numpy can repeat."""
    folded = c.cast("long")
    for shift in (46, 23):
        folded = folded.bitwiseXOR(F.shiftrightunsigned(folded, shift))
    return folded.bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def places(x: np.ndarray, size: int) -> np.ndarray:
    folded = x.astype(np.int64).view(np.uint64)
    for shift in (46, 23):
        folded = folded ^ (folded >> np.uint64(shift))
    return (folded & np.uint64((1 << size) - 1)).astype(np.int64)


def bit_set(ids: DataFrame, column: str) -> tuple[int, bytes]:
    """The size and the whole set, on the driver. ids is read twice."""
    size = size_for(ids.count())
    bits = np.zeros((1 << (size - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), np.uint8)
    for row in id_filter(ids, column, size).select("chunk", "bits").collect():
        bits[row.chunk] |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return size, bits.tobytes()


def holds(bits: bytes, places: np.ndarray) -> np.ndarray:
    return (np.frombuffer(bits, np.uint8)[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0


def passing(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows that may have an id of `ids` (in its column rep); keeps work from rows that can't before they are shuffled."""
    size, bits = bit_set(ids, "rep")
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = holds(shared.value, batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(hit))

    return rows.where(F.col(column).isNotNull()).withColumn("_place", place(F.col(column), size)).mapInArrow(run, rows.schema)
