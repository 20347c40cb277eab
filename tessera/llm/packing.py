"""Best-fit packing by a plan over the length histogram.

Tokenising cuts each document into pieces of at most `capacity` tokens; only
longer documents are cut, the first piece takes the remainder. The histogram of
piece lengths has at most `capacity` rows, so the plan is made on the driver:
best fit, decreasing, over counts. Equal sequences form runs; placing a length
into a run fills as many of its sequences as there are pieces left, and each
such step is one row of planned slots. A step uses up either the pieces of the
length or a run, so the plan's size depends on `capacity` alone: 40,000 rows at
1024 at most, small enough to broadcast whatever the input. Pieces then take
slots by joining on their rank within their length. Ranks come in two steps, so
that a length that a third of all pieces share isn't one task's: rows are
numbered within (length, salt), and the counts of these give the offsets.

Null texts count as empty: their document is its end id alone, one piece.
Repeated rows are packed each on their own. Ties in rank are broken by the key
columns and are otherwise open.
"""

from __future__ import annotations

import bisect
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .text import as_bytes, slices

#: How the vocabulary file spells bytes: printable ones as themselves, the others, in order, from U+0100 on (fixed values).
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The split before the merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file. Its ids are ranks of merges; added tokens are found in texts, as that library does by default."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError(f"{path}: only byte-level BPE without normalisation")
    byte_of = {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer_path)
        for batch in slices(batches, "text"):
            rows, piece, start, length, data = [], [], [], [], []
            for i, text in enumerate(as_bytes(batch.column(1))):
                ids = np.append(bpe.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special="all"), end_id).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    data.append(ids[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, pieces a sequence, offset): rank r of a length goes to
    sequence first sequence + (r - first rank) // pieces, at offset + (r - first rank) % pieces * length."""
    slots = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, sequences)
    rooms: list[int] = []  # sorted keys of runs
    sequences = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (at := bisect.bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            each = room // length
            full = min(n, left // each)
            if full:  # a sequence that is begun stays the best fit until the length fits no more
                slots.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, (first, full))
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:
                slots.append((length, rank, left, first, left, capacity - room))
                put(room - left * length, (first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                put(room, (first, n))
        each = capacity // length
        full, rest = divmod(left, each)
        if full:
            slots.append((length, rank, full * each, sequences, each, 0))
            put(capacity - each * length, (sequences, full))
            rank, sequences = rank + full * each, sequences + full
        if rest:
            slots.append((length, rank, rest, sequences, rest, 0))
            put(capacity - rest * length, (sequences, 1))
            sequences += 1
    return slots


def pack(pieces: DataFrame, keys: list[str], capacity: int = 1024, salts: int | None = None) -> DataFrame:
    """pieces, with a length column of 1 to capacity, -> the same rows with sequence_id and offset. keys: columns that order equal lengths.

    The pieces are read twice, so they should be a written table. salts: parts
    that a length is numbered in; by default one for each 100,000 pieces, 64 at
    least.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    if any(n is None or not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    salts = salts or max(64, sum(histogram.values()) // 100_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").count().select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy(*keys)
    ranked = (
        salted.withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    slots = spark.createDataFrame(plan_best_fit(histogram, capacity), "_length long, _first long, _ranks long, _sequence long, _each long, _offset long")
    place = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_ranks"))).select(
        *pieces.columns, (F.col("_sequence") + F.floor(place / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + place % F.col("_each") * F.col("length")).cast("long").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; the ids themselves are dropped before anything is shuffled."""
    pieces = tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    pieces = materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    packed = pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
    return packed.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)  # small rows: no need of a file for each shuffle partition
