"""Lines that many documents share, kept in one of them.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case. Keys of at least `least_chars` code points that at least `least_docs`
documents hold lose all their lines but those of the largest document id that
holds the key.

Method: the 128-bit hashes of keys, with document and line number, are dealt into
ranges of (hash, document) and sorted by hash, falling document and line. A task
streams its range: the first document of a hash is the one that keeps its lines,
the lines of later ones go once `least_docs` documents have come. A hash that a
large share of all documents holds spans several ranges; only such hashes, at
most one for each border of ranges, are summed up beforehand and sent to the
tasks. What leaves the stream is a bitmap for each document that loses lines;
texts are not moved until apply_bitmaps() joins them to their bitmaps.

Null and empty texts are one empty line, which is never dropped. Rows that
repeat an id count as one document; each gets its own bitmap, told apart by a
hash of the text, so equal rows stay equal. Rows with a null id count as one
document below all others. Ids are integers. An empty table gives an empty
result. Other columns are passed through by apply_bitmaps(), except that
n_lines and n_dropped replace columns of these names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import keep
from .text import as_bytes, slices

WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def _hashes(least_chars: int):
    """doc_id, tag, text -> a row for each line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, rows, lines = [], [], []
            for i, text in enumerate(as_bytes(batch.column(2))):
                if len(text) < least_chars:
                    continue
                for k, line in enumerate(text.split(b"\n")):
                    if len(line) >= least_chars:
                        key = line_key(line)
                        if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            rows.append(i)
                            lines.append(k)
            h = np.ascontiguousarray(np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(lines, pa.int32())], ["h1", "h2", "doc_id", "tag", "line"])

    return run


class _Part(NamedTuple):
    """Rows of a sorted stream. Groups are runs of one hash; the first may go on from the part before, and counts and firsts include what that held."""

    batch: pa.RecordBatch
    ids: np.ndarray
    null: np.ndarray
    group: np.ndarray
    starts: np.ndarray
    keys: list[tuple[int, int]]  # of the first and the last group
    docs: np.ndarray  # documents of each group so far
    first: np.ndarray
    first_null: np.ndarray
    goes_on: bool


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    key, docs, first, last = None, 0, (0, False), (0, False)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (batch.column(k).to_numpy() for k in (0, 1))
        null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(2).cast(pa.int64()).fill_null(0).to_numpy()
        new_key = np.ones(len(h1), bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
        keys = [(int(h1[0]), int(h2[0])), (int(h1[-1]), int(h2[-1]))]
        goes_on = keys[0] == key
        new_doc[0] = not (goes_on and last == (ids[0], null[0]))
        starts = np.flatnonzero(new_key)
        counts, firsts, first_null = np.add.reduceat(new_doc.astype(np.int64), starts), ids[starts], null[starts]
        if goes_on:
            counts[0] += docs
            firsts[0], first_null[0] = first
        yield _Part(batch, ids, null, np.cumsum(new_key) - 1, starts, keys, counts, firsts, first_null, goes_on)
        key, docs, first, last = keys[1], counts[-1], (firsts[-1], first_null[-1]), (ids[-1], null[-1])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last hash of a range: its documents here and the largest of them."""
    head = tail = None
    for p in _walk(batches):
        if head is None or head[0] == p.keys[0]:
            head = (p.keys[0], int(p.docs[0]), None if p.first_null[0] else int(p.first[0]))
        tail = (p.keys[1], int(p.docs[-1]), None if p.first_null[-1] else int(p.first[-1]))
    rows = [] if head is None else [head] if head[0] == tail[0] else [head, tail]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _, _ in rows], pa.int64()), pa.array([k[1] for k, _, _ in rows], pa.int64()), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([d for *_, d in rows], pa.int64())], ["h1", "h2", "docs", "first"])


def _drops(least_docs: int, spread: dict[tuple[int, int], tuple[int, int | None]]):
    """Rows of lines to drop. spread: documents and largest document of the hashes that several ranges hold."""

    def rows(batch: pa.RecordBatch, drop: np.ndarray) -> pa.RecordBatch:
        return batch.select(["doc_id", "tag", "line"]).filter(pa.array(drop))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[_Part] = []  # rows of the last hash, of fewer than least_docs documents
        for p in _walk(batches):
            enough = p.docs >= least_docs
            for at, key in ((0, p.keys[0]), (-1, p.keys[1])):
                if key in spread:
                    docs, first = spread[key]
                    enough[at] = docs >= least_docs
                    p.first[at], p.first_null[at] = (0 if first is None else first), first is None
            if p.goes_on and enough[0]:
                for w in waiting:
                    yield rows(w.batch, (w.ids != p.first[0]) | (w.null != p.first_null[0]))
            if not (p.goes_on and len(p.starts) == 1 and not enough[0]):
                waiting = []
            yield rows(p.batch, enough[p.group] & ((p.ids != p.first[p.group]) | (p.null != p.first_null[p.group])))
            if not enough[-1] and p.keys[1] not in spread:
                at = p.starts[-1]
                waiting.append(p._replace(batch=p.batch.slice(at), ids=p.ids[at:], null=p.null[at:]))

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of dropped lines -> bitmaps: bit i is 1 if line i stays; lines beyond the last bit stay."""
    for batch in batches:
        kept = []
        for lines in batch.column(2):
            gone = lines.values.to_numpy()
            bits = np.ones(-(-(int(gone.max()) + 1) // 8) * 8, bool)
            bits[gone] = False
            kept.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], ["doc_id", "tag", "keep"])


def _with_tag(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (hash of the text), keep (compressed bitmap, see _bitmaps) of the documents that lose lines."""
    spark = docs.sparkSession
    hashed = _with_tag(docs, id_col, text_col).mapInArrow(_hashes(max(1, least_chars)), "h1 long, h2 long, doc_id long, tag long, line int")
    order = "h1", "h2", F.desc_nulls_last("doc_id")
    ranges = keep(hashed.repartitionByRange(*order).sortWithinPartitions(*order, "tag", "line"))
    edges = ranges.mapInArrow(_edges, "h1 long, h2 long, docs long, first long").groupBy("h1", "h2").agg(F.count("*").alias("ranges"), F.sum("docs").alias("docs"), F.max("first").alias("first"))
    spread = {(x.h1, x.h2): (x.docs, x["first"]) for x in edges.where("ranges > 1").collect()}
    gone = ranges.mapInArrow(_drops(least_docs, spread), "doc_id long, tag long, line int")
    return gone.groupBy("doc_id", "tag").agg(F.collect_set("line").alias("lines")).mapInArrow(_bitmaps, "doc_id long, tag long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay as their texts, and n_lines (before), n_dropped. A null text stays null."""
    docs = docs.drop(*(c for c in docs.columns if c in ("n_lines", "n_dropped")))
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names, at = docs.columns, docs.columns.index(text_col)
    inner = [f"c{k}" for k in range(len(names))]  # so that no name of the table is one of the join's
    own = docs.select(*(docs[c].alias(x) for c, x in zip(names, inner, strict=True)), docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("tag"))
    found = bitmaps.select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "keep")
    both = own.join(found, own["id"].eqNullSafe(found["of"]) & (own["tag"] == found["of_tag"]), "left").select(*inner, "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            texts = batch.column(at).to_pylist()
            n_lines, n_dropped = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, (text, kept) in enumerate(zip(texts, batch.column(len(names)).to_pylist(), strict=True)):
                n_lines[i] += (text or "").count("\n")
                if kept is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(kept), np.uint8))
                    lines = text.split("\n")
                    gone = set(np.flatnonzero(bits[: len(lines)] == 0).tolist())
                    n_dropped[i] = len(gone)
                    texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], [*names, "n_lines", "n_dropped"])

    return both.mapInArrow(run, out)
