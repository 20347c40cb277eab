"""Batches of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .storage import release_memory

U = np.uint64
#: Bytes of text at once where many arrays of eight bytes a character are alive.
SMALL = 1 << 20


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text, or one longer text: memory doesn't follow the batch size.

    What a batch took is given back to the system after it, as Python workers live on and stand idle.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.float64))
        part = ((np.cumsum(sizes) - sizes) // most).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        del batch, texts
        release_memory()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other than ASCII white space) of all texts one after another, and how many each text has."""
    flat: list[int] = []
    counts = np.empty(len(texts), np.int64)
    get = known.__getitem__
    for i, t in enumerate(texts):
        words = t.split()
        counts[i] = len(words)
        flat.extend(map(get, words))
    return np.array(flat, dtype=U), counts


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def window_hashes(flat: np.ndarray, counts: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of `width` words, and their number per text.

    short: a text of fewer words, but at least one, gives its whole sequence as one window.
    """
    factor = [U(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1) for i in range(width)]
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.maximum(counts - width + 1, 0)
    span = len(flat) - width + 1
    if span > 0:
        rolled = np.zeros(span, U)
        for i in range(width):
            rolled += flat[i : i + span] * factor[i]
        where = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        hashes = mix(rolled[where])
    else:
        hashes = np.empty(0, U)
    few = np.flatnonzero((counts < width) & (counts > 0)) if short else []
    if len(few):
        own = np.array([mix(np.array([sum(int(flat[starts[i] + j]) * int(factor[j]) for j in range(counts[i])) + int(counts[i]) & (2**64 - 1)], dtype=U))[0] for i in few], dtype=U)
        at = np.cumsum(n)[few]
        hashes = np.insert(hashes, at, own)
        n = n.copy()
        n[few] = 1
    return hashes, n


def window_sums(values: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Sums of `values` of words over the windows of window_hashes(..., short=True)."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.repeat(ends - counts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return total[np.minimum(first + width, np.repeat(ends, n))] - total[first]


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, type=kind))


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, whose text is judged True; judge() is called once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in slices(batches, text_col, SMALL):
            yield batch.filter(pa.array(keep(as_bytes(batch.column(batch.schema.get_field_index(text_col)))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
