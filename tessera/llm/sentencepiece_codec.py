"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into segments over whose borders no pair merges. The distinct
segments of a slice of texts form flat symbol arrays; each round takes the
least pair rank of every segment and merges its leftmost occurrences in all
segments at once, then compacts the arrays, until no pair remains. All
occurrences in a segment merge in one round if none of the pairs that arise
ranks before the merged one; else only the leftmost does, as one merge may then
change what comes next. The ids equal the library's. A bounded store keeps the
ids of segments seen before.

Null texts count as empty: an empty text has the begin and end ids alone.
Texts of any length are encoded whole. Each row gives one row; rows may repeat.
Columns besides the id and the text are not read.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_model import BYTE, CONTROL, NEVER, NORMAL, SPACE, Numbering, PieceModel, piece_model
from .text import as_bytes, slices

STORED = 200_000


def merge_rounds(model: PieceModel, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the symbols of segments of `counts` symbols each. Returns symbols, the place of each one's first character, and counts."""
    place = np.arange(len(symbols))
    segment = np.repeat(np.arange(len(counts)), counts)
    done_symbols, done_places, done_segments = [], [], []
    while len(symbols):
        inner = segment[:-1] == segment[1:]
        rank, merged = model.lookup(symbols[:-1], symbols[1:])
        rank = np.append(np.where(inner, rank, NEVER), NEVER)
        merged = np.append(merged, 0)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        length = np.diff(np.append(starts, len(segment)))
        least = np.repeat(np.minimum.reduceat(rank, starts), length)
        over = least == NEVER
        if over.any():
            for to, x in ((done_symbols, symbols), (done_places, place), (done_segments, segment)):
                to.append(x[over])
            go = ~over
            symbols, place, segment, rank, merged, least = (x[go] for x in (symbols, place, segment, rank, merged, least))
            if not len(symbols):
                break
        at = np.flatnonzero(rank == least)
        # of overlapping occurrences (a run), every other one
        new_run = np.diff(at, prepend=-2) != 1
        run_start = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
        at = at[(at - run_start) % 2 == 0]
        own = segment[at]
        first = np.diff(own, prepend=-1) != 0
        if not first.all():
            m, r = merged[at], rank[at]
            left = np.maximum(at - 1, 0)
            chained = np.concatenate([[False], (np.diff(at) == 2) & ~first[1:]])
            left_symbol = np.where(chained, m, symbols[left])
            left_rank = np.where((at > 0) & (segment[left] == own), model.lookup(left_symbol, m)[0], NEVER)
            right = np.minimum(at + 2, len(symbols) - 1)
            right_rank = np.where((at + 2 < len(symbols)) & (segment[right] == own), model.lookup(m, symbols[right])[0], NEVER)
            risky = np.zeros(segment.max() + 1, bool)
            risky[own[(left_rank <= r) | (right_rank <= r)]] = True
            at = at[first | ~risky[own]]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, place, segment = symbols[keep], place[keep], segment[keep]
    if not done_symbols:
        return symbols, place, np.zeros(len(counts), np.int64)
    symbols, place, segment = (np.concatenate(x) for x in (done_symbols, done_places, done_segments))
    order = np.argsort(place)
    return symbols[order], place[order], np.bincount(segment, minlength=len(counts))


def encode_segments(model: PieceModel, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after another, and how many each has."""
    texts = [s.decode("utf-8", "replace").replace(" ", SPACE) for s in segments]
    counts = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    symbols, place, counts = merge_rounds(model, model.of_char[chars].copy(), counts)
    odd = (symbols < 0) | (symbols >= len(model.pieces))
    if not odd.any():
        return symbols.astype(np.uint32), counts
    if model.byte_ids is None:
        return np.where(odd, model.unk, symbols).astype(np.uint32), counts
    code = chars[place]
    width = np.where(odd, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
    ids = np.repeat(symbols, width).astype(np.uint32)
    begin = (np.cumsum(width) - width)[odd]
    for at, c in zip(begin.tolist(), code[odd].tolist(), strict=True):
        own = chr(c).encode("utf-8")
        ids[at : at + len(own)] = model.byte_ids[list(own)]
    segment = np.repeat(np.arange(len(counts)), counts)
    return ids, np.bincount(segment, weights=width, minlength=len(counts)).astype(np.int64)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start + length] of each, one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    def __init__(self, path: str) -> None:
        self.model = piece_model(path)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.flat, self.start, self.length = Numbering(), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, begin and end ids included, and how many each has."""
        if len(self.numbers) > STORED:
            self._forget()
        known, found, counts = len(self.numbers), [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.model.segments(t)
            counts[i] = len(own)
            found.extend(map(self.numbers.__getitem__, own))
        if len(self.numbers) > known:
            names = list(self.numbers)[known:]
            ids, n = encode_segments(self.model, names)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
            self.length = np.concatenate([self.length, n])
            self.flat = np.concatenate([self.flat, ids])
        # a begin and an end id around each text
        numbers, text = np.array(found, np.int64), np.repeat(np.arange(len(texts)), counts)
        length = self.length[numbers]
        per_text = np.bincount(text, weights=length, minlength=len(texts)).astype(np.int64)
        out = np.empty(per_text.sum() + 2 * len(texts), np.uint32)
        ends = np.cumsum(per_text + 2)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = inside[ends - per_text - 2] = False
        out[ends - 1], out[ends - per_text - 2] = self.model.eos, self.model.bos
        out[inside] = gather(self.flat, self.start[numbers], length)
        return out, per_text + 2


def _each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tessera-each", _each)


class Decoder:
    """Ids to text: a piece's text, a byte piece's byte, nothing for control ids; the first piece loses one leading space."""

    def __init__(self, path: str) -> None:
        model = piece_model(path)
        texts = [(p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else model.unk_surface.encode()) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.control = model.kinds == CONTROL
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds, strict=True)])

    def __call__(self, lists: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(lists), "<u4").astype(np.int64)
        n = np.array([len(x) // 4 for x in lists], np.int64)
        data = gather(self.flat, self.start[ids], self.length[ids]).tobytes()
        size = np.concatenate([[0], np.cumsum(self.length[ids])])
        ends = np.cumsum(n)
        out = []
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            k = a
            while k < b and self.control[ids[k]]:
                k += 1
            out.append(data[size[a] + (k < b and bool(self.spaced[ids[k]])) : size[b]].decode("utf-8", "tessera-each"))
        return out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, ids: binary, little-endian unsigned 32-bit ids with begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in slices(batches, "text"):
            ids, n = encoder(as_bytes(batch.column(1)))
            ends = 4 * np.cumsum(n)
            data = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[b - 4 * k : b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded (doc_id, ids) -> the same with text: what the ids say. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model_path)
        for batch in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoder(as_bytes(batch.column(1))), pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
