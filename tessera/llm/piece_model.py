"""A sentencepiece BPE model as arrays: symbols, pair table, segments."""

from __future__ import annotations

import functools
import re

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from .int_table import IntTable

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = np.iinfo(np.int32).max


class PieceModel:
    """Read-only tables of one model file.

    A symbol is a piece id, or the number of a character that occurs in pieces
    without being one, or -1 for characters in no piece. Pairs of symbols whose
    joined text is a piece have the rank of that piece: 0 is merged first.
    """

    def __init__(self, path: str) -> None:
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(processor.serialized_model_proto())
        norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only BPE models with identity normalisation, a dummy prefix, and normal, byte and control pieces")
        self.bos, self.eos, self.unk = processor.bos_id(), processor.eos_id(), processor.unk_id()
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = np.array([p.type for p in proto.pieces])
        self.unk_surface = proto.trainer_spec.unk_surface
        self.number = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        by_score = sorted(self.number.values(), key=lambda i: -proto.pieces[i].score)
        ranks, last = {}, None
        for i in by_score:  # equal scores are equal ranks: the leftmost pair goes first
            if proto.pieces[i].score != last:
                rank, last = len(ranks), proto.pieces[i].score
            ranks[i] = rank
        symbol = dict(self.number)
        for ch in sorted({c for p in self.number for c in p}):
            symbol.setdefault(ch, len(self.pieces) + len(symbol) - len(self.number))
        self.symbol = symbol
        self.n_symbols = len(self.pieces) + len(symbol) - len(self.number)
        self.pairs = {}
        for p, i in self.number.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol and (k == 1 or p[:k] in self.number) and (len(p) - k == 1 or p[k:] in self.number):
                    self.pairs[symbol[p[:k]], symbol[p[k:]]] = (ranks[i], i)
        self.pair_table = IntTable()
        self.pair_table.add(np.array([a * self.n_symbols + b for a, b in self.pairs], np.int64))
        values = np.array(list(self.pairs.values()), np.int32)
        self.pair_ranks, self.pair_merged = values[:, 0].copy(), values[:, 1].copy()
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, s in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = s
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)]) if BYTE in kinds else None
        # no piece goes on over a space after another character
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.number):
            raise ValueError(f"{path}: pieces cross words")
        # ASCII marks that follow other characters in no piece begin segments too
        marks = {chr(c) for c in range(128) if not chr(c).isalnum() and c != 32}
        follows = {(p[k - 1], p[k]) for p in self.number for k in range(1, len(p))}
        while wrong := {b for a, b in follows if b in marks and a not in marks and a != SPACE}:
            marks -= wrong
        self.is_mark = np.zeros(0x110000, bool)
        self.is_mark[[ord(c) for c in marks]] = True
        own = "".join(f"\\x{ord(c):02x}" for c in sorted(marks)).encode()
        self.segment = re.compile(rb" *[%b]*[^ %b]+| *[%b]+| +" % (own, own, own) if marks else rb" *[^ ]+| +")

    def segments(self, text: bytes) -> list[bytes]:
        """Parts of the text, with its dummy prefix, over whose borders nothing merges; spaces stand for the space symbol."""
        return self.segment.findall(b" " + text.replace(SPACE.encode(), b" ")) if text else []

    def resets(self, chars: np.ndarray) -> np.ndarray:
        """Whether a segment begins at each code point of a text whose spaces are written as the space symbol; the first has no neighbour and counts as none."""
        space, mark = chars == ord(SPACE), self.is_mark[chars]
        out = np.zeros(len(chars), bool)
        out[1:] = space[1:] & ~space[:-1] | mark[1:] & ~space[:-1] & ~mark[:-1]
        return out

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; NEVER where the pair doesn't merge."""
        rows = self.pair_table.get(np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n_symbols + right, self.n_symbols**2))
        return np.where(rows >= 0, self.pair_ranks[rows], NEVER), self.pair_merged[rows]


@functools.lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """One copy of each model in a Python worker."""
    return PieceModel(path)


class Numbering(dict):
    """Numbers keys as they first appear."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
