"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

The encoding of a prefix that ends at i is that of the prefix before its last
token t, then t; and t is the one piece ending there that stands unmerged
behind the last token of that shorter prefix (a pair of tokens is *stable* if
it encodes to itself, and a row of tokens is an encoding if and only if each
neighbouring pair is stable). So a deterministic transducer reads characters:
its state holds the longest suffix that begins a piece, and for each border
inside it the last token before the border and how many tokens more or fewer
that prefix has. A transition emits the change of the token count. Transitions
are compiled when first met; the store is emptied when it holds MOST_MOVES of
them, so a worker's memory is bounded.

Whole texts are cut into chunks of CHUNK characters. A chunk's map takes start
states to end states and counts. A *reset*, a place nothing merges over, leads to
the start state whatever came before, so a chunk that holds one ends in one state,
which is known without its neighbours and is the only state that the next chunk
can begin in. Behind a chunk without a reset the map is taken from the states
that the chunk's last characters lead to, read from each of several places. All
maps are evaluated at once, column by column, then composed by a parallel prefix
scan: in round r each map is joined to the one 2**r chunks on. A text's count is
that of its first map composed with all others. Where a composition asks for a
start state that a map doesn't hold yet, the map gets it and the scan is run again.

Null texts count as empty and have 0 tokens. Texts of any length are counted
whole, blocks of BLOCK characters at a time. Each row gives one row; rows may
repeat. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .int_table import IntTable
from .piece_model import SPACE, PieceModel, piece_model
from .text import SMALL, as_bytes, slices

CHUNK, BLOCK = 64, 1 << 20
#: How far before a chunk's begin reading starts, behind a chunk without a reset.
WARM_UPS = range(17, 33)
#: Transitions that a worker's machine holds before it begins anew (one block may add BLOCK more).
MOST_MOVES = 1 << 20
NONE, MIDDLE = -1, 1 << 15


class Transducer:
    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._build_trie()
        self._texts = {s: t for t, s in model.symbol.items()}
        self.width = model.n_symbols + 5  # behind the symbols: characters in no piece, of 1 to 4 bytes
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        self.stable: set[tuple[int, int]] = set()
        self.unstable: set[tuple[int, int]] = set()
        self.states: dict[bytes, int] = {}
        self.keys: list[bytes] = []  # node, then last token << 16 | count + 2**15 for each border, as 8-byte integers
        self.start = self._state(array("q", [0, NONE << 16 | MIDDLE]).tobytes())
        # by state * width + symbol: next state and change of the count
        self.moves, self.next, self.change = IntTable(), np.empty(1 << 12, np.int32), np.empty(1 << 12, np.int32)

    def _build_trie(self) -> None:
        """Nodes of all prefixes of pieces; of each node its depth and its longest proper suffix that is a node."""
        goto: list[dict[int, int]] = [{}]
        depth, token = [0], [NONE]
        sym = self.model.symbol
        for text, s in sym.items():
            node = 0
            for c in text:
                if (nxt := goto[node].get(sym[c])) is None:
                    goto[node][sym[c]] = nxt = len(goto)
                    goto.append({})
                    depth.append(depth[node] + 1)
                    token.append(NONE)
                node = nxt
            token[node] = s
        fail, queue = [0] * len(goto), list(goto[0].values())
        for node in queue:
            for c, nxt in goto[node].items():
                back = fail[node]
                while back and c not in goto[back]:
                    back = fail[back]
                fail[nxt] = goto[back].get(c, 0)
                queue.append(nxt)
        self.goto, self.depth, self.token, self.fail = goto, depth, token, fail

    def _chain(self, node: int) -> list[int]:
        out = [node]
        while out[-1]:
            out.append(self.fail[out[-1]])
        return out

    @functools.cache  # noqa: B019  one entry for each node of the trie at most
    def _depths(self, node: int) -> list[int]:
        return [self.depth[n] for n in self._chain(node)]

    @functools.cache  # noqa: B019
    def _tokens(self, node: int) -> list[tuple[int, int]]:
        """Symbols that end at a node, and their lengths."""
        return [(self.token[n], self.depth[n]) for n in self._chain(node) if self.token[n] != NONE]

    def _is_stable(self, a: int, b: int) -> bool:
        """Whether the symbols a, b encode to themselves; a NONE: b alone."""
        if (a, b) not in self.unstable:
            (self.stable if self._encodes_to_itself(a, b) else self.unstable).add((a, b))
        return (a, b) in self.stable

    def _encodes_to_itself(self, a: int, b: int) -> bool:
        text = [self._chars(x) for x in (a, b) if x != NONE]
        row = [c for t in text for c in t]
        pairs = self.model.pairs
        while True:
            found = [(pairs[p][0], i) for i, p in enumerate(zip(row[:-1], row[1:], strict=True)) if p in pairs]
            if not found:
                return row == [x for x in (a, b) if x != NONE]
            i = min(found)[1]
            row[i : i + 2] = [pairs[row[i], row[i + 1]][1]]

    def _chars(self, symbol: int) -> list[int]:
        return [self.model.symbol[c] for c in self._texts[symbol]]

    def _cost(self, symbol: int) -> int:
        """Tokens that a symbol gives: one, or its bytes if it isn't a piece."""
        if symbol < len(self.model.pieces):
            return 1
        return len(self._texts[symbol].encode()) if self.model.byte_ids is not None else 1

    def _state(self, key: bytes) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        if symbol >= self.model.n_symbols:
            return self.start, symbol - self.model.n_symbols if self.model.byte_ids is not None else 1
        node, *borders = array("q", self.keys[state])
        before = dict(zip(self._depths(node), borders, strict=True))
        while symbol not in self.goto[node]:
            node = self.fail[node]
        node = self.goto[node][symbol]
        for t, d in self._tokens(node):
            border = before[d - 1] >> 16
            if (border, t) in self.stable or self._is_stable(border, t):
                change = (before[d - 1] & 0xFFFF) - MIDDLE + self._cost(t)
                break
        after = [before[d - 1] - change if d else t << 16 | MIDDLE for d in self._depths(node)]
        return self._state(array("q", [node, *after]).tobytes()), change

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states * self.width + symbols
        row = self.moves.get(keys)
        if (new := row < 0).any():
            missing = np.unique(keys[new])
            found = np.array([self._step(*divmod(key, self.width)) for key in missing.tolist()], np.int32)
            at = self.moves.size
            self.moves.add(missing)
            if self.moves.size > len(self.next):
                self.next, self.change = (np.concatenate([x[:at], np.empty(2 * self.moves.size - at, np.int32)]) for x in (self.next, self.change))
            self.next[at : at + len(found)], self.change[at : at + len(found)] = found[:, 0], found[:, 1]
            row[new] = self.moves.get(keys[new])
        return self.next[row], self.change[row]

    def run(self, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, symbols: np.ndarray, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of spans of symbols, all of them advancing together."""
        length = end - begin
        order = np.argsort(-length, kind="stable")
        at, state, sizes = begin[order], starts[order].astype(np.int64), length[order]
        count = np.zeros(len(order), np.int64)
        left = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")  # spans longer than k
        for k, n in enumerate(left.tolist()):
            here = at[:n] + k
            state[:n], change = self.step(np.where(resets[here], self.start, state[:n]), symbols[here])
            count[:n] += change
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def scan(self, symbols: np.ndarray, resets: np.ndarray, length: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of rows of symbols (one after another, none empty), each read from its start state."""
        per = -(-length // CHUNK)
        last = np.cumsum(per) - 1
        first = last - per + 1
        n = int(per.sum())
        number = np.arange(n) - np.repeat(first, per)
        begin = np.repeat(np.cumsum(length) - length, per) + number * CHUNK
        end = np.minimum(begin + CHUNK, np.repeat(np.cumsum(length), per))
        is_last = np.zeros(n, bool)
        is_last[last] = True
        # from a chunk's first reset on, nothing depends on its start
        places = np.append(np.flatnonzero(resets), len(symbols))
        turn = np.minimum(places[np.searchsorted(places, begin)], end)
        tail_end, tail_count = self.run(np.full(n, self.start), turn, end, symbols, resets)
        known = np.flatnonzero((turn < end) & ~is_last)
        open_ = np.flatnonzero((turn == end) & ~is_last)
        warm = np.repeat(open_, len(WARM_UPS))
        likely, _ = self.run(np.full(len(warm), self.start), end[warm] - np.tile(np.array(WARM_UPS, np.int64), len(open_)), end[warm], symbols, resets)
        # a node is a chunk with a start state: an entry of that chunk's map
        root = first << 32 | starts
        node, to, count = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        fresh = np.unique(np.concatenate([root, known + 1 << 32 | tail_end[known], warm + 1 << 32 | likely]))
        while True:
            chunk = fresh >> 32
            own_end, own_count = self.run(fresh & 0xFFFFFFFF, begin[chunk], turn[chunk], symbols, resets)
            whole = turn[chunk] < end[chunk]
            own_end = np.where(whole, tail_end[chunk], own_end)
            own_count = own_count + np.where(whole, tail_count[chunk], 0)
            order = np.argsort(np.concatenate([node, fresh]))
            node, to, count = (np.concatenate(x)[order] for x in ((node, fresh), (to, own_end), (count, own_count)))
            total, final = self._compose(node, to, count, is_last)
            at = np.searchsorted(node, root)
            stop = final[at]
            done = is_last[node[stop] >> 32]
            if done.all():
                return to[stop], total[at]
            fresh = np.unique(((node[stop] >> 32) + 1 << 32 | to[stop])[~done])

    @staticmethod
    def _compose(node: np.ndarray, to: np.ndarray, count: np.ndarray, is_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix scan over the maps. Of each node: the count of all nodes that follow from it, itself included, and the last of them that is held."""
        chunk = node >> 32
        follows = np.where(is_last[chunk], -1, chunk + 1 << 32 | to)
        at = np.minimum(np.searchsorted(node, follows), len(node) - 1)
        ahead = np.where(node[at] == follows, at, -1)
        total, final = count.copy(), np.arange(len(node))
        while len(on := np.flatnonzero(ahead >= 0)):
            to_node = ahead[on]
            total[on], final[on], ahead[on] = total[on] + total[to_node], final[to_node], ahead[to_node]
        return total, final

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, the dummy prefix included; blocks of texts and of parts of long ones at a time."""
        total = np.zeros(len(texts), np.int64)
        block: list[tuple[int, str]] = []
        size, carried = 0, None  # state of a text whose first part was read in an earlier block, and the code point before
        for i, t in enumerate(texts):
            whole, a = SPACE + t.replace(" ", SPACE) if t else "", 0
            while a < len(whole):
                part = whole[a : a + BLOCK - size]
                block.append((i, part))
                size, a = size + len(part), a + len(part)
                if size == BLOCK:
                    carried = self._block(block, carried, total, open_end=a < len(whole))
                    block, size = [], 0
        if block:
            self._block(block, carried, total, open_end=False)
        return total

    def _block(self, block: list[tuple[int, str]], carried: tuple[bytes, str] | None, total: np.ndarray, open_end: bool) -> tuple[bytes, str] | None:
        if self.moves.size > MOST_MOVES:
            self.forget()
        length = np.array([len(t) for _, t in block], np.int64)
        chars = np.frombuffer(((carried[1] if carried else SPACE) + "".join(t for _, t in block)).encode("utf-32-le", "surrogatepass"), np.uint32)
        resets = self.model.resets(chars)[1:]
        chars = chars[1:]
        symbols = self.model.of_char[chars].astype(np.int64)
        symbols = np.where(symbols >= 0, symbols, self.model.n_symbols + 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))
        starts = np.full(len(block), self.start, np.int64)
        if carried:
            starts[0] = self._state(carried[0])
        resets[(np.cumsum(length) - length)[1 if carried else 0 :]] = True
        ends, counts = self.scan(symbols, resets, length, starts)
        np.add.at(total, [i for i, _ in block], counts)
        return (self.keys[ends[-1]], block[-1][1][-1]) if open_end else None


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer per model in a Python worker."""
    return Transducer(piece_model(path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_bytes, n_tokens, without begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in slices(batches, "text", SMALL):
            texts = as_bytes(batch.column(1))
            counts = machine.counts([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
