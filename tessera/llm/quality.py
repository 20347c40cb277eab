"""Quality rules by labelling lines with a linear-chain conditional random field.

Base rules, over the words (runs of other than ASCII white space) of the whole
text: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
with a word that equal an earlier line), n_repeat_words (words in windows of 8
that the text holds twice or more). A text fails them with fewer than 20 words
or more than 30 % repeated words.

The lines with a word form a chain; each has features of its characters and of
repetition inside the text, and Viterbi decoding labels it content or
boilerplate. A text is kept if it passes the base rules and at least half of
its words are in content lines.

The field is fitted on the driver to a bounded sample: whole labelled documents
in the order of a hash of their id, of any length, until there are FIT_DOCS of
them or FIT_LINES lines (the last document may go beyond).
Labels are by document, so a logistic model of lines is fitted to them first;
in documents of low quality, the lines it takes for boilerplate are labelled so
and the others content, in the others all lines are content. Without labels of
both kinds, FALLBACK weights serve.

Null, empty and wordless texts have zero counts, fail, and aren't kept. Rows may
repeat; each is judged alone. Ties between label rows of one document: the lower
quality counts. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_logistic, minimise
from .storage import drop, materialise, release_memory
from .text import SMALL, U, WordHashes, as_bytes, keep_rows, mix, slices, window_hashes, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
FIT_DOCS, FIT_LINES = 3000, 200_000
FEATURES = ("first", "short", "log_words", "upper", "symbols", "digits", "marks", "ends_sentence", "earlier_line", "repeated", "long_words", "one_word", "bare")
#: Weights for content without labels to fit: shouting, symbols and repetition count against it.
FALLBACK = (0.0, -0.5, 0.0, -4.0, -12.0, -2.0, -4.0, 0.5, -3.0, -4.0, -1.0, -0.5, -6.0)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


SPACES = _table(b" \t\n\v\f\r")
IS_SYMBOL, IS_DIGIT = _table(SYMBOLS), _table(b"0123456789")
IS_UPPER, IS_LETTER = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
IS_MARK = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS and c not in b".,;:'\"()-"))
STARTS_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)
ENDS = _table(b".!?:;\"')")


@dataclass
class Lines:
    """What a slice of texts shows: counts per text, and features, words and text of each line with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    words: np.ndarray
    text: np.ndarray


def analyse(texts: list[bytes], known: WordHashes) -> Lines:
    n = len(texts)
    hashes, counts = word_hashes(texts, known)
    # words in windows that their text holds twice
    windows, per = window_hashes(hashes, counts, WINDOW, short=False)
    of = np.repeat(np.arange(n), per)
    _, inverse, times = np.unique(windows ^ mix(of.astype(U) + U(1)), return_inverse=True, return_counts=True)
    starts = np.cumsum(counts) - counts
    place = starts[of] + np.arange(len(windows)) - (np.cumsum(per) - per)[of]
    twice = place[times[inverse] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + WINDOW, len(hashes)), -1)
    repeated = (np.cumsum(cover)[:-1] > 0).astype(np.int64)
    ends = np.cumsum(np.append(0, repeated))
    n_repeat = ends[starts + counts] - ends[starts]

    # one line end behind each text, so that every line ends in one
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    line_end = np.flatnonzero(flat == 10)
    line_start = np.append(0, line_end[:-1] + 1)
    text_end = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
    text_of = np.searchsorted(text_end, line_end)
    space = SPACES[flat]
    add = lambda x: np.add.reduceat(x, line_start)
    begins = (1 - space) * np.append(1, space[:-1])
    lone = begins * np.append(space[1:], 1) * (1 - (IS_LETTER | IS_DIGIT)[flat]) * (flat < 128)
    words, chars, bare = add(begins), add(STARTS_CHAR[flat] * (1 - space)), add(lone)
    symbols, digits, upper, letters, marks = (add(x[flat]) for x in (IS_SYMBOL, IS_DIGIT, IS_UPPER, IS_LETTER, IS_MARK))
    earlier = np.zeros(len(words), np.int64)
    line = 0
    for t in texts:
        seen = set()
        for own in t.split(b"\n"):
            if words[line]:
                earlier[line] = own in seen
                seen.add(own)
            line += 1
    per_text = lambda x: np.bincount(text_of, x, n).astype(np.int64)
    has = words > 0
    w, c = words[has], chars[has]
    word_ends = np.cumsum(w)
    rep = (ends[word_ends] - ends[word_ends - w]) / np.maximum(w, 1)
    # the last byte of a line that isn't white space
    index = np.where(space == 0, np.arange(len(flat)), 0)
    final = flat[np.maximum.reduceat(index, line_start)[has]]
    own = text_of[has]
    features = np.stack([
        np.diff(own, prepend=-1) != 0, w <= 3, np.log1p(w) / 5, upper[has] / np.maximum(letters[has], 1), np.minimum(symbols[has] / np.maximum(c, 1), 0.5) * 2, digits[has] / np.maximum(c, 1),
        np.minimum(marks[has] / np.maximum(c, 1), 0.5) * 2, ENDS[final], earlier[has], rep, np.minimum(c / np.maximum(w, 1), 50) / 10 - 0.5, w == 1, bare[has] / np.maximum(w, 1),
    ], axis=1).astype(np.float64) if has.any() else np.zeros((0, len(FEATURES)))
    return Lines(counts, per_text(chars), per_text(symbols), per_text(earlier), n_repeat, features, w, own)


@dataclass(frozen=True)
class Field:
    """Weights of a line's features for content (boilerplate has 0), their intercept, and transition weights [from][to], 1 for content."""

    weights: tuple[float, ...]
    intercept: float
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ np.array(self.weights) + self.intercept


DEFAULT = Field(FALLBACK, 2.0, ((1.0, 0.0), (0.0, 1.0)))


def _columns(chain: np.ndarray) -> list[np.ndarray]:
    """Line numbers by place in their chains (sorted numbers of chains): [first lines, second lines, ...], each in the order of the longest chains first."""
    if not len(chain):
        return []
    start = np.flatnonzero(np.diff(chain, prepend=-1))
    length = np.diff(np.append(start, len(chain)))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    return [start[: np.searchsorted(-length, -k, side="left")] + k for k in range(length[0])]


def viterbi(field: Field, features: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The likeliest labels (1: content) of all lines; chain: sorted numbers of their texts. Equal scores go to content."""
    score, t = field.scores(features), np.array(field.transitions)
    columns = _columns(chain)
    best, back = np.zeros((len(chain), 2)), np.zeros((len(chain), 2), np.int64)
    for k, now in enumerate(columns):
        if k:
            through = best[columns[k - 1][: len(now)], :, None] + t  # [line, from, to]
            back[now] = np.where(through[:, 1] >= through[:, 0], 1, 0)
            best[now] = through.max(axis=1)
        best[now, 1] += score[now]
    labels = np.zeros(len(chain), np.int64)
    for k in range(len(columns) - 1, -1, -1):
        now = columns[k]
        on = len(columns[k + 1]) if k + 1 < len(columns) else 0
        labels[now[on:]] = best[now[on:], 1] >= best[now[on:], 0]
        if on:
            labels[now[:on]] = back[columns[k + 1], labels[columns[k + 1]]]
    return labels


def fit_field(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, l2: float = 1.0) -> Field:
    """Maximum likelihood by forward and backward sums, all chains advancing together."""
    columns, width = _columns(chain), features.shape[1]
    same = np.diff(chain, append=-1) == 0
    a, b = labels[:-1][same[:-1]], labels[1:][same[:-1]]
    moves = np.array([[((a == i) & (b == j)).sum() for j in (0, 1)] for i in (0, 1)], float)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        emit = np.zeros((len(chain), 2))
        emit[:, 1] = features @ x[:width] + x[width]
        t = x[width + 1 :].reshape(2, 2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        for k, now in enumerate(columns):
            ahead[now] = emit[now] + (np.logaddexp.reduce(ahead[columns[k - 1][: len(now)], :, None] + t, axis=1) if k else 0)
        total = 0.0
        expected = np.zeros((2, 2))
        for k in range(len(columns) - 1, 0, -1):
            now, prev = columns[k], columns[k - 1][: len(columns[k])]
            behind[prev] = np.logaddexp.reduce(t + (emit[now] + behind[now])[:, None, :], axis=2)
        norm = np.logaddexp.reduce(ahead + behind, axis=1)
        total = norm[columns[0]].sum()
        for k in range(1, len(columns)):
            now, prev = columns[k], columns[k - 1][: len(columns[k])]
            expected += np.exp(ahead[prev, :, None] + t + (emit[now] + behind[now])[:, None, :] - norm[now][:, None, None]).sum(axis=0)
        content = np.exp(ahead[:, 1] + behind[:, 1] - norm)
        value = total - emit[labels == 1, 1].sum() - (moves * t).sum() + l2 / 2 * (x @ x)
        err = content - labels
        return value, np.concatenate([features.T @ err, [err.sum()], (expected - moves).ravel()]) + l2 * x

    x = minimise(loss, np.zeros(width + 5), 60)
    return Field(tuple(x[:width]), float(x[width]), tuple(map(tuple, x[width + 1 :].reshape(2, 2))))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """labels: doc_id, quality (0 low). See the module's text for the sample and its bounds."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)  # at most FIT_DOCS rows: small enough to broadcast
    chosen = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text", SMALL):
            x = analyse(as_bytes(batch.column(1)), known)
            per = np.bincount(x.text, minlength=batch.num_rows)
            ends = np.cumsum(per)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(per, pa.int64()), pa.array([x.features[e - k : e].astype("<f4").tobytes() for e, k in zip(ends.tolist(), per.tolist(), strict=True)], pa.binary())], ["doc_id", "quality", "lines", "features"])

    rows = materialise(chosen.mapInArrow(run, "doc_id long, quality int, lines long, features binary").where("lines > 0"), "lines")
    last, lines = None, 0
    for r in rows.groupBy(F.xxhash64("doc_id").alias("h"), "doc_id").agg(F.max("lines").alias("lines")).orderBy("h", "doc_id").collect():  # at most FIT_DOCS rows
        if lines >= FIT_LINES:
            break
        last, lines = (r["h"], r["doc_id"]), lines + r["lines"]
    if last is None:
        drop(rows)
        return DEFAULT
    taken = rows.where((F.xxhash64("doc_id") < last[0]) | (F.xxhash64("doc_id") == last[0]) & (F.col("doc_id") <= last[1]))
    written, rows = rows, taken.select("doc_id", "quality", "features").toPandas().sort_values(["doc_id", "features"]).drop_duplicates("doc_id")
    drop(written)
    if rows["quality"].gt(0).nunique() < 2:
        return DEFAULT
    parts = [np.frombuffer(x, "<f4").reshape(-1, len(FEATURES)).astype(float) for x in rows["features"]]
    x, chain = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    good = (rows["quality"].to_numpy() > 0)[chain]
    weight = 1 / np.bincount(chain)[chain]
    w, b = fit_logistic(lambda w: x @ w, lambda e: e @ x, good.astype(float), x.shape[1], 1.0, weight)
    field = fit_field(x, (good | (x @ w + b > 0)).astype(np.int64), chain)
    del rows, parts
    release_memory()
    return field


@dataclass
class Verdicts:
    lines: Lines
    base_failed: np.ndarray
    share: np.ndarray  # words in content lines
    kept: np.ndarray


def judge(texts: list[bytes], field: Field, known: WordHashes) -> Verdicts:
    x = analyse(texts, known)
    share = np.bincount(x.text, x.words * viterbi(field, x.features, x.text), len(texts))
    failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > MAX_REPEAT_PERCENT * x.n_words)
    return Verdicts(x, failed, share, ~failed & (2 * share >= x.n_words))


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the counts, base_failed, content_share (of words; null without words), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, "text", SMALL):
            v = judge(as_bytes(batch.column(1)), field, known)
            x = v.lines
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)), pa.array(v.base_failed), pa.array(v.share / np.maximum(x.n_words, 1), mask=x.n_words == 0), pa.array(v.kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def keep_documents(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The kept rows of docs, with all columns."""

    def start():
        known = WordHashes()
        return lambda texts: judge(texts, field, known).kept

    return keep_rows(docs, text_col, start)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit the field to the labels and score every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return score_documents(docs, fit(docs, labels))
