"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (3 to 6 code points of the
lower-cased text, white space runs as one space, a space at either end), hashed
to 2**HASH_BITS numbers, whatever its length. For each n-gram the log-count
ratio of document shares, r = log((toxic + a) / (all toxic + 2a)) - log((clean +
a) / (all clean + 2a)), is taken over the training sample; those of the largest
evidence stay, weighted by r, and a penalised logistic regression is fitted on
them. The score is its probability, with the intercept put right for the share
of toxic labels among all labels.

How many n-grams stay is one of FEATURES: the number with the least log loss over
FOLDS folds of the training sample, by hash of the id, each scored by a model
whose n-grams, ratios and weights come from the other folds (ties, and samples too
small for folds: the least). That few stay is part of the fit, not a saving: most
n-grams are in hardly more than one document of the sample and restate its label.

The training sample is bounded: FIT_DOCS / 2 labelled documents of either kind
at most, by hash of their id. It is written once; the model has max(FEATURES)
weights at most, so what goes to the driver and to executors is bounded too. With
labels of one kind or none, or of no document here, every score is the share of
toxic labels (0 without labels).

Null texts count as empty; an empty text scores as a text without any kept
n-gram. Repeated rows are each scored. Of several labels of a document the
greatest counts. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import SparseRows, fit_logistic, sigmoid
from .storage import drop, materialise, release_memory
from .text import SMALL, as_bytes, keep_rows, slices

HASH_BITS = 22
SIZES = (3, 4, 5, 6)
FIT_DOCS, LEAST_DOCS = 6000, 3
FEATURES, FOLDS = (1 << 9, 1 << 11, 1 << 13, 1 << 15), 3
#: Parts that the training sample is dealt into.
FIT_PARTS = 16
#: Steps of the histogram of evidence: this many for a factor of 2; LOWEST is that of no evidence.
STEPS, LOWEST = 64, -(1 << 20)
SMOOTHING, PENALTY = 0.5, 4.0
THRESHOLD = 0.3


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram: hashes, and the number of the text each belongs to."""
    parts = [" " + " ".join(t.decode("utf-8", "replace").lower().split()) + " " for t in texts]
    length = np.array([len(p) for p in parts], np.int64)
    chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(parts), dtype=np.int32), length)
    rolled = chars.copy()  # wraps around at 32 bits
    for size in range(2, max(SIZES) + 1):
        if len(chars) < size:
            return
        rolled = rolled[:-1] * np.uint32(0x01000193) + chars[size - 1 :] * np.uint32(0x9E3779B1)
        if size in SIZES:
            h = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(size * 0x27D4EB2F & 0xFFFFFFFF)
            inside = of[: len(h)] == of[size - 1 :]
            yield (h >> np.uint32(32 - HASH_BITS))[inside], of[: len(h)][inside]


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """Place of each hash in features + 1; 0 for others."""
        out = np.zeros(1 << HASH_BITS, np.uint16)
        out[self.features] = np.arange(1, len(self.features) + 1)
        return out


def constant(share: float) -> Model:
    """Scores every text with the share."""
    return Model(np.empty(0, np.int64), np.empty(0), float(np.log((share + 1e-12) / (1 - share + 1e-12))))


def _present(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the kept features that texts hold, each once."""
    found = [np.empty(0, np.int64)]
    for h, of in ngrams(texts):
        place = table[h]
        hit = np.flatnonzero(place)
        found.append(of[hit].astype(np.int64) << 20 | (place[hit] - 1).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> 20, both & ((1 << 20) - 1)


def _add_counts(counts: np.ndarray, texts: list[bytes], toxic: np.ndarray) -> None:
    """To the document counts of each n-gram, [clean or toxic][hash]."""
    found = np.unique(np.concatenate([np.empty(0, np.int64), *(of.astype(np.int64) << HASH_BITS | h for h, of in ngrams(texts))]))
    kind = toxic[found >> HASH_BITS]
    for k in (0, 1):
        np.add.at(counts[k], found[kind == k] & ((1 << HASH_BITS) - 1), 1)


def _counted(sample: DataFrame) -> DataFrame:
    """h, fold, clean, toxic: document counts of each n-gram in each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((FOLDS, 2, 1 << HASH_BITS), np.int16)  # of FIT_DOCS documents at most
        for batch in slices(batches, "text", SMALL // len(SIZES)):
            texts, toxic, fold = as_bytes(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for f in np.unique(fold).tolist():
                some = np.flatnonzero(fold == f)
                _add_counts(counts[f], [texts[i] for i in some], toxic[some])
        for f in range(FOLDS):
            held = np.flatnonzero(counts[f].any(axis=0))
            for part in np.array_split(held, max(1, len(held) // 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), f), pa.int32()), pa.array(counts[f][0][part], pa.int64()), pa.array(counts[f][1][part], pa.int64())], ["h", "fold", "clean", "toxic"])

    return sample.mapInArrow(run, "h int, fold int, clean long, toxic long").groupBy("h", "fold").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _best(counted: DataFrame, n_clean: int, n_toxic: int, n: int) -> pd.DataFrame:
    """Hash and log-count ratio of the n n-grams of most evidence, the most first. n_clean, n_toxic: documents counted."""
    a = SMOOTHING
    ratio = F.log((F.col("toxic") + a) / (n_toxic + 2 * a)) - F.log((F.col("clean") + a) / (n_clean + 2 * a))
    gap = F.abs(F.col("toxic") / n_toxic - F.col("clean") / n_clean)
    counted = counted.groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counted.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).select("h", ratio.alias("ratio"), (F.abs(ratio) * gap).alias("evidence"))
    kept = materialise(kept.withColumn("step", F.when(F.col("evidence") > 0, F.floor(F.log2("evidence") * STEPS)).otherwise(LOWEST).cast("int")), "evidence")
    # a histogram of the evidence tells the step in which the last one is; so the driver gets what stays, not the best of every partition
    left, last = n, LOWEST - 1
    for r in sorted(kept.groupBy("step").count().collect(), reverse=True):  # at most 64 * STEPS rows or so: evidence is 2**-50 to 2**4, or 0
        if r["count"] > left:
            last = r["step"]
            break
        left -= r["count"]
    best = kept.where(F.col("step") > last).select("h", "ratio", "evidence").unionAll(kept.where(F.col("step") == last).select("h", "ratio", "evidence").orderBy(F.col("evidence").desc(), "h").limit(left))
    best = best.toPandas().sort_values(["evidence", "h"], ascending=[False, True])
    drop(kept)
    return best


def _matrix(sample: DataFrame, model: Model) -> pd.DataFrame:
    """doc_id, toxic, fold, features (their columns, two bytes each) of the sample's rows, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in slices(batches, "text", SMALL):
            rows, cols = _present(as_bytes(batch.column(1)), table)
            cuts = np.searchsorted(rows, np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([x.astype("<u2").tobytes() for x in np.split(cols, cuts)], pa.binary())], ["doc_id", "toxic", "fold", "features"])

    return sample.mapInArrow(run, "doc_id long, toxic int, fold int, features binary").toPandas().sort_values(["doc_id", "features"])


def _rows(data: pd.DataFrame, ratios: np.ndarray, n: int) -> SparseRows:
    """Rows of _matrix() with their first n columns."""
    cols = [(own := np.frombuffer(x, "<u2"))[own < n] for x in data["features"]]  # row by row, as running counts of all entries would take eight bytes each
    return SparseRows(np.concatenate([np.empty(0, "<u2"), *cols]), np.array([len(x) for x in cols], np.int64), ratios[:n])


def losses(sample: DataFrame, counted: DataFrame, n: dict[tuple[int, int], int]) -> dict[int, float]:
    """Log loss of each of FEATURES over the folds. n: documents by (fold, toxic). Empty if no fold has both kinds outside it."""
    out: dict[int, float] = {}
    for f in range(FOLDS):
        kinds = [sum(v for (fold, k), v in n.items() if k == kind and fold != f) for kind in (0, 1)]
        if not all(kinds) or not any(fold == f for fold, _ in n):
            continue
        best = _best(counted.where(F.col("fold") != f), *kinds, max(FEATURES))
        ratios = best["ratio"].to_numpy()
        data = _matrix(sample, Model(best["h"].to_numpy(np.int64), ratios, 0.0))
        own, rest = data[data["fold"] == f], data[data["fold"] != f]
        for size in FEATURES:
            learnt, tried = _rows(rest, ratios, size), _rows(own, ratios, size)
            w, b = fit_logistic(learnt.forward, learnt.backward, rest["toxic"].to_numpy(float), len(ratios[:size]), PENALTY)
            z = tried.forward(w) + b
            out[size] = out.get(size, 0.0) + float((np.logaddexp(0, z) - own["toxic"].to_numpy(float) * z).sum())
        del data, own, rest
        release_memory()
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1), of training documents alone."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if not (n.get(0) and n.get(1)):
        return constant(share)
    half = FIT_DOCS // 2
    chosen = [labels.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for k in (0, 1)]
    chosen = chosen[0].unionAll(chosen[1]).withColumnRenamed("doc_id", "_id")  # at most FIT_DOCS rows: small enough to broadcast
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", fold.alias("fold"))
    sample = materialise(sample.repartition(FIT_PARTS), "sample")  # else each part of docs, with a row of the sample or none, would make arrays for all hashes
    n = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    kinds = [sum(v for (_, k), v in n.items() if k == kind) for kind in (0, 1)]
    if not all(kinds):
        drop(sample)
        return constant(share)
    counted = materialise(_counted(sample), "counted")
    tried = losses(sample, counted, n)
    best = _best(counted, *kinds, min(FEATURES, key=lambda size: (tried.get(size, 0.0), size)))
    drop(counted)
    model = Model(best["h"].to_numpy(np.int64), best["ratio"].to_numpy(), 0.0)
    data = _matrix(sample, model)
    drop(sample)
    rows, y = _rows(data, model.weights, len(model.weights)), data["toxic"].to_numpy(float)
    del data
    w, b = fit_logistic(rows.forward, rows.backward, y, len(model.weights), PENALTY)
    del rows
    release_memory()
    odds = lambda p: np.log(p / (1 - p))
    return Model(model.features, w * model.weights, b + odds(share) - odds(min(max(y.mean(), 1e-6), 1 - 1e-6)))


def probabilities(texts: list[bytes], model: Model, table: np.ndarray) -> np.ndarray:
    rows, cols = _present(texts, table)
    return sigmoid(np.bincount(rows, model.weights[cols], len(texts)) + model.intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in slices(batches, "text", SMALL):
            p = probabilities(as_bytes(batch.column(1)), model, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all columns."""

    def start():
        table = model.table()
        return lambda texts: probabilities(texts, model, table) < THRESHOLD

    return keep_rows(docs, text_col, start)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit to the labels that aren't held out and score every document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
