"""The best documents for each item by shared terms: TPUT over term-partitioned postings.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z in lower case. With N documents that have terms, L terms in all, n of them in
a document, df documents that hold a term and tf times it stands in one, a term's
weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's size
m = 50 + (50 * n * N) div L, and a term adds
weight * ((1000000000 * tf) div (1000 * tf + 20 * m)) to the document's score.

Method (Cao and Wang, 2004). All documents are read once into profiles: the
items' terms with their counts. From those come the statistics and the postings,
a list for each term, dealt into ranges of (term, falling addition), so that a
list of a term that most documents hold spans many ranges and a small share of
all rows lies in each. Three phases:

1. The k heads of every list name documents; the k-th largest of their scores for
   an item is a lower bound of its k-th score.
2. Every list is read down to one threshold for the item: THRESHOLD times that
   bound over the number of lists. What was read is dealt to documents and summed
   there, for all items that share a term at once, so that nothing is shuffled per
   item. A document stays if its sum, with the threshold (or the list's head, if
   less) for each list that didn't give it, reaches the bound; one met nowhere
   can't. The k-th largest sum is a better bound and drops more.
3. The documents left get exact scores from their profiles.

THRESHOLD at 1 is the original method; less reads more of the lists and leaves
fewer documents to look up. With 34 terms an item, most additions are above even
the whole threshold: on a table of 51,282 documents 1.0 read 41.6 of 46.6 million
additions and left 6.0 million documents of all items, 0.25 read 46.5 and left 0.35.

Nothing is cut off but what can't be among the first k. Items are worked on in
blocks by a hash of their ids when they have more than PAIRS pairs of item and
term, so that what is broadcast (a block's terms, weights and thresholds) stays
bounded; each block reads the documents once.

Null texts have no terms. Rows of documents are documents each, also when they
repeat an id or whole rows; a null id is last among equal scores, then rows as
numbered by the profiles. Rows of items that repeat an id are one item of all
their terms; a null id is one, too. Items without terms, or with terms that no
document holds, have no rows in the result; empty tables give an empty one.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, keep, materialise, release
from .text import as_bytes, list_array, slices

PAIRS = 1 << 18
THRESHOLD = 0.25
#: Cells (documents x items) that a task sums at once; documents looked up that are broadcast rather than joined by a shuffle.
CELLS, LOOKUPS = 1 << 18, 1 << 18
#: Bytes to bytes: A-Z to lower case, what separates terms to a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        own = [sorted(set(terms(x))) for x in as_bytes(batch.column(1))]
        at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([t for x in own for t in x], pa.binary())], ["item_id", "term"])


def _profiles(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """row, doc_id, n (terms), terms, tfs (those with a number and how often they stand there) of each document that has terms."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, width = shared.value.get, len(shared.value) + 1
        for batch in slices(batches, "text", 1 << 20):
            sizes, found = [], []
            for text in as_bytes(batch.column(1)):
                words = terms(text)
                sizes.append(len(words))
                found.extend(map(get, words, repeat(width - 1)))
            sizes = np.array(sizes, np.int64)
            keys = np.repeat(np.arange(len(sizes)), sizes) * width + np.array(found, np.int64)
            keys, tfs = np.unique(keys[keys % width != width - 1], return_counts=True)
            counts = np.bincount(keys // width, minlength=len(sizes))
            columns = [batch.column(0), pa.array(sizes), list_array(keys % width, counts, pa.int32()), list_array(tfs, counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"]).filter(pa.array(sizes > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").withColumn("row", F.monotonically_increasing_id())


def _heads(k: int):
    """The first k rows of each run of a term in sorted (term, row, s) rows; a rise of s begins a run, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            term, s = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (s[1:] > s[:-1])
            new[0] = last is None or term[0] != last[0] or s[0] > last[1]
            starts = np.flatnonzero(new)
            at = np.arange(len(term)) + place
            if len(starts):
                at[starts[0] :] = np.arange(starts[0], len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
            yield batch.filter(pa.array(at < k))
            last, place = (term[-1], s[-1]), int(at[-1]) + 1

    return run


class _Lists(NamedTuple):
    """Which items have which terms, and what a document's sums need."""

    starts: np.ndarray  # by term: its items are items[starts[t] : starts[t + 1]]
    items: np.ndarray
    n_items: int

    @classmethod
    def of(cls, item: np.ndarray, term: np.ndarray, n_items: int, n_terms: int) -> _Lists:
        order = np.lexsort((item, term))
        return cls(np.searchsorted(term[order], np.arange(n_terms + 1)), item[order].astype(np.int64), n_items)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms: their places, and the items, one for each pair."""
        n = self.starts[term + 1] - self.starts[term]
        at = np.repeat(np.arange(len(term)), n)
        return at, self.items[np.repeat(self.starts[term] - (np.cumsum(n) - n), n) + np.arange(len(at))]

    def docs_at_once(self) -> int:
        return max(1, CELLS // self.n_items)


def _sum(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by cell: in doubles, which hold them exactly below 2^53."""
    out = np.bincount(cells, values, size)
    if len(out) and out.max() >= 2.0**53:
        raise OverflowError("scores of 2^53 or more")
    return out.astype(np.int64)


def _exact(lists: Broadcast, weights: Broadcast, all_docs: int, all_terms: int):
    """row, doc_id, n, terms, tfs, wanted (items) -> item, row, doc_id, score for the wanted items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lists.value
        for whole in batches:
            for start in range(0, whole.num_rows, of.docs_at_once()):
                batch = whole.slice(start, of.docs_at_once())
                counts, wanted = (batch.column(k).value_lengths().to_numpy() for k in (3, 5))
                own, term = np.repeat(np.arange(batch.num_rows), counts), batch.column(3).flatten().to_numpy()
                tf, size = batch.column(4).flatten().to_numpy(), 50 + 50 * batch.column(2).to_numpy() * all_docs // all_terms
                s = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 20 * size[own]))
                at, item = of.spread(term)
                score = _sum(own[at] * of.n_items + item, s[at], batch.num_rows * of.n_items)
                own, item = np.repeat(np.arange(batch.num_rows), wanted), batch.column(5).flatten().to_numpy()
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(score[own * of.n_items + item])], ["item", "row", "doc_id", "score"])

    return run


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (row, ...), sorted by row, cut so that no row is in two of them."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            both = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            row = both.column(0).to_numpy()
            cut = int(np.searchsorted(row, row[-1]))
            rest = both.slice(cut)
            if cut:
                yield both.slice(0, cut)
    if rest is not None:
        yield rest


def _reach(lists: Broadcast, limits: Broadcast):
    """row, term, s of what was read, sorted by row -> item, row, known (sum), most (upper bound) of the documents that can reach the bound.

    limits: by item the threshold, the bound and the sum of caps; by term the largest addition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (least, bound, caps, top) = lists.value, limits.value
        for batch in _whole_rows(batches):
            row, term, s = (batch.column(k).to_numpy() for k in range(3))
            firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            for start in range(0, len(firsts), of.docs_at_once()):
                a, b = firsts[start], firsts[min(start + of.docs_at_once(), len(firsts))] if start + of.docs_at_once() < len(firsts) else len(row)
                rows = row[firsts[start : start + of.docs_at_once()]]
                at, item = of.spread(term[a:b])
                own = (np.searchsorted(firsts, np.arange(a, b), side="right") - 1 - start)[at]
                add = s[a:b][at]
                read = add >= least[item]
                at, item, own, add = at[read], item[read], own[read], add[read]
                cells, size = own * of.n_items + item, len(rows) * of.n_items
                known = _sum(cells, add, size).reshape(len(rows), -1)
                most = known + caps - _sum(cells, np.minimum(least[item] - 1, top[term[a:b][at]]), size).reshape(len(rows), -1)
                doc, item = np.nonzero((most >= bound) & (known > 0))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(rows[doc]), pa.array(known[doc, item]), pa.array(most[doc, item])], ["item", "row", "known", "most"])

    return run


def _kth(sums: DataFrame, k: int, n_items: int) -> np.ndarray:
    """The k-th largest `known` of each item; 0 where there are fewer rows."""
    out = np.zeros(n_items, np.int64)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("known")))
    for x in sums.select("item", "known").withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).collect():
        out[x.item] = x.known
    return out


def _search(docs: DataFrame, pairs: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """One block of items."""
    spark = docs.sparkSession
    names = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    number = {t: j for j, t in enumerate(sorted({t for _, t in pairs}))}
    place = {i: j for j, i in enumerate(names)}
    item, term = np.array([place[i] for i, _ in pairs], np.int32), np.array([number[t] for _, t in pairs], np.int32)

    profiles = materialise(_profiles(docs, number), "profiles")
    total = profiles.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    all_docs, all_terms = total.docs, total.terms or 1
    weights = np.zeros(len(number), np.int64)
    for x in profiles.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[x.term] = math.floor(1000 * math.log((2 * all_docs + 2) / (2 * x["count"] + 1)))

    by_term = lambda terms, **more: F.broadcast(spark.createDataFrame(pa.table({"term": terms.astype(np.int32), **more})))
    size = F.expr(f"50L + (50L * n * {all_docs}L) div {all_terms}L")
    found = profiles.select("row", size.alias("size"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "row", F.col("p.tfs").alias("tf"), "size")
    added = found.join(by_term(np.flatnonzero(weights), weight=weights[weights > 0]), "term").select("term", "row", F.expr("weight * ((1000000000L * tf) div (1000L * tf + 20L * size))").alias("s")).where("s > 0")
    postings = materialise(added.repartitionByRange("term", F.desc("s")).sortWithinPartitions("term", F.desc("s")), "postings")

    firsts = Window.partitionBy("term").orderBy(F.desc("s"), "row")
    heads = keep(postings.mapInArrow(_heads(k), postings.schema).withColumn("place", F.row_number().over(firsts)).where(F.col("place") <= k).drop("place"))
    top = np.zeros(len(number), np.int64)
    for x in heads.groupBy("term").agg(F.max("s").alias("s")).collect():
        top[x.term] = x.s
    some = top[term] > 0  # lists that aren't empty
    item, term = item[some], term[some]
    lists = spark.sparkContext.broadcast(_Lists.of(item, term, len(names), len(number)))
    shared = spark.sparkContext.broadcast(weights)

    def scores(wanted: DataFrame) -> DataFrame:
        """Of (item, row) pairs, from the profiles."""
        wanted = keep(wanted.groupBy("row").agg(F.collect_set("item").alias("wanted")))
        small = wanted.limit(LOOKUPS + 1).count() <= LOOKUPS
        both = profiles.join(F.broadcast(wanted) if small else wanted, "row").select("row", "doc_id", "n", "terms", "tfs", "wanted")
        return both.mapInArrow(_exact(lists, shared, all_docs, all_terms), "item int, row long, doc_id long, score long")

    pairs_of_heads = heads.join(F.broadcast(spark.createDataFrame(pa.table({"item": item, "term": term}))), "term").select("item", "row")
    bound = _kth(scores(pairs_of_heads).withColumnRenamed("score", "known"), k, len(names))
    n_lists = np.bincount(item, minlength=len(names))
    least = np.maximum(1, np.ceil(THRESHOLD * bound / np.maximum(1, n_lists)).astype(np.int64))
    caps = np.zeros(len(names), np.int64)
    np.add.at(caps, item, np.minimum(least[item] - 1, top[term]))
    down_to = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(down_to, term, least[item])
    read = postings.join(by_term(np.flatnonzero(top), least=down_to[top > 0]), "term").where("s >= least").select("row", "term", "s")
    limits = spark.sparkContext.broadcast((least, bound, caps, top))
    met = keep(read.repartition("row").sortWithinPartitions("row").mapInArrow(_reach(lists, limits), "item int, row long, known long, most long"))
    bound = np.maximum(bound, _kth(met, k, len(names)))
    per_item = spark.createDataFrame(pa.table({"item": np.arange(len(names), dtype=np.int32), "item_id": pa.array(names, pa.int64()), "bound": bound}))
    left = met.join(F.broadcast(per_item), "item").where("most >= bound").select("item", "row")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    best = scores(left).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(per_item), "item")
    best = materialise(best.select("item_id", "rank", "doc_id", "score"), "ranked", small=True)
    release(spark, heads, met)
    drop(postings)
    drop(profiles)
    return best


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item, by falling score, then rising id."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pairs = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(_pairs, "item_id long, term binary")
    pairs = materialise(pairs.distinct(), "pairs", small=True)
    n = pairs.count()
    blocks = 1 if n <= PAIRS else math.ceil(2 * n / PAIRS)
    out = None
    for b in range(blocks):
        block = [(x.item_id, bytes(x.term)) for x in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        if block:
            best = _search(own, block, k)
            out = best if out is None else out.unionAll(best)
    drop(pairs)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
