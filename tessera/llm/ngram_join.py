"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes (64 bits) of its distinct word shingles. Two
sets link when 100 * intersection >= threshold * union. A token is a shingle.

1. Frequencies: every text adds its words and its shingles to two count sketches
   of four cells a document. Cells of shingles well above the mean mark *frequent* tokens;
   others are ranked by the frequency that their words alone let expect. Marks
   and ranks depend on the token alone, so a wrong one costs time, never a link.
2. Prefixes: the total order is rare tokens by rank and hash, then frequent
   ones. A set of n tokens lacks at most t = n - ceil(threshold * n / 100)
   tokens of any partner, so of t + SHARED leading rare tokens, indexed one by
   one, a partner has SHARED (fewer where the smaller set is smaller). Where rare tokens run out, frequent ones follow; they
   are dealt into classes by hash and a class gives the 2-combinations of its
   tokens. The prefix is extended until rare + sum(max(0, class size - 1)) >=
   t + SHARED: t absences then leave SHARED shared signatures, as m tokens of a
   class have at least m - 1 combinations. Classes are counted per size band (powers of two); a set near the
   upper end of a band takes part in the next band too, so that partners always
   share a band. The lowest bands index frequent tokens singly.
3. Candidates: each set that has a signature held by more than FEW sets goes once,
   with its tokens, to the most held one it has, its *home*. There, sets are
   compared in chunks, inside tasks, and links of spanning forests come out, which
   make components. Signatures held by more than CROWDED sets are *crowded*; every
   chunk of such a home gets its LEADERS too, the first of all the signature's
   holders in as many orders by hash, so that chunks and homes are linked through
   them. Other signatures give pairs, of which those with SHARED signatures in
   common whose sets aren't in one component yet are verified. Verification is
   exact, on whole sets; links make components.
4. What is left: only links between components matter now. A crowded signature
   whose holders are all in one component is done. Of the others, holders outside
   the largest component (the *minor* ones) must be compared to all holders, each
   pair at the least such signature it shares, if it wasn't in a home's chunk. Tasks
   first find, by the lists of signatures alone, which sets take part in such a
   pair; only these get their tokens and are compared. Work grows with the minor
   holders times all holders, so with the square only of sets that share a crowded
   signature without being linked. No partner is capped and no pair of these is
   written out.

Sets that are equal are joined once, as a class. Results per input row:
doc_id, n_shingles, component_id (the least doc_id reachable by links, itself
included). Null and wordless texts have no shingles and link with nothing. Rows
with a null id link with nothing and have a null component. Rows that repeat an
id are one node. Other columns, of any name, are ignored.

The sketches and the bit sets grow with the input, so that cells hold as much
noise at any size, up to 2**24 cells (four million documents) and 2**26 bits. They are
sent to tasks, so they have to end somewhere: beyond, cells of rare tokens hold more
noise, only tokens well above it are told apart, which are the ones that make
crowded signatures, and filters pass more. That costs time, never a link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, dealt, forest, leaders, unlinked
from .id_filter import bit_set, holds, passing, places
from .storage import drop, keep, materialise, release, release_memory
from .text import SMALL, U, WordHashes, as_bytes, list_array, mix, slices, window_hashes, window_sums, word_hashes

#: Sketches have four cells a document, from 2**LEAST_SKETCH to 2**MOST_SKETCH.
LEAST_SKETCH, MOST_SKETCH = 20, 24
CHUNK_BITS = 16
#: A token is 64 bits: a frequent mark, RANK_BITS of rank, then a hash.
RANK_BITS = 7
#: A shingle is frequent if its cell holds this many more than the noise of cells explains.
MARGIN = 32
#: Bands of sizes that index frequent tokens singly: sets under 2**SINGLE_BANDS tokens.
SINGLE_BANDS = 5
#: Signatures that linked sets have in common at least.
SHARED = 12
#: Signatures of more sets than this can be homes; signatures of more sets than this are crowded.
FEW, CROWDED = 256, 256
#: Sets of each crowded signature that every chunk of its home gets.
LEADERS = 8
#: Sets that a chunk of a home aims at; sets and tokens that any chunk aims at.
HOME_SETS = 256
CHUNK_SETS, CHUNK_TOKENS = 512, 1 << 19
#: Bytes of bit rows in a block; beyond, overlaps are counted token by token.
BIT_ROWS = 32 << 20


@dataclass(frozen=True)
class Frequencies:
    """marks: bit set of the cells of frequent shingles; logs: 8 * log2(count + 1) of the cells of words; total: words in all."""

    marks: bytes
    logs: bytes
    total: int


def sketch_size(n_docs: int) -> int:
    """Bits of the number of a cell."""
    return min(MOST_SKETCH, max(LEAST_SKETCH, (4 * n_docs - 1).bit_length()))


def _cell(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> U(64 - size)).astype(np.int64)


def shingle_sets(batches: Iterator[pa.RecordBatch], words: int, known: Frequencies | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of batches: the batch, hashes of all words, hashes of all shingles (with repeats), shingles per text. With known frequencies, tokens in place of shingle hashes."""
    table = WordHashes()
    if known:
        marks, logs = np.unpackbits(np.frombuffer(known.marks, np.uint8)), np.frombuffer(known.logs, np.uint8)
        size = len(logs).bit_length() - 1
    for batch in slices(batches, "text", SMALL):
        flat, counts = word_hashes([t.lower() for t in as_bytes(batch.column(batch.schema.get_field_index("text")))], table)
        hashes, n = window_hashes(flat, counts, words, short=True)
        if known:
            # log2 of the count expected of independent words, from 2**-48 to 2**36
            expected = window_sums(logs[_cell(flat, size)].astype(np.int32), counts, words) / 8 - (words - 1) * np.log2(known.total + 1)
            rank = np.clip((expected + 48) * 1.5, 0, (1 << RANK_BITS) - 1).astype(U)
            hashes = marks[_cell(hashes, size)].astype(U) << U(63) | rank << U(63 - RANK_BITS) | hashes >> U(1 + RANK_BITS)
        yield batch, flat, hashes, n


def _sketch(docs: DataFrame, words: int) -> Frequencies:
    """Counts of all words and shingles, each in cells of their own. Partial sketches are added up in a tree of groups of 256."""
    size = sketch_size(docs.count())
    n_chunks, per = 2 << (size - CHUNK_BITS), 1 << CHUNK_BITS

    def count(batches):
        total = np.zeros((2, 1 << size), np.int64)
        for _, flat, hashes, _ in shingle_sets(batches, words):
            for row, h in zip(total, (flat, hashes), strict=True):
                row += np.bincount(_cell(h, size), minlength=len(row))
        parts = total.reshape(n_chunks, per)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(n_chunks), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].astype("int32"), "salt": pdf["salt"].iloc[:1].astype("int32") // 256, "counts": [zlib.compress(total.tobytes(), 1)]})

    text = docs.select("text")
    left = text.rdd.getNumPartitions()
    part = text.mapInArrow(count, "chunk int, counts binary").select("chunk", (F.spark_partition_id() / 256).cast("int").alias("salt"), "counts")
    while left > 0:
        part = part.groupBy("chunk", "salt").applyInPandas(add, "chunk int, salt int, counts binary")
        left //= 256
    out = np.zeros((n_chunks, per), np.int64)
    for row in part.select("chunk", "counts").collect():  # at most as large as the sketches
        out[row.chunk] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    of_words, of_shingles = out.reshape(2, -1)
    return Frequencies(np.packbits(of_shingles > (mean := of_shingles.mean()) + 4 * np.sqrt(mean) + MARGIN).tobytes(), np.minimum(8 * np.log2(of_words + 1), 255).astype(np.uint8).tobytes(), int(of_words.sum()))


def prefix_signatures(tokens: np.ndarray, frequent: np.ndarray, threshold: int) -> np.ndarray:
    """Signatures of one set. tokens: sorted and distinct; frequent: mark of each."""
    n = len(tokens)
    overlap = -(-threshold * n // 100)
    need = n - overlap + min(SHARED, overlap)
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need]
    common, found = tokens[frequent], [rare]
    band = n.bit_length() - 1
    for b in (band, band + 1):
        if b > band and 100 * n < threshold << b:
            break
        if b < SINGLE_BANDS:
            found.append(mix(common[: need - len(rare)] + U(1)))
            continue
        classes = max(1, min((1 << b) * (100 - threshold) // 100, (1 << b) * threshold**2 // 10_000 - (1 << b) * (100 - threshold) // 100 - SHARED - 1))
        of = (mix(common + U(2)) % U(classes)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        first = np.zeros(len(of), bool)
        first[order[np.flatnonzero(np.diff(of[order], prepend=-1))]] = True
        length = int(np.searchsorted(np.cumsum(~first), need - len(rare))) + 1
        token, of = common[:length], of[:length]
        order = np.argsort(of, kind="stable")
        token, of = token[order], of[order]
        # pairs at distance 1, 2, ... within a class
        for step in range(1, length):
            same = of[step:] == of[:-step]
            if not same.any():
                break
            found.append(mix(mix(token[:-step][same] + U(b)) + token[step:][same]))
    return np.unique(np.concatenate(found))


def _signed(docs: DataFrame, words: int, threshold: int, known: Frequencies) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(known)  # 18 MB at most

    def sign(batches):
        for batch, _, tokens, n in shingle_sets(batches, words, shared.value):
            ends, sizes, prints, sigs = np.cumsum(n), [], [], []
            for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                own = np.unique(tokens[a:b])
                sizes.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sigs.append(prefix_signatures(own, own >> U(63) > 0, threshold) if len(own) else own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), list_array(np.concatenate(sigs).view(np.int64), np.array([len(x) for x in sigs]), pa.int64())], ["doc_id", "n_shingles", "print", "sigs"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, print binary, sigs array<long>")


def _likely(reps: DataFrame, size: int, bits: bytes) -> DataFrame:
    """reps (rep, n, sigs) with the signatures that may be in the set."""
    shared = reps.sparkSession.sparkContext.broadcast(bits)  # of 8 MB at most

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            hit = holds(shared.value, places(flat, size))
            n = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[hit], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(flat[hit], n, pa.int64())], ["rep", "n", "sigs"])

    return reps.mapInArrow(run, "rep long, n long, sigs array<long>")


def _arrays(docs: DataFrame, words: int) -> DataFrame:
    def arrays(batches):
        for batch, _, hashes, n in shingle_sets(batches, words):
            ends = np.cumsum(n)
            own = [np.unique(hashes[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]), pa.int64())], ["rep", "tokens"])

    return docs.select("rep", "text").mapInArrow(arrays, "rep long, tokens array<long>")


class Overlaps:
    """Numbers of elements that rows of one list of arrays have in common with rows of another."""

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray]) -> None:
        flat = [np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right)]
        common = np.intersect1d(*flat)
        self.rows, self.cols, self.starts = [], [], []
        for lists, own in ((left, flat[0]), (right, flat[1])):
            at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
            hit = common[at] == own if len(common) else np.zeros(len(own), bool)
            row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[hit]
            self.rows.append(row)
            self.cols.append(at[hit])
            self.starts.append(np.searchsorted(row, np.arange(len(lists) + 1)))
        self.width = len(common)
        words = self.width // 64 + 1
        self.bits = None
        if (len(left) + len(right)) * words * 8 <= BIT_ROWS:
            self.bits = [np.zeros((len(x), words), U) for x in (left, right)]
            for to, row, col in zip(self.bits, self.rows, self.cols, strict=True):
                np.bitwise_or.at(to, (row, col // 64), U(1) << (col % 64).astype(U))
        self.mark = np.zeros(self.width, bool)

    def __call__(self, i: int, some: np.ndarray) -> np.ndarray:
        """Of row i of the left with the given rows of the right."""
        if self.bits:
            return np.bitwise_count(self.bits[1][some] & self.bits[0][i]).sum(axis=1, dtype=np.int64)
        own = self.cols[0][self.starts[0][i] : self.starts[0][i + 1]]
        self.mark[own] = True
        total = np.append(0, np.cumsum(self.mark[self.cols[1]]))
        self.mark[own] = False
        return total[self.starts[1][some + 1]] - total[self.starts[1][some]]


def _forest(u: list[np.ndarray], v: list[np.ndarray]) -> pd.DataFrame:
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v))
    ids, node = np.unique(np.concatenate([a, b]), return_inverse=True)
    on, least = forest(node[: len(a)], node[len(a) :], len(ids))
    return pd.DataFrame({"u": ids[on], "v": ids[least]}, dtype="int64")


def _links(x: pd.DataFrame, y: pd.DataFrame, threshold: int, among: np.ndarray | None = None) -> pd.DataFrame:
    """Links of a forest between sets x and y, of ids that differ; among: components, if only links between two of them count."""
    a, b, na, nb = x["rep"].to_numpy(), y["rep"].to_numpy(), x["n"].to_numpy(), y["n"].to_numpy()
    shared, u, v = Overlaps(list(x["tokens"]), list(y["tokens"])), [], []
    for i in range(len(x)):
        open_ = (100 * np.minimum(na[i], nb) >= threshold * np.maximum(na[i], nb)) & (a[i] != b)
        j = np.flatnonzero(open_ if among is None else open_ & (x["comp"].iat[i] != among))
        if len(j):
            both = shared(i, j)
            j = j[100 * both >= threshold * (na[i] + nb[j] - both)]
            u.append(np.full(len(j), a[i]))
            v.append(b[j])
    return _forest(u, v)


def _home_links(threshold: int):
    """A task's links inside one chunk of a home."""
    return lambda pdf: _links(pdf, pdf, threshold)


def _needed(threshold: int):
    """The rows of a task (the minor sets of one chunk and all sets of another, of one signature's holders) that must be compared here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, side = pdf["key"].iloc[0], pdf["minor_side"].to_numpy()
        x, y = pdf[side], pdf[~side]
        a, b, na, nb = x["rep"].to_numpy(), y["rep"].to_numpy(), x["n"].to_numpy(), y["n"].to_numpy()
        ca, cb, ha, hb, other_minor = x["comp"].to_numpy(), y["comp"].to_numpy(), x["met"].to_numpy(), y["met"].to_numpy(), y["minor"].to_numpy()
        # pairs that share a signature of lower number are compared there
        lower = Overlaps(*([v[v < key] for v in part["crowded"]] for part in (x, y)))
        need = [np.zeros(len(x), bool), np.zeros(len(y), bool)]
        for i in range(len(x)):
            j = np.flatnonzero((ca[i] != cb) & (ha[i] != hb) & ~(other_minor & (b < a[i])) & (100 * np.minimum(na[i], nb) >= threshold * np.maximum(na[i], nb)))
            if lower.width and len(j):
                j = j[lower(i, j) == 0]
            need[0][i] = len(j) > 0
            need[1][j] = True
        return pd.concat([x[need[0]], y[need[1]]])[["key", "i", "j", "rep", "n", "comp", "minor_side"]]

    return run


def _left_links(threshold: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["minor_side"]], pdf[~pdf["minor_side"]]
        return _links(x, y, threshold, y["comp"].to_numpy())

    return links


def _candidates(docs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> members (doc_id, n_shingles, rep), pairs (u, v) of classes to verify, the sets that have a home
    (rep, n, crowded: their crowded signatures, home, met: a number of their chunk of it), and what goes to homes (met, rep, n).

    All are written, so that signatures and their shuffles can go before token arrays are made.
    """
    signed = keep(_signed(docs, words, threshold, _sketch(docs, words)))
    release_memory()
    with_set, without = signed.where("print is not null"), signed.where("print is null")  # these would all meet at one key of the join
    classes = materialise(with_set.groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")  # as a table, so that Spark can split a large class's part of the joins
    members = with_set.select("doc_id", "n_shingles", "print").join(classes, "print").select("doc_id", "n_shingles", "rep")
    members = materialise(members.unionAll(without.select("doc_id", "n_shingles", F.lit(None).cast("long"))), "members", small=True)
    reps = with_set.where("doc_id is not null").join(classes.withColumnRenamed("print", "p"), (F.col("print") == F.col("p")) & (F.col("doc_id") == F.col("rep")))
    reps = keep(reps.select("rep", F.col("n_shingles").alias("n"), "sigs"))
    sizes = materialise(reps.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("sets")).where("sets > 1"), "sizes")
    held = _likely(reps, *bit_set(sizes, "sig")).select("rep", "n", F.explode("sigs").alias("sig"))
    live = materialise(held.join(sizes, "sig"), "live")
    drop(sizes)
    for t in (reps, signed):
        t.unpersist()

    few = live.where(F.col("sets") <= CROWDED).select("sig", "rep", "n")
    a, b = few.select("sig", F.col("rep").alias("u"), F.col("n").alias("nu")), few.select("sig", F.col("rep").alias("v"), F.col("n").alias("nv"))
    met = a.join(b, (a["sig"] == b["sig"]) & (F.col("u") < F.col("v")) & (100 * F.least("nu", "nv") >= threshold * F.greatest("nu", "nv")))
    shared = F.least(F.lit(SHARED), F.ceil(F.min(F.least("nu", "nv")) * threshold / 100))
    pairs = materialise(met.groupBy("u", "v").agg(F.count("*").alias("shared"), shared.alias("least")).where("shared >= least").select("u", "v"), "pairs")

    many = live.where(F.col("sets") > FEW).select(F.col("sig").alias("key"), "rep", "n", "sets")
    crowded = F.collect_list(F.when(F.col("sets") > CROWDED, F.col("key"))).alias("crowded")  # at most a prefix long
    holders = many.groupBy("rep").agg(F.first("n").alias("n"), crowded, F.max(F.struct("sets", "key")).alias("home")).select("rep", "n", "crowded", F.col("home.key").alias("home"))
    sizes_of_homes = holders.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / HOME_SETS, F.sum("n") / CHUNK_TOKENS)).cast("int").alias("chunks"))
    sizes_of_homes = materialise(sizes_of_homes, "home_sizes")
    met_at = lambda chunk: F.xxhash64("home", chunk).alias("met")
    holders = materialise(holders.join(sizes_of_homes, "home").select("rep", "n", "crowded", "home", met_at(F.pmod(F.xxhash64("rep"), "chunks").cast("int"))), "holders")
    first = leaders(many.where(F.col("sets") > CROWDED).select("key", "rep", "n"), LEADERS).select(F.col("key").alias("home"), F.col("to.rep").alias("rep"), F.col("to.n").alias("n")).distinct()
    first = first.join(sizes_of_homes, "home").select("home", "rep", "n", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(met_at(F.col("chunk")), "rep", "n")
    homes = materialise(holders.select("met", "rep", "n").unionAll(first).distinct(), "homes")
    drop(live)
    return members, pairs, holders, homes


def ngram_jaccard_join(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, n_shingles, component_id, one row per row of docs; see the module's text."""
    if not 70 <= threshold <= 100:
        raise ValueError("the threshold must be 70 to 100")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members, pairs, holders, homes = _candidates(docs, words, threshold)
    release(docs.sparkSession)

    chosen = pairs.select(F.explode(F.array("u", "v")).alias("rep")).unionAll(holders.select("rep")).distinct()
    chosen = materialise(chosen, "chosen", small=True)  # read three times
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = keep(_arrays(passing(docs.withColumnRenamed("doc_id", "rep"), "rep", chosen).join(chosen, "rep"), words).repartition(parts, "rep"))  # dealt once for all joins on rep
    left, right = arrays.select(F.col("rep").alias("u"), F.col("tokens").alias("tu")), arrays.select(F.col("rep").alias("v"), F.col("tokens").alias("tv"))
    both = F.size(F.array_intersect("tu", "tv"))
    found = connected_components(homes.join(arrays, "rep").groupBy("met").applyInPandas(_home_links(threshold), "u long, v long"))
    of = lambda name: found.select(F.col("id").alias(f"id_{name}"), F.col("component").alias(f"in_{name}"))
    apart = pairs.join(of("u"), F.col("u") == F.col("id_u"), "left").join(of("v"), F.col("v") == F.col("id_v"), "left").where(F.coalesce("in_u", "u") != F.coalesce("in_v", "v")).select("u", "v")
    verified = apart.join(left, "u").join(right, "v").where(100 * both >= threshold * (F.size("tu") + F.size("tv") - both)).select("u", "v")
    found = connected_components(found.toDF("u", "v").unionAll(verified))

    held = holders.join(found, F.col("rep") == F.col("id"), "left").select(F.explode("crowded").alias("key"), "rep", "n", F.coalesce("component", "rep").alias("comp"), "met", "crowded")
    rest = unlinked(held, CHUNK_SETS, CHUNK_TOKENS)
    if not rest.isEmpty():
        needed = dealt(rest).groupBy("key", "i", "j").applyInPandas(_needed(threshold), "key long, i int, j int, rep long, n long, comp long, minor_side boolean")
        more = materialise(needed.join(arrays, "rep").groupBy("key", "i", "j").applyInPandas(_left_links(threshold), "u long, v long"), "more")
        if not more.isEmpty():
            found = connected_components(found.toDF("u", "v").unionAll(more))
    release(docs.sparkSession, arrays)
    drop(chosen)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")
    linked = members.where("rep is not null").join(found, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", component)
    return linked.unionAll(members.where("rep is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_representatives(docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, one for each component of their texts: the one of the least id (ids before null, ties by a hash of id and text).

    Rows are told apart by id and text, so rows that repeat an id with unlike texts
    all stay, and rows with a null id are compared like others. Of rows equal in id
    and text, the least by all columns stays. Wordless texts link with nothing.
    """
    key, n = "_key", "_n"
    while key in docs.columns or n in docs.columns:
        key, n = key + "_", n + "_"
    own = F.xxhash64(F.lit(0), F.col(id_col), F.lit(1), F.col(text_col))  # a null leaves the hash as it is; the numbers tell where it is
    rows = docs.select(own.alias("doc_id"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = ngram_jaccard_join(rows, words, threshold)
    ids = rows.groupBy("doc_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id", "n")).alias("first")
    kept = joined.select("doc_id", "component_id").distinct().join(ids, "doc_id").groupBy("component_id").agg(first).select(F.col("first.doc_id").alias(key), F.col("first.n").alias(n))
    kept = materialise(kept, "kept", small=True)
    keyed = docs.withColumn(key, own)
    single = keyed.join(kept.where(F.col(n) == 1), key, "left_semi").drop(key)
    repeated = keyed.join(kept.where(F.col(n) > 1), key, "left_semi").groupBy(key).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return single.unionByName(repeated.select("row.*"))
