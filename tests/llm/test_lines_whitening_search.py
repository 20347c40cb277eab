"""Line dedup, whitening and ranked search: odd rows, hot groups, and plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical_search, line_dedup, whitening

LONG = "Subscribe to our newsletter for weekly news about é and 日本"


def dedup(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **more)).collect()


def check_lines(spark, rows, **more):
    out = sorted((x.doc_id is None, x.doc_id or 0, x.n_lines, x.n_dropped, x.text or "") for x in dedup(spark, rows, **more))
    limits = {"least_chars": 40, "least_docs": 5, **more}
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, brute.kept_lines(rows, **limits), strict=True))
    assert out == want
    return want


def test_lines_that_many_documents_hold_stay_in_the_last_one(spark):
    r = random.Random(1)
    lines = [LONG, "\t" + LONG.upper().replace("É", "é") + " \x0b", LONG + "!", "é" * 39, "é" * 40, "short", "", " " * 60, "x" * 50, "X" * 50, "\x1c" + "x" * 50]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 30)))) for i in range(60)]
    rows += [(None, LONG), (None, LONG + "\nown"), (-3, LONG), (7, None), (8, ""), (9, "\n"), (10, "\n".join([LONG] * 5000)), (11, "z" * 300_000)]
    rows += [rows[5], rows[5], (5, LONG + "\nsame id, other text")]
    want = check_lines(spark, rows)
    assert sum(x[3] for x in want) > 4000
    check_lines(spark, rows, least_chars=1, least_docs=2)
    check_lines(spark, rows, least_chars=1, least_docs=1)


@pytest.mark.parametrize("docs", [4, 5, 3000])
def test_a_line_of_all_documents_spans_ranges(spark, docs):
    """At 3000 the hot line lies in all ranges; at 4 and 5 it lies on both sides of the least number."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"{LONG}\nline {i} of its own\n{LONG}") for i in range(docs)]
        want = check_lines(spark, rows)
        assert sum(x[3] for x in want) == (2 * (docs - 1) if docs >= 5 else 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_of_empty_tables_and_clashing_columns(spark):
    assert dedup(spark, []) == []
    names = ["h1", "h2", "tag", "line", "keep", "row", "id", "of", "n_lines", "lines"]
    docs = spark.createDataFrame([(i, LONG + f"\n{i}", *[f"{c}{i}" for c in names]) for i in range(6)], "key long, body string, " + ", ".join(f"{c} string" for c in names))
    bitmaps = line_dedup.keep_bitmaps(docs, id_col="key", text_col="body")
    out = line_dedup.apply_bitmaps(docs, bitmaps, id_col="key", text_col="body").orderBy("key").collect()
    assert [(x.key, x.body, x.n_lines, x.n_dropped) for x in out] == [(i, f"{i}" if i < 5 else LONG + "\n5", 2, int(i < 5)) for i in range(6)]
    assert [x.row for x in out] == [f"row{i}" for i in range(6)] and set(out[0].asDict()) == {"key", "body", *names, "n_dropped"}
    assert all(len(x.keep) < 20 for x in bitmaps.collect())


def plain_whitening(vectors):
    """Whole numbers, mean and eigenvectors of the covariance by a dense solver."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100000
    y = x - x.sum(axis=0) / len(x)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    return x, y, e[::-1], u[:, ::-1]


def whiten(spark, rows, **more):
    return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **more).orderBy("vec_id", "component").collect()


def check_whitening(out, ids, vectors, k):
    x, y, e, u = plain_whitening(vectors)
    n, s = len(x), x.sum(axis=0)
    z = np.array([r.whitened for r in out]).reshape(n, k)
    want = y @ u[:, :k] / np.sqrt(e[:k])
    assert [(r.vec_id, r.component) for r in out] == [(i, c + 1) for i in ids for c in range(k)]
    assert np.allclose(z * np.sign((z * want).sum(axis=0)), want, atol=1e-7)
    assert [int(r.deviation) for r in out[::k]] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert np.allclose([r.explained for r in out[:k]], e[:k] / e.sum(), rtol=1e-10)
    assert {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    assert np.abs(np.cov(z.T, bias=True).reshape(k, k) - np.eye(k)).max() == pytest.approx(out[0].identity_error, abs=1e-12)


@pytest.mark.parametrize(("n", "d", "k"), [(400, 40, 8), (60, 5, 8), (300, 96, 3), (30, 96, 8)])
def test_whitening_equals_a_dense_solver(spark, n, d, k):
    r = np.random.default_rng(d)
    vectors = (r.normal(size=(n, d)) * np.linspace(0.05, 1, d) + r.normal(size=d)).astype(np.float32).tolist()
    out = whiten(spark, list(enumerate(vectors)), k=k)
    check_whitening(out, range(n), vectors, min(k, d))


def test_whitening_drops_what_is_not_a_vector(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(50, 12)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None] * 6, [float("nan")] * 12, [float("inf")] * 12, [1.0] * 11, [1.0] * 13]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100 + i, v) for i, v in enumerate(odd)]
    check_whitening(whiten(spark, rows), range(50), vectors, 8)
    again = whiten(spark, [*rows, (3, vectors[3]), (None, vectors[4])])  # repeated rows and null ids count
    assert len(again) == 52 * 8 and again[0].n == 52 and again[0].vec_id is None


def test_whitening_of_little(spark):
    assert whiten(spark, []) == whiten(spark, [(1, None)]) == whiten(spark, [(1, [1.0, 2.0])]) == whiten(spark, [(i, [1.0, 2.0]) for i in range(9)]) == []
    out = whiten(spark, [(0, [0.0, 0.0, 1.0]), (1, [1.0, 1.0, 1.0])])  # of rank one
    assert [(x.component, round(abs(x.whitened), 9), x.explained) for x in out] == [(1, 1.0, pytest.approx(1.0))] * 2
    with pytest.raises(Exception, match="can't be whitened"):
        whiten(spark, [(0, [1e30])])


def test_deviations_beyond_a_long_are_exact():
    z = np.array([[2**61, -(2**61) + 1, 3], [0, 1, -(2**40)]])
    assert whitening._square_sums(z) == [sum(int(v) ** 2 for v in row) for row in z]


def test_lobpcg_certifies_residuals():
    d, r = 300, np.random.default_rng(0)
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    e = 1 / np.arange(1.0, d + 1)
    v = q * e @ q.T
    values, u, residuals, products = whitening.lobpcg(lambda w: v @ w, d, 6)
    assert np.allclose(values, e[:6], rtol=1e-12) and np.allclose(np.abs((u * q[:, :6]).sum(axis=0)), 1) and products < 30
    assert np.allclose(residuals, np.linalg.norm(v @ u - u * values, axis=0), atol=1e-14) and residuals.max() < 1e-11
    noisy = np.random.default_rng(1)
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda w: v @ w + noisy.normal(size=w.shape) * 1e-3, d, 6)


def search(spark, docs, items, k):
    out = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string, score long, item_id long"), spark.createDataFrame(items, "item_id long, text string, row long"), k).orderBy("item_id", "rank").collect()
    found = {}
    for x in out:
        found.setdefault(x.item_id, []).append((x.score, x.doc_id))
        assert x["rank"] == len(found[x.item_id])
    return found


def check_search(spark, docs, items, k):
    found = search(spark, [(i, t, 1, 2) for i, t in docs], [(i, t, 3) for i, t in items], k)
    want = {i: x for i, x in brute.ranked(docs, items, k).items() if x}
    assert found == want
    return found


def corpus(n):
    r = random.Random(n)
    words = [f"w{j}" for j in range(200)]
    rows = [(i, " ".join(["the", *r.choices(words, [1 / (j + 1) for j in range(200)], k=r.randint(1, 40))])) for i in range(n)]
    rows[3] = (3, "The THE the-the é日本 Straße1 straße1 x")
    items = [(j, " ".join(["the", *r.choices(words, k=12)])) for j in range(15)]
    return rows, items


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search_equals_scores_of_all_documents(spark, k):
    docs, items = corpus(700)
    assert len(check_search(spark, docs, items, k)) == 15


def test_search_of_odd_rows(spark):
    docs, items = corpus(40)
    docs += [(None, docs[0][1]), (None, docs[0][1]), (0, docs[0][1]), (7, "w1 w2 w3"), (50, None), (51, ""), (52, "-- ."), (53, "w1 " * 40_000)]
    items += [(0, "w1 w2"), (20, None), (21, "..."), (22, "no such words"), (None, "w1 w150"), (23, "the"), (24, "É日本"), (25, "é日本 straße1")]
    found = check_search(spark, docs, items, 6)
    assert {20, 21, 22}.isdisjoint(found) and None in found and found[25][0][1] == 3
    assert check_search(spark, [], items, 6) == check_search(spark, docs, [], 6) == check_search(spark, [(1, None)], items, 6) == {}


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "PAIRS", 64)
    docs, items = corpus(150)
    assert len(check_search(spark, docs, items, 4)) == 15


def test_search_reads_lists_to_a_threshold(spark):
    """A list that all documents share isn't read beyond what can matter, and ties at the border are kept."""
    docs = [(i, f"common word{i % 50} and more") for i in range(2000)] + [(5000, "rare common"), (5001, "rare and common")]
    found = check_search(spark, docs, [(1, "rare common"), (2, "common"), (3, "word7 common")], 10)
    assert [d for _, d in found[1]][:2] == [5000, 5001] and len(found[3]) == 10


def test_heads_of_runs():
    import pyarrow as pa

    term, s = [1, 1, 1, 1, 2, 2, 1, 1, 1], [9, 8, 8, 7, 5, 4, 9, 9, 3]
    whole = pa.record_batch([pa.array(term, pa.int32()), pa.array(range(9)), pa.array(s)], ["term", "row", "s"])
    for cut in range(9):  # whatever the batches
        out = [x for b in lexical_search._heads(2)(iter([whole.slice(0, cut), whole.slice(cut)])) for x in b.column(1).to_pylist()]
        assert out == [0, 1, 4, 5, 6, 7]


def test_new_queries_explain_without_cross_joins(spark):
    docs = spark.createDataFrame([(i, LONG) for i in range(9)], "doc_id long, text string")
    plan = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert docs.select(F.xxhash64("text")).distinct().count() == 1
