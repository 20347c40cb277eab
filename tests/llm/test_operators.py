"""Each operator against plain Python or the library it follows, and on nulls, empty and long texts, repeats, empty tables and extra columns."""

import collections
import gzip
import io
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_queries import check_pieces

from tessera.llm import chat, components, embedding_dedup, lattice, licenses, ngram_join, packing, quality, sentencepiece_codec, token_counts, toxicity, warc

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "the", "  ", " ", "\n", "\t", "é", "日本", "👍", "▁", "12", "<s>", "</s>", "<|endoftext|>", "ing", "aaaa", "​", "ction", "==", "'s", "\r\n"]
ODD = [None, "", " ", "\n", "one", "one two", "x" * 30_000, "word " * 4000, "same text here now", "same text here now"]
SCHEMA = "doc_id long, text string, rep long, length int, u string"  # with names that operators use inside


def texts(n=150):
    r = random.Random(5)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(rows)] + [(None, "no id", 1, 2, "x"), (3, rows[3] if rows else "x", 1, 2, "x")] * bool(rows), SCHEMA)


def test_encode_decode_and_counts_equal_the_library(spark):
    rows = [*ODD, *texts()]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame(spark, rows)
    ids = {r.doc_id: r for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs, PIECES).collect()}
    for i, t in enumerate(rows):
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(ids[i].ids, "<u4").tolist() == want
        assert ids[i].text == sp.decode(want)
        assert (counts[i].n_tokens, counts[i].n_bytes) == (len(want) - 2, len((t or "").encode()))


def test_token_counts_do_not_depend_on_chunks_blocks_or_the_store(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(9)
    rows = [*(t or "" for t in ODD), *texts(60), "".join(r.choice("abcdefgh") for _ in range(3000)), "日本語" * 700, "ab" * 900]
    want = [len(x) for x in sp.encode(rows)]
    machine = token_counts.Transducer(token_counts.piece_model(PIECES))
    for chunk, block, most in ((64, 1 << 20, 1 << 20), (33, 1000, 500), (64, 97, 1 << 20)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "BLOCK", block)
        monkeypatch.setattr(token_counts, "MOST_MOVES", most)
        assert machine.counts(rows).tolist() == want
        if most == 500:
            assert machine.moves.size <= most + block


def test_token_maps_compose_in_rounds_of_doubling():
    r = np.random.default_rng(2)
    n, states = 37, 5
    to, count = r.integers(0, states, (n, states)), r.integers(0, 9, (n, states))
    node = (np.arange(n)[:, None] << 32 | np.arange(states)).ravel()
    is_last = np.zeros(n, bool)
    is_last[[11, n - 1]] = True
    total, final = token_counts.Transducer._compose(node, to.ravel(), count.ravel(), is_last)
    for k, s in ((0, 2), (12, 4), (20, 0), (11, 1)):
        at, state, sum_ = k, s, 0
        while True:
            sum_, last, state = sum_ + count[at, state], (at, state), to[at, state]
            if is_last[at]:
                break
            at += 1
        assert total[k * states + s] == sum_ and final[k * states + s] == last[0] * states + last[1]


def test_packing(spark):
    rows = [*ODD, *texts(), *(" ".join(["word"] * k) for k in range(1, 300, 7))]
    docs = frame(spark, rows).where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack_documents(docs, BYTES).collect(), dict(enumerate(rows)))
    twice = packing.pack_documents(docs.unionAll(docs.where("doc_id = 4")), BYTES)
    assert twice.count() == packing.pack_documents(docs, BYTES).count() + 1


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_ngram_join_equals_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 4)  # so that small groups take the ways of homes and crowded signatures too
    monkeypatch.setattr(ngram_join, "CROWDED", 8)
    monkeypatch.setattr(ngram_join, "HOME_SETS", 4)
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    r = random.Random(1)
    common = [f"w{k}" for k in range(30)]
    rows = list(ODD)
    for _ in range(12):
        base = [r.choice(common) if r.random() < 0.5 else f"u{r.random()}" for _ in range(r.choice([8, 30, 80, 200]))]
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                own[r.randrange(len(own))] = f"e{r.random()}"
            rows.append(" ".join(own))
    sets, of = brute.classes(rows, words, percent)
    out = {x.doc_id: x for x in ngram_join.ngram_jaccard_join(frame(spark, rows), words, percent).collect()}
    assert [out[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets]
    assert [out[i].component_id for i in range(len(rows))] == of
    assert out[None].component_id is None


def test_overlaps_by_bits_and_by_tokens(monkeypatch):
    r = np.random.default_rng(4)
    lists = [[np.unique(r.integers(-50, 50, r.integers(0, 60))) for _ in range(9)] for _ in range(2)]
    for most in (32 << 20, 0):
        monkeypatch.setattr(ngram_join, "BIT_ROWS", most)
        both = ngram_join.Overlaps(*lists)
        assert (both.bits is None) == (most == 0)
        for i in range(9):
            assert both(i, np.arange(9)).tolist() == [len(np.intersect1d(lists[0][i], y)) for y in lists[1]]


def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(None, None), (0, None), (1, []), (2, [0.0] * 16), (3, [1.0, None]), (4, [float("nan")] * 16)]
    base = r.normal(size=(12, 16))
    vectors = [b + r.normal(size=16) * 0.08 for b in base for _ in range(r.integers(1, 60))]
    vectors += [vectors[0], vectors[0] * 3.0]
    rows += [(10 + k, v.tolist()) for k, v in enumerate(vectors)]
    out = {x.vec_id: x for x in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = x @ x.T >= 0.95
    found = sum(out[10 + k].n_links for k in range(len(x)))
    assert found >= 0.98 * (near.sum() - len(x))
    assert all(out[10 + k].n_links <= near[k].sum() - 1 for k in range(len(x)))
    assert all(out[k].n_links == 0 and out[k].kept for k in range(5))
    assert out[None].component_id is None and not out[None].kept


@pytest.mark.parametrize("crowded", [0, 1024])
def test_embedding_groups_larger_than_a_chunk(spark, monkeypatch, crowded):
    monkeypatch.setattr(embedding_dedup, "CROWDED", crowded)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    r = np.random.default_rng(8)
    base = r.normal(size=(3, 12))
    vectors = np.concatenate([base[k] + r.normal(size=(n, 12)) * 0.16 for k, n in enumerate((90, 40, 5))])
    rows = [(k, v.tolist(), 1, 2, b"x") for k, v in enumerate(vectors)]
    out = {x.vec_id: x for x in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int, copies int, unit binary")).collect()}
    x = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    of = brute.components(len(x), lambda i, j: near[i, j])
    assert 2 < len(set(of)) < len(x) - 20
    assert [(out[i].component_id, out[i].kept) for i in range(len(x))] == [(c, c == i) for i, c in enumerate(of)]
    # links inside a component are all counted, however it was found
    assert [out[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()


def test_embedding_plans_keep_their_recall():
    r = np.random.default_rng(1)
    assert [embedding_dedup.plan(n)[0] for n in (0, 10**5, 10**7, 10**9, 10**11)] == sorted((embedding_dedup.plan(n)[0] for n in (0, 10**5, 10**7, 10**9, 10**11)), reverse=True)
    with pytest.raises(ValueError, match="0.95"):
        embedding_dedup.embedding_dedup(None, threshold=0.9)


@pytest.mark.parametrize(("d", "n"), [(32, 1500), (64, 1000), (384, 400)])
def test_embedding_plans_find_pairs_at_the_threshold(d, n):
    r = np.random.default_rng(d)
    x, e = (r.normal(size=(n, d)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e -= (e * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * e / np.linalg.norm(e, axis=1)[:, None]
    for width, tables, _ in embedding_dedup.PLANS:
        left = np.arange(n)
        for _ in range(tables):  # only those not met yet are looked at
            p = r.normal(size=(d, 16)) / width
            a, b = (np.rint(2 * lattice.cells(v[left] @ p, embedding_dedup.PROBES)) for v in (x, y))
            left = left[~((a[:, :1] == b).all(axis=2).any(axis=1) | (b[:, :1] == a).all(axis=2).any(axis=1))]
            if not len(left):
                break
        assert len(left) < 0.01 * n


def test_lattice_points_are_nearest():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 8)) * 2
    own = lattice.decode(x)
    assert len(lattice.ROOTS) == 240 and ((own * 2) % 1 == 0).all() and (own.sum(axis=1) % 2 == 0).all()
    d = ((x - own) ** 2).sum(axis=1)
    assert (d[:, None] <= ((x[:, None] - own[:, None] - lattice.ROOTS) ** 2).sum(axis=2) + 1e-9).all()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.id: r.component for r in components.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_chat_reads_back(spark):
    marks = ["<|im_end|>\n", "<|im_sep|>", "␛", "␛1", "<␛1|im_sep|>", "</s>[INST] ok [/INST]", "", "\n", "<", "<|im_start|>user\n", "é👍"]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "a\nb", "<|im_end|>"]), r.choice([None, *marks]) if r.random() < 0.5 else "".join(r.choices(marks, k=4))) for c in range(30) for t in range(r.randint(1, 8))]
    out = {x.conv_id: x for x in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(30):
        own = [(role, text or "") for k, _, role, text in rows if k == c]
        assert [tuple(x) for x in out[c].turns] == own
        assert "".join(out[c].loss_texts) == "".join(t for role, t in own if role == "assistant")


def test_long_conversations_and_odd_rows(spark):
    r = random.Random(7)
    long = [(1, t, r.choice(["user", "assistant", "assistant"]), r.choice(["", "é", "word " * 40, "␛"])) for t in range(1500)] + [(2, t, "assistant", f"t{t}") for t in range(400)]
    odd = [(None, 0, "assistant", "x"), (3, 0, None, "a"), (3, 0, None, "a"), (3, None, "user", None), (4, 1, "user", "b"), (4, 1, "assistant", "b")]
    rows = [(*x, "clash", 1, ["c"]) for x in long + odd]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, rows int, parts array<string>")
    out = {x.conv_id: x for x in chat.read_chats(chat.format_chats(turns)).collect()}
    assert set(out) == {None, 1, 2, 3, 4}
    for c, own in ((1, long[:1500]), (2, long[1500:])):
        assert [tuple(x) for x in out[c].turns] == [x[2:] for x in own]
        assert out[c].loss_texts == [t for _, _, role, t in own if role == "assistant"]
        assert [out[c].formatted[s.start : s.start + s.length].replace("␛0", "␛") for s in out[c].loss_spans] == out[c].loss_texts
    assert out[2].n_messages == 1 and out[None].loss_texts == ["x"]
    assert [tuple(x) for x in out[3].turns] == [("user", ""), ("", "a"), ("", "a")]
    assert [tuple(x) for x in out[4].turns] == [("assistant", "b"), ("user", "b")]


def test_quality_counts_and_viterbi(spark):
    rows = [*ODD, *texts(80), "a b c d e f g h\nx\na b c d e f g h\nx\n"]
    out = {x.doc_id: x for x in quality.score_documents(frame(spark, rows).select("doc_id", "text"), quality.DEFAULT).collect()}
    for i, t in enumerate(rows):
        x, counts = out[i], brute.quality_counts(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == counts
        assert x.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
    r = np.random.default_rng(1)
    field = quality.Field((1.0,), 0.1, ((0.5, -0.2), (-0.7, 0.9)))
    x = r.normal(size=(7, 1))
    got = quality.viterbi(field, x, np.zeros(7, int))
    value = lambda y: sum(y[k] * field.scores(x)[k] for k in range(7)) + sum(field.transitions[y[k - 1]][y[k]] for k in range(1, 7))
    assert value(got) == pytest.approx(max(value([m >> k & 1 for k in range(7)]) for m in range(128)))


def test_fitted_field_has_the_least_loss():
    r = np.random.default_rng(6)
    x, chain = r.normal(size=(14, 3)), np.repeat([0, 1, 2], [5, 2, 7])
    labels = r.integers(0, 2, 14)
    field = quality.fit_field(x, labels, chain)

    def loss(f):
        own = [brute.chain_loss(f, x[chain == k], labels[chain == k], 0.0) for k in range(3)]
        w = np.concatenate([f.weights, [f.intercept], np.ravel(f.transitions)])
        return sum(own) + w @ w / 2

    flat = np.concatenate([field.weights, [field.intercept], np.ravel(field.transitions)])
    made = lambda v: quality.Field(tuple(v[:3]), float(v[3]), tuple(map(tuple, v[4:].reshape(2, 2))))
    for k in range(len(flat)):
        step = np.eye(len(flat))[k] * 1e-4
        assert abs(loss(made(flat + step)) - loss(made(flat - step))) / 2e-4 < 2e-3


def test_quality_learns_from_long_documents_within_its_budget(spark, monkeypatch):
    good, bad = "The river runs under the old stone bridge tonight.\n" * 400, "*** 12 ###\n" * 400
    docs = spark.createDataFrame([(1, good), (2, bad), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (9, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) != quality.DEFAULT
    monkeypatch.setattr(quality, "FIT_LINES", 1)
    assert quality.fit(docs, labels) == quality.DEFAULT  # one document fills the budget


def test_toxicity_finds_held_out_words(spark):
    r = random.Random(4)
    clean = lambda: " ".join(r.choice(["river", "stone", "light", "paper", "green", "table"]) for _ in range(30))
    rows = [clean() + (" vile grobian" if i % 3 == 0 else "") for i in range(300)]
    docs = frame(spark, [*rows, None, ""])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = [x for x in toxicity.toxicity(docs, labels).collect() if x.held_out and x.doc_id < 300]
    assert np.mean([x.predicted == int(x.doc_id % 3 == 0) for x in out]) > 0.98
    assert {x.predicted for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    elsewhere = labels.withColumn("doc_id", F.col("doc_id") + 10_000)
    assert {round(x.score, 1) for x in toxicity.toxicity(docs, elsewhere).collect()} == {0.3}


def test_toxicity_scores_are_plain_sums(spark):
    r = random.Random(4)
    rows = ["".join(r.choice("abcdefgh ") for _ in range(80)) + (" MEAN" if i % 3 == 0 else "") for i in range(90)]
    docs = frame(spark, [*rows, None, "", " \n", "ab", "mean " * 30_000])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    for x in toxicity.score(docs.select("doc_id", "text"), model).join(docs.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).collect():
        if x.doc_id != 3:  # twice there
            assert x.score == pytest.approx(brute.toxicity_score(x.text, model), abs=1e-9)
    only = labels.where("toxic = 1")
    assert {round(x.score, 6) for x in toxicity.toxicity(docs, only).collect()} == {1.0}


def test_toxicity_learns_nothing_from_held_out_labels(spark, monkeypatch):
    """Neither the model nor the number of n-grams changes with them; the number has the least loss over folds."""
    monkeypatch.setattr(toxicity, "FEATURES", (20, 200))
    tried, whole = [], toxicity.losses
    monkeypatch.setattr(toxicity, "losses", lambda *a: tried.append(whole(*a)) or tried[-1])
    r = random.Random(9)
    rows = [" ".join(r.choice(["kind", "mild", "calm", "good"] + (["mean", "vile"] if i % 3 == 0 else [])) + str(r.randint(0, 9)) for _ in range(6)) for i in range(240)]
    docs = frame(spark, rows)
    models = []
    for flip in (0, 1):
        labels = [(i, int(i % 3 == 0) ^ (flip & brute.held_out(i))) for i in range(240)]
        own = spark.createDataFrame(labels, "doc_id long, toxic int").where(~toxicity.held_out(F.col("doc_id")))
        models.append(toxicity.fit(docs.select("doc_id", "text"), own))
    assert (models[0].features == models[1].features).all() and (models[0].weights == models[1].weights).all() and models[0].intercept == models[1].intercept
    assert tried[0] == tried[1] and set(tried[0]) == {20, 200}
    assert len(models[0].features) == min(tried[0], key=tried[0].get)


def test_toxicity_of_samples_too_small_for_folds(spark):
    docs = frame(spark, ["mean words here", "kind words here", "", None])
    model = toxicity.fit(docs.select("doc_id", "text"), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert len(model.features) <= min(toxicity.FEATURES) and np.isfinite(model.intercept)


def test_toxicity_keeps_the_features_of_most_evidence(spark):
    r = random.Random(6)
    rows = [("mean" if i % 4 == 0 else "kind") + " " + "".join(r.choice("abcdef ") for _ in range(60)) for i in range(200)]
    sample = spark.createDataFrame([(i, t, int(i % 4 == 0), i % toxicity.FOLDS) for i, t in enumerate(rows)], "doc_id long, text string, toxic int, fold int")
    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in enumerate(rows):
        for h in {int(x) for own, _ in toxicity.ngrams([t.encode()]) for x in own}:
            counts[h][i % 4 == 0] += 1
    evidence = {}
    for h, (clean, toxic) in counts.items():
        if clean + toxic >= toxicity.LEAST_DOCS:
            evidence[h] = abs(np.log((toxic + 0.5) / 51) - np.log((clean + 0.5) / 151)) * abs(toxic / 50 - clean / 150)
    want = sorted(evidence, key=lambda h: (-round(evidence[h], 9), h))[:100]
    assert set(toxicity._best(toxicity._counted(sample), 150, 50, 100)["h"]) == set(want)


def test_warc_derivatives_are_linked(spark):
    page = "<html><head><title>T &amp; t</title><script>no()</script></head><body><p>One</p><a href='/x?a=1&amp;b'>two</a><!-- c --></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/", page, "k"), (2, None, None, "k"), (3, "u", "", "k"), (4, "v", "<p>word</p>" * 100_000, "k")], "page_id long, url string, html string, kind string")
    made = warc.responses(pages).cache()
    source = {r.page_id: warc.parse_record(bytes(r.warc))[0] for r in made.collect()}
    out = {(r.page_id, r.kind): r for r in warc.derivatives(made.unionAll(spark.createDataFrame([(9, None)], made.schema))).collect()}
    assert len(out) == 9 and out[9, None].error
    for k in (1, 2, 3, 4):
        for kind in ("metadata", "conversion"):
            r = out[k, kind]
            assert r.refers_to == warc.field(source[k], "WARC-Record-ID") and r.source_payload_digest == warc.field(source[k], "WARC-Payload-Digest") and r.block_digest == warc.digest(bytes(r.content))
    assert bytes(out[1, "conversion"].content).decode() == "T & t\nOne\ntwo"
    assert bytes(out[4, "conversion"].content) == b"\n".join([b"word"] * 100_000)
    assert b'"/x?a=1&b"' in bytes(out[1, "metadata"].content)


def response(fields, payload, more=()):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + payload
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), *more], block)


def test_warc_encodings_and_headers():
    page = b"<title>T</title><p>Hi and</p>"
    chunked = b"7\r\n" + page[:7] + b"\r\n%X;a=b\r\n" % (len(page) - 7) + page[7:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    plain = [([], page), ([("Transfer-Encoding", "chunked")], chunked), ([("Content-Encoding", "gzip")], gzip.compress(page)), ([("Content-Encoding", "deflate")], zlib.compress(page)), ([("Content-Encoding", "deflate")], raw)]
    packed = gzip.compress(page)
    plain.append(([("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")], b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"))
    for fields, payload in plain:
        metadata, conversion, wrong = warc.derive(response(fields, payload))
        assert warc.parse_record(conversion)[1] == b"T\nHi and" and wrong is None
        assert warc.field(warc.parse_record(metadata)[0], "WARC-Source-Payload-Digest") == warc.digest(payload)
    for fields, payload in (([("Content-Type", "image/png")], b"\x89PNG"), ([("Content-Encoding", "br")], page), ([("Content-Encoding", "gzip")], page), ([("Content-Encoding", "gzip")], packed[:-9]), ([("Transfer-Encoding", "chunked")], page)):
        metadata, conversion, wrong = warc.derive(response(fields, payload))
        assert metadata and conversion is None and wrong
    assert warc.parse_record(warc.derive(response([("Content-Type", "text/plain")], b"a <b> &amp;\r\nc"))[1])[1] == b"a <b> &amp;\nc"
    metadata = warc.derive(response([("Set-Cookie", "a"), ("Set-Cookie", "b")], page, [("WARC-Concurrent-To", "<1>"), ("WARC-Concurrent-To", "<2>")]))[0]
    for pair in (b'["Set-Cookie", "a"], ["Set-Cookie", "b"]', b'["WARC-Concurrent-To", "<1>"], ["WARC-Concurrent-To", "<2>"]'):
        assert pair in metadata


def test_warc_files(spark, tmp_path):
    records = [response([], b"<p>%d</p>" % k * k) for k in (1, 3000, 2)]
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        assert list(warc.read_records(io.BytesIO(data))) == records
    assert list(warc.read_records(io.BytesIO(b""))) == [] and list(warc.read_records(io.BytesIO(records[0] + b"WARC/1.0\r\nx: y\r\n\r\nz")))[1].endswith(b"z")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "in" / "b.warc").write_bytes(records[1])
    read = warc.read_warc(spark, str(tmp_path / "in"))
    assert sorted((r.path.rpartition("/")[2], r.record_no, bytes(r.warc)) for r in read.collect()) == sorted([("a.warc.gz", k, x) for k, x in enumerate(records)] + [("b.warc", 0, records[1])])
    made = warc.derivatives(read, id_col="record_no")
    warc.write_warc(made, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out" / "*.gz"))
    assert sorted(bytes(r.warc) for r in back.collect()) == sorted(bytes(r.warc) for r in made.collect()) and back.count() == 8


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    files = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "x = 1"), (3, "a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "a/b/d.py", "# Licensed under CC BY-NC 4.0.\ncode"), (5, "z/e.py", None), (6, None, "text"), (7, "a/b/COPYING", "nothing here")]
    out = {r.file_id: r for r in licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [out[k].license for k in range(1, 8)] == ["MIT", "Apache-2.0", "Apache-2.0", "CC-BY-NC-4.0", "MIT", None, "Apache-2.0"]
    assert out[2].inherited_from == "a/LICENSE.txt" and out[4].inherited_from is None


def test_tags_of_other_licenses_stop_inheritance(spark):
    files = [(1, "d/LICENSE", "Released under the MIT License."), (2, "d/a.c", "// SPDX-License-Identifier: BSL-1.0\nint x;"), (3, "d/b.c", "int y;"), (4, "e/LICENSE", "SPDX-License-Identifier: LGPL-2.1-only"), (5, "e/x.c", "")]
    out = {r.file_id: (r.license, r.inherited_from) for r in licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert out == {1: ("MIT", None), 2: ("BSL-1.0", None), 3: ("MIT", "d/LICENSE"), 4: ("LGPL-2.1", None), 5: ("LGPL-2.1", "e/LICENSE")}


def test_open_files_get_their_words_counts(spark):
    """Copies of an open text share them; results equal a scan with the counts of all words."""
    r = random.Random(2)
    filler = ["was", "from", "zebra", "about", "over"]
    files = [(i, "x", " ".join(r.choice(filler) for _ in range(r.randint(0, 5)))) for i in range(150)]
    near = "Licensed {} under the {} Apache License, {} Version 2.0"
    files += [(200 + i, "LICENSE" if i % 3 == 0 else "y", near.format(*(r.choice(["", *filler]) for _ in range(3)))) for i in range(60)] + [(300 + i, "z", near.format("zebra", "was", "over")) for i in range(50)]
    out = {x.file_id: x for x in licenses.scan_files(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    df = collections.Counter(w for _, _, t in files for w in set(licenses.words(t.encode())))
    matcher = licenses.Matcher(licenses.TEMPLATES, df, len(files), licenses.THRESHOLD)
    assert len(out) == len(files)
    for i, path, t in files:
        want = matcher.scan_all(t.encode(), path == "LICENSE")
        assert (out[i].own_license, out[i].licenses) == ((want[0][0], [x[0] for x in want]) if want else (None, None))
        assert not want or out[i].score == pytest.approx(want[0][1], abs=1e-12)
    assert 10 < sum(x.own_license is not None for x in out.values()) < 120


def test_license_words_weigh_by_their_frequency_in_all_files(spark):
    files = [(0, "a", "Licensed was under the Apache from License, Version 2.0")] + [(i, "b", f"it was from {i}") for i in range(1, 400)]
    files += [(400, "c", "Licensed under the Apache License, Version 2.0 zebra quagga")]
    out = {r.file_id: r for r in licenses.scan_files(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    df = collections.Counter(w for _, _, t in files for w in set(licenses.words(t.encode())))
    idf = {w: np.log((len(files) + 1) / (n + 1)) + 1 for w, n in df.items()}
    template = {w: idf[w] ** 2 for w in licenses.words(b"Licensed under the Apache License, Version 2.0.")}
    cosine = (sum(template.values()) / (sum(template.values()) + idf[b"was"] ** 2 + idf[b"from"] ** 2)) ** 0.5
    assert out[0].own_license == "Apache-2.0" and abs(out[0].score - cosine) < 1e-9


def test_license_statements_inside_longer_lines():
    matcher = licenses.Matcher(licenses.TEMPLATES, {}, 1000, licenses.THRESHOLD)
    cases = {
        "Copyright 2021 Jane Doe. Released under the MIT License.": ("MIT", 0),
        "Copyright (c) Acme. Licensed under the Apache License, Version 2.0.": ("Apache-2.0", 0),
        "x\nAll of the text in this page is released under the MIT License.": ("MIT", 1),
        "var a=1;" * 500 + "/* Released under the ISC License. */" + "b=2;" * 500: ("ISC", 0),
    }
    for text, (name, line) in cases.items():
        assert matcher.scan(text.encode(), False) == (name, pytest.approx(1.0), line)
    assert matcher.scan(b"he ran under the old bridge and released a bird", False) is None


def test_files_under_several_licenses():
    matcher = licenses.Matcher(licenses.TEMPLATES, {}, 1000, licenses.THRESHOLD)
    names = lambda t, whole=False: [x[0] for x in matcher.scan_all(t.encode(), whole)]
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    assert names(f"{apache}\nsome words between them here\n{mit}") == ["Apache-2.0", "MIT"]
    assert names("// SPDX-License-Identifier: MIT OR Apache-2.0") == ["Apache-2.0", "MIT"]
    full = licenses.texts()
    assert set(names(full["MIT"] + "\n\n" + full["BSD-3-Clause"])) == {"MIT", "BSD-3-Clause"}
    assert names(full["GPL-3.0"]) == ["GPL-3.0"] or names(full["GPL-3.0"])[0] == "GPL-3.0"
    assert names("word " * 50_000 + mit) == ["MIT"] and names("") == []


def test_license_ties_repeats_and_clashing_columns(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License.", "x", 1), (2, "a/COPYING", "Released under the ISC License.", "x", 1), (3, "a/x", "no", "x", 1), (3, "a/x", None, "x", 1), (4, "a/x", "", "x", 1), (None, "b", "Released under the MIT License. " * 3000, "x", 1)]
    out = licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string, owner string, score int")).collect()
    assert len(out) == 6
    assert all((r.license, r.inherited_from) == ("ISC", "a/COPYING") for r in out if r.path == "a/x")  # equal cosines: the first path
    assert next(r for r in out if r.path == "b").licenses == ["MIT"]


def test_license_windows_equal_plain_counts():
    r = random.Random(3)
    some = sorted({w for t in licenses.TEMPLATES["MIT"] + licenses.TEMPLATES["ISC"] for w in licenses.words(t.encode())})
    frequency = {w: r.randint(1, 900) for w in [*some, b"aa", b"bb"]}
    matcher = licenses.Matcher({k: licenses.TEMPLATES[k] for k in ("MIT", "ISC")}, frequency, 1000, 0.3)
    for _ in range(30):
        text = b"".join(r.choice([*some, b"aa", b"bb", b"cc"]) + r.choice([b" ", b" ", b"\n"]) for _ in range(r.randint(1, 150)))
        found = licenses.Windows(matcher, text)
        for k in range(len(matcher.names)):
            found.slide(k)
        found.grow_lines(np.arange(len(matcher.names)))
        assert found.n == len(licenses.words(text))
        for batch in found.found:
            for least, most, k, start, end in zip(*batch, strict=True):
                held = collections.Counter(found.words[start:end])
                for bound, other in ((least, matcher.most), (most, 1.0)):
                    weight = {w: n * (matcher.idf[matcher.index[w]] if w in matcher.index else other) for w, n in held.items()}
                    dot = sum(x * matcher.weights[k, matcher.index[w]] for w, x in weight.items() if w in matcher.vocabulary)
                    assert bound == pytest.approx(dot / sum(x * x for x in weight.values()) ** 0.5)


def test_license_texts_notices_and_tags():
    matcher = licenses.Matcher(licenses.TEMPLATES, {}, 1000, licenses.THRESHOLD)
    full = licenses.texts()
    assert set(full) == set(licenses.TEMPLATES) - {"AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0"}
    for name, text in full.items():
        again = "Copyright (c) 2020 Jane Doe\n" + "".join(f" * {x}\n" for x in re.findall(r"(?:\S+\s+){1,9}|\S+", " ".join(text.split())))
        for t in (text, again, " ".join(text.split())):
            assert matcher.scan(t.encode(), False)[0] == name
    notice = "This program is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n# the Free Software Foundation{} either version {} of the License, or\n# (at your option) any later version."
    kinds = {"GPL-2.0": (";", "General Public License", ";", 2), "LGPL-2.1": (";", "Lesser General Public License", ";", "2.1"), "GPL-3.0": (":", "General Public License", ",", 3), "LGPL-3.0": (":", "Lesser General Public License", ",", 3), "AGPL-3.0": (":", "Affero General Public License", ",", 3)}
    for name, parts in kinds.items():
        assert matcher.scan(notice.format(*parts).encode(), False)[0] == name
    for name in licenses.TEMPLATES:
        assert matcher.scan(f"x\n// SPDX-License-Identifier: {name}\n".encode(), False) == (name, 1.0, 1)
    tags = {"GPL-2.0-only": "GPL-2.0", "LGPL-3.0-or-later": "LGPL-3.0", "GPL-3.0+": "GPL-3.0", "(MIT OR Zlib)": "MIT", "GPL-2.0 WITH Classpath-exception-2.0": "GPL-2.0"}
    for tag, name in tags.items():
        assert matcher.scan(f"/* SPDX-License-Identifier: {tag} */".encode(), False)[0] == name
    assert matcher.scan(b"x\n/* the SPDX-License-Identifier: Zlib */\n", False) == ("Zlib", 1.0, 1)
    assert [x[0] for x in matcher.scan_all(b"# SPDX-License-Identifier: BSL-1.0 AND (MIT OR LicenseRef-Own) \r\n", False)] == ["BSL-1.0", "LicenseRef-Own", "MIT"]
    assert [x[0] for x in matcher.scan_all(b"<!-- SPDX-License-Identifier: EPL-2.0 WITH Some-exception -->", False)] == ["EPL-2.0"]
    for none in (b"SPDX-License-Identifier: is how a tag begins", b"SPDX-License-Identifier: NONE", b"SPDX-License-Identifier:", b"spdx-license-identifier: NOASSERTION\n"):
        assert matcher.scan(none, False) is None
    bsd = full["BSD-3-Clause"].replace("the copyright holder nor the names of its", "the University nor the names of its").replace("COPYRIGHT HOLDERS", "REGENTS")
    assert matcher.scan(bsd.encode(), True)[0] == "BSD-3-Clause"
    share = full["CC-BY-SA-4.0"]
    for name, kind in (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial")):
        assert matcher.scan(share.replace("Attribution-ShareAlike", kind).encode(), True)[0] == name


def test_sketches_and_bit_sets_grow_with_the_input(spark, monkeypatch):
    from tessera.llm import id_filter

    assert [ngram_join.sketch_size(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 40)] == [20, 20, 20, 21, 24]
    assert [id_filter.size_for(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 1 << 40)] == [23, 23, 23, 24, 26]
    r = random.Random(8)
    ids = [r.randint(-(2**63), 2**63 - 1) for _ in range(500)]
    for size in (18, 23, 26):
        monkeypatch.setattr(id_filter, "size_for", lambda n, size=size: size)
        rows = spark.createDataFrame([(i, 1) for i in [*ids, *range(500)]], "rep long, place int")
        got = {x.rep for x in id_filter.passing(rows, "rep", spark.createDataFrame([(i,) for i in ids], "rep long")).collect()}
        assert set(ids) <= got and len(got) < 600
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(40)) for _ in range(60)]
    texts += [t + " end" for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.classes(texts, 3, 80)[1]
    monkeypatch.setattr(ngram_join, "sketch_size", lambda n: 22)
    out = {x.doc_id: x.component_id for x in ngram_join.ngram_jaccard_join(docs, 3, 80).collect()}
    assert [out[i] for i in range(len(texts))] == want


def test_empty_tables(spark):
    docs = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        sentencepiece_codec.encode(docs, PIECES), token_counts.count_tokens(docs, PIECES), packing.pack_documents(docs, BYTES), ngram_join.keep_representatives(docs), quality.quality_rules(docs, labels), toxicity.toxicity(docs, labels),
        licenses.license_scan(docs.withColumn("path", F.lit("a"))), warc.derivatives(warc.responses(docs.select("doc_id", "text", "u"), id_col="doc_id", url_col="u", html_col="text")),
        embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")), chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    assert [df.count() for df in made] == [0] * len(made)

