"""The registered queries and the pipeline on a small directory, against the libraries and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality, queries, toxicity, warc

ODD = [None, "", " ", "\n", "one", "x" * 20_000, "</s> <s> <|endoftext|>", "é日本👍 \r\n ▁", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]


def prose(r, n):
    return " ".join(r.choice("river stone light paper green table house water under morning city small letter garden window".split()) + (str(r.randint(0, 99)) if r.random() < 0.6 else "") for _ in range(n))


def documents():
    r = random.Random(11)
    rows = list(ODD)
    for i in range(110):
        t = "\n".join(prose(r, r.randint(6, 14)) + "." for _ in range(r.randint(2, 9)))
        if i % 4 == 0:
            t += "\nyou vile grobian and filthy lout"
        if i % 5 == 0:
            t = "\n".join(["## $$ ** << >> ||", "MENU | HOME | LOGIN", *[f"*** {r.randint(0, 9)} ###" for _ in range(12)], t[:120]])
        rows.append(t)
    for i in (30, 31, 33, 37):  # copies and near copies
        rows += [rows[i], rows[i] + " end", rows[i].replace("river", "lake", 1)]
    rows.append(prose(r, 4000))
    return rows


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rows, r = documents(), random.Random(3)
    ids = list(range(len(rows)))
    put = lambda name, **columns: pq.write_table(pa.table(columns), where / f"{name}.parquet")
    put("documents", doc_id=pa.array(ids, pa.int64()), text=pa.array(rows, pa.string()), lang=["en"] * len(rows), source=[f"s{i % 3}" for i in ids], n_chars=[len(t or "") for t in rows])
    put("labels", doc_id=pa.array(ids, pa.int64()), quality=pa.array([int("***" not in (t or "***")) for t in rows], pa.int32()), toxic=pa.array([int("grobian" in (t or "")) for t in rows], pa.int32()))
    base = np.random.default_rng(5).normal(size=(6, 24))
    vectors = [(b + np.random.default_rng(7 * k + j).normal(size=24) * 0.1).tolist() for j, b in enumerate(base) for k in range(12)]
    vectors += [vectors[0], None, [0.0] * 24, [1.0, None], [float("inf")] * 24]
    put("embeddings", vec_id=pa.array(range(len(vectors)), pa.int64()), embedding=pa.array(vectors, pa.list_(pa.float32())), label=[0] * len(vectors))
    turns = [(c, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice([None, "", "a</s>b", "<|im_end|>", prose(r, 5)])) for c in range(8) for t in range(r.randint(1, 7))]
    put("conversations", **{k: [x[i] for x in turns] for i, k in enumerate(("conv_id", "turn", "role", "text"))})
    put("pages", page_id=[1, 2, 3], url=["http://a.example/", None, "u"], html=["<html><title>T</title><body><p>One</p>two</body></html>", None, ""])
    put("benchmark", item_id=[1, 2, 3, 4, 4], text=["x", None, prose(r, 12), "grobian and lout", prose(r, 3)])
    return str(where), rows, vectors, turns


def run(spark, made, name):
    return queries.QUERIES[name](spark, made[0]).collect()


def test_op1(spark, made):
    where, rows = made[:2]
    out = {x.doc_id: x for x in run(spark, made, "op1_toxicity")}
    labels = spark.read.parquet(f"{where}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text"), labels.where(~toxicity.held_out(F.col("doc_id"))))
    assert len(out) == len(rows) and model.weights.any()
    for i, t in enumerate(rows):
        assert out[i].held_out == brute.held_out(i)
        assert out[i].score == pytest.approx(brute.toxicity_score(t, model), abs=1e-9)
        assert out[i].predicted == int(out[i].score >= 0.3)
    assert np.mean([out[i].predicted == int("grobian" in (t or "")) for i, t in enumerate(rows) if brute.held_out(i)]) > 0.95


def test_op2(spark, made):
    vectors = made[2]
    out = {x.vec_id: x for x in run(spark, made, "op2_embedding_dedup")}
    good = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([vectors[i] for i in good], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    of = brute.components(len(good), lambda i, j: near[i, j])
    assert near.any() and len(out) == len(vectors)
    for k, i in enumerate(good):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (near[k].sum(), good[of[k]], of[k] == k)
    for i in set(range(len(vectors))) - set(good):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)


def test_op3(spark, made):
    sets, of = brute.classes(made[1], 3, 90)
    out = {x.doc_id: x for x in run(spark, made, "op3_ngram_jaccard_join")}
    assert [(out[i].n_shingles, out[i].component_id) for i in range(len(sets))] == [(len(s), c) for s, c in zip(sets, of, strict=True)]
    assert len(set(of)) < len(of) - 5


def test_op4_and_op10(spark, made):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    out, counts = ({x.doc_id: x for x in run(spark, made, q)} for q in ("op4_sentencepiece", "op10_token_counts"))
    for i, t in enumerate(made[1]):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), *digests)
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((t or "").encode()), len(ids) - 2, len(ids) - 2 > 4096)
    assert any(x.over_limit for x in counts.values())


def test_op5(spark, made):
    probe = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for c, _, role, text in [*made[3], (-1, 0, "user", probe), (-1, 1, "assistant", probe)]:
        turns[c].append((role, text or ""))
    out = {x.conv_id: x for x in run(spark, made, "op5_chat_format")}
    assert set(out) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in own)
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[c].formatted_chars > len(said)


def test_op11(spark, made):
    rows = made[1]
    out = {x.doc_id: x for x in run(spark, made, "op11_line_dedup")}
    for i, (lines, dropped, text) in enumerate(brute.kept_lines(list(enumerate(rows)), 40, 5)):
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept_sha256) == (lines, dropped, hashlib.sha256(text.encode()).hexdigest())


def test_op12(spark, made):
    good = [(i, v) for i, v in enumerate(made[2]) if v and None not in v and np.isfinite(v).all()]
    out = {(x.vec_id, x.component): x for x in run(spark, made, "op12_embedding_whitening")}
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    assert set(out) == {(i, c) for i, _ in good for c in range(1, 9)}
    for c in range(1, 9):
        want = y @ u[:, -c] / np.sqrt(e[-c])
        have = np.array([out[i, c].whitened for i, _ in good])
        assert np.allclose(have * np.sign(have @ want), want, atol=1e-6)
        assert out[0, c].explained == pytest.approx(e[-c] / e.sum(), rel=1e-9)
    assert [out[i, 1].deviation for i, _ in good] == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert {(x.n, x.identity_error < 1e-9) for x in out.values()} == {(n, True)}


def test_op13(spark, made):
    where, rows = made[:2]
    items = [(x["item_id"], x["text"]) for x in pq.read_table(f"{where}/benchmark.parquet").to_pylist()]
    out = defaultdict(list)
    for x in sorted(run(spark, made, "op13_ranked_search"), key=lambda x: (x.item_id, x["rank"])):
        out[x.item_id].append((x.score, x.doc_id))
    assert out == {i: x for i, x in brute.ranked(list(enumerate(rows)), items, 50).items() if x} and len(out[3]) == 50


def check_pieces(out, texts):
    """out: rows of a packing; texts: by doc_id."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.BYTES)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in out:
        pieces[x.doc_id].append(x)
        sequences[x.sequence_id].append((x.offset, x.length))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own, at = sorted(pieces[i], key=lambda x: x.piece), 0
        for k, x in enumerate(own):
            assert (x.piece, x.start) == (k, at) and (x.length == 1024 or k == 0)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(ids) and (len(own) == 1 or at > 1024)
    for s in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(s)]).tolist()]
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= 1024
    assert len(sequences) == brute.best_fit_bound([x.length for x in out], 1024)


def test_op6(spark, made):
    check_pieces(run(spark, made, "op6_best_fit_packing"), dict(enumerate(made[1])))


def test_op7(spark, made):
    out = {(x.page_id, x.kind): x for x in run(spark, made, "op7_warc_derivatives")}
    assert len(out) == 6
    for x in out.values():
        assert x.error is None and x.refers_to.startswith("<urn:uuid:") and x.record_id != x.refers_to
    text = b"T\nOne\ntwo"
    x = out[1, "conversion"]
    assert (x.content_bytes, x.content_sha256, x.block_digest) == (len(text), hashlib.sha256(text).hexdigest(), warc.digest(text))
    assert x.source_payload_digest == warc.digest(b"<html><title>T</title><body><p>One</p>two</body></html>") and x.target_uri == "http://a.example/"
    assert out[2, "conversion"].content_bytes == 0


def test_op8(spark, made):
    out = {x.doc_id: x for x in run(spark, made, "op8_license_scan")}
    assert len(out) == len(made[1])
    own = {i: x for i, x in out.items() if x.own_license}
    assert {i: x.own_license for i, x in own.items()} == {8: "MIT", 9: "Apache-2.0"}
    owners = {x.path.rpartition("/")[0]: x for x in own.values() if x.is_licence_file}
    for x in out.values():
        at, found = x.path.rpartition("/")[0], None
        while not x.own_license and found is None:
            found = owners.get(at)
            if not at:
                break
            at = at.rpartition("/")[0]
        assert (x.license, x.inherited_from) == ((x.own_license, None) if x.own_license else (found.own_license, found.path) if found else (None, None))


def test_op9(spark, made):
    where, rows = made[:2]
    out = {x.doc_id: x for x in run(spark, made, "op9_quality_rules")}
    field = quality.fit(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{where}/labels.parquet"))
    assert field != quality.DEFAULT
    for i, t in enumerate(rows):
        x, counts = out[i], brute.quality_counts(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == counts
        assert x.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        lines = quality.analyse([(t or "").encode()], quality.WordHashes())
        if counts[0]:
            share = sum(w for w, y in zip(lines.words.tolist(), brute.best_labels(field, lines.features), strict=True) if y)
            assert x.kept == (not x.base_failed and 2 * share >= counts[0]) and x.content_share == pytest.approx(share / counts[0])
        else:
            assert not x.kept and x.content_share is None
    good = [out[i].kept for i, t in enumerate(rows) if "***" not in (t or "") and brute.quality_counts(t)[0] >= 20]
    assert np.mean(good) > 0.9 and np.mean([out[i].kept for i, t in enumerate(rows) if "***" in (t or "")]) < 0.3


def test_pipeline(spark, made):
    where, rows = made[:2]
    labels = spark.read.parquet(f"{where}/labels.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    left, columns = dict(enumerate(rows)), docs.columns
    for (name, stage), judge in zip(corpus_pipeline.STAGES[:3], ("quality", "toxicity", "copies"), strict=True):
        out = stage(spark, docs, where)
        assert out.columns == columns
        got = {x.doc_id: x.text for x in out.collect()}
        if judge == "quality":
            field = quality.fit(docs.select("doc_id", "text"), labels)
            want = set()
            for i, t in left.items():
                counts = brute.quality_counts(t)
                if counts[0] >= 20 and 100 * counts[4] <= 30 * counts[0]:
                    lines = quality.analyse([t.encode()], quality.WordHashes())
                    if 2 * sum(w for w, y in zip(lines.words.tolist(), brute.best_labels(field, lines.features), strict=True) if y) >= counts[0]:
                        want.add(i)
        elif judge == "toxicity":
            model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~toxicity.held_out(F.col("doc_id"))))
            want = {i for i, t in left.items() if brute.toxicity_score(t, model) < 0.3}
            assert not any("grobian" in left[i] for i in want)
        else:
            keys = sorted(left)
            of = brute.classes([left[i] for i in keys], 5, 80)[1]
            want = {keys[c] for c in of}
        assert got == {i: left[i] for i in want} and 0 < len(got) < len(left), name
        left, docs = got, corpus_pipeline.materialise(out, name)
    check_pieces(corpus_pipeline.run(spark, where).collect(), left)


def test_pipeline_on_nulls_repeats_and_empty_tables(spark, made, tmp_path):
    text = "the same words stand here " * 2 + " ".join(f"w{k}" for k in range(30))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(1, text), (1, text), (1, other), (None, text + " more"), (None, other + " and more"), (2, None), (3, ""), (4, text + " x"), (5, " ".join(f"z{k}" for k in range(50)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.STAGES[2][1](spark, docs, "")
    kept = Counter((x.doc_id, x.text) for x in near.collect())
    assert kept == Counter([(1, text), (1, other), (2, None), (3, ""), (5, rows[-1][1])])
    for name, schema in (("documents", docs.schema), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} <= {1, 5} and len(packed) >= 2


def test_queries_read_only_what_they_state():
    assert re.match(r"op\d+_", next(iter(queries.QUERIES))) and len(queries.QUERIES) == 13
    assert all(f.__doc__ for f in queries.QUERIES.values())


def test_pipeline_plans_stay_small(spark, made):
    """The driver stores every query's plan with its metrics; chains of kept tables would put plans into plans."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    corpus_pipeline.run(spark, made[0]).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(before, 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert len(plans) > 30 and max(map(len, plans)) < 40_000
    assert max(p.count("InMemoryRelation") for p in plans) <= 8
