"""The registered queries on the smallest tables against brute force, and the operators at odd sizes."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floodspark.llm import bpe, decontaminate, language_id, queries, simhash, substring_dedup, suffix_dedup, token_files, toxicity
from tests.llm.test_text_operators import TOKENIZER, naive_model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    return lib, {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in docs}


def test_op4(spark, docs, ids):
    lib, want = ids
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, SF).collect()}
    assert got == {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(lib.decode(x, skip_special_tokens=False).encode())) for i, x in want.items()}


def test_op7(spark, docs, ids):
    at, want = 0, {}
    for i, _ in docs:
        x = [*ids[1][i], 2]
        want[i] = (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, SF).collect()} == want


def test_op6(spark, docs):
    fps = [simhash.fingerprint((t or "").encode()) for _, t in docs]
    parent = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    want = {i: (f"{f:016x}", docs[p][0]) for (i, _), f, p in zip(docs, fps, parent)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, SF).collect()} == want


def test_op8(spark, docs):
    n, _, held, _, _, out = naive_model(docs)
    got = {r.doc_id: r for r in queries.op8_lm_score(spark, SF).collect()}
    assert {i: (r.held_out, r.train_tokens, r.n_tokens, r.n_known) for i, r in got.items()} == {i: (held(i), n, *x[:2]) for (i, _), x in zip(docs, out)}
    assert all(abs(got[i].base_score - x[2]) < 1e-3 and abs(got[i].score - x[3]) < 1e-3 for (i, _), x in zip(docs, out))


def test_op10(spark, docs):
    raw = [(t or "").encode() for _, t in docs]
    want = {}
    for (i, _), b, gone in zip(docs, raw, suffix_dedup.brute_force(raw)):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), sha(kept))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, SF).collect()} == want


def test_op1_and_op9(spark, docs):
    held = lambda i, m, r: zlib.crc32(str(i).encode()) % m == r
    one = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    nine = {r.doc_id: r for r in queries.op9_language_id(spark, SF).collect()}
    assert set(one) == set(nine) == {i for i, _ in docs}
    assert all(r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in one.items())
    assert all(r.held_out == held(i, 3, 1) and 0 <= r.score <= 1 for i, r in nine.items())
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = [i for i, t in docs if held(i, 3, 1) and lang[i] and t and any(x.isalpha() for x in t)]
    assert sum(nine[i].lang_pred == lang[i] for i in own) >= 0.95 * len(own)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.arange(30, dtype=np.uint64), -0.4, rng.normal(size=30), rng.normal(size=(30, 5)))
    texts = [rng.choice(30, k, replace=False) for k in (0, 1, 2, 7, 30)]
    got = m.logits(np.repeat(np.arange(5), [len(t) for t in texts]), np.concatenate(texts).astype(np.int64), 5)
    for x, t in zip(got, texts):
        pairs = sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(t) for b in t[:k])
        assert abs(x - (m.bias + m.w[t].sum() + pairs / max(len(t), 1) ** 0.5)) < 1e-9


def test_bit_sliced_filters_equal_one_bloom_filter_each():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc dé.7") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    column = pa.array(texts)
    data, offsets = language_id.c.utf8(column)
    for size in language_id.SIZES:
        grams, first = language_id.n_grams(data, offsets, size)
        for k, t in enumerate(texts):
            b = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in f" {t} ".lower().encode())
            ok = lambda g: (g[:1] != b" " or g[1:2] != b" ") and (g[-1:] != b" " or g[-2:-1] != b" ")
            want = [int.from_bytes(b[i : i + size], "little") | size << 56 for i in range(len(b) - size + 1) if ok(b[i : i + size])]
            assert grams[first[k] : first[k + 1]].tolist() == want
    known = [set(rng.sample(sorted({int(g) for s in language_id.SIZES for g in language_id.n_grams(data, offsets, s)[0]}), 25)) for _ in range(70)]
    filters, filled = [set() for _ in known], np.zeros((2, language_id.SLOTS), np.uint64)
    for k, own in enumerate(known):
        for at in language_id.slots(np.array(sorted(own), np.uint64)):
            filters[k].update(at.tolist())
            filled[k // 63, at] |= np.uint64(1 << k % 63)
    m = language_id.Model([str(k) for k in range(70)], filled)
    got, want = m.counts(data, offsets), np.zeros((len(texts), 70))
    for k, own in enumerate(filters):
        rate = (len(own) / language_id.SLOTS) ** language_id.PROBES
        for size in language_id.SIZES:
            grams, first = language_id.n_grams(data, offsets, size)
            at = np.stack(language_id.slots(grams))
            for d in range(len(texts)):
                cols = at[:, first[d] : first[d + 1]].T.tolist()
                assert sum(int(g) in known[k] for g in grams[first[d] : first[d + 1]]) <= (hits := sum(all(s in own for s in c) for c in cols))
                want[d, k] += max(hits - len(cols) * rate, 0) / (1 - rate + 1e-12)
    assert np.allclose(got, want)


def test_pieces_are_the_text(ids):
    rng = random.Random(7)
    letters = "ab Zé'ß9,. \n\t  　中!<|endoftext|>÷×"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    v, lib = bpe.Vocabulary(open(TOKENIZER, encoding="utf-8").read()), ids[0]
    column = pa.array(texts)
    got, cut = v.encode(column)
    raw, first = bpe.pieces(column, v.keep)
    raw = raw.to_pylist()
    for k, t in enumerate(texts):
        assert b"".join(raw[first[k] : first[k + 1]]).decode() == t
        assert np.frombuffer(got, "<u4")[cut[k] // 4 : cut[k + 1] // 4].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_files_of_other_rules_are_rejected():
    import json

    spec = json.loads(open(TOKENIZER, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "a b"}]}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change))


def test_very_long_texts_and_a_long_word(spark, ids):
    rng = random.Random(9)
    long = " ".join(rng.choice(["alpha", "beta", "delta"]) + str(rng.randint(0, 9999)) for _ in range(500_000))
    word = "x" * 50_000 + "y"
    rows = [(1, long), (2, word), (3, long[:2_000_000]), (4, None)]
    assert len(long) > 4 << 20
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode_decode(frame, TOKENIZER).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i], "<u4").tolist() == ids[0].encode(t or "", add_special_tokens=False).ids
    sizes = {r.doc_id: r.n_tokens for r in token_files.written_and_read(frame, TOKENIZER).collect()}
    assert sizes == {i: len(got[i]) // 4 + 1 for i, _ in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(frame).collect()}[1] == simhash.fingerprint(long.encode())
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_bytes(frame).collect()}
    assert gone == {1: 2_000_000, 2: 50_000, 3: 2_000_000, 4: 0}
    words = {r.doc_id: r.n_removed for r in substring_dedup.repeated_words(frame).collect()}
    assert words == {1: 0, 2: 0, 3: len(long[:2_000_000].split()) - (long[1_999_999] != " " and long[2_000_000] != " "), 4: 0}


def test_many_equal_rows(spark):
    text = "one sentence of some words that stands in very many equal rows, " * 5
    frame = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    assert substring_dedup.repeated_words(frame).agg(F.sum("n_removed"), F.count("*")).first()[:] == (0, 20_000)
    assert suffix_dedup.repeated_bytes(frame).agg(F.min("n_removed"), F.count("*")).first()[:] == (len(text), 20_000)
    assert simhash.keep_one(frame).count() == 1
    assert token_files.written_and_read(frame, TOKENIZER).agg(F.countDistinct("start"), F.countDistinct("ids_crc32")).first()[:] == (20_000, 1)
    items = spark.createDataFrame([(1, "sentence of some words that")], "item_id long, text string")
    assert decontaminate.matches(frame, items).filter("n_hit = 25").count() == 20_000


def test_pipeline_stages_keep_columns_of_any_name(spark):
    names = "text_hash string, kept_id string, kept_hash string, cut_id string, cut_hash string, cut_text string, lang_pred string, lang_score string, _t string, chunk string"
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [x.split()[0] for x in names.split(", ")]
    docs = base.select("*", *(F.lit(x).alias(x) for x in extra))
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-1, "", None, None, 0)], base.schema).select("*", *(F.lit(x).alias(x) for x in extra))
    for make in (lambda: docs.unionByName(odd), lambda: docs.limit(0)):
        some = make()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = corpus_pipeline.common.stored(stage(spark, some, SF))
            assert some.columns == docs.columns
            assert some.filter(" or ".join(f"coalesce({x}, '') <> '{x}'" for x in extra)).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == some.count()
