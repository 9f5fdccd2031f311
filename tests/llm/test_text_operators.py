"""The text operators against brute force, on small texts with nulls, copies, ties and clashing columns."""

import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floodspark.llm import bpe, common, decontaminate, graph, language_id, lm_score, queries, simhash, substring_dedup, suffix_dedup, token_files, toxicity

TOKENIZER = queries.tokenizer_file()
EXTRA = "doc_id long, text string, chunk int, key string, fp long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "délta", "x", "0"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words(rng, 300).split(" ")
    out = []
    for i in range(40):
        a = rng.randint(0, 260)
        out.append((i, words(rng, 20) + " " + " ".join(base[a : a + rng.randint(5, 40)]) + "\n" + words(rng, 5)))
    out += [(100, out[3][1]), (101, out[3][1]), (102, None), (103, ""), (104, "   \n\t "), (105, "one"), (106, "a" * 900), (107, "ab " * 400), (108, "é" * 300)]
    return out


def frame(spark, rows):
    """Rows with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "k", 1) for r in rows], EXTRA)


def test_substring_dedup(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.repeated_words(frame(spark, texts)).collect()}
    assert got == substring_dedup.brute_force(texts)


def test_substring_dedup_keeps_repeated_ids_and_null_ids(spark, texts):
    t = texts[3][1]
    rows = [(1, t), (1, t), (None, t), (2, t)]
    got = sorted((str(r.doc_id), r.n_removed > 0) for r in substring_dedup.repeated_words(frame(spark, rows)).collect())
    assert got == [("1", False), ("1", False), ("2", True), ("None", True)]
    assert substring_dedup.repeated_words(frame(spark, rows).limit(0)).count() == 0


def test_substring_dedup_tells_windows_apart_whose_hashes_are_equal(spark, texts):
    """A first hash of four values: nearly all windows look repeated until the second one is asked."""
    weak = (lambda data, start, end: common.word_hashes(data, start, end) & np.uint64(3), substring_dedup.HASHES[1])
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.repeated_words(frame(spark, texts), hashes=weak).collect()}
    assert got == substring_dedup.brute_force(texts)


def test_bytes_that_are_no_utf8(spark):
    bad = "unhex(concat(repeat('FF20E2', 30), '41'))"
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.expr(f"cast({bad} as string)").alias("text"))
    assert sorted(r.n_removed > 0 for r in substring_dedup.repeated_words(docs).collect()) == [False, True, True]
    assert bpe.encode_decode(docs, TOKENIZER).count() == simhash.near_duplicates(docs).count() == 3
    assert suffix_dedup.repeated_bytes(docs, width=40).filter("n_removed = n_bytes").count() == 3


def test_substring_spans_are_maximal(spark, texts):
    for r in substring_dedup.repeated_words(frame(spark, texts)).collect():
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))


def test_suffix_dedup(spark, texts):
    raw = [(t or "").encode() for _, t in texts]
    gone = suffix_dedup.brute_force(raw)
    want = {i: (len(b), int(g.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for (i, _), b, g in zip(texts, raw, gone)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.repeated_bytes(frame(spark, texts)).collect()}
    assert got == want
    assert suffix_dedup.repeated_bytes(frame(spark, texts).limit(0)).count() == 0


def test_simhash_links(spark, texts):
    rng = random.Random(1)
    long = words(rng, 400).split(" ")
    rows = texts + [(200 + k, " ".join(long[:k] + ["zz"] + long[k + 1 :])) for k in (3, 90, 200)] + [(None, texts[3][1]), (3, texts[3][1])]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = min(parent[i], parent[j]), max(parent[i], parent[j])
                parent = [a if p == b else p for p in parent]
    least = {}
    for (i, _), p in zip(rows, parent):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = sorted((str(i), f"{f:016x}", str(least.get(p))) for (i, _), f, p in zip(rows, fps, parent))
    out = simhash.near_duplicates(frame(spark, rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out.collect()) == want
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.count() == len(set(parent)) and kept.columns == ["doc_id", "text", "chunk", "key", "fp"]
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_fingerprint_is_the_majority_of_xxh64_bits(spark):
    text = "The quick Brown fox  jumps\nover it"
    w = text.lower().split()
    sh = [(" ".join(w[i : i + 3]),) for i in range(len(w) - 2)]
    h = [r[0] & (2**64 - 1) for r in spark.createDataFrame(sh, "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(b" ") == 0


def test_every_pair_within_the_radius_shares_a_table():
    masks = simhash.covering_masks(3)
    rng = random.Random(2)
    for _ in range(3000):
        flip = sum({1 << rng.randrange(64) for _ in range(3)})
        assert any(flip & m == 0 for m in masks)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 30)] + [(5, 5)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + k: 1000 for k in range(30)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_meet_each_pair_once(spark):
    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(1, 99)], "key int, id long")
    seen = []
    for r in graph.blocks(rows, ["key"], "id", block=8).groupBy("key", "i", "j").agg(F.collect_list(F.struct("id", "own")).alias("x")).collect():
        ids, own = np.array([x.id for x in r.x]), np.array([x.own for x in r.x])
        for a, b in graph.pairs(np.zeros(len(ids), np.int64), own, np.full(len(ids), r.i != r.j)):
            seen += [tuple(sorted(p)) for p in zip(ids[a].tolist(), ids[b].tolist())]
    assert len(seen) == len(set(seen)) == 50 * 49 // 2


ITEMS = [(1, "the Quick brown fox jumps over the lazy dog again and again"), (2, "short one"), (3, None), (4, "--"), (None, "nameless item text"), (2, "short one")]


def brute_matches(text, items, width=10):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        p = cut(t)
        for s in range(max(1, len(p) - width + 1)) if p else []:
            g = p[s : s + width]
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rows = [(1, "so THE quick brown fox jumps over the lazy dog again, and more"), (2, "a short   One! and short one"), (3, None), (4, ""), (5, "the quick brown fox jumps over the lazy cat"), (None, "nameless item text"), (1, "other text"), (6, "short" + " one two" * 400)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.matches(frame(spark, rows), items).collect())
    assert got == sorted((str(i), *brute_matches(t, ITEMS)) for i, t in rows)
    clean = decontaminate.clean(frame(spark, rows), items)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows if not brute_matches(t, ITEMS)[1]}
    assert decontaminate.matches(frame(spark, rows).limit(0), items).count() == 0
    assert decontaminate.matches(frame(spark, rows), items.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    rows = [(1, "short x y one"), (2, "short a b c d e f g one"), (3, "short one")]
    got = {(r.doc_id, r.gap) for r in decontaminate.proximity_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(2, "short one")], "item_id long, text string"), slop=3).collect()}
    assert {i for i, _ in got} == {1, 3} and (3, 0) in got and {abs(g) for i, g in got if i == 1} == {2}


def odd_texts():
    rng = random.Random(3)
    letters = "ab theéñ'sll\n\t  \r\x0b\x1c\x85\xa0 ​　中文1234567890...!!<|endoftext|>😀́²ⅷ"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["aaaaaaaaaaaaaaaaaaaa", "ab" * 50, " " * 30, "x<|endoftext|> y", "don't we'll", "A plain text of words,\nand lines."]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib, rows = Tokenizer.from_file(TOKENIZER), [*enumerate(odd_texts()), (999, None), (None, "no id")]
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, rows), TOKENIZER).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want)
        assert got[i].decoded == lib.decode(want, skip_special_tokens=False)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    rows = [(1000 - i, t) for i, t in enumerate(odd_texts())] + [(None, "first"), (5000, None), (1000, "twice")]
    docs = frame(spark, rows)
    parts = token_files.write(docs, f"file://{tmp_path}/t", TOKENIZER, 2)
    assert parts[0]["dtype"] == "<u2" and sum(p["n_docs"] for p in parts) == len(rows)
    got = token_files.read(spark, f"file://{tmp_path}/t", parts).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.written_and_read(docs.limit(0), TOKENIZER).count() == 0


def naive_model(rows):
    """Counts, EM tables and scores of the language model by dictionaries: doc -> (base, score), and the exact table."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [["<s>", "<s>", *(t or "").translate({c: c + 32 for c in range(65, 91)}).split(), "</s>"] for _, t in rows]
    n1, n2, n3, h1, h2 = ({} for _ in range(5))
    add = lambda d, k: d.__setitem__(k, d.get(k, 0) + 1)
    for (i, _), t in zip(rows, tokens):
        for k in range(2, len(t)):
            if not held(i):
                add(n1, t[k]), add(n2, (t[k - 1], t[k])), add(n3, tuple(t[k - 2 : k + 1])), add(h1, t[k - 1]), add(h2, (t[k - 2], t[k - 1]))
    n, v = sum(n1.values()), len(n1)
    cells, exact = {}, []
    deep = lambda t, k: k > 2 and h2.get((t[k - 2], t[k - 1]), 0) >= 1
    for (i, _), t in zip(rows, tokens):
        for k in range(2, len(t)):
            if not held(i):
                h, w, pair = h1[t[k - 1]] - 1, n1[t[k]] - 1, n2[t[k - 1], t[k]] - 1
                one, two = w / (n - 1), pair / max(h, 1)
                exact.append((h, one, two))
                key = tuple(lm_score.cell(lm_score.bucket(np.array([h])), np.array([one]), np.array([two]))[0])
                add(cells, key)
    mixed = lm_score.weights(np.array([k[0] for k in cells]), np.array([float(x) for x in cells.values()]), v)
    two_words = lambda w, pair, h, total: float(mixed[lm_score.bucket(np.array([h]))[0]] @ [1 / (v + 1), w / total, pair / max(h, 1)])
    cells = {}
    for (i, _), t in zip(rows, tokens):
        for k in range(2, len(t)):
            if not held(i) and deep(t, k):
                g = h2[t[k - 2], t[k - 1]] - 1
                lower = two_words(n1[t[k]] - 1, n2[t[k - 1], t[k]] - 1, h1[t[k - 1]] - 1, n - 1)
                add(cells, int(lm_score.cell(lm_score.bucket(np.array([g])), np.array([lower]), np.array([(n3[tuple(t[k - 2 : k + 1])] - 1) / max(g, 1)]))[0][0]))
    deeper = lm_score.weights_of_triples(np.array(list(cells)), np.array([float(x) for x in cells.values()]))
    out = []
    for t in tokens:
        base = score = 0.0
        for k in range(2, len(t)):
            base += np.log10((n1.get(t[k], 0) + 1) / (n + v + 1))
            p = two_words(n1.get(t[k], 0), n2.get((t[k - 1], t[k]), 0), h1.get(t[k - 1], 0), n)
            if deep(t, k):
                g = h2[t[k - 2], t[k - 1]]
                p = float(deeper[lm_score.bucket(np.array([g]))[0]] @ [p, n3.get(tuple(t[k - 2 : k + 1]), 0) / g])
            score += np.log10(p)
        out.append((len(t) - 2, sum(x in n1 for x in t[2:]), round(base, 6), round(score, 6)))
    return n, v, held, exact, mixed, out


def test_language_model(spark, texts):
    rows = texts + [(None, "alpha1 beta2"), (7, texts[7][1])]
    n, v, held, exact, mixed, out = naive_model(rows)
    want = sorted((str(i), held(i), n, *x) for (i, _), x in zip(rows, out))
    got = lm_score.score(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.train_tokens, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.score(frame(spark, rows).limit(0)).count() == 0
    # what rounding the estimates to levels costs, in held-out log-probability
    h, one, two = map(np.array, zip(*exact))
    p, b = np.stack([np.full(len(one), 1 / (v + 1)), one, two], axis=1), lm_score.bucket(h)
    start = np.tile([0.1, 0.5, 0.4], (lm_score.BUCKETS, 1))
    best = np.log10((lm_score.maximised(p, b, np.ones(len(b)), start)[b] * p).sum(axis=1)).sum()
    assert 0 <= best - np.log10((mixed[b] * p).sum(axis=1)).sum() < 0.002 * abs(best)


def test_interpolation_weights_are_probabilities_and_model_sums_to_one():
    cells = np.array([(1 * 512 + 400) * 512 + 0, (3 * 512 + 380) * 512 + 500, 0])
    w = lm_score.weights(cells, np.array([10.0, 90.0, 1.0]), 1000)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and (w[:, 0] > 0).all() and w[0, 2] == 0
    assert w[3, 2] > w[1, 2]


LANGS = {"aa": ["kala", "mene", "talo", "vesi"], "bb": ["schw", "unge", "weit", "zucht"], "cc": ["ciao", "bello", "gatto", "ñandú"]}


def test_language_id(spark):
    rng = random.Random(4)
    make = lambda k, n: " ".join(rng.choice(LANGS[k]) + rng.choice(["", "x", "en"]) for _ in range(n))
    rows = [(i, make(k, rng.randint(3, 60)), k) for i, k in enumerate(list(LANGS) * 60)]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (None, "kala mene", None), (903, "日本", None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) >= 0.98 * len(rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "aa" and got[903].lang_pred in LANGS
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_more_languages_than_bits_of_a_word(spark):
    """130 languages, some with a quote or a dot in the name, and a sample that would have few of the rare ones."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stock = {f"l`{k}.x": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(4)] for k in range(130)}
    rows = [(k * 100 + i, " ".join(rng.choice(stock[lang]) for _ in range(12)), lang) for k, lang in enumerate(stock) for i in range(60 if k < 4 else 9)]
    docs = spark.createDataFrame([*rows, (99999, "one tag of its own", "dirty")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, text_rows=200)
    assert set(model.languages) == set(stock)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)


def test_portions_keep_rare_languages():
    got = language_id.portions({"big": 1_000_000, "mid": 5_000, "rare": 30}, 12_000)
    assert got["rare"] == got["mid"] == 1.0 and round(got["big"] * 1_000_000) == 12_000 - 5_030
    assert language_id.portions({"a": 5, "b": 7}, 12_000) == {"a": 1.0, "b": 1.0}


def test_toxicity(spark):
    rng = random.Random(6)
    insults = ["grobian", "fieserling", "widerling"]
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.25
        w = [rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 80))]
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(insults) + rng.choice(["", "e", "!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = frame(spark, [*rows, (700, None), (701, ""), (None, "grobian")])
    table = spark.createDataFrame([*labels, (700, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs, table)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, m).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert all(0 <= x <= 1 for x in got.values()) and got[700] == got[701] < 0.3 <= got[None]
    flat = toxicity.fit(docs, table.limit(0))
    assert {round(r.toxicity, 6) for r in toxicity.score(docs, flat).collect()} == {0.5}


def test_terms_that_tell_nothing_alone_get_factors(spark):
    """Toxic if both or neither of two words are there: each one's chi-square is 0, below that of thousands of others."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        a, b = i // 2 % 2, i // 4 % 2
        w = [f"{rng.randint(1000, 2999)}filler" for _ in range(30)] + ["zwiebel"] * a + ["quark"] * b
        rows.append((i, " ".join(w)))
        labels.append((i, int(a == b)))
    m = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert m.present(pa.array(["zwiebel quark"]))[1].size == 6  # two words, three stems of the one and one of the other
    assert len(m.terms) > 5000
    at = m.present(pa.array(["zwiebel quark"]))[1]
    init = np.random.default_rng(7).normal(0, 0.05, m.v.shape).astype(np.float32)
    assert (np.abs(m.v[at] - init[at]).max(axis=1) > 1e-4).all()


def test_fit_learns_a_pair_that_tells_nothing_alone(spark):
    """Toxic if both or neither of two words are there, among 30 others of each text: rows held out."""
    rng = random.Random(21)
    words = lambda a, b: " ".join([f"{rng.randint(1000, 2999)}filler" for _ in range(30)] + ["zwiebel"] * a + ["quark"] * b)
    flags = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(8000)]
    rows, labels = [(i, words(a, b)) for i, a, b in flags], [(i, int(a == b)) for i, a, b in flags]
    m = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(frame(spark, rows), m).collect()}
    own = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    good, bad = (np.array([x for x, y in own if y == k]) for k in (1, 0))
    assert (good[:, None] > bad).mean() >= 0.9


def test_factors_learn_a_pair_that_weights_cannot():
    """Toxic only when both of two terms are there, or neither: no linear weights can tell."""
    rows = [np.array(x) for x in ([0, 2], [1, 2], [0, 1, 2], [2])] * 100
    y = np.array([0.0, 0.0, 1.0, 1.0] * 100)
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(3, dtype=np.uint64), 0.0, np.zeros(3), rng.normal(0, 0.3, (3, 4)))
    grad2 = [np.full(3, 1e-8), np.full((3, 4), 1e-8)]
    for _ in range(60):
        toxicity.epoch(m, rows, y, grad2, 0.3, 0.0, rng.permutation(len(y)))
    doc, at = np.repeat(np.arange(4), [2, 2, 3, 1]), np.concatenate(rows[:4])
    assert ((toxicity.sigmoid(m.logits(doc, at, 4)) >= 0.5) == y[:4].astype(bool)).all()


def test_hashes_of_words_depend_on_all_bytes():
    rng = random.Random(9)
    w = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(500)} | {"x" * 300, "x" * 301, "x" * 299 + "y"})
    raw = " ".join(w).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    start, end, first = common.words(data, offsets)
    assert first.tolist() == [0, len(w)] and len(set(common.word_hashes(data, start, end).tolist())) == len(w)


def test_workers_keep_little_for_later_stages(spark):
    """A worker is used again by other stages: what Arrow freed goes back, and another operator's tables go."""
    code = """
import random, re
import pyarrow as pa
from floodspark.llm import bpe, common, queries
anon = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
v = bpe.vocabulary(open(queries.tokenizer_file(), encoding="utf-8").read())
rng = random.Random(1)
text = " ".join(rng.choice(["alpha", "beta", "Gamma", "x"]) + str(rng.randint(0, 9)) for _ in range(20_000))
batch = pa.record_batch({"doc_id": list(range(40)), "text": [text] * 40})
common.tidy(alone=False)
before, n = anon(), 0
for out in bpe.encoded_batches(v, iter([batch] * 3)):
    n += out.num_rows
    del out
print(n, anon() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    n, grown = done.stdout.split()
    assert int(n) == 120 and float(grown) < 20

    def kept(batches):
        common.kept_in_worker("another", dict)
        for batch in batches:
            yield batch.select([]).append_column("n", pa.array([len(common.KEPT)] * batch.num_rows))

    def after(table):
        return pa.table({"n": pa.array([len(common.KEPT)], pa.int64())})

    ids = spark.range(1)
    assert [r.n for r in ids.mapInArrow(kept, "n long").collect()] == [1]
    common.kept_in_worker("another", dict)
    assert common.tidied(after)(pa.table({"id": [1]})).column("n").to_pylist() == [0] and not common.KEPT
    assert [r.n for r in ids.groupBy("id").applyInArrow(common.tidied(after), "n long").collect()] == [0]
    assert [r.n for r in ids.groupBy("id").cogroup(ids.groupBy("id")).applyInArrow(common.tidied(lambda a, b: after(a)), "n long").collect()] == [0]
