"""Conversation trie, posting lists and Merkle manifest against brute force, and at odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.llm import conversation_trie, merkle, posting_lists

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ trie
def naive_trie(rows, rebuild):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {k: [x[2:] for x in sorted(v)] for k, v in turns.items()}
    built = own
    if rebuild:
        built = {}
        for k in own:
            h = zlib.crc32(str(k).encode()) % 9
            built[k] = own.get(k - k % 5, [])[:h] + own[k][h:]
    members = defaultdict(list)
    for k, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(k)
    kids = defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return {(min(m), len(n)): (min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], H(",".join(map(str, sorted(k for k in m if len(built[k]) == len(n)))))) for n, m in members.items()}


def spark_trie(spark, rows, rebuild, schema="conv_id long, turn long, role string, text string"):
    turns = conversation_trie.c.stored(conversation_trie.ordered(spark.createDataFrame(rows, schema)))
    ids = conversation_trie.c.stored(turns.select("conv_id").distinct())
    built = conversation_trie.c.stored(conversation_trie.branched(turns, ids)) if rebuild else turns
    nodes, ends = conversation_trie.trie(built, ids)
    out = nodes.join(conversation_trie.end_digests(ends), ["depth", "key"], "left").collect()
    assert len({(r.conv_id, r.depth) for r in out}) == len(out)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256 or H("")) for r in out}


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_of_few_texts_and_long_conversations(spark, rebuild):
    rng = random.Random(4)
    rows = []
    for conv in [*range(60), 1003, 1004]:
        size = rng.choice([1, 2, 3, 9, 16, 17, 40]) if conv != 7 else 1200
        rows += [(conv, t, rng.choice(["user", "user", "user", None]), "é" * (t % 3) + rng.choice("aaaaaaab")) for t in range(size)]
    rng.shuffle(rows)
    assert spark_trie(spark, rows, rebuild) == naive_trie(rows, rebuild)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, "user", "a"), (1, 0, "user", None), (1, 0, "user", None), (2, None, "user", "a"), (2, 5, None, ""), (None, 1, "user", "x"), (-3, 1, "", "a"), (9, 1, "user", "a" * 100_000)]
    for rebuild in (False, True):
        assert spark_trie(spark, rows, rebuild) == naive_trie(rows, rebuild)
    assert spark_trie(spark, [], False) == {} == spark_trie(spark, [], True)
    extra = [(*r, 1, 2, 3) for r in rows]
    assert spark_trie(spark, extra, False, "conv_id long, turn long, role string, text string, pos int, digest int, pid int") == naive_trie(rows, False)


def test_trie_of_many_equal_conversations(spark):
    rows = [(k, t, "user", f"turn {t}") for k in range(3000) for t in range(10)] + [(3000 + k, t, "user", f"turn {t}" if t < 9 else f"{k}") for k in range(50) for t in range(11)]
    assert spark_trie(spark, rows, False) == naive_trie(rows, False)


# ------------------------------------------------------------------ posting lists
def exact(queries, rows, top):
    ok = lambda v: v is not None and None not in v and np.isfinite(v).all() and any(v)
    rows, out = {(i, tuple(v)) for i, v in rows if i is not None and ok(v)}, {}
    for i, v in queries:
        if i is not None and ok(v):
            d = sorted((float(np.sqrt(np.cumsum((np.array(w) - np.array(v)) ** 2)[-1])), k) for k, w in rows if k != i and len(w) == len(v))
            out[i] = [k for _, k in d[:top]]
    return out


def found(spark, queries, rows, top=10):
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in sorted(posting_lists.nearest(frame(queries), frame(rows), top).collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.5]), (8, [1.0, 0.5]), (9, [1.0, -0.5]), (10, [3.0]), (11, [4.0]), (None, [1.0, 1.0]), (12, [1.0, 2.0, 3.0])]
    want = {k: v for k, v in exact(rows, rows, 10).items() if v}
    assert dict(found(spark, rows, rows)) == want and want[1] == [8, 9] and 12 not in want
    assert found(spark, [], rows) == {} == found(spark, rows, [])


def test_nearest_recall_and_equal_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 16))[rng.integers(40, size=6000)] + 0.4 * rng.normal(size=(6000, 16))
    x[1000:3000] = x[1000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [rows[i] for i in range(0, 6000, 50)]
    got, want = found(spark, queries, rows), exact(queries, rows, 10)
    assert all(len(v) == 10 for v in got.values()) and set(got) == set(want)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.97 * 10 * len(want)
    assert got[1500] == want[1500] == [k for k in range(1000, 1011)][:10]


def test_a_query_whose_lists_hold_too_few_looks_into_all(spark, monkeypatch):
    """More neighbours are asked for than the lists of a query hold."""
    monkeypatch.setattr(posting_lists, "LIST", 3)  # which only the driver reads
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))]
    assert dict(found(spark, rows[:20], rows, 195)) == exact(rows[:20], rows, 195)


def test_beam_finds_the_nearest_centroids():
    x = np.random.default_rng(3).normal(size=(8000, 24))
    m = posting_lists.Centroids.of(x, 600)
    ids, d = m.beam(x[:300], 32)
    best = np.argsort(posting_lists.squares(x[:300], m.at), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, best)]) > 0.9 and (np.diff(d, axis=1) >= 0).all()
    r, k = m.homes(x[:300])
    assert len(r) > 300 and np.bincount(r).max() <= posting_lists.REPLICAS
    every = m.lists(x[:3], True)[1]
    assert every.tolist() == [*range(len(m.at))] * 3


# ------------------------------------------------------------------ Merkle manifest
def naive_merkle(rows, hit):
    cell = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more=0: H("".join(map(cell, (r[0], r[2], r[3], None if r[4] is None else r[4] + more, r[1]))))

    def tree(now):
        levels = [now]
        while len(now) > 1:
            now = [H("".join(now[k : k + 2])) for k in range(0, len(now), 2)]
            levels.append(now)
        return levels

    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    order = {n: sorted(trees[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    built = {n: tree([leaf(r) for r in order[n]]) for n in names}
    top = tree([built[n][-1][0] for n in names])
    out = []
    for q, n in enumerate(names):
        for p, r in enumerate(order[n]):
            proof, now = [], leaf(r, int(hit(r[0])))
            for levels, at in ((built[n], p), (top, q)):
                for level in levels[:-1]:
                    pair = [now if k == at else x for k, x in enumerate(level) if k // 2 == at // 2]
                    proof += [x for k, x in enumerate(level) if k // 2 == at // 2 and k != at]
                    now, at = H("".join(pair)), at // 2
            out.append((r[0], leaf(r), built[n][-1][0], top[-1][0], H("".join(proof)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1, 1], [33, 1, 2, 32, 64, 65], [1100, 3]])
def test_proofs(spark, sizes):
    rng = random.Random(sum(sizes))
    langs = [None, "en", "", "é", "zz", "a:b"]
    rows = [(rng.choice([None, 5, *range(2000)]), rng.choice([None, "", "text", "ü" * 9]), rng.choice([None, "s", "-"]), langs[k], rng.choice([None, 9, 10])) for k, n in enumerate(sizes) for _ in range(n)]
    hit = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, tree int")
    got = merkle.proofs(frame, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")), 256).alias("proof"), "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == naive_merkle(rows, hit)
    assert spark.conf.get(merkle.ROW_LIMIT) == "1000000"


def test_proofs_of_no_rows_and_of_equal_rows(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    assert merkle.proofs(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "same", "s", "en", 4)] * 3000
    got = merkle.proofs(spark.createDataFrame(rows, schema))
    assert got.count() == 3000 and got.filter("verified").count() == 3000 and got.select("root").distinct().count() == 1
