"""Embedding near-dedup against all pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from floodspark.llm import embedding_dedup as e


def vectors(seed=0, n=400, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 4):  # near copies around the threshold
        x[k + 1] = x[k] + rng.normal(size=dim) * rng.uniform(0.05, 0.5)
    x[10], x[11], x[12] = x[5], 2 * x[5], x[5]
    x[100:160] = x[100] + rng.normal(size=(60, dim)) * 0.08
    return x


def brute(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[np.flatnonzero(link[i])]]) for i in range(len(x))])
        if (new == label).all():
            return link.sum(axis=1), label
        label = new


def test_links_equal_all_pairs(spark):
    x = vectors()
    links, label = brute(x, 0.95)
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, key int")
    got = {r.vec_id: r for r in e.near_duplicates(df, 0.95).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * links.sum() and all(got[i].n_links <= links[i] for i in got)
    assert sum(got[i].component_id == label[i] for i in got) >= 0.99 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])]
    got = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted([("1", 3, "1"), ("2", 3, "1"), ("2", 3, "1"), ("None", 3, "1"), *((str(i), 0, str(i)) for i in range(3, 10))])
    assert e.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    x = vectors(2, 2000, 64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    turn = e.rotation(64)
    codes = e.Codes.read(pa.array(e.Codes.of(u, turn).rows()))
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2000, 5000), rng.integers(0, 2000, 5000)
    true = np.einsum("ij,ij->i", u[a], u[b])
    upper, middle = codes.bound(a, b, 4.0), codes.bound(a, b, 0.0)
    assert (upper >= true).mean() > 0.999
    assert abs((middle - true).mean()) < 0.01 and np.abs(middle - true).mean() < 0.1


def test_float_vectors_and_labels_are_ignored(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1], 0), (2, [1.0, 0.11], 1)], "vec_id long, embedding array<float>, label int")
    assert [r.n_links for r in e.near_duplicates(df.withColumn("code", F.lit("x"))).collect()] == [1, 1]


def test_every_length_links_its_own(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.01]), (5, [1.0, 0.02]), (6, [-1.0] * 200), (7, [-1.0] * 199 + [-1.1])]
    got = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (1, 6), 7: (1, 6)}


def test_probability_of_a_miss():
    """Codes of pairs right at the threshold: the share that no table brings together."""
    rng = np.random.default_rng(5)
    turn, masks = e.rotation(64), e.tables(5000, 0.95, 1e-2, 128)
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    differ = e.encode(a, turn)[0] ^ e.encode(b, turn)[0]
    missed = np.all([((differ & m) != 0).any(axis=1) for m in masks], axis=0).mean()
    assert missed < 1.5e-2
