"""Groups of rows that share a key, compared in blocks, and connected components of what they link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c

#: Rows of one key that one block holds; larger keys are compared block against block.
BLOCK = 512
#: Rows of many small keys that one task handles together.
PART_ROWS = 50_000


def blocks(rows: DataFrame, keys: list[str], split_by: str, block: int = BLOCK) -> DataFrame:
    """Rows whose ``keys`` other rows have too, with i, j, own and part: every two rows of a key meet in
    exactly one (keys, i, j), as the two of block i if i = j, else as one of block i and one of j. No
    key, however many rows it has, needs more than two blocks in one place."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    found = rows.join(counts, keys).withColumn("_b", F.ceil(F.col("_n") / block).cast("int"))
    own: Column = F.pmod(F.xxhash64(split_by), F.col("_b")).cast("int")
    found = found.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    found = found.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    spark = rows.sparkSession
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = counts.agg(F.sum(F.col("_n") * F.ceil(F.col("_n") / block))).first()[0] or 0
    return found.withColumn("part", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(max(least, -(-n // PART_ROWS)))).cast("int")).drop("_n", "_b", "other")


def pairs(key: np.ndarray, own: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal ``key`` (of different ``own`` where ``cross``), as a few arrays at a time."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(new)[1:], len(k)) - 1
    end = last[np.cumsum(new) - 1] if len(k) else last
    at = np.flatnonzero(np.arange(len(k)) < end)
    step = 1
    while len(at):
        a, b = order[at], order[at + step]
        keep = ~cross[a] | (own[a] != own[b])
        yield a[keep], b[keep]
        step += 1
        at = at[at + step <= end[at]]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that connect what the edges (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id in ``edges`` (a, b; long, not null).

    Alternating large-star and small-star steps; every step is two partial aggregations and joins, and
    its edges are written to the shared folder. Only counts and sums reach the driver.
    """
    now = c.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:  # until a step changes nothing
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        old, now = now, c.stored(small.unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        c.forget(old)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
