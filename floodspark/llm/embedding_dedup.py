"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector o is rotated to ``CODE_BITS`` dimensions by fixed random orthonormal columns and kept as
the signs of its coordinates, with the stored factor f = <code, rotated o>. For another vector q,
<code, rotated q> / f is an unbiased estimate of <o, q> whose error exceeds
eps * sqrt((1 - f**2) / f**2 / (CODE_BITS - 1)) with probability below 2 exp(-eps**2 / 2). q enters as
4-bit integers, so an estimate is a few bit counts; a pair whose bound stays below the threshold is
dismissed, every other one is recomputed in double precision.

Which pairs are looked at: those whose codes agree on all of a table's bits, for so many tables that a
pair right at the threshold is missed by all with a probability below ``miss`` (closer pairs far more rarely). A pair
counts in the first table that it meets in, so counts need no pair list. Vectors meet those of their own length.

Only codes, factors and 4-bit numbers go to the tables. Rows that have a pair there which is not dismissed, in the
first table where it meets, then get their vectors and are compared exactly in the same block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common as c
from floodspark.llm import graph

CODE_BITS = 128
LEVELS = 15
PAIRS_AT_ONCE = 1 << 18


@functools.lru_cache(16)
def rotation(dim: int, bits: int = CODE_BITS, seed: int = 1) -> np.ndarray:
    """dim x bits; orthonormal rows, so inner products survive (bits >= dim)."""
    bits = max(bits, -(-dim // 64) * 64)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0][:dim]


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x bits/64 uint64) and correction factors of unit vectors."""
    x = unit @ turn
    return np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64), np.abs(x).sum(axis=1) / math.sqrt(turn.shape[1])


class Codes:
    """What a table needs of vectors: codes, factors, and the rotated vectors as 4-bit numbers (low + step * number)."""

    def __init__(self, codes: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, total: np.ndarray) -> None:
        self.codes, self.factor, self.planes, self.low, self.step, self.total = codes, factor, planes, low, step, total

    @classmethod
    def of(cls, unit: np.ndarray, turn: np.ndarray) -> Codes:
        codes, factor = encode(unit, turn)
        x = unit @ turn
        low = x.min(axis=1)
        step = np.maximum((x.max(axis=1) - low) / LEVELS, 1e-12)
        whole = np.rint((x - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([np.packbits((whole >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(4)], axis=1)
        return cls(codes, factor, planes, low, step, whole.sum(axis=1) * step + low * x.shape[1])

    def rows(self) -> list[bytes]:
        """One binary for each vector."""
        numbers = np.stack([self.factor, self.low, self.step, self.total], axis=1).astype("<f8").view(np.uint64)
        both = np.concatenate([numbers, self.codes, self.planes.reshape(len(self.codes), -1)], axis=1)
        return [x.tobytes() for x in both]

    @classmethod
    def read(cls, column: pa.Array) -> Codes:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
        words = (raw.shape[1] - 4) // 5
        numbers = np.ascontiguousarray(raw[:, :4]).view("<f8")
        return cls(np.ascontiguousarray(raw[:, 4 : 4 + words]), numbers[:, 0], np.ascontiguousarray(raw[:, 4 + words :]).reshape(len(raw), 4, words), numbers[:, 1], numbers[:, 2], numbers[:, 3])

    def bound(self, a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
        """Upper confidence bounds of the inner products of vectors a and b, from a's codes and b's 4-bit numbers."""
        bits = 64 * self.codes.shape[1]
        ones = np.bitwise_count(self.codes[a]).sum(axis=1, dtype=np.int64)
        both = np.bitwise_count(self.codes[a][:, None, :] & self.planes[b]).sum(axis=2, dtype=np.int64) @ np.array([1, 2, 4, 8])
        dot = (2 * (both * self.step[b] + self.low[b] * ones) - self.total[b]) / math.sqrt(bits)
        # random error of the code, and of rounding to a step (uniform, so a standard deviation of step / sqrt(12))
        slack = eps * np.sqrt(np.maximum(1 - self.factor[a] ** 2, 0) / self.factor[a] ** 2 / (bits - 1))
        return dot / self.factor[a] + slack + eps * self.step[b] / math.sqrt(12) / self.factor[a]


def missed(count: int, width: int, threshold: float, bits: int) -> float:
    """Probability that a pair right at the threshold meets in none of ``count`` tables of ``width`` code bits. The
    tables sample the same code, so it is the mean over the number of bits in which the pair's codes differ."""
    differ = math.acos(min(threshold, 1.0)) / math.pi
    total = 0.0
    for m in range(bits + 1):
        chance = math.comb(bits, m) * differ**m * (1 - differ) ** (bits - m)
        total += chance * (1 - math.comb(bits - m, width) / math.comb(bits, width)) ** count
    return total


@functools.lru_cache(16)
def tables(n: int, threshold: float, miss: float, bits: int) -> list[np.ndarray]:
    """Bit masks (bits/64 words each): more bits a table for more vectors, more tables for more bits."""
    width = int(min(bits, max(4, math.ceil(math.log2(max(n, 2))) - 8)))
    most = 1
    while missed(most, width, threshold, bits) > miss:
        most *= 2
    least = most // 2
    while most - least > 1:
        middle = (least + most) // 2
        least, most = (middle, most) if missed(middle, width, threshold, bits) > miss else (least, middle)
    masks = []
    for t in range(most):
        on = np.zeros(bits, np.uint8)
        on[np.random.default_rng(1000 + t).permutation(bits)[:width]] = 1
        masks.append(np.packbits(on, bitorder="little").view(np.uint64))
    return masks


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-3, eps: float = 4.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Links are pairs with a cosine of at least ``threshold`` in double precision; n_links counts the other
    rows linked directly, component_id is the smallest vec_id that links reach, kept says that it is the
    row's own. Equal vectors are compared once and counted with their copies. Nulls and edges: vectors
    that are null, empty or zero, or that hold null or non-finite components, link with nothing; vectors of other
    lengths have no cosine, so each length is a table of its own; a null vec_id is never a component's smallest, unless it has no
    other; rows that repeat a vec_id count as rows of their own. An empty table gives no rows.
    """
    vec = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"))
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.to_json("v"), 256)))
    distinct = c.stored(rows.filter("key is not null").groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.xxhash64("key")))
    n = distinct.count()
    about = lambda dim: (rotation(dim), tables(n, threshold, miss, rotation(dim).shape[1]))

    def units(column: pa.Array, dim: int) -> np.ndarray:
        x = column.flatten().to_numpy().reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def by_length(table, f) -> list:
        """``f(rows, length)`` of the rows of each vector length (column dim)."""
        size = table.column("dim").to_numpy()
        return [f(table.filter(pa.array(size == dim)), dim) for dim in np.unique(size).tolist()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the tables need of each vector, and its key in every one."""

        def rows(part: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
            turn, masks = about(dim)
            codes = Codes.of(units(part.column("v"), dim), turn)
            sent = pa.array(codes.rows(), pa.binary())
            for t, m in enumerate(masks):
                key = c.mix((codes.codes & m) @ c.powers(c.BASE, codes.codes.shape[1]) + np.uint64(t + (dim << 16)) * c.ODD).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dim"), sent, pa.array(np.full(len(key), t, np.int32)), pa.array(key)], ["id", "dim", "sent", "t", "key"])

        for batch in batches:
            for made in by_length(batch, rows):
                yield from made

    # tables x vectors rows of short numbers; they are met twice, by the counts of their keys and by each other
    coded = distinct.select("id", F.size("v").alias("dim"), "v").mapInArrow(spread, "id long, dim int, sent binary, t int, key long")
    met = graph.blocks(coded, ["t", "key"], "id")

    def likely_pairs(table: pa.Table, codes: Codes, masks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a block whose bound reaches the threshold, each in the first table where it meets."""
        t, key, own, i, j = (table.column(x).to_numpy() for x in ("t", "key", "own", "i", "j"))
        group = np.unique(np.stack([t.astype(np.int64), key, i.astype(np.int64), j.astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)
        for x_all, y_all in graph.pairs(group, own, i != j):
            for at in range(0, len(x_all), PAIRS_AT_ONCE):
                x, y = x_all[at : at + PAIRS_AT_ONCE], y_all[at : at + PAIRS_AT_ONCE]
                likely = codes.bound(x, y, eps) >= threshold
                x, y = x[likely], y[likely]
                fresh = np.ones(len(x), bool)
                for s, m in enumerate(masks):
                    fresh &= (t[x] <= s) | (((codes.codes[x] ^ codes.codes[y]) & m) != 0).any(axis=1)
                yield x[fresh], y[fresh]

    def asking(table: pa.Table) -> pa.Table:
        """Rows of this block that need their vectors."""

        def some(part: pa.Table, dim: int) -> pa.Table:
            need = np.zeros(part.num_rows, bool)
            for x, y in likely_pairs(part, Codes.read(c.flat(part.column("sent"))), about(dim)[1]):
                need[x] = need[y] = True
            return part.filter(pa.array(need)).select(["id", "dim", "sent", "t", "key", "own", "i", "j", "part"])

        return pa.concat_tables(by_length(table, some))

    asked = met.groupBy("part").applyInArrow(asking, "id long, dim int, sent binary, t int, key long, own int, i int, j int, part int")
    given = asked.join(distinct.select("id", "copies", "v"), "id")

    def compare(table: pa.Table) -> pa.Table:
        return pa.concat_tables(by_length(table, compared))

    def compared(table: pa.Table, dim: int) -> pa.Table:
        """Links of each row of this block (weighted by copies), and edges that connect what is linked."""
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        unit = units(c.flat(table.column("v")), dim)
        linked = np.zeros(len(ids), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x, y in likely_pairs(table, Codes.read(c.flat(table.column("sent"))), about(dim)[1]):
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[near], y[near]
            linked += np.bincount(x, copies[y], len(ids)).astype(np.int64) + np.bincount(y, copies[x], len(ids)).astype(np.int64)
            a, b = np.concatenate([a, ids[x]]), np.concatenate([b, ids[y]])
            if len(a) > 1 << 20:
                a, b = graph.stars(a, b)
        a, b = graph.stars(a, b)
        some = np.flatnonzero(linked)
        return pa.table({"a": pa.array(np.concatenate([ids[some], a])), "b": pa.array(np.concatenate([ids[some], b])), "n": pa.array(np.concatenate([linked[some], np.zeros(len(a), np.int64)]))})

    found = c.stored(given.groupBy("part").applyInArrow(compare, "a long, b long, n long"))
    counts = found.filter("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = graph.components(found.filter("a <> b").select("a", "b"))
    labelled = distinct.select("key", "id", "least", "copies").join(counts, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    leads = labelled.groupBy("component").agg(F.min("least").alias("lead"))
    by_key = labelled.join(leads, "component").select("key", "lead", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    whole = rows.select("vec_id", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("lead"))
    return whole.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
