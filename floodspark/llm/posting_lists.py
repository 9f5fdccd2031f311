"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample: it is halved again and again across the direction that parts it best, at the median, so
all lists have the same share of the sample. A vector goes to the list of its nearest centroid, and to others nearly as near
(``BOUNDARY``), a nearer one of which does not already stand for it. Centroids are found by a beam search in a graph of
their neighbours, held in memory; a query looks into the lists whose centroid is within ``1 + RATIO`` of the nearest's
distance, ``LEAST_LISTS`` at least: the beam grows until it has left that ratio behind, so no number of lists cuts it off.

Equal vectors stand in the lists with their ``top + 1`` smallest ids: no answer can hold more of them, so nothing is lost
by a vector that a third of the rows repeat. Equal queries are searched once. Lists of any length are searched in blocks.
A query that finds fewer than it should looks into all lists of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm import common as c
from floodspark.llm.ranks import attached

#: Vectors that a list is meant to hold, and the sample that centroids come from: at most so many vectors, and so many numbers
#: of all lengths together. With more than SAMPLE / 8 lists' worth of vectors, lists grow longer instead.
LIST, SAMPLE, SAMPLE_VALUES = 512, 65_536, 1 << 22
#: A vector's other lists: centroids within 1 + BOUNDARY of its nearest one's distance, unless one of its lists stands closer to
#: them than HIDDEN times their distance from it; this many lists in all.
BOUNDARY, HIDDEN, REPLICAS = 0.05, 0.3, 4
#: A query's lists.
RATIO, LEAST_LISTS = 0.15, 8
#: Neighbours of a centroid in the graph, centroids opened at once, and the first width of a beam.
DEGREE, OPENED, BEAM = 16, 4, 16
#: Vectors and queries that meet in one place.
BLOCK, QUERIES = 4096, 1024


def halved(x: np.ndarray, lists: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of ``lists`` equally large groups of ``x``; groups that are halves of one group follow each other."""
    if lists < 2 or len(x) < 2:
        return [x.mean(axis=0)]
    a = x[rng.integers(len(x))]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    a = x[((x - b) ** 2).sum(axis=1).argmax()]
    first = lists // 2
    for _ in range(8):
        order = np.argsort(-(x @ (a - b)), kind="stable")
        at = max(1, len(x) * first // lists)
        left, right = x[order[:at]], x[order[at:]]
        a, b = left.mean(axis=0), right.mean(axis=0)
    return halved(left, first, rng) + halved(right, lists - first, rng)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y, to rounding."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (x @ y.T), 0)


@dataclass
class Centroids:
    """Centroids of one vector length, and each one's neighbours: the nearest, and those beside it in the order of halving,
    which leave no part of the graph out of reach."""

    at: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, lists: int) -> Centroids:
        at = np.unique(np.stack(halved(sample, lists, np.random.default_rng(5))), axis=0)
        order, n = np.arange(len(at)), len(at)
        degree, near = min(DEGREE, n - 1), np.zeros((n, 0), np.int64)
        if degree:
            near = np.concatenate([np.argpartition(squares(at[k : k + 512], at) + np.where(np.arange(n) == order[k : k + 512, None], np.inf, 0), degree - 1, axis=1)[:, :degree] for k in range(0, n, 512)])
        return cls(at, np.concatenate([near, ((order + 1) % n)[:, None], ((order - 1) % n)[:, None]], axis=1))

    def beam(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each row of x, nearest first, and their distances."""
        n, rows = len(self.at), np.arange(len(x))[:, None]
        width = min(width, n)
        entries = np.unique(np.linspace(0, n - 1, min(n, 2 * BEAM)).astype(np.int64))
        ids, d = np.tile(entries, (len(x), 1)), squares(x, self.at[entries])
        seen, opened = np.zeros((len(x), n), bool), np.zeros((len(x), n), bool)
        seen[:, entries] = True
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            closed = opened[rows, ids] | np.isinf(d)
            if closed.all():
                return ids, np.sqrt(d)
            next_ = np.argsort(closed, axis=1, kind="stable")[:, :OPENED]
            new = ids[rows, next_]
            fresh = ~closed[rows, next_]
            opened[np.repeat(rows, new.shape[1], 1)[fresh], new[fresh]] = True
            met = np.sort(np.where(np.repeat(fresh, self.near.shape[1], 1), self.near[new].reshape(len(x), -1), n), axis=1)
            again = np.concatenate([np.zeros((len(x), 1), bool), met[:, 1:] == met[:, :-1]], axis=1) | (met == n)
            met = np.minimum(met, n - 1)
            again |= seen[rows, met]
            seen[np.repeat(rows, met.shape[1], 1)[~again], met[~again]] = True
            at = np.full(met.shape, np.inf)
            r, k = np.nonzero(~again)
            at[r, k] = ((x[r] - self.at[met[r, k]]) ** 2).sum(axis=1)
            ids, d = np.concatenate([ids, met], axis=1), np.concatenate([d, at], axis=1)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of x and list: its nearest, and boundary lists that no nearer list of its own stands closer to than it does."""
        ids, d = self.beam(x, BEAM)
        keep = np.zeros(ids.shape, bool)
        keep[:, 0] = True
        for k in range(1, ids.shape[1]):
            gap = np.sqrt(((self.at[ids[:, :k]] - self.at[ids[:, k]][:, None, :]) ** 2).sum(axis=2))
            hidden = (keep[:, :k] & (gap < HIDDEN * d[:, k : k + 1])).any(axis=1)
            keep[:, k] = (d[:, k] <= (1 + BOUNDARY) * d[:, 0]) & ~hidden & (keep.sum(axis=1) < REPLICAS)
        r, k = np.nonzero(keep)
        return r, ids[r, k]

    def lists(self, x: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """Row of x and list, for the lists that each query looks into."""
        n = len(self.at)
        if every:
            return np.repeat(np.arange(len(x)), n), np.tile(np.arange(n), len(x))
        width, rows, found = 2 * BEAM, np.arange(len(x)), []
        while len(rows):
            ids, d = self.beam(x[rows], width)
            done = (d[:, -1] > (1 + RATIO) * d[:, 0]) | (ids.shape[1] == n)
            take = (d <= (1 + RATIO) * d[:, :1]) | (np.arange(ids.shape[1]) < LEAST_LISTS)
            r, k = np.nonzero(take & done[:, None])
            found.append(np.stack([rows[r], ids[r, k]]))
            rows, width = rows[~done], 2 * width
        r, k = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return r, k


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return c.flat(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(queries: DataFrame, vectors: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of the ``top`` nearest rows of ``vectors``
    (vec_id, embedding) found for each of ``queries`` (same columns); nearest first, equally near ones by vec_id.

    A query's own vec_id is no candidate. Vectors that are null, empty or zero, or hold null or non-finite components, and rows
    without vec_id take no part on either side; vectors of other lengths have no distance, so a query may have fewer
    candidates, and then gives all. Rows equal in vec_id and vector count once. No usable rows: no results.
    """
    spark = vectors.sparkSession
    c.small_batches(spark)

    def usable(rows: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
        return rows.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).distinct()

    few = Window.partitionBy("v").orderBy("vec_id")
    points = usable(vectors).withColumn("n", F.row_number().over(few)).filter(F.col("n") <= top + 1)
    points = c.stored(points.select("vec_id", "v", F.size("v").alias("dim")))
    sizes = {r.dim: r.n for r in points.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > LIST).collect()}  # other lengths are one list each
    models: dict[int, Centroids] = {}
    for dim, n in sizes.items():
        most = min(SAMPLE, max(8 * LIST, SAMPLE_VALUES // (dim * len(sizes))))
        sample = points.filter(F.col("dim") == dim).orderBy(F.xxhash64("v", "vec_id")).limit(most).select("v").toArrow()
        models[dim] = Centroids.of(matrix(sample.column("v"), dim), max(1, min(-(-n // LIST), sample.num_rows // 8)))

    asked = c.stored(usable(queries).withColumn("key", F.sha2(F.to_json(F.transform("v", lambda x: x.cast("double"))), 256)))
    distinct = c.stored(asked.groupBy("key").agg(F.first("v").alias("v")).withColumn("dim", F.size("v")))

    def dealt(rows: DataFrame, name: str, f) -> DataFrame:
        """A row of ``rows`` (``name``, v, dim) for each of its lists; ``f(centroids, x)`` gives rows and lists."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    for at in range(0, part.num_rows, 256):
                        some = part.slice(at, 256)
                        r, k = (np.arange(some.num_rows), np.zeros(some.num_rows, np.int64)) if dim not in models else f(models[dim], matrix(some.column("v"), dim))
                        for a in range(0, len(r), 4096):
                            own = some.take(pa.array(r[a : a + 4096]))
                            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(k[a : a + 4096], pa.int32())], [*own.schema.names, "lst"])

        wanted = rows.select(name, "v", "dim")
        return wanted.mapInArrow(spread, f"{name} {dict(wanted.dtypes)[name]}, v {dict(wanted.dtypes)['v']}, dim int, lst int")

    lists = c.stored(dealt(points, "vec_id", lambda m, x: m.homes(x)))
    # a row for each list: SAMPLE / 8 at most of each length
    lengths = c.stored(lists.groupBy("dim", "lst").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))

    def met(table: pa.Table, other: pa.Table) -> pa.Table:
        """The nearest of one block of a list for one block of queries."""
        out: list[list] = [[], [], []]
        if table.num_rows and other.num_rows:
            dim = table.column("dim")[0].as_py()
            x, ids, q, keys = matrix(table.column("v"), dim), table.column("vec_id").to_numpy(), matrix(other.column("v"), dim), other.column("key").to_pylist()
            small, kept = 1e-9 * (1 + (x**2).sum(axis=1).max()), min(top + 1, len(x))
            for at in range(0, len(q), 64):
                near = squares(q[at : at + 64], x)
                edge = np.partition(near, kept - 1, axis=1)[:, kept - 1] + small * (1 + (q[at : at + 64] ** 2).sum(axis=1))
                for k, line in enumerate(near):
                    likely = np.flatnonzero(line <= edge[k])
                    d = np.sqrt(np.cumsum((x[likely] - q[at + k]) ** 2, axis=1)[:, -1])  # one term after the other, as SQL adds
                    first = np.lexsort((ids[likely], d))[:kept]
                    out[0].append(keys[at + k])
                    out[1].append(d[first])
                    out[2].append(ids[likely][first])
        return pa.table({"key": pa.array(out[0], pa.string()), "d": pa.array(out[1], pa.list_(pa.float64())), "id": pa.array(out[2], pa.list_(pa.int64()))})

    cell = ["dim", "lst", "i", "j"]

    def searched(some: DataFrame, every: bool) -> DataFrame:
        """key and found (up to top + 1 of d and id, in order)."""
        looks = c.stored(dealt(some, "key", lambda m, x: m.lists(x, every)))
        asks = looks.groupBy("dim", "lst").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        shape = F.broadcast(lengths.join(asks, ["dim", "lst"]))  # as many rows as lists
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lists.join(shape, ["dim", "lst"]).withColumn("i", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int")).withColumn("j", each("groups"))
        theirs = looks.join(shape, ["dim", "lst"]).withColumn("j", F.pmod(F.xxhash64("key"), "groups").cast("int")).withColumn("i", each("blocks"))
        own, theirs = own.select(*cell, "vec_id", "v"), theirs.select(*cell, "key", "v")
        pairs = own.groupBy(*cell).cogroup(theirs.groupBy(*cell)).applyInArrow(lambda a, b: met(a, b), "key string, d array<double>, id array<long>")
        best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "id")))), 1, (top + 1) * REPLICAS)
        best = pairs.groupBy("key").agg(best.alias("best"))
        once = F.filter("best", lambda x, k: (k == 0) | (x["id"] != F.element_at("best", F.greatest(k, F.lit(1)))["id"]))  # a replica is next to its copy
        return best.select("key", F.slice(once, 1, top + 1).alias("found"))

    found = c.stored(searched(distinct, False))
    # fewer than there are to find: look everywhere
    there = points.groupBy("dim").agg(F.least(F.count("*"), F.lit(top + 1)).alias("there"))
    short = c.stored(attached(distinct, found, ["key"]).join(F.broadcast(there), "dim").filter(F.coalesce(F.size("found"), F.lit(0)) < F.col("there")).select("key", "v", "dim"))
    if short.head(1):
        found = c.stored(found.join(short, "key", "left_anti").unionByName(searched(short, True)))
    answers = attached(asked.select("vec_id", "key"), found, ["key"]).withColumnRenamed("vec_id", "query_id")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, top)
    return answers.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
