"""Surrogate of depth, velocity and arrival together: training corridor, scenario answers, Monte Carlo histograms, folds.

A corridor cell is one row: the transformed values of all runs for the three outputs (log1p of depth and velocity, arrival
filled with the end of the runs). A predicted map is a weighted sum of the runs' maps, so the driver holds runs x runs and
runs x components numbers for each output and no cell; every task works off its own cells, whatever is asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.operators import surrogate as s
from floodspark.sources.io import kept

OUTPUTS = ("depth", "velocity", "arrival")
# Thresholds and normal quantiles of the method; fixed values.
WET_M, EXTENT_M, ARRIVAL_M, BAND_Z, P90_Z = 0.03, 0.3, 0.1, 1.645, 1.2815515655446004
#: Cells that are put together at once.
CELLS = 4096
#: Bins of a histogram, samples that tasks hold at once, and samples of one pass.
BINS, CHUNK, PASS = 64, 256, 20_000


def corridor(maps: DataFrame, width: int, height: int, wet_m: float = WET_M, buffer: int = 3, tile: int = 256) -> DataFrame:
    """cell_id of row-major cells that some run wets, and all within ``buffer`` four-neighbour steps, with lo and hi: the
    smallest and the largest run (column i) that does. A cell with lo = hi is in the corridor for that run alone. Wet cells go to their
    tile, and near its edge to the next one too; every tile widens its own."""
    wet = maps.filter(F.col("depth_m") > wet_m).groupBy("cell_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    if not buffer:
        return wet
    near = lambda x: F.explode(F.array_distinct(F.array(*(F.floor((F.col(x) + d) / tile).cast("int") for d in (-buffer, 0, buffer)))))
    spread = wet.select("lo", "hi", F.floor(F.col("cell_id") / width).cast("int").alias("r"), (F.col("cell_id") % width).cast("int").alias("c")).withColumn("tr", near("r")).withColumn("tc", near("c"))

    def widened(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        side = tile + 2 * buffer
        lo, hi = np.full((side + 2, side + 2), 1 << 30), np.full((side + 2, side + 2), -1)
        r, c = (table.column(x).to_numpy() - t * tile + buffer + 1 for x, t in (("r", tr), ("c", tc)))
        lo[r, c], hi[r, c] = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        for _ in range(buffer):
            for grid, least in ((lo, np.minimum), (hi, np.maximum)):
                old = grid.copy()
                for step in ((0, 1), (2, 1), (1, 0), (1, 2)):
                    grid[1:-1, 1:-1] = least(grid[1:-1, 1:-1], old[step[0] : step[0] + side, step[1] : step[1] + side])
        own = slice(buffer + 1, buffer + 1 + tile)
        r, c = np.nonzero(hi[own, own] >= 0)
        keep = (r + tr * tile >= 0) & (r + tr * tile < height) & (c + tc * tile >= 0) & (c + tc * tile < width)
        r, c = r[keep], c[keep]
        return pa.table({"cell_id": (r + tr * tile).astype(np.int64) * width + c + tc * tile, "lo": pa.array(lo[own, own][r, c], pa.int32()), "hi": pa.array(hi[own, own][r, c], pa.int32())})

    return spread.groupBy("tr", "tc").applyInArrow(widened, "cell_id long, lo int, hi int")


def physical(z: np.ndarray, output: int, t_end: float) -> np.ndarray:
    """Values of transformed ones: depth and velocity not negative, arrival between 0 and the end."""
    return np.clip(z, 0, t_end) if output == 2 else np.maximum(np.expm1(z), 0)


def values(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Cells x 3 x runs."""
    return batch.column("ys").flatten().to_numpy().reshape(-1, 3, n)


def products(y: np.ndarray) -> np.ndarray:
    """Inner products of the runs, for each output."""
    return np.stack([x.T @ x for x in np.ascontiguousarray(y.transpose(1, 0, 2))])


def decoded(y: np.ndarray, latent: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Transformed mean and deviation (cells x queries) of each output for a block of cells."""
    for o, (mean, sd) in enumerate(latent):
        w = y[:, o] @ weights[o]
        yield y[:, o].mean(axis=1)[:, None] + w @ mean.T, np.sqrt((w**2) @ (sd**2).T)


def sampled(y: np.ndarray, draws: list[np.ndarray], weights: list[np.ndarray], t_end: float) -> list[np.ndarray]:
    """Depth, velocity and arrival (cells x samples) of a block of cells."""
    return [physical(y[:, o].mean(axis=1)[:, None] + (y[:, o] @ weights[o]) @ d.T, o, t_end) for o, d in enumerate(draws)]


def schema_of(keys: str, doubles: list[str]) -> str:
    return ", ".join([keys, *(f"{x} double" for x in doubles)])


@dataclass
class Part:
    """What one output has on the driver: scores (runs x components), what weights the runs' maps for each component, shares."""

    scores: np.ndarray
    weights: np.ndarray
    explained: np.ndarray


class Emulator:
    """Principal components of the three outputs' maps over the corridor.

    ``maps``: run_id, cell_id (row-major), depth_m, velocity_ms, arrival_s; null depths and velocities are 0, null arrivals never.
    ``wide`` has cell_id, only (the run that alone has the cell in the corridor, else -1) and ys, the values of depth, velocity
    and arrival of all runs in their order.
    """

    def __init__(self, maps: DataFrame, width: int, height: int, t_end: float, share: float = 0.99, wet_m: float = WET_M, buffer: int = 3) -> None:
        self.runs, self.t_end, self.spark = s.run_list(maps), float(t_end), maps.sparkSession
        self.n = n = len(self.runs)
        places = F.broadcast(self.spark.createDataFrame([(r, i) for i, r in enumerate(self.runs)], "run_id int, i int"))  # as many rows as runs
        maps = maps.select(F.col("run_id").cast("int").alias("run_id"), F.col("cell_id").cast("long").alias("cell_id"), "depth_m", "velocity_ms", F.col("arrival_s").cast("double").alias("arrival_s")).join(places, "run_id")
        block = F.floor(F.col("cell_id") / CELLS).alias("block")
        marked = corridor(maps, width, height, wet_m, buffer).select(block, "cell_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).cast("int").alias("only"))
        some = (F.col("depth_m") > 0) | (F.col("velocity_ms") > 0) | F.col("arrival_s").isNotNull()  # others are as if absent
        rows = maps.filter(some).select(block, "cell_id", "i", *(F.col(x).cast("double").alias(x) for x in ("depth_m", "velocity_ms", "arrival_s")))

        def placed(table: pa.Table, cells: pa.Table) -> pa.Table:
            cells = cells.sort_by("cell_id")
            known, ids = cells.column("cell_id").to_numpy(), table.column("cell_id").to_numpy()
            at = np.searchsorted(known, ids).clip(0, max(len(known) - 1, 0))
            keep = known[at] == ids if len(known) else np.zeros(len(ids), bool)
            at, i = at[keep], table.column("i").to_numpy()[keep]
            y = np.zeros((len(known), 3, n))
            y[:, 2] = t_end
            for k, name in enumerate(("depth_m", "velocity_ms", "arrival_s")):
                value = table.column(name).to_numpy()[keep]
                value = np.where(np.isnan(value), t_end if k == 2 else 0.0, value)
                y[at, k, i] = np.clip(value, 0, t_end) if k == 2 else np.log1p(np.maximum(value, 0))
            ys = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * (3 * n), y.reshape(-1))
            return pa.table({"cell_id": pa.array(known, pa.int64()), "only": cells.column("only"), "ys": ys})

        self.wide = kept(rows.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(lambda a, b: placed(a, b), "cell_id long, only int, ys array<double>"))
        self.centre = np.eye(n) - 1 / n
        self.gram = self.grams(False)[-1]
        self.parts = [Part(scores, self.centre @ weights, explained) for scores, weights, explained in (s.principal(self.centre @ g @ self.centre, share) for g in self.gram)]
        self.weights = [p.weights for p in self.parts]

    def grams(self, folds: bool) -> dict[int, np.ndarray]:
        """Inner products of the runs (3 x runs x runs) over all cells (-1), and with ``folds`` over the cells that only one
        run has in the corridor, by that run: a fold without it has the former less the latter. Tasks send sums."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                y, only = values(batch, n), batch.column("only").to_numpy()
                total[-1] = total.get(-1, 0) + products(y)
                for f in np.unique(only[only >= 0]) if folds else ():
                    total[int(f)] = total.get(int(f), 0) + products(y[only == f])
            for f, g in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([g.reshape(-1)])], ["fold", "g"])

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"fold": table.column("fold")[:1], "g": pa.array([sum(np.asarray(x) for x in table.column("g").to_numpy())])})

        found = self.wide.mapInArrow(run, "fold int, g array<double>").groupBy("fold").applyInArrow(add, "fold int, g array<double>").collect()
        return {r.fold: np.array(r.g).reshape(3, n, n) for r in found} or {-1: np.zeros((3, n, n))}

    # ------------------------------------------------------------------ queries
    def fit(self, design: DataFrame, names: list[str]) -> None:
        """A process for each output and component, each fitted in its own task on the runs' standardised inputs."""
        self.names, self.x = names, s.inputs(self.runs, design, names)
        x = self.x
        rows = [(o, k, [float(v) for v in p.scores[:, k]]) for o, p in enumerate(self.parts) for k in range(p.scores.shape[1])]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m = s.fit_process(x, np.array(pdf["scores"].iloc[0]))
            plain = {k: [np.ravel(v).tolist()] if isinstance(v, np.ndarray) else v for k, v in m.items()}
            return pd.DataFrame({"output": pdf["output"], "component": pdf["component"], **plain})

        kind = "output int, component int, length array<double>, amplitude double, noise double, alpha array<double>, inverse array<double>, shift double, scale double"
        frame = self.spark.createDataFrame(rows, "output int, component int, scores array<double>").repartition(len(rows), "output", "component")
        fitted = frame.groupBy("output", "component").applyInPandas(run, kind).toPandas()
        n = len(x)
        self.models = {(r.output, r.component): {"length": np.array(r.length), "amplitude": r.amplitude, "noise": r.noise, "alpha": np.array(r.alpha), "inverse": np.array(r.inverse).reshape(n, n), "shift": r.shift, "scale": r.scale} for r in fitted.itertuples()}

    def latent(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Mean and deviation of the scores (queries x components) of each output."""
        out = []
        for o, p in enumerate(self.parts):
            both = [s.predict_process(self.models[o, k], self.x, queries) for k in range(p.scores.shape[1])]
            out.append((np.stack([m for m, _ in both], axis=1), np.stack([d for _, d in both], axis=1)))
        return out

    def bands(self, queries: DataFrame, z: float = BAND_Z, opposite: bool = False) -> DataFrame:
        """query_id, cell_id, p (that the depth is over EXTENT_M) and central, low and high depth, velocity and arrival of every query and
        corridor cell, low and high at ``z`` deviations. Arrivals are null where the central depth is not over ARRIVAL_M, or with
        ``opposite`` where that of the other side's depth is not: the early one goes with the high depth."""
        asked = s.few(queries).toPandas()
        ids, latent, t_end, n = asked["query_id"].to_numpy(np.int64), self.latent(asked[self.names].to_numpy(float)), self.t_end, self.n
        weights = self.weights
        columns = [f"{o}_{b}" for o in OUTPUTS for b in ("central", "low", "high")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = max(1, 400_000 // max(len(ids), 1))
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    found = {}
                    for o, (mean, sd) in enumerate(decoded(values(part, n), latent, weights)):
                        ends = physical(mean - z * sd, o, t_end), physical(mean + z * sd, o, t_end)
                        found |= {f"{OUTPUTS[o]}_central": physical(mean, o, t_end), f"{OUTPUTS[o]}_low": np.minimum(*ends), f"{OUTPUTS[o]}_high": np.maximum(*ends)}
                        if o == 0:
                            p = 1 - cdf((np.log1p(EXTENT_M) - mean) / np.maximum(sd, 1e-12))
                    for b, other in (("central", "central"), ("low", "high" if opposite else "central"), ("high", "low" if opposite else "central")):
                        found[f"arrival_{b}"] = np.where(found[f"depth_{other}"] > ARRIVAL_M, found[f"arrival_{b}"], np.nan)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, part.num_rows)), pa.array(np.repeat(part.column("cell_id").to_numpy(), len(ids))), pa.array(p.reshape(-1)), *(pa.array(found[x].reshape(-1), from_pandas=True) for x in columns)], ["query_id", "cell_id", "p", *columns])

        return self.wide.select("cell_id", "ys").mapInArrow(run, schema_of("query_id long, cell_id long", ["p", *columns]))

    def scenario(self, queries: DataFrame, high: float = 0.9, possible: float = 0.1) -> DataFrame:
        """``bands`` between the 10th and the 90th percentile, with zone (2 high, 1 possible, 0 dry)."""
        zone = F.when(F.col("p") >= high, 2).when(F.col("p") >= possible, 1).otherwise(0)
        return self.bands(queries, P90_Z, opposite=True).withColumn("zone", zone)

    # ------------------------------------------------------------------ Monte Carlo
    def upper_bounds(self, corners: np.ndarray, z: float = 4.0, factor: float = 1.5, least: float = 1e-3):
        """A function of a block of values: upper ends (cells x 2) of depth and velocity over the corners of the inputs' box."""
        latent, weights, t_end = self.latent(corners), self.weights, self.t_end

        def ends(y: np.ndarray) -> np.ndarray:
            found = [physical(mean + z * sd, o, t_end).max(axis=1) for o, (mean, sd) in enumerate(decoded(y, latent[:2], weights))]
            return np.maximum(np.stack(found, axis=1) * factor, least)

        return ends

    def histograms(self, samples: DataFrame, corners: np.ndarray, seed: int = 0) -> DataFrame:
        """cell_id, n, wet (samples deeper than EXTENT_M), tops (upper ends) and counts, the 3 x BINS counts of depth, velocity
        and arrival over ``samples`` (query_id and the inputs), each with a draw of its scores. The last bin of arrivals is for
        never. Any number of samples: they are taken PASS at a time, and what passes count is added cell by cell.
        """
        passes = max(1, -(-samples.count() // PASS))
        done = None
        for k in range(passes):
            some = samples if passes == 1 else samples.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)
            one = self.counted(some.toPandas(), self.upper_bounds(corners), seed)
            done = one if done is None else done.unionByName(one)
        return done if passes == 1 else merged(done)

    def draws(self, samples: pd.DataFrame, seed: int) -> list[np.ndarray]:
        """Scores (samples x components) of each output: the process's mean and a normal deviate from the sample's number."""
        latent = self.latent(samples[self.names].to_numpy(float))
        ids = samples["query_id"].to_numpy(np.uint64)
        out = []
        for o, (mean, sd) in enumerate(latent):
            keys = ids[:, None] * np.uint64(1_000_003) + np.arange(mean.shape[1], dtype=np.uint64) * np.uint64(7919) + np.uint64(o * 104_729 + seed)
            out.append(mean + sd * normal(keys))
        return out

    def counted(self, samples: pd.DataFrame, ends, seed: int) -> DataFrame:
        draws, t_end, weights, runs, n = self.draws(samples, seed), self.t_end, self.weights, self.n, len(samples)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    y = values(part, runs)
                    tops = np.column_stack([ends(y), np.full(len(y), t_end * BINS / (BINS - 1))])
                    counts, wet, rows = np.zeros((len(y), 3, BINS), np.int64), np.zeros(len(y), np.int64), np.arange(len(y))[:, None]
                    for c in range(0, n, CHUNK):
                        found = sampled(y, [d[c : c + CHUNK] for d in draws], weights, t_end)
                        wet += (found[0] > EXTENT_M).sum(axis=1)
                        found[2] = np.where(found[0] > ARRIVAL_M, found[2], t_end)
                        for o, x in enumerate(found):
                            bins = np.clip((x / (tops[:, o, None] / BINS)).astype(np.int64), 0, BINS - 1)
                            counts[:, o] += np.bincount((rows * BINS + bins).reshape(-1), minlength=len(y) * BINS).reshape(len(y), BINS)
                    lists = lambda a: pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a[0].size, a.reshape(-1))
                    yield pa.RecordBatch.from_arrays([part.column("cell_id"), pa.array(np.full(len(y), n)), pa.array(wet), lists(tops), lists(counts)], ["cell_id", "n", "wet", "tops", "counts"])

        return self.wide.select("cell_id", "ys").mapInArrow(run, "cell_id long, n long, wet long, tops array<double>, counts array<long>")

    def at_points(self, samples: DataFrame, points: DataFrame, seed: int = 0) -> DataFrame:
        """poi_id and median, 10th and 90th percentile of depth, velocity and arrival (of the samples that arrive) at ``points`` (poi_id,
        cell_id), over the values of all samples. A point outside the corridor has no row."""
        here = self.wide.join(points.select("poi_id", "cell_id"), "cell_id").select("poi_id", "ys")
        passes, rows = max(1, -(-samples.count() // PASS)), None
        weights, runs, t_end = self.weights, self.n, self.t_end
        for k in range(passes):
            some = samples if passes == 1 else samples.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k)
            draws = self.draws(some.toPandas(), seed)

            def run(batches: Iterator[pa.RecordBatch], draws=draws) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(batch.num_rows):
                        part = batch.slice(at, 1)
                        d, v, a = (x[0] for x in sampled(values(part, runs), draws, weights, t_end))
                        yield pa.RecordBatch.from_arrays([pa.array(part.column("poi_id").to_pylist() * len(d)), pa.array(d), pa.array(v), pa.array(np.where(d > ARRIVAL_M, a, np.nan), from_pandas=True)], ["poi_id", *OUTPUTS])

            one = here.mapInArrow(run, schema_of(f"poi_id {dict(points.dtypes)['poi_id']}", list(OUTPUTS)))
            rows = one if rows is None else rows.unionByName(one)
        at = F.array(*map(F.lit, (0.5, 0.1, 0.9)))
        out = rows.groupBy("poi_id").agg(*(F.percentile(x, at).alias(x) for x in OUTPUTS))
        return out.select("poi_id", *(F.col(x)[k].alias(f"{x}_{b}") for x in OUTPUTS for k, b in enumerate(("central", "low", "high"))))

    # ------------------------------------------------------------------ validation
    def leave_one_out(self, design: DataFrame, names: list[str], k: int = 3, share: float = 0.99, methods: tuple[str, ...] = ("gp", "linear", "nearest", "projection")) -> DataFrame:
        """method, run_id and how well the run's maps are predicted without it, over the corridor of the whole design: iou and area_error_pct of
        the extent, f1 at 0.05, 0.1 and 0.3 m, depth_rmse and velocity_mae where truth or prediction is wet, arrival_mae and arrival_rmse where
        both arrive, and for the process the coverage of its interval by output. ``projection`` is the truth itself on the fold's components: no
        way of finding scores can do better.

        A fold's corridor is that of the other runs: outside of it everything is predicted dry. Its Gram matrices are the full ones
        less what the cells that only the left-out run has give. Cells are read twice: for the matrices, and to judge all folds.
        """
        n, x, spark, t_end = self.n, s.inputs(self.runs, design, names), self.spark, self.t_end
        if not 4 <= n <= s.MOST_FOLDS:
            raise ValueError(f"leave-one-out takes 4 to {s.MOST_FOLDS} runs")
        grams = self.grams(True)
        centre = np.eye(n - 1) - 1 / (n - 1)
        plans = {f: [] for f in range(n)}
        for f in range(n):
            rest = np.delete(np.arange(n), f)
            for o in range(3):
                own = (grams[-1][o] - (grams[f][o] if f in grams else 0))[rest]
                scores, weights, _ = s.principal(centre @ own[:, rest] @ centre, share)
                onto = (centre @ weights).T @ (own[:, f] - own[:, rest].mean(axis=1))  # the left-out truth on the fold's components
                plans[f].append((scores, centre @ weights, onto))
        fitted = {}
        if "gp" in methods:
            rows = [(f, o, c, [float(v) for v in plans[f][o][0][:, c]]) for f in range(n) for o in range(3) for c in range(plans[f][o][0].shape[1])]

            def run(pdf: pd.DataFrame) -> pd.DataFrame:
                f = int(pdf["fold"].iloc[0])
                others = np.delete(x, f, axis=0)
                mean, sd = zip(*(s.predict_process(s.fit_process(others, np.array(y), starts=3), others, x[f : f + 1]) for y in pdf["scores"]))
                return pd.DataFrame({"fold": pdf["fold"], "output": pdf["output"], "component": pdf["component"], "mean": np.concatenate(mean), "sd": np.concatenate(sd)})

            frame = spark.createDataFrame(rows, "fold int, output int, component int, scores array<double>").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism), "fold", "output", "component")
            fitted = {(r.fold, r.output, r.component): (r.mean, r.sd) for r in frame.groupBy("fold", "output", "component").applyInPandas(run, "fold int, output int, component int, mean double, sd double").collect()}
        weight = {m: np.zeros((3, n, n)) for m in methods}  # predicted = values @ weight
        spread = {}
        for f in range(n):
            rest, d = np.delete(np.arange(n), f), np.linalg.norm(np.delete(x, f, axis=0) - x[f], axis=1)
            for o, (scores, loading, onto) in enumerate(plans[f]):
                ways = {"projection": onto, "linear": np.concatenate([[1.0], x[f]]) @ np.linalg.lstsq(np.column_stack([np.ones(n - 1), x[rest]]), scores, rcond=None)[0]}
                if fitted:
                    ways["gp"], sd = (np.array([fitted[f, o, c][j] for c in range(scores.shape[1])]) for j in (0, 1))
                    spread[f, o] = np.zeros((n, scores.shape[1]))
                    spread[f, o][rest] = loading * sd
                for m, way in ways.items():
                    if m in methods:
                        weight[m][o][rest, f] = 1 / (n - 1) + loading @ way
            order = np.argsort(d, kind="stable")[: min(k, n - 1)]
            near = (np.arange(len(order)) == 0).astype(float) if d[order[0]] == 0 else 1 / d[order] ** 2
            if "nearest" in methods:
                weight["nearest"][0][rest[order], f] = near / near.sum()
        names_of = ["a", "b", "tp", "n_wet", "depth_se", "velocity_ae", "n_arrival", "arrival_ae", "arrival_se", *(f"{x}{k}" for x in ("t", "p", "tp") for k in range(3)), *(f"in_{o}" for o in OUTPUTS), "n_in_arrival"]
        run_ids = self.runs

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {m: np.zeros((len(names_of), n)) for m in methods}
            for batch in batches:
                y, only = values(batch, n), batch.column("only").to_numpy()
                truth = [physical(y[:, o], o, t_end) for o in range(3)]
                came = y[:, 2] < t_end
                outside = only[:, None] == np.arange(n)
                for m in methods:
                    if m == "nearest":  # blends the maps themselves
                        pred = [v @ weight[m][0] for v in truth]
                    else:
                        pred = [physical(y[:, o] @ weight[m][o], o, t_end) for o in range(3)]
                    pred = [np.where(outside, t_end if o == 2 else 0.0, p) for o, p in enumerate(pred)]
                    wet, arrived = (truth[0] > WET_M) | (pred[0] > WET_M), came & (pred[0] > ARRIVAL_M)
                    a, b = truth[0] > EXTENT_M, pred[0] > EXTENT_M
                    late = np.where(arrived, np.abs(pred[2] - truth[2]), 0)
                    rows = [a, b, a & b, wet, np.where(wet, pred[0] - truth[0], 0) ** 2, np.where(wet, np.abs(pred[1] - truth[1]), 0), arrived, late, late**2]
                    limits = (0.05, 0.1, 0.3)
                    rows += [truth[0] > t for t in limits] + [pred[0] > t for t in limits] + [(truth[0] > t) & (pred[0] > t) for t in limits]
                    more = np.zeros((4, n))
                    if m == "gp":
                        for o in range(3):
                            z = y[:, o] @ weight[m][o]
                            sd = np.stack([np.sqrt(((y[:, o] @ spread[f, o]) ** 2).sum(axis=1)) for f in range(n)], axis=1)
                            lo, hi = (np.where(outside, t_end if o == 2 else 0.0, physical(z + q * sd, o, t_end)) for q in (-BAND_Z, BAND_Z))
                            mask = arrived if o == 2 else wet
                            more[o] = (mask & (lo - 1e-12 <= truth[o]) & (truth[o] <= hi + 1e-12)).sum(axis=0)
                        more[3] = arrived.sum(axis=0)
                    total[m] += np.concatenate([np.stack([r.sum(axis=0) for r in rows]).astype(float), more])
            for m in methods:
                yield pa.RecordBatch.from_arrays([pa.array([m] * n), pa.array(run_ids, pa.int32()), *map(pa.array, total[m])], ["method", "run_id", *names_of])

        got = self.wide.mapInArrow(judge, schema_of("method string, run_id int", names_of)).groupBy("method", "run_id").agg(*(F.sum(x).alias(x) for x in names_of))
        c = F.col
        ratio = lambda a, b: F.when(b > 0, a / b)
        out = {
            "iou": F.coalesce(ratio(c("tp"), c("a") + c("b") - c("tp")), F.lit(1.0)), "area_error_pct": ratio(100 * (c("b") - c("a")), c("a")),
            "depth_rmse": F.sqrt(ratio(c("depth_se"), c("n_wet"))), "velocity_mae": ratio(c("velocity_ae"), c("n_wet")), "arrival_mae": ratio(c("arrival_ae"), c("n_arrival")), "arrival_rmse": F.sqrt(ratio(c("arrival_se"), c("n_arrival"))),
            **{f"f1_{int(t * 100):03d}": F.coalesce(ratio(2 * c(f"tp{k}"), c(f"t{k}") + c(f"p{k}")), F.lit(1.0)) for k, t in enumerate((0.05, 0.1, 0.3))},
            **{f"coverage_{o}": F.when(c("method") == "gp", ratio(c(f"in_{o}"), c("n_in_arrival") if o == "arrival" else c("n_wet"))) for o in OUTPUTS},
        }
        return got.select("method", "run_id", *(v.alias(name) for name, v in out.items()))


def cdf(x: np.ndarray) -> np.ndarray:
    """Of the normal distribution (Abramowitz and Stegun 7.1.26; the error is below 2e-7)."""
    a = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    tail = (0.254829592 * t - 0.284496736 * t**2 + 1.421413741 * t**3 - 1.453152027 * t**4 + 1.061405429 * t**5) * np.exp(-a * a) / 2
    return np.where(x >= 0, 1 - tail, tail)


def normal(keys: np.ndarray) -> np.ndarray:
    """Normal deviates from 64-bit keys, the same wherever they are drawn: Box-Muller over two mixed numbers."""
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53

    a, b = mixed(keys * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), mixed(keys * np.uint64(2) + np.uint64(1) + np.uint64(0x9E3779B97F4A7C15))
    return np.sqrt(-2 * np.log(np.maximum(a, 2.0**-53))) * np.cos(2 * np.pi * b)


def merged(histograms: DataFrame) -> DataFrame:
    """Histograms of the same cells and upper ends (cell_id, n, wet, tops, counts), added up."""
    places = F.posexplode("counts").alias("k", "count")
    sums = histograms.select("cell_id", places).groupBy("cell_id", "k").agg(F.sum("count").alias("count"))
    sums = sums.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "count"))), lambda x: x["count"]).alias("counts"))
    return histograms.groupBy("cell_id").agg(F.sum("n").alias("n"), F.sum("wet").alias("wet"), F.first("tops").alias("tops")).join(sums, "cell_id")


def histogram_maps(histograms: DataFrame, t_end: float, at: tuple[float, ...] = (0.5, 0.1, 0.9), high: float = 0.9, possible: float = 0.1) -> DataFrame:
    """cell_id, p, zone and central, low and high depth, velocity and arrival from histograms, interpolated inside the bin that reaches the
    rank. An arrival is null where it falls in the upper half of the last bin (never), or where the opposite band's depth is
    not over ARRIVAL_M: the early arrival goes with the high depth, the late one with the low."""
    def percentile(o: int, p: float):
        own = F.slice("counts", o * BINS + 1, BINS)
        start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(0).alias("bin"), F.lit(None).cast("double").alias("x"))

        def step(acc, count):
            reached = acc["x"].isNull() & (acc["cum"] + count >= F.col("n") * p)
            inside = acc["bin"] + F.when(count > 0, (F.col("n") * p - acc["cum"]) / count).otherwise(0.0)
            return F.struct((acc["cum"] + count).alias("cum"), (acc["bin"] + 1).alias("bin"), F.when(reached, inside).otherwise(acc["x"]).alias("x"))

        return F.aggregate(own, start, step)["x"] * (F.col("tops")[o] / BINS)

    names = ("central", "low", "high")
    out = histograms.withColumn("p", F.col("wet") / F.col("n")).withColumns({f"{o}_{b}": percentile(k, p) for k, o in enumerate(OUTPUTS) for b, p in zip(names, at)})
    never = (BINS - 0.5) / (BINS - 1) * t_end
    masked = {f"arrival_{b}": F.when((F.col(f"depth_{other}") > ARRIVAL_M) & (F.col(f"arrival_{b}") < never), F.col(f"arrival_{b}")) for b, other in (("central", "central"), ("low", "high"), ("high", "low"))}
    zone = F.when(F.col("p") >= high, 2).when(F.col("p") >= possible, 1).otherwise(0)
    return out.withColumns(masked).select("cell_id", "p", zone.alias("zone"), *(f"{o}_{b}" for o in OUTPUTS for b in names))


def site_values(maps: DataFrame, cell_m: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """area_m2 of zones 1 and 2, the site's largest central depth and velocity, and possible_share: zone 1 in what is flooded (null: nothing is)."""
    flooded = F.count_if(F.col("zone") >= 1)
    out = [(flooded * cell_m**2).alias("area_m2"), F.max("depth_central").alias("max_depth"), F.max("velocity_central").alias("max_velocity"), F.when(flooded > 0, F.count_if(F.col("zone") == 1) / flooded).alias("possible_share")]
    return maps.groupBy(*keys).agg(*out) if keys else maps.agg(*out)
