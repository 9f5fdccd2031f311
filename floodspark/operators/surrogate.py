"""Surrogate of solver runs: designs, principal components of maps, Gaussian processes, Monte Carlo, validation.

Maps are long tables (run_id, cell_id, y). Runs are few (hundreds) and cells many: everything of size runs x runs
or runs x components may be on the driver, nothing of the size of the cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.sources.io import kept

#: Runs up to which runs x runs sums are collected.
MOST_RUNS = 2000
#: Folds of a leave-one-out at most, and queries that are broadcast together.
MOST_FOLDS, AT_ONCE = 200, 1000
#: Monte Carlo samples at most, and depths that a task holds at once.
MOST_SAMPLES, BLOCK_VALUES = 100_000, 250_000
P90 = 1.2815515655446004
BOUNDS = {"length": (0.1, 10.0), "amplitude": (1e-3, 1e3), "noise": 1e-6}


def hash_uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the keys: the same however the data are partitioned."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def hash_normal(*keys: Column | str) -> Column:
    """Box-Muller over two hash uniforms."""
    a, b = F.greatest(hash_uniform(*keys, F.lit("a")), F.lit(2.0**-33)), hash_uniform(*keys, F.lit("b"))
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)


def scaler(design: DataFrame, log: set[str], names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each input, logarithms of those in ``log``; zero spread is an error."""
    value = lambda n: F.log10(n) if n in log else F.col(n).cast("double")
    row = design.agg(*(f(value(n)).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    out = {n: (row[f"m_{n}"], row[f"s_{n}"]) for n in names}
    if any(not s for _, s in out.values()):
        raise ValueError("an input does not vary over the design")
    return out


def scaled(design: DataFrame, scale: dict[str, tuple[float, float]], log: set[str]) -> DataFrame:
    value = lambda n: F.log10(n) if n in log else F.col(n).cast("double")
    return design.withColumns({n: (value(n) - m) / s for n, (m, s) in scale.items()})


def few(rows: DataFrame, most: int = MOST_RUNS) -> DataFrame:
    """Broadcast a design, or queries, after a check that they are as few as these are."""
    if rows.count() > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return F.broadcast(rows)


def small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a table of short rows if their number allows; beyond, the join shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows


def inside_box(box: dict[str, tuple[float, float]]) -> Column:
    """Whether every input lies in its range, ends included."""
    out = F.lit(True)
    for n, (lo, hi) in box.items():
        out = out & F.col(n).between(lo, hi)
    return out


def box_of(design: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    r = design.agg(*(f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max)))).first()
    return {n: (r[f"lo{n}"], r[f"hi{n}"]) for n in names}


def coverage(queries: DataFrame, design: DataFrame, names: list[str], edge: float = 1.0, outside: float = 2.0, box: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """query_id, r and label: distance to the nearest training point over the design's median nearest distance. A query with an
    input outside the training box (the design's own extent if none is given) is OUTSIDE whatever its r."""
    far = lambda a, b: F.sqrt(sum((F.pow(F.col(f"{a}.{n}") - F.col(f"{b}.{n}"), 2) for n in names), F.lit(0.0)))
    trained = few(design)
    box = box_of(design, names) if box is None else box
    median = design.alias("a").join(trained.alias("b"), F.col("a.run_id") != F.col("b.run_id")).groupBy("a.run_id").agg(F.min(far("a", "b")).alias("d")).agg(F.percentile("d", 0.5)).first()[0]
    near = queries.withColumn("inside", inside_box(box)).alias("a").join(trained.alias("b")).groupBy("a.query_id", "a.inside").agg(F.min(far("a", "b")).alias("d"))
    r = F.col("d") / F.lit(median) if median else F.lit(0.0)
    label = F.when(~F.col("inside"), "OUTSIDE").when(F.col("r") <= edge, "INSIDE").when(F.col("r") <= outside, "EDGE").otherwise("OUTSIDE")
    return near.select("query_id", "inside", r.alias("r")).select("query_id", "r", label.alias("label"))


def run_list(maps: DataFrame) -> list[int]:
    """The runs of maps, at most MOST_RUNS."""
    runs = sorted(r[0] for r in maps.select("run_id").distinct().limit(MOST_RUNS + 1).collect())
    if len(runs) > MOST_RUNS:
        raise ValueError("too many runs for a runs x runs table on the driver")
    return runs


def wide(maps: DataFrame, runs: list[int]) -> DataFrame:
    """A row for each cell: cell_id and ys, its values in the order of ``runs``; a run that lacks the cell has null."""
    by_run = F.map_from_entries(F.collect_list(F.struct(F.col("run_id").cast("int"), F.col("y").cast("double"))))
    rows = maps.groupBy(F.col("cell_id").cast("long").alias("cell_id")).agg(by_run.alias("m"))
    return rows.select("cell_id", F.transform(F.array(*map(F.lit, runs)), lambda r: F.try_element_at("m", r)).alias("ys"))


def block(column: pa.Array, n: int) -> np.ndarray:
    """Rows of ``n`` numbers as a matrix; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def centred(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows less their mean, and the means; what is missing counts as the mean."""
    mean = np.nansum(y, axis=1) / np.maximum((~np.isnan(y)).sum(axis=1), 1)
    return np.nan_to_num(y - mean[:, None]), mean


def gram_rows(cells: DataFrame, n: int) -> DataFrame:
    """i, j, g: centred inner products of the i-th and j-th run over all cells (``wide``). Every task sums its own
    runs x runs matrix, so the shuffle has one of these for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((n, n)), False
        for batch in batches:
            y, _ = centred(block(batch.column("ys"), n))
            total, some = total + y.T @ y, True
        if some:
            i, j = np.triu_indices(n)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    return cells.mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def gram(cells: DataFrame, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for r in gram_rows(cells, n).collect():  # runs x runs
        out[r.i, r.j] = out[r.j, r.i] = r.g
    return out


def principal(g: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (runs x components), what to weight the runs' maps with for the loadings, and explained shares, of a
    centred Gram matrix: the fewest components that explain ``share``, runs - 2 at most."""
    value, vector = np.linalg.eigh(g)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    part = value / max(value.sum(), 1e-300)
    count = int(min(max(1, len(g) - 2), np.searchsorted(np.cumsum(part), share - 1e-12) + 1))
    sign = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(g))])
    vector = (vector * np.where(sign == 0, 1, sign))[:, :count]
    root = np.sqrt(np.maximum(value[:count], 1e-300))
    return vector * root, vector / root, part[:count]


class Basis:
    """Principal components of maps: scores (runs x components), and ``cells``: cell_id, mean and loadings (array w)."""

    def __init__(self, maps: DataFrame, share: float = 0.99) -> None:
        self.runs = run_list(maps)
        n = len(self.runs)
        self.wide = kept(wide(maps, self.runs))
        self.scores, weights, self.explained = principal(gram(self.wide, n), share)
        self.count = self.scores.shape[1]

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, mean = centred(block(batch.column("ys"), n))
                w = y @ weights
                yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.array(mean), pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.reshape(-1))], ["cell_id", "mean", "w"])

        self.cells = kept(self.wide.mapInArrow(project, "cell_id long, mean double, w array<double>"))

    def encode(self, maps: DataFrame) -> DataFrame:
        """run_id, component, score of maps."""
        parts = F.posexplode(F.transform("w", lambda w: w * (F.col("y") - F.col("mean")))).alias("component", "part")
        return maps.join(self.cells, "cell_id").select("run_id", parts).groupBy("run_id", "component").agg(F.sum("part").alias("score"))

    def decode(self, scores: DataFrame, key: str = "run_id", spread: str | None = None) -> DataFrame:
        """key, cell_id, y (and sd, from independent standard deviations of the scores). Queries are few, so they go to
        the cells, AT_ONCE of them at a time."""
        values = ["score", *([spread] if spread else [])]
        lists = [F.map_from_entries(F.collect_list(F.struct("component", x))).alias(x) for x in values]
        listed = lambda x: F.transform(F.sequence(F.lit(0), F.lit(self.count - 1)), lambda k: F.coalesce(F.try_element_at(x, k), F.lit(0.0))).alias(x)
        queries = kept(scores.groupBy(key).agg(*lists).select(key, *map(listed, values)))
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        y = F.col("mean") + total(F.zip_with("w", "score", lambda a, b: a * b))
        sd = [F.sqrt(total(F.zip_with("w", spread, lambda a, b: a * a * b * b))).alias("sd")] if spread else []
        blocks = max(1, -(-queries.count() // AT_ONCE))
        out = None
        for k in range(blocks):
            part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
            some = self.cells.join(F.broadcast(part)).select(key, "cell_id", y.alias("y"), *sd)  # about AT_ONCE rows
            out = some if out is None else out.unionAll(some)
        return out


def matern(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum((((a[:, None, :] - b[None, :, :]) / length) ** 2).sum(axis=2), 0)) * math.sqrt(3)
    return (1 + d) * np.exp(-d)


def fit_process(x: np.ndarray, y: np.ndarray, starts: int = 6, steps: int = 25) -> dict:
    """Matern-3/2 process with a length for each input, amplitude and noise, by a bounded coordinate search
    of the log marginal likelihood from several starts; y is standardised inside."""
    shift, scale = y.mean(), y.std() or 1.0
    t = (y - shift) / scale
    low = np.log([BOUNDS["length"][0]] * x.shape[1] + [BOUNDS["amplitude"][0], BOUNDS["noise"]])
    high = np.log([BOUNDS["length"][1]] * x.shape[1] + [BOUNDS["amplitude"][1], 1.0])

    apart, eye = 3 * (x[:, None, :] - x[None, :, :]) ** 2, np.eye(len(x))

    def loss(p: np.ndarray) -> float:
        d = np.sqrt(apart @ np.exp(-2 * p[:-2]))
        k = np.exp(p[-2]) * (1 + d) * np.exp(-d) + (np.exp(p[-1]) + 1e-10) * eye
        try:
            c = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return np.inf
        z = np.linalg.solve(c, t)
        return 0.5 * z @ z + np.log(np.diag(c)).sum()

    rng, best = np.random.default_rng(0), (np.inf, None)
    for s in range(starts):
        p = np.array([0.0] * x.shape[1] + [0.0, math.log(1e-3)]) if s == 0 else rng.uniform(low, high)
        now, width = loss(p), 1.0
        for _ in range(steps):
            moved = False
            for k in range(len(p)):
                for d in (-width, width):
                    q = p.copy()
                    q[k] = np.clip(q[k] + d, low[k], high[k])
                    if (new := loss(q)) < now - 1e-9:
                        p, now, moved = q, new, True
            width = width if moved else width / 2
            if width < 0.02:
                break
        if now < best[0]:
            best = (now, p)
    p = best[1]
    k = np.exp(p[-2]) * matern(x, x, np.exp(p[:-2])) + (np.exp(p[-1]) + 1e-10) * np.eye(len(x))
    return {"length": np.exp(p[:-2]), "amplitude": float(np.exp(p[-2])), "noise": float(np.exp(p[-1])), "alpha": np.linalg.solve(k, t), "inverse": np.linalg.inv(k), "shift": shift, "scale": scale}


def predict_process(m: dict, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = m["amplitude"] * matern(q, x, m["length"])
    var = m["amplitude"] - np.einsum("ij,jk,ik->i", k, m["inverse"], k)
    return m["shift"] + m["scale"] * (k @ m["alpha"]), m["scale"] * np.sqrt(np.maximum(var, 1e-12))


def inputs(runs: list[int], design: DataFrame, names: list[str]) -> np.ndarray:
    """Inputs of the runs, in their order; a design has a row for each run."""
    return few(design).toPandas().set_index("run_id").loc[runs, names].to_numpy(float)


def processes(basis: Basis, design: DataFrame, names: list[str]) -> dict[int, dict]:
    """A fitted process for each component, each fitted in its own task."""
    x = inputs(basis.runs, design, names)
    long = design.sparkSession.createDataFrame([(int(k), [float(s) for s in basis.scores[:, k]]) for k in range(basis.count)], "component int, scores array<double>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fit_process(x, np.array(pdf["scores"].iloc[0]))
        return pd.DataFrame({"component": pdf["component"], "length": [m["length"].tolist()], "amplitude": m["amplitude"], "noise": m["noise"], "alpha": [m["alpha"].tolist()], "inverse": [m["inverse"].ravel().tolist()], "shift": m["shift"], "scale": m["scale"]})

    fitted = long.groupBy("component").applyInPandas(run, "component int, length array<double>, amplitude double, noise double, alpha array<double>, inverse array<double>, shift double, scale double").toPandas()
    return {r.component: {"length": np.array(r.length), "amplitude": r.amplitude, "noise": r.noise, "alpha": np.array(r.alpha), "inverse": np.array(r.inverse).reshape(len(x), len(x)), "shift": r.shift, "scale": r.scale} for r in fitted.itertuples()}


def gp_scores(basis: Basis, design: DataFrame, queries: DataFrame, names: list[str]) -> DataFrame:
    """query_id, component, score, sd: one process for each component, fitted in its own task on runs x inputs."""
    x, models = inputs(basis.runs, design, names), processes(basis, design, names)

    def score(batches):
        for pdf in batches:
            for k, m in models.items():
                mean, sd = predict_process(m, x, pdf[names].to_numpy(float))
                yield pd.DataFrame({"query_id": pdf["query_id"], "component": k, "score": mean, "sd": sd})

    return queries.select("query_id", *names).mapInPandas(score, "query_id long, component int, score double, sd double")


def gp_lengths(basis: Basis, design: DataFrame, names: list[str]) -> DataFrame:
    """component, input, evr (explained share) and length of each fitted process: what ``sensitivity`` takes."""
    models = processes(basis, design, names)
    rows = [(k, n, float(basis.explained[k]), float(m["length"][i])) for k, m in models.items() for i, n in enumerate(names)]
    return design.sparkSession.createDataFrame(rows, "component int, input string, evr double, length double")


def linear_scores(basis: Basis, design: DataFrame, queries: DataFrame, names: list[str]) -> DataFrame:
    """query_id, component, score of least squares with an intercept."""
    x = inputs(basis.runs, design, names)
    coef = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), basis.scores, rcond=None)[0]
    parts = [F.struct(F.lit(k).alias("component"), (F.lit(float(coef[0, k])) + sum(F.col(n) * float(coef[1 + i, k]) for i, n in enumerate(names))).alias("score")) for k in range(basis.count)]
    return queries.select("query_id", F.explode(F.array(*parts)).alias("p")).select("query_id", "p.component", "p.score")


def nearest_blend(queries: DataFrame, design: DataFrame, maps: DataFrame, names: list[str], k: int = 3) -> DataFrame:
    """query_id, cell_id, y from the k nearest runs by weights 1 / d**2; a run at distance 0 alone counts."""
    d = F.sqrt(sum((F.pow(F.col(f"q.{n}") - F.col(f"d.{n}"), 2) for n in names), F.lit(0.0)))
    far = queries.alias("q").join(few(design).alias("d")).select("q.query_id", "d.run_id", d.alias("dist"))
    near = far.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "run_id"))).filter(F.col("rank") <= k)
    exact = F.min("dist").over(Window.partitionBy("query_id")) == 0
    near = near.withColumn("w", F.when(exact, (F.col("rank") == 1).cast("double")).otherwise(1 / (F.col("dist") * F.col("dist"))))
    near = near.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query_id")))
    return maps.join(small(near), "run_id").groupBy("query_id", "cell_id").agg(F.sum(F.col("w") * F.col("y")).alias("y"))


def predicted_maps(decoded: DataFrame, key: str = "query_id", z: float = 1.645) -> DataFrame:
    """low, central and high depth of decoded log1p depths (the central one is a median)."""
    back = lambda c: F.greatest(F.expm1(c), F.lit(0.0))
    y, sd = F.col("y"), F.col("sd")
    return decoded.select(key, "cell_id", back(y - z * sd).alias("low"), back(y).alias("central"), back(y + z * sd).alias("high"))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; the error is below 2e-7."""
    a = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    tail = (0.254829592 * t - 0.284496736 * t * t + 1.421413741 * F.pow(t, 3) - 1.453152027 * F.pow(t, 4) + 1.061405429 * F.pow(t, 5)) * F.exp(-a * a)
    return F.when(x >= 0, 1 - tail / 2).otherwise(tail / 2)


def inundation(decoded: DataFrame, limit_m: float = 0.3, key: str = "query_id") -> DataFrame:
    z = (math.log1p(limit_m) - F.col("y")) / F.greatest("sd", F.lit(1e-9))
    return decoded.select(key, "cell_id", (1 - normal_cdf(z)).alias("p"))


def sample_inputs(spark, ranges: dict[str, tuple[float, float]], n: int, log: set[str], seed: int = 0) -> DataFrame:
    """sample_id and inputs, uniform (or log-uniform) in their ranges, from hashes of the sample's number."""
    ids = spark.range(n).withColumnRenamed("id", "sample_id")
    draw = lambda k: hash_uniform(F.lit(seed), "sample_id", F.lit(k))
    return ids.withColumns({k: F.pow(F.lit(10.0), F.lit(math.log10(a)) + draw(k) * (math.log10(b) - math.log10(a))) if k in log else F.lit(float(a)) + draw(k) * float(b - a) for k, (a, b) in ranges.items()})


def drawn(scores: DataFrame, seed: int) -> np.ndarray:
    """Samples x components: a latent draw of each sample's scores (query_id, component, score, sd), by query_id."""
    rows = scores.select("query_id", "component", (F.col("score") + F.col("sd") * hash_normal(F.lit(seed), "query_id", "component")).alias("s"))
    table = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("component", "s"))).alias("x")).select("query_id", F.col("x.s").alias("s")).toPandas().sort_values("query_id")
    if len(table) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    return np.stack(table["s"].to_list())


def depths(count: int, sample: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Depth of every sample in the cells of a batch, some cells at a time."""
    size = max(1, BLOCK_VALUES // len(sample))
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        depth = block(part.column("w"), count) @ sample.T
        depth += part.column("mean").to_numpy()[:, None]
        np.expm1(depth, out=depth)
        yield part, np.maximum(depth, 0, out=depth)


def monte_carlo(basis: Basis, scores: DataFrame, limit_m: float = 0.3, seed: int = 0, high: float = 0.9, possible: float = 0.1) -> DataFrame:
    """cell_id, p, p10, p50, p90 of depth and zone (2 high, 1 possible, 0) over samples (query_id, component, score,
    sd), each with a latent draw.

    Samples x components are few (MOST_SAMPLES at most) and go to every task; each block of cells decodes all samples
    and reduces them at once, so no samples x cells table is made and cells are not shuffled by sample.
    """
    sample, count = drawn(scores, seed), basis.count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, depth in depths(count, sample, batch):
                p, q = (depth > limit_m).mean(axis=1), np.percentile(depth, (10, 50, 90), axis=1, overwrite_input=True)
                zone = np.where(p >= high, 2, np.where(p >= possible, 1, 0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("cell_id"), *map(pa.array, (p, *q, zone))], ["cell_id", "p", "p10", "p50", "p90", "zone"])

    return basis.cells.mapInArrow(run, "cell_id long, p double, p10 double, p50 double, p90 double, zone int")


def sample_summaries(basis: Basis, scores: DataFrame, cell_m: float, limit_m: float = 0.3, seed: int = 0) -> DataFrame:
    """sample (0, 1, ... in the order of query_id), site_max and area_m2: the deepest cell and the inundated area of
    each sample; the draws are those of ``monte_carlo``. Every task sums its own cells before the shuffle."""
    sample, count = drawn(scores, seed), basis.count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, wet = np.zeros(len(sample)), np.zeros(len(sample), np.int64)
        for batch in batches:
            for _, depth in depths(count, sample, batch):
                top, wet = np.maximum(top, depth.max(axis=0)), wet + (depth > limit_m).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sample), dtype=np.int32)), pa.array(top), pa.array(wet)], ["sample", "top", "wet"])

    out = basis.cells.mapInArrow(run, "sample int, top double, wet long").groupBy("sample")
    return out.agg(F.max("top").alias("site_max"), (F.sum("wet") * cell_m**2).alias("area_m2"))


def latin_hypercube(spark, n: int, names: list[str], candidates: int = 20, seed: int = 0) -> DataFrame:
    """point and inputs in [0, 1): of ``candidates`` hashed Latin hypercubes the one whose closest points are furthest apart."""
    base = spark.range(candidates * n).select((F.col("id") / n).cast("int").alias("cand"), (F.col("id") % n).cast("int").alias("point"))
    for name in names:
        rank = F.row_number().over(Window.partitionBy("cand").orderBy(hash_uniform(F.lit(seed), F.lit(name), "cand", "point"), "point")) - 1
        base = base.withColumn(name, (rank + hash_uniform(F.lit(seed + 1), F.lit(name), "cand", "point")) / n)
    a, b = base.alias("a"), base.alias("b")
    d = sum((F.pow(F.col(f"a.{k}") - F.col(f"b.{k}"), 2) for k in names), F.lit(0.0))
    best = a.join(b, (F.col("a.cand") == F.col("b.cand")) & (F.col("a.point") < F.col("b.point"))).groupBy("a.cand").agg(F.min(d).alias("d")).agg(F.max_by("cand", F.struct("d", -F.col("cand"))).alias("cand"))
    return base.join(F.broadcast(best), "cand").drop("cand")


def leave_one_out(maps: DataFrame, design: DataFrame, names: list[str], k: int = 3, share: float = 0.99, limit_m: float = 0.3, wet_m: float = 0.03) -> DataFrame:
    """method (gp, linear, nearest), run_id, and how well the run's map of log1p depths is predicted without it: rmse
    (of log1p depths), depth_rmse (m, where truth or prediction is wet), iou and f1 of the extent, and coverage_90
    of the process's interval (null for the others).

    The full Gram matrix is made once; a fold's is its sub-matrix, centred anew. Folds are split in tasks,
    and each fold's processes again. A predicted map is a weighted sum of the other runs' maps, so the cells
    are read once: every task predicts all folds for its own cells and sends sums.
    """
    runs = run_list(maps)
    n = len(runs)
    if not 4 <= n <= MOST_FOLDS:
        raise ValueError(f"leave-one-out takes 4 to {MOST_FOLDS} runs")
    cells = kept(wide(maps, runs))
    g, x, spark = gram(cells, n), inputs(runs, design, names), maps.sparkSession

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fold"].iloc[0])
        rest = np.delete(np.arange(n), f)
        centre = np.eye(n - 1) - 1 / (n - 1)
        scores, weights, _ = principal(centre @ g[np.ix_(rest, rest)] @ centre, share)
        coef = np.linalg.lstsq(np.column_stack([np.ones(n - 1), x[rest]]), scores, rcond=None)[0]
        linear = np.concatenate([[1.0], x[f]]) @ coef
        return pd.DataFrame({"fold": f, "component": np.arange(scores.shape[1], dtype=np.int32), "scores": scores.T.tolist(), "weights": (centre @ weights).T.tolist(), "linear": linear})

    def process(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fold"].iloc[0])
        others = np.delete(x, f, axis=0)
        mean, sd = predict_process(fit_process(others, np.array(pdf["scores"].iloc[0])), others, x[f : f + 1])
        return pd.DataFrame({"fold": pdf["fold"], "component": pdf["component"], "weights": pdf["weights"], "linear": pdf["linear"], "gp": mean, "sd": sd})

    folds = spark.createDataFrame([(f,) for f in range(n)], "fold int").repartition(n, "fold")
    parts = folds.groupBy("fold").applyInPandas(split, "fold int, component int, scores array<double>, weights array<double>, linear double")
    # folds x components rows of as many numbers as runs: MOST_FOLDS bounds them
    fitted = parts.groupBy("fold", "component").applyInPandas(process, "fold int, component int, weights array<double>, linear double, gp double, sd double").toPandas().sort_values(["fold", "component"])
    methods = ("gp", "linear", "nearest")
    weight, spread = {m: np.zeros((n, n)) for m in methods}, []
    for f, own in fitted.groupby("fold"):
        rest, loading = np.delete(np.arange(n), f), np.stack(own["weights"].to_list())
        for m in ("gp", "linear"):
            weight[m][rest, f] = 1 / (n - 1) + own[m].to_numpy() @ loading
        full = np.zeros((n, len(own)))
        full[rest] = (loading * own["sd"].to_numpy()[:, None]).T
        spread.append(full)
        d = np.linalg.norm(x[rest] - x[f], axis=1)
        order = np.argsort(d, kind="stable")[: min(k, n - 1)]
        near = (np.arange(len(order)) == 0).astype(float) if d[order[0]] == 0 else 1 / d[order] ** 2
        weight["nearest"][rest[order], f] = near / near.sum()
    sums = ("n", "se", "n_wet", "wet_se", "tp", "fp", "fn", "covered")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((len(sums), n)) for m in methods}
        for batch in batches:
            centre, mean = centred(block(batch.column("ys"), n))
            truth = centre + mean[:, None]
            depth = np.maximum(np.expm1(truth), 0)
            for m in methods:
                pred = truth @ weight[m]
                guess = np.maximum(np.expm1(pred), 0)
                wet, a, b = (depth > wet_m) | (guess > wet_m), depth > limit_m, guess > limit_m
                inside = np.stack([np.abs(truth[:, f] - pred[:, f]) <= 1.645 * np.sqrt(((truth @ s) ** 2).sum(axis=1)) for f, s in enumerate(spread)], axis=1) if m == "gp" else np.zeros(truth.shape, bool)
                total[m] += np.stack([np.full(n, len(truth)), ((pred - truth) ** 2).sum(axis=0), wet.sum(axis=0), (np.where(wet, guess - depth, 0) ** 2).sum(axis=0), (a & b).sum(axis=0), (~a & b).sum(axis=0), (a & ~b).sum(axis=0), inside.sum(axis=0)])
        for m in methods:
            yield pa.RecordBatch.from_arrays([pa.array([m] * n), pa.array(runs, pa.int32()), *map(pa.array, total[m])], ["method", "run_id", *sums])

    got = cells.mapInArrow(judge, "method string, run_id int, " + ", ".join(f"{x} double" for x in sums)).groupBy("method", "run_id").agg(*(F.sum(x).alias(x) for x in sums))
    either = F.col("tp") + F.col("fp") + F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return got.select(
        "method", "run_id", F.sqrt(ratio(F.col("se"), F.col("n"))).alias("rmse"), F.sqrt(ratio(F.col("wet_se"), F.col("n_wet"))).alias("depth_rmse"),
        F.coalesce(ratio(F.col("tp"), either), F.lit(1.0)).alias("iou"), F.coalesce(ratio(2 * F.col("tp"), either + F.col("tp")), F.lit(1.0)).alias("f1"),
        F.when(F.col("method") == "gp", ratio(F.col("covered"), F.col("n"))).alias("coverage_90"),
    )


def sensitivity(lengths: DataFrame) -> DataFrame:
    """Share of each input (component, input, evr, length): the sum of explained variance over length, normalised."""
    s = lengths.groupBy("input").agg(F.sum(F.col("evr") / F.col("length")).alias("s"))
    return s.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy())).drop("s")  # a row an input


def monotone(pairs: DataFrame, low: str, high: str) -> DataFrame:
    return pairs.agg(F.avg((F.col(high) >= F.col(low)).cast("double")).alias("share"), F.count("*").alias("n"))


def monotone_pairs(maps: DataFrame, points: DataFrame, limit: float = 0.3, share: float = 0.95) -> DataFrame:
    """n pairs and the shares of those whose extent, depth at points and arrival at points answer a raised input as they should, and whether all
    are at least ``share`` (PASS, FAIL; null without pairs). ``maps`` (pair_id, raised, row, col, depth_m, arrival_s) holds both answers of a
    pair; depth must not fall at any of ``points`` (row, col), and arrival not rise where both arrive."""
    wet = maps.groupBy("pair_id").agg(F.count_if(F.col("raised") & (F.col("depth_m") > limit)).alias("high"), F.count_if(~F.col("raised") & (F.col("depth_m") > limit)).alias("low"))
    here = maps.join(F.broadcast(points.select("row", "col").distinct()), ["row", "col"])
    of = lambda raised, c: F.max(F.when(F.col("raised") == raised, F.col(c)))
    at = here.groupBy("pair_id", "row", "col").agg(of(False, "depth_m").alias("d1"), of(True, "depth_m").alias("d2"), of(False, "arrival_s").alias("a1"), of(True, "arrival_s").alias("a2"))
    ok = at.groupBy("pair_id").agg(F.bool_and(F.coalesce(F.col("d2") >= F.col("d1") - 1e-9, F.lit(True))).alias("depth"), F.bool_and(F.coalesce(F.col("a2") <= F.col("a1") + 1e-6, F.lit(True))).alias("arrival"))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(True)).cast("double"))
    out = wet.join(ok, "pair_id", "left").agg(F.count("*").alias("n"), mean(F.col("high") >= F.col("low")).alias("extent"), mean(F.col("depth")).alias("depth"), mean(F.col("arrival")).alias("arrival"))
    return out.withColumn("status", F.when(F.col("n") > 0, F.when(F.least("extent", "depth", "arrival") >= share, "PASS").otherwise("FAIL")))


def upper_bound(basis: Basis, corner_scores: DataFrame, z: float = 4.0, factor: float = 1.5, least: float = 1e-3) -> DataFrame:
    """Per cell an upper depth over the corners of the inputs' box (query_id, component, score, sd)."""
    d = basis.decode(corner_scores, "query_id", "sd")
    return d.groupBy("cell_id").agg(F.greatest(F.max(F.expm1(F.col("y") + z * F.col("sd"))) * factor, F.lit(least)).alias("bound"))


def valley(scenarios: DataFrame, width: int, height: int, cell_m: float) -> DataFrame:
    """run_id, row, col, depth_m, velocity_ms, arrival_s of a closed-form flood in a widening valley for each scenario
    (run_id, volume, breach_m, time_s): attenuation and travel time are running sums down the valley."""
    spark = scenarios.sparkSession
    cols = spark.range(width).select(F.col("id").cast("int").alias("col")).withColumn("s", (F.col("col") + 0.5) * cell_m)
    half = 20 + 0.05 * F.col("s")
    q0 = 2000 * F.pow(F.col("volume") / 1e7, 0.55) * F.pow(F.col("breach_m") / 50, 0.25) * F.pow(1800 / F.col("time_s"), 0.35)
    w = Window.partitionBy("run_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    along = scenarios.join(F.broadcast(cols)).withColumn("half", half).withColumn("q", q0 * F.exp(-F.sum(half * cell_m * 1e-6).over(w)))
    along = along.withColumn("axis_m", 0.9 * F.sqrt(F.col("q") / (2 * F.col("half")))).withColumn("axis_ms", F.pow(F.col("axis_m"), 2 / 3) * math.sqrt(0.01) / 0.04)
    along = along.withColumn("travel", F.sum(cell_m / F.greatest(1.5 * F.col("axis_ms"), F.lit(0.1))).over(w) + 0.05 * F.col("time_s"))
    rows = spark.range(height).select(F.col("id").cast("int").alias("row")).withColumn("off", F.abs(F.col("row") - height / 2 + 0.5) * cell_m)
    side = F.least(F.greatest((F.col("half") * 1.6 - F.col("off")) / (F.col("half") * 0.6), F.lit(0.0)), F.lit(1.0))
    out = along.join(F.broadcast(rows)).withColumn("k", side)
    return out.select("run_id", "row", "col", (F.col("axis_m") * F.col("k")).alias("depth_m"), (F.col("axis_ms") * F.col("k")).alias("velocity_ms"), F.when(F.col("axis_m") * F.col("k") > 0.1, F.col("travel") + 2 * F.col("off")).alias("arrival_s"))
