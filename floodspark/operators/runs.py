"""Run summaries of solver output, their metrics and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL_M, WET_M, EXTENT_M = 0.1, 0.03, 0.3


def above(value: Column, limit: float, inclusive: bool = False) -> Column:
    return value >= limit if inclusive else value > limit


def run_summary(steps: DataFrame, keys: tuple[str, ...] = ("run_id", "face_id"), arrival_m: float = ARRIVAL_M) -> DataFrame:
    """Maximum depth and velocity and the first time with depth over ``arrival_m``, per run and face.
    Nulls are ignored; a face without a finite sample is null. One shuffle of partial aggregates."""
    clean = lambda x: F.when(~F.isnan(x), F.col(x))
    return steps.groupBy(*keys).agg(F.max(clean("depth_m")).alias("max_depth"), F.max(clean("velocity_ms")).alias("max_velocity"), F.min(F.when(clean("depth_m") > arrival_m, F.col("t_s"))).alias("arrival_s"))


def rise_summary(steps: DataFrame, spinup_s: int, rise_m: float = 0.1) -> DataFrame:
    """First time at or after ``spinup_s`` at which the depth is over that of the first step by ``rise_m``,
    with the least depth and the number of samples reached; null baseline depths give no arrival."""
    base = steps.groupBy("run_id", "face_id").agg(F.min_by("depth_m", F.struct("t_s", "velocity_ms", "depth_m")).alias("base"))
    joined = steps.join(base, ["run_id", "face_id"])
    reached = (F.col("t_s") >= spinup_s) & (F.col("depth_m") > F.col("base") + rise_m)
    return joined.groupBy("run_id", "face_id").agg(F.min(F.when(reached, F.col("t_s"))).alias("arrival_s"), F.min("depth_m").alias("min_depth"), F.count_if(reached).alias("n_reached"))


def map_interval(steps: DataFrame) -> DataFrame:
    """Median time between a run's distinct steps."""
    w = Window.partitionBy("run_id").orderBy("t_s")
    gaps = steps.select("run_id", "t_s").distinct().withColumn("dt", F.col("t_s") - F.lag("t_s").over(w))
    return gaps.groupBy("run_id").agg(F.percentile("dt", 0.5).alias("interval_s"))


def extent(summary: DataFrame, limit: float = EXTENT_M, cell_m: float = 20.0, inclusive: bool = True) -> DataFrame:
    """Inundated area, wet cells and site maxima of each run."""
    wet = above(F.col("max_depth"), limit, inclusive)
    return summary.groupBy("run_id").agg(F.count_if(wet).alias("n_wet"), (F.count_if(wet) * cell_m * cell_m).alias("area_m2"), F.max("max_depth").alias("site_max_depth"), F.max("max_velocity").alias("site_max_velocity"))


def maximum_cell(summary: DataFrame, slope: DataFrame, steep: float) -> DataFrame:
    """Each run's deepest cell (the smallest id of ties), whether it is steep, and the steep share of its wet cells."""
    joined = summary.join(slope.select(F.col("cell_id").alias("face_id"), "slope"), "face_id", "left")
    best = F.max_by(F.struct("face_id", "slope"), F.struct("max_depth", -F.col("face_id")))
    wet = F.col("max_depth") > WET_M
    out = joined.filter("max_depth is not null").groupBy("run_id").agg(best.alias("b"), F.avg(F.when(wet, (F.coalesce("slope", F.lit(0.0)) > steep).cast("double"))).alias("steep_share"))
    return out.select("run_id", F.col("b.face_id").alias("face_id"), (F.coalesce(F.col("b.slope"), F.lit(0.0)) > steep).alias("is_steep"), "steep_share")


def pits_and_steeps(summary: DataFrame, ground: DataFrame, pit_m: float, steep: float) -> DataFrame:
    """Per run whether its deepest cell lies in a pit and its fastest on a steep reach, and the shares of wet cells that do. ``ground`` has run_id,
    face_id, depression and slope; a cell without ground is in no pit and not steep. Ties go to the smallest face_id."""
    at = summary.join(ground, ["run_id", "face_id"], "left")
    pit, steep_ = F.coalesce(F.col("depression") >= pit_m, F.lit(False)), F.coalesce(F.col("slope") >= steep, F.lit(False))
    top = lambda flag, c: F.max_by(F.when(F.col(c).isNotNull(), flag), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("face_id"))))
    share = lambda flag: F.avg(F.when(F.col("max_depth") > WET_M, flag.cast("double")))
    return at.groupBy("run_id").agg(top(pit, "max_depth").alias("deepest_in_pit"), share(pit).alias("pit_share"), top(steep_, "max_velocity").alias("fastest_on_steep"), share(steep_).alias("steep_share"))


def fold_scores(pairs: DataFrame) -> DataFrame:
    """method, fold and the scores of predicted maps (method, fold, depth_a of the truth, depth_b, arrival_a, arrival_b): depth RMSE where either is
    wet, arrival RMSE where both arrive, F1 of the extents. Null where there is nothing to compare; F1 of two empty extents is 1."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    a, b = zero("depth_a"), zero("depth_b")
    square = lambda d: F.sqrt(F.avg(d * d))
    hit, total = F.count_if((a > EXTENT_M) & (b > EXTENT_M)), F.count_if(a > EXTENT_M) + F.count_if(b > EXTENT_M)
    return pairs.groupBy("method", "fold").agg(
        square(F.when((a > WET_M) | (b > WET_M), a - b)).alias("depth_rmse"), square(F.col("arrival_a") - F.col("arrival_b")).alias("arrival_rmse"), F.when(total == 0, 1.0).otherwise(2 * hit / total).alias("f1"))


def acceptance(folds: DataFrame, model: str, others: tuple[str, ...], better: float = 0.1, covered: tuple[float, float] = (0.8, 0.95), terrace: float = 0.9, projection: float = 0.5) -> DataFrame:
    """test and status (PASS, FAIL, NOT_EVALUATED) of a model over folds (method, fold, depth_rmse, arrival_rmse, f1, and if there are such: coverage,
    poi_coverage, terrace_ok, projection_depth, projection_arrival). A1: its median errors are ``better`` than those of all others and its median F1
    not lower. A2: the mean coverage of its intervals lies in ``covered``, that at points too where given. A4: the terrace is right in that
    share of folds. A5: the projection's median errors are at most that part of the model's. One row a method comes to each; values that are not finite are left out."""
    has = lambda c: F.col(c) if c in folds.columns else F.lit(None).cast("double")
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    median = lambda m, c: F.percentile(F.when(F.col("method") == m, finite(has(c))), 0.5)
    mean = lambda c: F.avg(F.when(F.col("method") == model, finite(has(c).cast("double"))))
    beats = lambda c: F.least(*(F.coalesce((median(m, c) > 0) & (median(model, c) <= median(m, c) * (1 - better)), F.lit(False)) for m in (*others, others[0])))
    not_lower = F.least(*(F.coalesce(median(model, "f1") >= median(m, "f1"), F.lit(False)) for m in (*others, others[0])))
    within = lambda c: mean(c).between(*covered)
    small = lambda c, e: F.coalesce(median(model, c) <= projection * median(model, e), F.lit(False))
    tests = {
        "A1": beats("depth_rmse") & beats("arrival_rmse") & not_lower,
        "A2": F.coalesce(within("coverage"), F.lit(False)) & F.coalesce(within("poi_coverage"), F.lit(True)),
        "A4": F.when(mean("terrace_ok").isNotNull(), mean("terrace_ok") >= terrace),
        "A5": F.when(median(model, "projection_depth").isNotNull() | median(model, "projection_arrival").isNotNull(), small("projection_depth", "depth_rmse") & small("projection_arrival", "arrival_rmse")),
    }
    status = lambda ok: F.when(ok.isNull(), "NOT_EVALUATED").when(ok, "PASS").otherwise("FAIL")
    row = folds.agg(*(status(ok).alias(name) for name, ok in tests.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("test"), F.col(name).alias("status")) for name in tests))).alias("t")).select("t.*")


def pair_maps(summary: DataFrame, a: int, b: int) -> DataFrame:
    """Two runs' maps side by side, with the cells that only one of them has."""
    side = lambda run, x: summary.filter(F.col("run_id") == run).select("face_id", F.col("max_depth").alias(f"depth_{x}"), F.col("max_velocity").alias(f"velocity_{x}"), F.col("arrival_s").alias(f"arrival_{x}"))
    return side(a, "a").join(side(b, "b"), "face_id", "full")


def extent_metrics(pairs: DataFrame, limit: float = EXTENT_M, inclusive: bool = False) -> DataFrame:
    """IoU, F1, precision, recall and area error in percent of b against a. Both empty: IoU and F1 are 1;
    a empty: the area error is null; nothing predicted (nothing true): precision (recall) is null."""
    t = F.coalesce(above(F.col("depth_a"), limit, inclusive), F.lit(False))
    p = F.coalesce(above(F.col("depth_b"), limit, inclusive), F.lit(False))
    c = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda x, y, empty: F.when(y > 0, x / y).otherwise(F.lit(empty).cast("double"))
    return c.select("tp", "fp", "fn", ratio(tp, tp + fp + fn, 1.0).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn, 1.0).alias("f1"), ratio(tp, tp + fp, None).alias("precision"), ratio(tp, tp + fn, None).alias("recall"), ratio(100.0 * (fp - fn), tp + fn, None).alias("area_error_pct"))


def error_metrics(pairs: DataFrame, wet_m: float = WET_M) -> DataFrame:
    """Depth RMSE and velocity MAE over cells wet in either map, arrival MAE and RMSE where both arrive; null if none."""
    wet = (F.coalesce("depth_a", F.lit(0.0)) > wet_m) | (F.coalesce("depth_b", F.lit(0.0)) > wet_m)
    diff = lambda x: F.col(f"{x}_b") - F.col(f"{x}_a")
    return pairs.agg(
        F.sqrt(F.avg(F.when(wet, F.pow(diff("depth"), 2)))).alias("depth_rmse"), F.avg(F.when(wet, F.abs(diff("velocity")))).alias("velocity_mae"),
        F.avg(F.abs(diff("arrival"))).alias("arrival_mae"), F.sqrt(F.avg(F.pow(diff("arrival").cast("double"), 2))).alias("arrival_rmse"), F.count_if(wet).alias("n_wet"),
    )


def interval_coverage(cells: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Share of values inside their interval, both ends included."""
    return cells.agg(F.avg(F.col(value).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.count(value).alias("n"))


def zone_agreement(cells: DataFrame, zone: str, truth: str, pred: str) -> DataFrame:
    """Per zone the majority of true and predicted wet cells, and whether they agree (a tie is not wet)."""
    out = cells.groupBy(zone).agg(F.avg(F.col(truth).cast("double")).alias("t"), F.avg(F.col(pred).cast("double")).alias("p"))
    return out.select(zone, (F.col("t") > 0.5).alias("truth_wet"), (F.col("p") > 0.5).alias("pred_wet"), ((F.col("t") > 0.5) == (F.col("p") > 0.5)).alias("agrees"))


def fold_summary(folds: DataFrame, good: float, fair: float) -> DataFrame:
    """Median of a method's finite scores (lower is better), its grade and rank."""
    finite = F.when(F.abs("score") < float("inf"), F.col("score"))
    out = folds.groupBy("method").agg(F.percentile(finite, 0.5).alias("median"), F.count(finite).alias("n"))
    grade = F.when(F.col("median").isNull(), "UNKNOWN").when(F.col("median") <= good, "GOOD").when(F.col("median") <= fair, "FAIR").otherwise("POOR")
    return out.withColumn("grade", grade).withColumn("rank", F.rank().over(Window.orderBy(F.asc_nulls_last("median"))))  # one row a method


def exceedance(summary: DataFrame, limit: float = EXTENT_M) -> DataFrame:
    """Per cell over all runs: probability of a depth over ``limit``, depth percentiles, median arrival."""
    p = F.percentile("max_depth", F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    out = summary.groupBy(F.col("face_id").alias("cell_id")).agg(F.avg(F.when(F.col("max_depth") > limit, 1.0).otherwise(0.0)).alias("p"), p.alias("d"), F.percentile("arrival_s", 0.5).alias("a50"))
    return out.select("cell_id", "p", F.col("d")[0].alias("d10"), F.col("d")[1].alias("d50"), F.col("d")[2].alias("d90"), "a50")


def histogram_percentiles(values: DataFrame, key: str, value: str, top: float, bins: int = 64, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Percentiles per key from ``bins`` equal bins on [0, top], interpolated inside the bin that reaches the
    rank: only (key, bin) counts are shuffled. Values beyond the ends count in the end bins; null is skipped."""
    width = top / bins
    which = F.least(F.greatest(F.floor(F.col(value) / width), F.lit(0)), F.lit(bins - 1))
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, which.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("bin")  # at most ``bins`` rows a key
    run = counts.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    found = []
    for p in at:
        rank = F.col("total") * p
        inside = (F.col("cum") >= rank) & (F.col("cum") - F.col("n") < rank)
        found.append(F.max(F.when(inside, (F.col("bin") + (rank - (F.col("cum") - F.col("n"))) / F.col("n")) * width)).alias(f"p{round(p * 100)}"))
    return run.groupBy(key).agg(*found)


def extent_class(p: Column, high: float = 0.9, possible: float = 0.1, domain: Column | None = None) -> Column:
    """2 where the probability is at least ``high``, 1 at least ``possible``, else 0; 0 outside the domain."""
    out = F.when(p >= high, 2).when(p >= possible, 1).otherwise(0)
    return out if domain is None else F.when(domain, out).otherwise(0)


def class_of(value: Column, edges: list[float]) -> Column:
    """Number of edges at or below the value: left-closed classes; null stays null."""
    out = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(value.isNotNull(), out)


def wet_counts(steps: DataFrame, limit: float = EXTENT_M) -> DataFrame:
    return steps.groupBy("run_id", "t_s").agg(F.count_if(F.col("depth_m") >= limit).alias("n_wet"))


def representative_steps(counts: DataFrame, shares: tuple[float, ...] = (0.05, 0.35, 0.75)) -> DataFrame:
    """Of each run the first step that reaches each share of its peak, the first peak and the last step; distinct."""
    peak = counts.groupBy("run_id").agg(F.max("n_wet").alias("peak"), F.max("t_s").alias("last"))
    joined = counts.join(peak, "run_id")
    firsts = [F.min(F.when(F.col("n_wet") >= F.col("peak") * s, F.col("t_s"))) for s in (*shares, 1.0)]
    return joined.groupBy("run_id").agg(F.array_sort(F.array_distinct(F.array(*firsts, F.max("last")))).alias("steps")).select("run_id", F.explode("steps").alias("t_s"))


def timeline(cells: DataFrame, arrival: str, every_s: float, end_s: float) -> DataFrame:
    """Frames every ``every_s`` up to ``end_s`` and the number of cells reached by each: arrivals are put in
    the first frame that shows them, then counted up, so no frame x cell table is made."""
    frame = F.when(F.col(arrival) <= end_s, F.ceil(F.col(arrival) / every_s).cast("long"))
    counts = cells.groupBy(frame.alias("frame")).agg(F.count(arrival).alias("n")).filter("frame is not null")
    last = int(-(-end_s // every_s))
    frames = cells.sparkSession.range(last + 1).select(F.col("id").alias("frame"))
    w = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)  # one row a frame
    return frames.join(counts, "frame", "left").select("frame", F.least(F.col("frame") * every_s, F.lit(float(end_s))).alias("t_s"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n_cells"))


def poi_summary(series: DataFrame, arrival_m: float = ARRIVAL_M) -> DataFrame:
    """Peaks and first arrival of each point; a point with no finite depth is outside."""
    out = series.groupBy("poi_id").agg(F.max("depth_m").alias("peak_depth"), F.max("q_m3s").alias("peak_q"), F.min(F.when(F.col("depth_m") > arrival_m, F.col("ts"))).alias("first"), F.count("depth_m").alias("n"))
    return out.withColumn("status", F.when(F.col("n") == 0, "outside").otherwise("sampled")).drop("n")


def depth_averaged_velocity(levels: DataFrame, cap_m: float) -> DataFrame:
    """Per cell the maximum over time of the mean speed of levels at or below the surface (the bed level
    always counts), and whether a depth was over the cap. Columns: cell_id, t_s, level, z, surface, speed."""
    used = levels.filter((F.col("level") == 0) | (F.col("z") <= F.col("surface")))
    mean = used.groupBy("cell_id", "t_s").agg(F.avg("speed").alias("speed"), F.max("surface").alias("surface"))
    return mean.groupBy("cell_id").agg(F.max("speed").alias("max_velocity"), F.coalesce(F.bool_or(F.col("surface") > cap_m), F.lit(False)).alias("capped"))


def gauge_series(levels: DataFrame, speeds: DataFrame, beds: DataFrame, t_start: float) -> DataFrame:
    """poi_id, t_s, depth (water level over bed, not below 0) and speed, where both series have the time."""
    joined = levels.join(speeds, ["poi_id", "t_s"]).join(beds, "poi_id")
    return joined.select("poi_id", (F.col("t_s") + t_start).alias("t_s"), F.greatest(F.col("wse_m") - F.col("bed_m"), F.lit(0.0)).alias("depth_m"), F.hypot("vx", "vy").alias("speed_ms"))


def axis_mismatch(levels: DataFrame, speeds: DataFrame) -> DataFrame:
    """Points and times that only one of two series has."""
    keys = ["poi_id", "t_s"]
    return levels.select(*keys).exceptAll(speeds.select(*keys)).withColumn("only_in", F.lit("levels")).unionAll(speeds.select(*keys).exceptAll(levels.select(*keys)).withColumn("only_in", F.lit("speeds")))
