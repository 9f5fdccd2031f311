"""Time series: crossings, cascades, interpolation, centrelines and moving totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_crossing(series: DataFrame, key: str, threshold: float | Column, t: str = "t_s", q: str = "q_m3s") -> DataFrame:
    """First time each series reaches its threshold, interpolated from the sample before; a series that begins
    at or over it has its first time, one that never reaches it null. Nulls are skipped."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    w = Window.partitionBy(key).orderBy(t, q)
    s = series.filter(F.col(q).isNotNull()).withColumn("_t", F.lag(t).over(w)).withColumn("_q", F.lag(q).over(w))
    at = F.when(F.col("_t").isNull() | (F.col(q) == F.col("_q")), F.col(t).cast("double")).otherwise(F.col("_t") + (limit - F.col("_q")) / (F.col(q) - F.col("_q")) * (F.col(t) - F.col("_t")))
    return s.groupBy(key).agg(F.min_by(F.when(F.col(q) >= limit, at), F.when(F.col(q) >= limit, F.struct(t, q))).alias("t_cross"))


def cascade(dams: DataFrame, inflow: DataFrame, levels: int) -> DataFrame:
    """Trigger time of each dam of a chain (dam_id, upstream_id, threshold, delay_s): where the routed inflow
    (dam_id, t_s, q_m3s; seconds after the upstream failure) first reaches the dam's threshold, on the
    clock of the first failure. A dam whose upstream never fails does not fail; the loop is over dam order."""
    local = first_crossing(inflow.join(dams.select("dam_id", "threshold"), "dam_id"), "dam_id", F.col("threshold")).withColumnRenamed("t_cross", "t_local")
    state = dams.join(local, "dam_id", "left")
    found = state.filter("upstream_id is null").select("dam_id", F.lit(0.0).alias("t_trigger"))
    front = found
    for _ in range(levels):
        up = front.select(F.col("dam_id").alias("upstream_id"), F.col("t_trigger").alias("t_up"))
        front = state.join(up, "upstream_id").select("dam_id", (F.col("t_up") + F.col("delay_s") + F.col("t_local")).alias("t_trigger"))
        found = found.unionAll(front)
    return dams.select("dam_id").join(found, "dam_id", "left")


def interpolate(series: DataFrame, targets: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``targets`` (key, x) with y interpolated in each series, held to its ends."""
    w = Window.partitionBy(key).orderBy(x)
    s = series.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    pieces = s.select(key, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lag(x).over(w).isNull().alias("first"))
    inside = ((F.col(x) >= F.col("x0")) | F.col("first")) & ((F.col(x) < F.col("x1")) | F.col("x1").isNull())
    at = F.when(F.col("x1").isNull() | (F.col(x) <= F.col("x0")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return targets.join(pieces, key).filter(inside).select(*targets.columns, at.alias(y))


def chainage(path: DataFrame, key: str = "path_id", order: str = "step") -> DataFrame:
    """Distance along each path of points (x_m, y_m)."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)), F.lit(0.0))
    return path.withColumn("_d", step).withColumn("chainage_m", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def resample_chainage(path: DataFrame, every_m: float, key: str = "path_id") -> DataFrame:
    """Each path at regular distances: interpolated x, y and the row and column nearest (halves to even)."""
    total = path.groupBy(key).agg(F.max("chainage_m").alias("total"))
    targets = total.select(key, F.explode(F.sequence(F.lit(0), F.floor(F.col("total") / every_m).cast("int"))).alias("k")).select(key, (F.col("k") * every_m).alias("chainage_m"))
    out = targets
    for name in ("x_m", "y_m", "row", "col"):
        out = out.join(interpolate(path, targets, key, "chainage_m", name), [key, "chainage_m"])
    return out.withColumn("row", F.bround("row").cast("int")).withColumn("col", F.bround("col").cast("int"))


def gradient(series: DataFrame, key: str, x: str, y: str) -> Column:
    """Second-order difference for uneven spacing, one-sided at the ends, as a window column."""
    w = Window.partitionBy(key).orderBy(x)
    x0, x1, y0, y1 = F.lag(x).over(w), F.lead(x).over(w), F.lag(y).over(w), F.lead(y).over(w)
    a, b = F.col(x) - x0, x1 - F.col(x)
    inner = (a * a * y1 - b * b * y0 + (b * b - a * a) * F.col(y)) / (a * b * (a + b))
    return F.when(x0.isNull(), (y1 - F.col(y)) / b).when(x1.isNull(), (F.col(y) - y0) / a).otherwise(inner)


def bed_slope(path: DataFrame, key: str = "path_id", least: float = 1e-4) -> DataFrame:
    return path.withColumn("slope", F.greatest(F.abs(gradient(path, key, "chainage_m", "bed_m")), F.lit(least)))


def manning(q: Column, n: Column, slope: Column) -> tuple[Column, Column, Column]:
    """Normal depth, velocity and celerity (5/3 of the velocity, 0.1 at least) of a unit discharge."""
    depth = F.pow(q * n / F.sqrt(slope), 0.6)
    velocity = F.when(depth > 0, q / depth).otherwise(0.0)
    return depth, velocity, F.greatest(velocity * (5 / 3), F.lit(0.1))


def cumulative_arrival(path: DataFrame, key: str = "path_id", offset_s: float = 0.0) -> DataFrame:
    """Travel time: the sum of steps over celerity; the first step is the first chainage."""
    w = Window.partitionBy(key).orderBy("chainage_m")
    step = F.coalesce(F.col("chainage_m") - F.lag("chainage_m").over(w), F.col("chainage_m")) / F.col("celerity")
    return path.withColumn("_s", step).withColumn("arrival_s", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) + offset_s).drop("_s")


def trailing_totals(rain: DataFrame, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Daily sums per site and the totals of the last days, the day included; days without rows are not made up."""
    daily = rain.groupBy("site_id", "d").agg(F.sum("mm").alias("mm")).withColumn("day", F.datediff("d", F.lit("1970-01-01").cast("date")))
    over = lambda n: Window.partitionBy("site_id").orderBy("day").rangeBetween(-(n - 1), 0)
    return daily.select("site_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "mm", *(F.sum("mm").over(over(n)).alias(f"mm_{n}d") for n in days))


def totals_as_of(rain: DataFrame, as_of: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals of the days up to ``as_of`` per site; null (not 0) for a window without a row."""
    age = F.datediff(F.lit(as_of).cast("date"), "d")
    return rain.groupBy("site_id").agg(*(F.sum(F.when((age >= 0) & (age < n), F.col("mm"))).alias(f"mm_{n}d") for n in days))


def nearest_samples(series: DataFrame, key: str, every_s: float) -> DataFrame:
    """Of each series the sample nearest every multiple of ``every_s`` up to its last time; the earlier of ties, distinct."""
    # only the samples within an interval of a target can be nearest, unless there are none
    below, target = F.floor(F.col("t_s") / every_s).cast("int"), F.col("k") * every_s
    near = series.filter(F.col(key).isNotNull()).select(key, "t_s", below.alias("below"), F.explode(F.array(below, below + 1)).alias("k"))
    before, after = (F.when(x, F.col("t_s")) for x in (F.col("t_s") <= target, F.col("t_s") > target))
    near = near.groupBy(key, "k").agg(F.max(before).alias("a"), F.min(after).alias("b"), F.max("below").alias("below"))
    near = near.withColumn("last", F.max("below").over(Window.partitionBy(key))).filter("k between 0 and last")
    return near.select(key, F.when(F.col("b").isNull() | (target - F.col("a") <= F.col("b") - target), F.col("a")).otherwise(F.col("b")).alias("t_s")).distinct()


def clip_series(series: DataFrame, key: str, start: float, end: float, divide_by: float = 1.0) -> DataFrame:
    """Samples inside [start, end] with interpolated end points, time from start, values divided; a series
    that does not reach over both ends is left out."""
    span = series.groupBy(key).agg(F.min("t_s").alias("a"), F.max("t_s").alias("b")).filter((F.col("a") <= start) & (F.col("b") >= end)).select(key)
    inner = series.join(span, key, "left_semi").filter((F.col("t_s") > start) & (F.col("t_s") < end)).select(key, F.col("t_s").cast("double").alias("t_s"), F.col("q_m3s").cast("double").alias("q_m3s"))
    ends = interpolate(series, span.select(key, F.explode(F.array(F.lit(float(start)), F.lit(float(end)))).alias("t_s")), key, "t_s", "q_m3s")
    return inner.unionByName(ends).select(key, (F.col("t_s") - start).alias("t_s"), (F.col("q_m3s") / divide_by).alias("v"))
