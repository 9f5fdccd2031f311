"""Dam-breach parameters, storage and hydrographs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.operators.loss import mapped

G = 9.81
# Coefficients of the published regressions; fixed values.
OVERTOPPING_QP = {"O": 1.85, "P": 1.0}
OVERTOPPING_WIDTH_1995 = {"O": 1.4, "P": 1.0}
OVERTOPPING_WIDTH_2008 = {"O": 1.3, "P": 1.0}
ZHONG = {"HD": (-1.58, -0.76, 0.1, -4.55), "CD": (-1.51, -1.09, -0.12, -3.61)}
XU_ZHANG_TYPE = {"CD": -0.041, "FD": 0.026, "HD": -0.226, "ZD": -0.226}
XU_ZHANG_MODE = {"O": 0.149, "P": -0.389}
XU_ZHANG_ERODIBILITY = {"H": 0.291, "M": -0.140, "L": -0.391}
FUSED_WIDTH = {"f95": -0.8220, "f8": 1.0021, "xz9": 1.1031}
FUSED_TIME = {"f95": -1.0648, "f8": 1.5875, "mclm": 0.6189}
FUSED_QP = {"f16": 0.3048, "xz9": 0.4804, "z20": 0.1674}


def breach_parameters(dams: DataFrame) -> DataFrame:
    """Peak discharge, mean width and failure time (s) of each dam by each method, their fusion, and ranges.

    Dams (dam_id, v_w, h_w, h_b, h_d, w_ave, dam_type, failure_mode, erodibility) with a null or
    non-positive size, or an unknown code, have null results of the methods that need it; a null method
    makes its fusion null. A method without a published branch for the dam's type is null too, and the peak
    discharge of one fused method is not available at all, so the fused peak stays null. A fused value of
    0 or less is kept and flagged.
    """
    ok = lambda name: F.when(F.col(name) > 0, F.col(name).cast("double"))
    v, hw, hb, hd, w = map(ok, ("v_w", "h_w", "h_b", "h_d", "w_ave"))
    mode, kind = F.col("failure_mode"), F.col("dam_type")
    tall = F.when(hb <= 6.1, 1.0).otherwise(F.pow(hb / 6.1, 1 / 8))
    z20 = F.lit(None).cast("double")
    for name, (a, b, c, k) in ZHONG.items():
        z20 = F.when(kind == name, F.sqrt(F.lit(G)) * F.pow(hw, -0.5) * v * F.pow(F.pow(v, 0.333) / hw, a) * F.pow(hw / hb, b) * F.pow(hd, c) * F.exp(F.lit(k))).otherwise(z20)
    exponent = mapped(kind, XU_ZHANG_TYPE) + mapped(mode, XU_ZHANG_MODE) + mapped(F.col("erodibility"), XU_ZHANG_ERODIBILITY)
    out = dams.select(
        "dam_id",
        (0.0175 * mapped(mode, OVERTOPPING_QP) * tall * F.sqrt(G * hw * v * hb * hb / w)).alias("qp_f16"), z20.alias("qp_z20"), (0.0212 * F.pow(v, 0.5429) * F.pow(hw, 0.8713)).alias("qp_h14"),
        (0.1803 * mapped(mode, OVERTOPPING_WIDTH_1995) * F.pow(v, 0.32) * F.pow(hb, 0.19)).alias("width_f95"), (0.27 * mapped(mode, OVERTOPPING_WIDTH_2008) * F.pow(v, 0.32) * F.pow(hb, 0.04)).alias("width_f8"),
        (0.787 * hb * F.pow(hd / 15.0, 0.133) * F.pow(F.pow(v, 1 / 3) / hw, 0.652) * F.exp(exponent)).alias("width_xz9"),
        (3600 * 0.00254 * F.pow(v, 0.53) * F.pow(hb, -0.9)).alias("time_f95"), (63.2 * F.sqrt(v / (G * hb * hb))).alias("time_f8"), (3600 * 0.0179 * F.pow(0.0261 * F.pow(v * hw, 0.769), 0.364)).alias("time_mclm"),
    )
    fuse = lambda what, parts: sum(F.col(f"{what}_{k}") * x for k, x in parts.items())
    out = out.withColumn("width_fused", fuse("width", FUSED_WIDTH)).withColumn("time_fused", fuse("time", FUSED_TIME)).withColumn("qp_fused", F.lit(None).cast("double"))
    reasons = F.array_compact(F.array(F.when(F.col("qp_fused").isNull(), "qp_blocked"), F.when(F.col("width_fused").isNull(), "width_blocked"), F.when(F.col("width_fused") <= 0, "width_nonpositive"), F.when(F.col("time_fused") <= 0, "time_nonpositive")))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    for what, a, b in (("width", "width_fused", "width_xz9"), ("time", "time_fused", "time_f8")):
        out = out.withColumn(f"{what}_low", F.when(both(a, b), F.least(a, b))).withColumn(f"{what}_high", F.when(both(a, b), F.greatest(a, b)))
    return out.withColumn("warnings", F.concat_ws(",", reasons))


def ranges(parameters: DataFrame, dams: DataFrame) -> DataFrame:
    """dam_id, output, low, high, interval and status of each dam's outputs. Dams that the equations apply to (also where that is null) have the
    ends of ``breach_parameters``, others those that ``imposed_ranges`` (a struct by output, each with value [low, high]) gives, in
    either order. Without both ends a range is ``blocked``, with null ends; a dam without parameters is blocked too."""
    applies = F.coalesce("equations_applicable", F.lit(True))
    none = F.lit(None).cast("double")
    methods = {"peak_discharge_m3s": (none, none), "breach_width_m": (F.col("width_low"), F.col("width_high")), "failure_time_s": (F.col("time_low"), F.col("time_high"))}

    def one(output: str) -> Column:
        given, (low, high) = F.col(f"imposed_ranges.{output}.value"), methods[output]
        low, high = F.when(applies, low).otherwise(F.get(given, 0)), F.when(applies, high).otherwise(F.get(given, 1))
        both = low.isNotNull() & high.isNotNull()
        return F.struct(
            F.lit(output).alias("output"), F.when(both, F.least(low, high)).alias("low"), F.when(both, F.greatest(low, high)).alias("high"),
            F.when(applies, "method_range").otherwise("imposed").alias("interval"), F.when(both, "ok").otherwise("blocked").alias("status"))

    joined = dams.select("dam_id", "equations_applicable", "imposed_ranges").join(parameters.select("dam_id", "width_low", "width_high", "time_low", "time_high"), "dam_id", "left")
    return joined.select("dam_id", F.explode(F.array(*map(one, methods))).alias("r")).select("dam_id", "r.*")


def weir_discharge(b: Column, z: Column, head: Column, c_r: float, c_s: float) -> Column:
    return F.when(head <= 0, 0.0).otherwise(c_r * b * F.pow(head, 1.5) + c_s * z * F.pow(head, 2.5))


def storage_volume(v_w: Column, h_w: Column, h: Column, exponent: float) -> Column:
    """V(h) = V_w (h / h_w) ** (b / (b - 1)), h held to [0, h_w]."""
    held = F.least(F.greatest(h, F.lit(0.0)), h_w)
    return v_w * F.pow(held / h_w, exponent / (exponent - 1))


def storage_head(v_w: Column, h_w: Column, v: Column, exponent: float) -> Column:
    held = F.least(F.greatest(v, F.lit(0.0)), v_w)
    return h_w * F.pow(held / v_w, (exponent - 1) / exponent)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once for each row however often ``use`` names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def interpolated(points: Column, x: Column, of: str = "x", to: str = "y") -> Column:
    """Piecewise-linear through an array of structs with strictly increasing ``of``, held to its ends."""

    def at(points: Column, x: Column, below: Column) -> Column:
        a, k = F.try_element_at(below, F.lit(-1)), F.size(below)
        b = F.try_element_at(points, k + 1)
        inner = a[to] + (x - a[of]) * (b[to] - a[to]) / (b[of] - a[of])
        return F.when(x.isNull() | points.isNull(), None).when(k == 0, F.element_at(points, 1)[to]).when(k == F.size(points), F.element_at(points, -1)[to]).otherwise(inner)

    return bound(F.struct(points.alias("points"), x.alias("x")), lambda s: bound(F.filter(s["points"], lambda p: p[of] <= s["x"]), lambda below: at(s["points"], s["x"], below)))


def above_invert(points: Column, invert: Column) -> Column:
    """A surveyed curve (array of elevation x and volume y, both increasing) as heads and volumes over a breach invert:
    the invert itself is (0, 0), and what lies below it goes. Null where the invert is outside the survey."""
    above = lambda base: F.transform(F.filter(points, lambda p: p["x"] > invert), lambda p: F.struct((p["x"] - invert).alias("x"), (p["y"] - base).alias("y")))
    inside = (invert >= F.element_at(points, 1)["x"]) & (invert <= F.element_at(points, -1)["x"])
    return F.when(inside, F.concat(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), bound(interpolated(points, invert), above)))


def peak_in_range(peak: Column, low: Column, high: Column) -> Column:
    """Whether a hydrograph's peak lies in the range of methods, ends included; null where the range is blocked."""
    return F.when(low.isNull() | high.isNull(), None).otherwise(peak.between(low, high))


def symmetric_triangle(events: DataFrame, dt_s: float) -> DataFrame:
    """series_id, t_s, q_m3s of events (series_id, base, peak, duration_s): from the base flow up to the peak at half of the
    duration and back, sampled every ``dt_s`` and at the three corners."""
    half = F.col("duration_s") / 2
    grid = F.transform(F.sequence(F.lit(0), F.floor(F.col("duration_s") / dt_s).cast("int")), lambda k: k * F.lit(float(dt_s)))
    t = F.explode(F.array_sort(F.array_union(grid, F.array(F.lit(0.0), half, F.col("duration_s").cast("double"))))).alias("t_s")
    rows = events.select("series_id", "base", "peak", half.alias("half"), t)
    return rows.select("series_id", "t_s", (F.col("base") + (F.col("peak") - F.col("base")) * (1 - F.abs(F.col("t_s") - F.col("half")) / F.col("half"))).alias("q_m3s"))


def triangular(parameters: DataFrame, dt_s: float, offset_s: float = 0.0) -> DataFrame:
    """series_id, t_s, q_m3s of triangles (series_id, q_p, v, t_f) that rise to q_p at t_f and hold the volume v:
    a regular grid and the three corners. Infeasible ones (2 v / q_p not over t_f) give no rows."""
    base = parameters.withColumn("t_b", 2 * F.col("v") / F.col("q_p")).filter("q_p > 0 and v > 0 and t_f > 0 and t_b > t_f")
    rise, peak, end = F.lit(offset_s), offset_s + F.col("t_f"), offset_s + F.col("t_b")
    grid = F.transform(F.sequence(F.lit(0), F.floor(end / dt_s).cast("int")), lambda k: k * F.lit(dt_s))
    points = base.withColumn("t_s", F.explode(F.array_union(grid, F.array(rise, peak, end))))
    t = F.col("t_s")
    q = F.when(t <= rise, 0.0).when(t <= peak, F.col("q_p") * (t - rise) / F.col("t_f")).otherwise(F.col("q_p") * (end - t) / (F.col("t_b") - F.col("t_f")))
    return points.select("series_id", "t_s", q.alias("q_m3s"))


def trapezoid_volume(series: DataFrame, key: str = "series_id") -> DataFrame:
    """Volume under each series and whether its times increase strictly."""
    w = Window.partitionBy(key).orderBy("t_s", "q_m3s")
    step = series.withColumn("dt", F.col("t_s") - F.lag("t_s").over(w)).withColumn("area", (F.col("q_m3s") + F.lag("q_m3s").over(w)) / 2 * F.col("dt"))
    return step.groupBy(key).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("volume_m3"), F.coalesce(F.min("dt") > 0, F.lit(True)).alias("increasing"))


def mass_balance(balance: DataFrame) -> DataFrame:
    """Last error as percent of the inflows' last values (negative ones as 0); columns run_id, quantity, t, value."""
    last = balance.groupBy("run_id", "quantity").agg(F.max_by("value", "t").alias("value"))
    inflow = F.sum(F.when(F.col("quantity") == "inflow", F.greatest("value", F.lit(0.0))))
    error = F.max(F.when(F.col("quantity") == "error", F.col("value")))
    return last.groupBy("run_id").agg(F.when(inflow > 0, error / inflow * 100).alias("error_pct"))


def method_errors(cases: DataFrame, methods: list[str], observed: str) -> DataFrame:
    """Median percentage error of each method against observed values, and the median absolute deviation from it."""
    long = cases.select(observed, F.explode(F.create_map(*(y for m in methods for y in (F.lit(m), F.col(m))))).alias("method", "value"))
    pe = long.filter(F.col("value").isNotNull() & (F.col(observed) > 0)).withColumn("pe", (F.col("value") - F.col(observed)) / F.col(observed) * 100)
    mid = pe.groupBy("method").agg(F.percentile("pe", 0.5).alias("median_pe"))
    return pe.join(F.broadcast(mid), "method").groupBy("method", "median_pe").agg(F.percentile(F.abs(F.col("pe") - F.col("median_pe")), 0.5).alias("mad"), F.count("*").alias("n"))


def grow_breach(scenarios: DataFrame, dt_s: float = 30.0, c_r: float = 1.7, c_s: float = 1.35, drained: float = 0.99, most: float = 10.0) -> DataFrame:
    """series_id, peak_q, t_peak_s, volume_m3, error_pct of breaches that grow linearly over t_f while their reservoir drains.

    Columns: series_id, v_w, h_w, width (mean), h_b, t_f, z (side slope), exponent. Level-pool routing by
    fourth-order Runge-Kutta steps, all scenarios of a batch at once, on all cores however small their file, until ``drained`` of the water has left or ``most``
    times t_f has passed. A scenario whose numbers are null or
    not positive, or whose bottom width is not, has null results.
    """

    def run(batches):
        for pdf in batches:
            v_w, h_w, width, h_b, t_f, z, exponent = (pdf[k].to_numpy(float) for k in ("v_w", "h_w", "width", "h_b", "t_f", "z", "exponent"))
            bottom, power = width - z * h_b, (exponent - 1) / exponent
            good = (v_w > 0) & (h_w > 0) & (t_f > 0) & (bottom > 0)

            def flow(at: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
                """Outflow of the scenarios ``at`` at their times and volumes."""
                grown = np.clip(t / t_f[at], 0, 1)
                head = np.maximum(h_w[at] * (np.clip(v, 0, v_w[at]) / v_w[at]) ** power[at] - h_w[at] * (1 - grown), 0)
                return c_r * bottom[at] * grown * head**1.5 + c_s * z[at] * head**2.5

            n = len(pdf)
            t, v, q, peak, t_peak, volume = np.zeros(n), v_w.copy(), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
            at = np.flatnonzero(good)
            while len(at):
                step = np.minimum(dt_s, t_f[at] / 50)
                k1 = flow(at, t[at], v[at])
                k2 = flow(at, t[at] + step / 2, v[at] - k1 * step / 2)
                k3 = flow(at, t[at] + step / 2, v[at] - k2 * step / 2)
                k4 = flow(at, t[at] + step, v[at] - k3 * step)
                v[at] = np.maximum(v[at] - step * (k1 + 2 * k2 + 2 * k3 + k4) / 6, 0)
                t[at] += step
                now = flow(at, t[at], v[at])
                volume[at] += step * (q[at] + now) / 2
                q[at] = now
                top = at[now > peak[at]]
                peak[top], t_peak[top] = q[top], t[top]
                at = at[(v[at] > (1 - drained) * v_w[at]) & (t[at] < most * t_f[at])]
            out = v_w - v
            error = (volume - out) / np.maximum(out, 1e-9) * 100
            yield pd.DataFrame({"series_id": pdf["series_id"], **{k: np.where(good, x, np.nan) for k, x in (("peak_q", peak), ("t_peak_s", t_peak), ("volume_m3", volume), ("error_pct", error))}})

    dealt = scenarios.repartition(3 * scenarios.sparkSession.sparkContext.defaultParallelism, "series_id")
    return dealt.mapInPandas(run, "series_id long, peak_q double, t_peak_s double, volume_m3 double, error_pct double")
