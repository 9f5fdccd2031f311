"""Flood maps without a surrogate: a discharge routed down a channel, uniform flow by column, depth over the drainage.

A column of the grid is a station along the channel. Everything is keyed by site; columns are few, and they meet the
cells by a join on (site, column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.operators.series import cumulative_arrival, gradient, manning


def channel_by_column(cells: DataFrame, cell_m: float, hand_m: float = 2.0) -> DataFrame:
    """site_id, col, width_m and n: width of the cells (site_id, col, hand, n, in_domain) at most ``hand_m`` over the
    drainage, one cell at least, and their mean roughness, or that of the column's domain if there are none."""
    active = F.col("in_domain") & (F.col("hand") <= hand_m)
    return cells.groupBy("site_id", "col").agg(
        (F.greatest(F.count_if(active), F.lit(1)) * cell_m).alias("width_m"), F.coalesce(F.avg(F.when(active, F.col("n"))), F.avg(F.when(F.col("in_domain"), F.col("n")))).alias("n"),
    )


def column_flow(channel: DataFrame, stations: DataFrame, peak_m3s: float, offset_s: float = 0.0, least_slope: float = 1e-4) -> DataFrame:
    """site_id, col, depth_m, velocity_ms and arrival_s of uniform flow at each station (site_id, col, chainage_m,
    bed_m): the peak discharge does not change along the channel, and the wave travels at 5/3 of the velocity."""
    if peak_m3s <= 0:
        raise ValueError("the peak discharge must be over 0")
    s = channel.join(stations, ["site_id", "col"])
    slope = F.greatest(F.abs(gradient(s, "site_id", "chainage_m", "bed_m")), F.lit(least_slope))
    s = s.withColumn("slope", slope)
    depth, velocity, celerity = manning(peak_m3s / F.col("width_m"), F.col("n"), F.col("slope"))
    s = cumulative_arrival(s.withColumns({"depth_m": depth, "velocity_ms": velocity, "celerity": celerity}), "site_id", offset_s)
    return s.select("site_id", "col", "width_m", "n", "slope", "depth_m", "velocity_ms", "arrival_s")


def fallback_map(cells: DataFrame, flow: DataFrame, arrival_m: float = 0.1, extent_m: float = 0.3) -> DataFrame:
    """site_id, cell_id, depth_m, velocity_ms, arrival_s and zone of cells (site_id, cell_id, col, hand, in_domain): the
    column's depth less the height over the drainage; dry cells have no velocity and no arrival."""
    c = cells.join(flow.select("site_id", "col", F.col("depth_m").alias("stage"), F.col("velocity_ms").alias("v"), F.col("arrival_s").alias("a")), ["site_id", "col"], "left")
    depth = F.when(F.col("in_domain"), F.greatest(F.coalesce(F.col("stage") - F.col("hand"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    c = c.withColumn("depth_m", depth)
    wet = F.col("depth_m") > arrival_m
    return c.select("site_id", "cell_id", "depth_m", F.when(wet, F.col("v")).otherwise(0.0).alias("velocity_ms"), F.when(wet, F.col("a")).alias("arrival_s"), F.when(F.col("depth_m") > extent_m, 2).otherwise(0).alias("zone"))
