"""Exposure, damage and loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Run ids in one list, and ids that are broadcast at most.
TOGETHER, BROADCAST = 1000, 1_000_000


def cell_of(x: Column, y: Column, origin_x: float, origin_y: float, cell_m: float, width: int, height: int) -> Column:
    """Row-major cell of a point; null outside the grid."""
    col, row = F.floor((x - origin_x) / cell_m), F.floor((origin_y - y) / cell_m)
    return F.when((col >= 0) & (col < width) & (row >= 0) & (row < height), row * width + col)


def in_each_run(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``points`` once for each run_id of ``runs``. Ids travel in lists of about TOGETHER, in a small table that is broadcast up to
    BROADCAST ids; with more, points are dealt to the lists by a shuffle."""
    ids = runs.select("run_id").distinct()
    n = ids.count()
    lists = -(-n // TOGETHER)
    own = ids.groupBy(F.pmod(F.xxhash64("run_id"), F.lit(max(lists, 1))).cast("int").alias("_b")).agg(F.collect_list("run_id").alias("_ids"))
    dealt = points.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(max(lists - 1, 0)))))
    return dealt.join(F.broadcast(own) if n <= BROADCAST else own, "_b").withColumn("run_id", F.explode("_ids")).drop("_b", "_ids")


def sample(points: DataFrame, cells: DataFrame, value: str, keys: tuple[str, ...] = (), **grid) -> DataFrame:
    """``points`` (x_m, y_m, ``keys``) with ``value`` of the cell they are in; null outside and where the cell is null or absent."""
    at = points.withColumn("cell_id", cell_of(F.col("x_m"), F.col("y_m"), **grid))
    return at.join(cells.select("cell_id", *keys, value), ["cell_id", *keys], "left")


def damage_fraction(depth: Column, curve: list[tuple[float, float]], cap_m: float) -> Column:
    """Piecewise-linear through the curve's points, depth held to [0, cap] and to the curve's ends; null stays null."""
    d = F.when(depth.isNotNull(), F.least(F.greatest(depth, F.lit(0.0)), F.lit(cap_m)))
    out = F.when(d <= curve[0][0], F.lit(curve[0][1]))
    for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
        out = out.when(d <= x1, F.lit(y0) + (d - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.when(d.isNotNull(), F.lit(curve[-1][1])))


def class_damage(depth: Column, asset_class: Column, curves: dict[str, list[tuple[float, float]]], cap_m: float) -> Column:
    out = F.lit(None).cast("double")
    for name, curve in curves.items():
        out = F.when(asset_class == name, damage_fraction(depth, curve, cap_m)).otherwise(out)
    return out


def mapped(column: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def building_losses(buildings: DataFrame, curves: dict, values: dict[str, float], classes: dict[str, str], default_class: str, cap_m: float = 6.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Loss by ``keys`` and class: fraction x area x value of each building with depth over 0. Buildings off the grid or
    without a depth are counted apart; a class without a value has a null loss, never 0."""
    b = buildings.withColumn("asset_class", mapped(F.col("kind"), classes, default_class))
    fraction = class_damage(F.col("depth_m"), F.col("asset_class"), curves, cap_m)
    price = mapped(F.col("asset_class"), values).cast("double")
    wet = F.col("depth_m") > 0
    return b.groupBy(*keys, "asset_class").agg(F.sum(F.when(wet, fraction * F.col("area_m2") * price)).alias("loss"), F.count_if(wet).alias("n_flooded"), F.count_if(F.col("depth_m").isNull()).alias("n_excluded"), F.count("*").alias("n_buildings"), F.count_if(wet & (F.col("depth_m") > cap_m)).alias("n_over_cap"))


def asset_value(eur: Column, rate: float, index: float) -> Column:
    return eur * rate * index


def scaled_by_product(countries: DataFrame, regions: DataFrame) -> DataFrame:
    """Value of a unit of countries (country, region, gdp): their product times the region's (region, max_damage, gdp) largest damage
    by product; null where the region is unknown or has no product."""
    ratio = F.col("max_damage") / F.nullif(F.col("region_gdp"), F.lit(0.0))
    known = regions.select("region", "max_damage", F.col("gdp").alias("region_gdp"))
    return countries.join(known, "region", "left").withColumn("value_eur", F.col("gdp") * ratio).drop("max_damage", "region_gdp")


def priced(values: DataFrame, rate: float, index: float, sourced: Column) -> DataFrame:
    """value_inr of value_eur and its status: none, and a placeholder, where rate or index is not ``sourced``."""
    return values.withColumns({"value_inr": F.when(sourced, asset_value(F.col("value_eur"), rate, index)), "status": F.when(sourced, "sourced").otherwise("placeholder")})


def stale_values(values: DataFrame, rate: float, index: float, tolerance: float = 1e-6) -> DataFrame:
    """Priced rows whose stored value is not what price, rate and index give."""
    want = asset_value(F.col("value_eur"), rate, index)
    return values.filter(F.abs(F.col("value") - want) > tolerance * F.abs(want))


def road_losses(pieces: DataFrame, curve: list[tuple[float, float]], price: float, width_m: float, cap_m: float = 6.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Loss and flooded length of road pieces (road_id, piece_m, depth_m)."""
    wet = F.col("depth_m") > 0
    return pieces.groupBy(*keys, "road_id").agg(F.sum(F.when(wet, damage_fraction(F.col("depth_m"), curve, cap_m) * F.col("piece_m") * width_m * price)).alias("loss"), F.sum(F.when(wet, F.col("piece_m")).otherwise(0.0)).alias("flooded_m"))


def loss_estimate(losses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """P10, P50 and P90 losses (columns p10, p50, p90) by class and in total (class null), for each of ``keys``; null
    stays out of sums."""
    out = losses.rollup(*keys, "asset_class").agg(*(F.sum(x).alias(x) for x in ("p10", "p50", "p90")), *(F.grouping(k).alias(f"all_{k}") for k in keys))
    for k in keys:
        out = out.filter(F.col(f"all_{k}") == 0).drop(f"all_{k}")
    return out


def population_at_risk(cells: DataFrame) -> DataFrame:
    """value = sum of p x population; low counts the high zone (2), high the high and possible zones."""
    people = F.col("population")
    return cells.agg(F.sum(F.col("p") * people).alias("value"), F.sum(F.when(F.col("zone") == 2, people).otherwise(0.0)).alias("low"), F.sum(F.when(F.col("zone") >= 1, people).otherwise(0.0)).alias("high"))


def by_zone(assets: DataFrame, zones: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Number of assets by kind and zone."""
    return assets.groupBy("kind").pivot("zone", list(zones)).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({str(z): f"zone_{z}" for z in zones})


def warning_table(points: DataFrame, first: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points by arrival, those without last, ties by id; the ``first`` ones of each of ``keys`` if given."""
    order = [F.asc_nulls_last("arrival_s"), F.col("osm_id")]
    if first and keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return points.withColumn("rank", rank).filter(F.col("rank") <= first).drop("rank").orderBy(*keys, *order)
    out = points.orderBy(*keys, *order)
    return out.limit(first) if first else out


def shorten(text: Column, most: int = 254) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
