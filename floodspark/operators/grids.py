"""Cells on regular grids: geometry, resampling, neighbourhoods and point searches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# WGS 84 and the UTM projection; fixed values.
A, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere), by Krueger's series in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return FALSE_EASTING + SCALE * radius * x, SCALE * radius * y


def lonlat(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (SCALE * radius), (x - FALSE_EASTING) / (SCALE * radius)
    xi2 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta2 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(phi)


def snapped_grid(boxes: DataFrame, cell_m: float) -> DataFrame:
    """Grid of each box (id, x0, y0, x1, y1), snapped outward to multiples of the cell."""
    down, up = (lambda c: F.floor(F.col(c) / cell_m) * cell_m), (lambda c: F.ceil(F.col(c) / cell_m) * cell_m)
    return boxes.select("id", down("x0").alias("origin_x"), up("y1").alias("origin_y"), ((up("x1") - down("x0")) / cell_m).cast("int").alias("width"), ((up("y1") - down("y0")) / cell_m).cast("int").alias("height"))


def nested_grid(boxes: DataFrame) -> DataFrame:
    """Near grid of each box (id, x0, y0, x1, y1, cell_m) inside its far grid (far_x, far_y, far_width, far_height, far_m), snapped
    outward to corners of far cells. ``problem`` says why a box has none: its cell does not divide the far one, or it leaves the far grid."""
    far = F.col("far_m")
    low, high = (lambda c, o: F.col(o) + F.floor((F.col(c) - F.col(o)) / far) * far), (lambda c, o: F.col(o) + F.ceil((F.col(c) - F.col(o)) / far) * far)
    left, right, bottom, top = low("x0", "far_x"), high("x1", "far_x"), low("y0", "far_y"), high("y1", "far_y")
    ratio = far / F.col("cell_m")
    outside = (left < F.col("far_x")) | (top > F.col("far_y")) | (right > F.col("far_x") + F.col("far_width") * far) | (bottom < F.col("far_y") - F.col("far_height") * far)
    undivided = (F.col("cell_m") > far) | (F.abs(ratio - F.round(ratio)) > 1e-9)
    problem = F.when(undivided, "cell does not divide").when(outside, "outside far grid")
    count = lambda a, b: F.round((b - a) / F.col("cell_m")).cast("int")
    found = {"origin_x": left, "origin_y": top, "width": count(left, right), "height": count(bottom, top)}
    return boxes.select("id", *(F.when(problem.isNull(), c).alias(name) for name, c in found.items()), problem.alias("problem"))


def clip_to_boxes(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, x_m, y_m) inside the one box (keys, x0, y0, x1, y1) of their key, edges included."""
    inside = F.col("x_m").between(F.col("x0"), F.col("x1")) & F.col("y_m").between(F.col("y0"), F.col("y1"))
    return points.join(boxes.select(*keys, "x0", "y0", "x1", "y1"), keys).filter(inside).drop("x0", "y0", "x1", "y1")


def overview(cells: DataFrame, factor: int, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Blocks of factor x factor cells: mean terrain, maximum depth, and the surface where there is depth."""
    block = [F.floor(F.col(x) / factor).cast("int").alias(x) for x in ("row", "col")]
    out = cells.groupBy(*keys, *block).agg(F.avg("z").alias("z"), F.max("depth_m").alias("depth_m"))
    return out.withColumn("surface_m", F.when(F.col("depth_m") > 0, F.col("z") + F.col("depth_m")))


def resample(cells: DataFrame, value: str, source_m: float, target_m: float, method: str) -> DataFrame:
    """Cells (row, col, value) on another grid with the same corner. ``sum`` and ``average`` weigh by overlap (``sum``
    keeps the total), min, max and mode take every overlapped cell, nearest the one at the centre."""
    lo = {x: F.col(x) * source_m for x in ("row", "col")}
    first = {x: F.floor(lo[x] / target_m) for x in lo}
    last = {x: F.ceil((lo[x] + source_m) / target_m) - 1 for x in lo}
    if method == "nearest":
        ratio = target_m / source_m
        # target centres inside the source cell
        first = {x: F.ceil(F.col(x) / ratio - 0.5) for x in lo}
        last = {x: F.ceil((F.col(x) + 1) / ratio - 0.5) - 1 for x in lo}
    out = cells.withColumn("_a", F.when(last["row"] >= first["row"], F.sequence(first["row"], last["row"]))).withColumn("_b", F.when(last["col"] >= first["col"], F.sequence(first["col"], last["col"])))
    out = out.withColumn("trow", F.explode("_a")).withColumn("tcol", F.explode("_b"))
    overlap = lambda x, t: F.least(lo[x] + source_m, (F.col(t) + 1) * target_m) - F.greatest(lo[x], F.col(t) * target_m)
    weight = overlap("row", "trow") * overlap("col", "tcol")
    v = F.col(value)
    seen = F.when(v.isNotNull(), weight)
    agg = {"sum": F.sum(v * weight / source_m**2), "average": F.sum(v * weight) / F.sum(seen), "min": F.min(v), "max": F.max(v), "nearest": F.first(v), "mode": None}[method]
    if method == "mode":  # the value with the largest share, the smaller of ties
        share = out.filter(v.isNotNull()).groupBy("trow", "tcol", value).agg(F.sum(weight).alias("w"))
        return share.groupBy("trow", "tcol").agg(F.max_by(value, F.struct("w", -F.col(value))).alias(value)).withColumnsRenamed({"trow": "row", "tcol": "col"})
    return out.groupBy("trow", "tcol").agg(agg.alias(value)).withColumnsRenamed({"trow": "row", "tcol": "col"})


def bilinear(points: DataFrame, cells: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Value at points (id, r, c in cell units from the first cell's centre) from the four cells around; null if one
    is absent or null."""
    corners = points.withColumn("dr", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dc", F.explode(F.array(F.lit(0), F.lit(1))))
    corners = corners.withColumn("row", (F.floor("r") + F.col("dr")).cast("int")).withColumn("col", (F.floor("c") + F.col("dc")).cast("int"))
    part = lambda x, d: F.when(F.col(d) == 1, F.col(x) - F.floor(x)).otherwise(1 - (F.col(x) - F.floor(x)))
    weight = part("r", "dr") * part("c", "dc")
    got = corners.withColumn("w", weight).filter("w > 0").join(cells.select(*keys, "row", "col", value), [*keys, "row", "col"], "left")
    return got.groupBy(*keys, "id").agg(F.when(F.count(value) == F.count("*"), F.sum(F.col("w") * F.col(value))).alias(value))


def warp(cells: DataFrame, value: str, source: tuple[float, float, float, int], target: tuple[float, float, float, int], width: int, height: int, method: str = "bilinear") -> DataFrame:
    """row, col and value of a grid of ``width`` x ``height`` cells, at their centres, from the cells of another grid. A grid is the x and y of its
    upper-left corner, its cell and its UTM zone; centres go through lon/lat where zones differ. ``bilinear`` is null unless all
    four cells around have a value, ``nearest`` takes the cell that holds the centre. Target rows are made by Spark and meet
    the source by equal row and column."""
    (x0, y0, m, zone), (u0, v0, n, zone2) = source, target
    points = cells.sparkSession.range(width * height).withColumn("trow", F.floor(F.col("id") / width).cast("int")).withColumn("tcol", (F.col("id") % width).cast("int"))
    x, y = u0 + (F.col("tcol") + 0.5) * n, v0 - (F.col("trow") + 0.5) * n
    if zone != zone2:
        lon, lat = lonlat(x, y, zone2)
        points = points.withColumn("lon", lon).withColumn("lat", lat)
        x, y = utm(F.col("lon"), F.col("lat"), zone)
    points = points.select("id", "trow", "tcol", F.round((y0 - y) / m - 0.5, 9).alias("r"), F.round((x - x0) / m - 0.5, 9).alias("c"))
    if method == "nearest":
        at = points.withColumn("row", F.floor(F.col("r") + 0.5).cast("int")).withColumn("col", F.floor(F.col("c") + 0.5).cast("int"))
        got = at.select("id", "row", "col").join(cells.select("row", "col", value), ["row", "col"], "left").select("id", value)
    else:
        got = bilinear(points.select("id", "r", "c"), cells, value)
    place = (F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return got.select(*place, value)


def tile_names(boxes: DataFrame, step: int) -> DataFrame:
    """id and the names (as N24E087, of the south-west corner) of the tiles of ``step`` degrees that boxes (id, west, south, east, north) touch."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / step) * step, F.floor(F.col(hi) / step) * step, F.lit(step).cast("long")))
    part = lambda c, plus, minus, digits: F.concat(F.when(F.col(c) >= 0, plus).otherwise(minus), F.lpad(F.abs(c).cast("string"), digits, "0"))
    return boxes.withColumn("lat", span("south", "north")).withColumn("lon", span("west", "east")).select("id", F.concat(part("lat", "N", "S", 2), part("lon", "E", "W", 3)).alias("tile"))


def mosaic(tiles: DataFrame, projection: str | None = None) -> DataFrame:
    """First valid value of overlapping tiles (tile_order, row, col, z). Tiles of more than one ``projection`` are an error."""
    if projection and tiles.select(projection).distinct().limit(2).count() > 1:
        raise ValueError(f"tiles of more than one {projection}: put them on one grid first")
    return tiles.groupBy("row", "col").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("tile_order"))).alias("z"))


def roughness(cells: DataFrame, table: DataFrame, channel_class: int = 999) -> DataFrame:
    """Manning's n by land-cover code, channel cells by their own class; a code without a row is null."""
    code = F.when(F.col("channel"), channel_class).otherwise(F.col("code"))
    return cells.withColumn("used_code", code).join(F.broadcast(table.withColumnRenamed("code", "used_code")), "used_code", "left")


def unknown_codes(cells: DataFrame, table: DataFrame) -> DataFrame:
    return cells.select("code").distinct().join(table, "code", "left_anti")


def neighbours(cells: DataFrame, value: str, keys: tuple[str, ...] = ("site_id",), eight: bool = True) -> DataFrame:
    """Each cell with each neighbour (nrow, ncol, n_<value>): one explode and an equi-join."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    out = cells.withColumn("_s", to).withColumn("nrow", F.col("row") + F.col("_s.a")).withColumn("ncol", F.col("col") + F.col("_s.b")).drop("_s")
    other = cells.select(*keys, F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col(value).alias(f"n_{value}"))
    return out.join(other, [*keys, "nrow", "ncol"])


def terrain_slope(cells: DataFrame, cell_m: float, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Magnitude of the central-difference gradient (one-sided at edges and beside missing cells), and in degrees."""
    def along(line: str, step: str) -> Column:
        w = Window.partitionBy(*keys, line).orderBy(step)
        back = F.when(F.lag(step).over(w) == F.col(step) - 1, F.lag("z").over(w))
        ahead = F.when(F.lead(step).over(w) == F.col(step) + 1, F.lead("z").over(w))
        return F.when(back.isNotNull() & ahead.isNotNull(), (ahead - back) / (2 * cell_m)).when(ahead.isNotNull(), (ahead - F.col("z")) / cell_m).when(back.isNotNull(), (F.col("z") - back) / cell_m).otherwise(0.0)

    out = cells.withColumn("gx", along("row", "col")).withColumn("gy", along("col", "row"))
    slope = F.when(F.col("z").isNotNull(), F.hypot("gx", "gy"))
    return out.withColumn("slope", slope).withColumn("slope_deg", F.degrees(F.atan(slope))).drop("gx", "gy")


def within_radius(points: DataFrame, cells: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a point (osm_id, x_m, y_m) and a cell (cell_id, cx, cy) of equal ``keys`` not further apart than ``radius``: both are
    put into squares of that size, points into the nine around theirs, so the join is on equal squares."""
    square = lambda x: F.floor(F.col(x) / radius).cast("long")
    around = lambda x: F.explode(F.sequence(square(x) - 1, square(x) + 1))
    p = points.withColumn("sx", around("x_m")).withColumn("sy", around("y_m"))
    q = cells.withColumn("sx", square("cx")).withColumn("sy", square("cy"))
    return p.join(q, [*keys, "sx", "sy"]).withColumn("d", F.hypot(F.col("x_m") - F.col("cx"), F.col("y_m") - F.col("cy"))).filter(F.col("d") <= radius).drop("sx", "sy")


def nearest_cell(points: DataFrame, cells: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nearest cell of each point within ``radius`` (smallest id of ties) that has its ``keys``; null if none. Each square of that size
    lists the cells in it and in the eight around it, so a point stays one row, meets one list and is never sent to the driver."""
    square = lambda x: F.floor(F.col(x) / radius).cast("long")
    around = lambda x: F.explode(F.sequence(square(x) - 1, square(x) + 1))
    lists = cells.select(*keys, "cell_id", "cx", "cy", around("cx").alias("sx")).withColumn("sy", around("cy"))
    lists = lists.groupBy(*keys, "sx", "sy").agg(F.collect_list(F.struct("cx", "cy", "cell_id")).alias("_cells"))
    met = points.select(*keys, "osm_id", "x_m", "y_m", square("x_m").alias("sx"), square("y_m").alias("sy")).join(lists, [*keys, "sx", "sy"], "left")
    each = F.transform("_cells", lambda c: F.struct(F.hypot(F.col("x_m") - c["cx"], F.col("y_m") - c["cy"]).alias("d"), c["cell_id"].alias("cell_id")))
    best = F.array_min(F.filter(each, lambda b: b["d"] <= radius))
    return met.select(*keys, "osm_id", best.alias("b")).select(*keys, "osm_id", F.col("b.cell_id").alias("cell_id"), F.col("b.d").alias("d"))


def best_in_window(points: DataFrame, cells: DataFrame, value: str, r: int, keys: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Cell with the largest value in the square of 2r + 1 cells around each point (id, row, col); first in row-major order of ties."""
    span = lambda x: F.explode(F.sequence(F.col(x) - r, F.col(x) + r))
    window = points.select(*keys, "id", span("row").alias("row"), F.col("col").alias("_c")).withColumn("col", span("_c"))
    got = window.join(cells.select(*keys, "row", "col", value), [*keys, "row", "col"])
    return got.groupBy(*keys, "id").agg(F.max_by(F.struct("row", "col"), F.struct(F.col(value), -F.col("row"), -F.col("col"))).alias("b"), F.max(value).alias(value)).select(*keys, "id", F.col("b.row").alias("row"), F.col("b.col").alias("col"), value)


def polygon_area(ring: Column) -> Column:
    """Shoelace area of an open or closed ring of (x, y)."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["y"] - F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))["x"] * F.element_at(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def polygon_centroid(ring: Column) -> Column:
    """Centre of mass (x, y) of an open or closed ring of (x, y); null without an area."""
    n = F.size(ring)

    def total(f) -> Column:
        point = lambda i: F.element_at(ring, i)
        part = lambda i: f(point(i), point(F.when(i == n, 1).otherwise(i + 1)))
        return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0.0), lambda a, x: a + x)

    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    twice = total(cross)
    axis = lambda k: total(lambda p, q: (p[k] + q[k]) * cross(p, q)) / (3 * twice)
    return F.when(twice != 0, F.struct(axis("x").alias("x"), axis("y").alias("y")))


def line_length(line: Column) -> Column:
    steps = F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point in a ring."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        between = (a["y"] > y) != (b["y"] > y)
        return F.when(between, x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(a["y"] == b["y"], None).otherwise(b["y"] - a["y"]) + a["x"]).otherwise(False)

    return F.size(F.filter(F.sequence(F.lit(1), n), crosses)) % 2 == 1


def rasterise(polygons: DataFrame, cell_m: float) -> DataFrame:
    """Cells (row, col; y up from 0) whose centre is in a polygon (face_id, ring); the largest face_id wins."""
    bound = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    steps = lambda k: F.explode(F.sequence(F.floor(bound(F.array_min, k) / cell_m), F.floor(bound(F.array_max, k) / cell_m)))
    cand = polygons.withColumn("row", steps("y")).withColumn("col", steps("x"))
    inside = contains(F.col("ring"), (F.col("col") + 0.5) * cell_m, (F.col("row") + 0.5) * cell_m)
    return cand.filter(inside).groupBy("row", "col").agg(F.max("face_id").alias("face_id"))


def dilate(cells: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """Cells within k four-neighbour steps of ``cells`` (row, col), clipped to the grid."""
    steps = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a) + abs(b) <= k]
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    out = cells.select("row", "col", to.alias("s")).select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    return out.filter((F.col("row").between(0, height - 1)) & F.col("col").between(0, width - 1)).distinct()
