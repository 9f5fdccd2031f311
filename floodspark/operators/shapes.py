"""Lines of many vertices and polygons on a grid.

A line or ring is an array of vertices (x, y). It is taken apart into its legs, so a long one is many rows; lengths along it are
running sums over its legs. Rows and columns count from the upper-left corner of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def legs(lines: DataFrame, line: str = "line", closed: bool = False) -> DataFrame:
    """The legs of each line: its columns without ``line``, leg (from 0), x0, y0, x1, y1 and leg_m. A null line, and one
    without vertices, has none; one vertex is a leg without length. ``closed`` adds that from the last vertex to the first."""
    points, n = F.col(line), F.size(line)
    ends = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1)) if closed else F.when(n == 1, points).otherwise(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))))
    starts = F.slice(points, F.lit(1), F.size(ends))
    both = lines.filter(n > 0).select(*(x for x in lines.columns if x != line), F.posexplode(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("leg", "_p"))
    x0, y0, x1, y1 = (F.col(f"_p.{k}.{v}") for k in "ab" for v in "xy")
    return both.select("*", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.hypot(x1 - x0, y1 - y0).alias("leg_m")).drop("_p")


def with_chainage(parts: DataFrame, key: str) -> DataFrame:
    """Legs with from_m and to_m, the lengths along the line where they begin and end, and total_m."""
    so_far = Window.partitionBy(key).orderBy("leg")
    out = parts.withColumn("to_m", F.sum("leg_m").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("from_m", F.coalesce(F.lag("to_m").over(so_far), F.lit(0.0))).withColumn("total_m", F.max("to_m").over(Window.partitionBy(key)))


def densified(lines: DataFrame, spacing: float, key: str = "line_id", line: str = "line") -> DataFrame:
    """Middle points (x_m, y_m) of equal pieces along each line, at most ``spacing`` long, and their length piece_m. A line
    without length is one point of length 0. Every piece is found on the leg that its middle is on."""
    parts = with_chainage(legs(lines, line), key)
    n = F.greatest(F.lit(1), F.ceil(F.col("total_m") / spacing)).cast("long")
    first = lambda at, else_: F.when(F.col("total_m") > 0, F.ceil(F.col(at) * n / F.col("total_m") - 0.5)).otherwise(else_).cast("long")
    pieces = {"_n": n, "_lo": first("from_m", 0), "_hi": first("to_m", F.when(F.col("leg") == 0, 1).otherwise(0)) - 1}
    parts = parts.withColumns(pieces).filter("_hi >= _lo")
    parts = parts.withColumn("_i", F.explode(F.sequence("_lo", "_hi")))
    at = F.when(F.col("leg_m") > 0, ((F.col("_i") + 0.5) / F.col("_n") * F.col("total_m") - F.col("from_m")) / F.col("leg_m")).otherwise(0.0)
    own = [x for x in lines.columns if x != line]
    return parts.select(*own, (F.col("x0") + (F.col("x1") - F.col("x0")) * at).alias("x_m"), (F.col("y0") + (F.col("y1") - F.col("y0")) * at).alias("y_m"), (F.col("total_m") / F.col("_n")).alias("piece_m"))


def cut_at_cells(parts: DataFrame, cell_m: float, origin_x: float, origin_y: float) -> DataFrame:
    """Legs cut where they cross grid lines: row, col and length_m of every piece. A piece along a grid line belongs to the cell right of it
    or below it. Legs are dealt to tasks before the cuts: a small file has many pieces, which one task would have to add up."""
    parts = parts.repartition(*parts.columns)
    u = {"0": (F.col("x0") - origin_x) / cell_m, "1": (F.col("x1") - origin_x) / cell_m}
    w = {"0": (origin_y - F.col("y0")) / cell_m, "1": (origin_y - F.col("y1")) / cell_m}
    parts = parts.withColumns({"_u": u["0"], "_w": w["0"], "_du": u["1"] - u["0"], "_dw": w["1"] - w["0"]})

    def crossings(a: str, d: str) -> Column:
        lo, hi = F.least(F.col(a), F.col(a) + F.col(d)), F.greatest(F.col(a), F.col(a) + F.col(d))
        first, last = F.floor(lo) + 1, F.ceil(hi) - 1
        return F.when((F.col(d) != 0) & (last >= first), F.transform(F.sequence(first, last), lambda k: (k - F.col(a)) / F.col(d))).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("_u", "_du"), crossings("_w", "_dw"))))
    parts = parts.withColumn("_cuts", cuts)
    pieces = F.zip_with(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1), F.slice("_cuts", F.lit(2), F.size("_cuts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    parts = parts.withColumn("_p", F.explode(pieces))
    mid = (F.col("_p.a") + F.col("_p.b")) / 2
    row, col = F.floor(F.col("_w") + F.col("_dw") * mid), F.floor(F.col("_u") + F.col("_du") * mid)
    return parts.withColumns({"row": row.cast("int"), "col": col.cast("int"), "length_m": F.col("leg_m") * (F.col("_p.b") - F.col("_p.a"))}).drop("_u", "_w", "_du", "_dw", "_cuts", "_p")


def line_lengths(lines: DataFrame, cell_m: float, origin_x: float, origin_y: float, width: int, height: int, key: str = "line_id", line: str = "line") -> DataFrame:
    """Exact length of each line inside each cell of the grid: the lines' columns, cell_id and length_m. What is off the grid has a null
    cell_id."""
    own = [x for x in lines.columns if x != line]
    cut = cut_at_cells(legs(lines, line), cell_m, origin_x, origin_y)
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return cut.groupBy(*own, F.when(inside, F.col("row").cast("long") * width + F.col("col")).alias("cell_id")).agg(F.sum("length_m").alias("length_m"))


def flooded_length(lengths: DataFrame, wet: DataFrame, by: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Length inside the cells of ``wet`` (cell_id, ``keys``) for each of ``keys`` and ``by``. Lines are cut to cells once, then met by
    the wet cells of all maps."""
    return lengths.filter(F.col("cell_id").isNotNull()).join(wet.select(*keys, "cell_id"), "cell_id").groupBy(*keys, *by).agg(F.sum("length_m").alias("flooded_m"))


def interior(polygons: DataFrame, cell_m: float, origin_x: float, origin_y: float, width: int, height: int, key: str = "face_id", ring: str = "ring") -> DataFrame:
    """Cells (``key``, row, col) whose centre is inside the polygon, by even-odd scan lines: an edge gives the places where it crosses
    the middle of each row, and every second gap between them is inside. A row of a polygon is a group; cells are made only in gaps."""
    edges = legs(polygons.select(key, ring), ring, closed=True)
    w0, w1 = (origin_y - F.col("y0")) / cell_m, (origin_y - F.col("y1")) / cell_m
    first = F.greatest(F.ceil(F.least(w0, w1) - 0.5), F.lit(0))
    last = F.least(F.ceil(F.greatest(w0, w1) - 0.5) - 1, F.lit(height - 1))
    rows = edges.withColumns({"_a": first.cast("int"), "_b": last.cast("int")}).filter("_b >= _a").withColumn("row", F.explode(F.sequence("_a", "_b")))
    y = origin_y - (F.col("row") + 0.5) * cell_m
    at = (F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) - origin_x) / cell_m
    lines = rows.groupBy(key, "row").agg(F.array_sort(F.collect_list(at)).alias("_x"))
    gap = F.explode(F.sequence(F.lit(1), F.floor(F.size("_x") / 2).cast("int")))
    lines = lines.withColumn("_k", gap).select(key, "row", F.element_at("_x", 2 * F.col("_k") - 1).alias("_l"), F.element_at("_x", 2 * F.col("_k")).alias("_r"))
    lo, hi = F.greatest(F.ceil(F.col("_l") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("_r") - 0.5) - 1, F.lit(width - 1)).cast("int")
    return lines.withColumns({"_l": lo, "_r": hi}).filter("_r >= _l").select(key, "row", F.explode(F.sequence("_l", "_r")).alias("col"))


def touched(polygons: DataFrame, cell_m: float, origin_x: float, origin_y: float, width: int, height: int, key: str = "face_id", ring: str = "ring") -> DataFrame:
    """Cells (``key``, row, col) that a polygon covers in any part: those its edges run through, and those inside."""
    edges = cut_at_cells(legs(polygons.select(key, ring), ring, closed=True).filter("leg_m > 0"), cell_m, origin_x, origin_y)
    edges = edges.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).select(key, "row", "col")
    return edges.unionByName(interior(polygons, cell_m, origin_x, origin_y, width, height, key, ring)).distinct()


def burned(polygons: DataFrame, value: str, domain: DataFrame, cell_m: float, origin_x: float, origin_y: float, width: int, height: int, dry: float | None = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of ``domain`` (``keys``, row, col) with the value of the polygon (face_id, ring, ``value``, ``keys``) that touches them, the largest
    face_id of several; polygons without a value are left out. Cells of the domain that none touches get ``dry`` (0 for depths and
    velocities, null for arrivals); cells outside it are absent, which is null.

    A ring is rasterised once, whatever the number of maps that give its face a value.
    """
    rings = polygons.groupBy("face_id").agg(F.first("ring").alias("ring"))
    cells = touched(rings, cell_m, origin_x, origin_y, width, height)
    seen = polygons.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("face_id", *keys, value)
    top = cells.join(seen, "face_id").groupBy(*keys, "row", "col").agg(F.max_by(value, "face_id").alias(value))
    return domain.join(top, [*keys, "row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(dry).cast("double")))
