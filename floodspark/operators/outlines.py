"""Outlines of components of cells, of any length: border edges are linked to the next one and ranked by pointer jumping.

An edge is a side of a cell with no neighbour of its component there, directed so that the inside is on its right. Each has
one next edge, so edges form rings; where two rings touch in a corner the way turns right and stays with its own cells.
After k rounds an edge knows 2**k of its ring, so rounds grow with the logarithm of the longest ring, and no
ring is ever gathered: its points are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.operators.grids import lonlat
from floodspark.sources.io import stored

KEYS = ["site_id", "component"]
# Sides of a cell: step to the neighbour, and the corners (from the upper-left one) where the edge begins and ends.
SIDES = ((-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0))


def border(labelled: DataFrame) -> DataFrame:
    """site_id, component, edge (a number), r0, c0, r1, c1 of the border edges of cells (site_id, component, row, col)."""
    names = ("a", "b", "p", "q", "x", "y")
    sides = F.array(*(F.struct(F.lit(k).alias("side"), *(F.lit(v).alias(n) for n, v in zip(names, s))) for k, s in enumerate(SIDES)))
    e = labelled.select(*KEYS, "row", "col", F.explode(sides).alias("s")).withColumn("nr", F.col("row") + F.col("s.a")).withColumn("nc", F.col("col") + F.col("s.b"))
    other = labelled.select(*KEYS, F.col("row").alias("nr"), F.col("col").alias("nc"))
    number = F.shiftleft(F.col("row").cast("long"), 32) + F.col("col").cast("long") * 4 + F.col("s.side")
    corner = lambda k, s: (F.col(k) + F.col(f"s.{s}")).cast("int")
    return e.join(other, [*KEYS, "nr", "nc"], "left_anti").select(*KEYS, number.alias("edge"), corner("row", "p").alias("r0"), corner("col", "q").alias("c0"), corner("row", "x").alias("r1"), corner("col", "y").alias("c1"))


def linked(edges: DataFrame) -> DataFrame:
    """Edges with next: of those that leave the corner where an edge ends, two at most, the one most to the right."""
    out = edges.select(*KEYS, F.col("r0").alias("r1"), F.col("c0").alias("c1"), F.col("edge").alias("to"), (F.col("r1") - F.col("r0")).alias("tr"), (F.col("c1") - F.col("c0")).alias("tc"))
    turn = (F.col("r1") - F.col("r0")) * F.col("tc") - (F.col("c1") - F.col("c0")) * F.col("tr")
    met = edges.join(out, [*KEYS, "r1", "c1"])
    return met.groupBy(*KEYS, "edge", "r0", "c0", "r1", "c1").agg(F.min_by("to", turn).alias("next"))


def rings(labelled: DataFrame) -> DataFrame:
    """site_id, component, ring (the number of its first edge), pos (from 0) and the corners r0, c0, r1, c1 of every border edge."""
    edges = stored(linked(border(labelled)))
    state = stored(edges.select(*KEYS, "edge", F.col("next").alias("jump"), F.col("edge").alias("ring")))
    while True:  # until nobody learns of a smaller edge ahead
        ahead = state.select(*KEYS, F.col("edge").alias("jump"), F.col("jump").alias("on"), F.col("ring").alias("other"))
        state = stored(state.join(ahead, [*KEYS, "jump"]).select(*KEYS, "edge", F.col("on").alias("jump"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved")))
        if not state.filter("moved").limit(1).count():
            break
    ring = state.select(*KEYS, "edge", "ring")
    edges = stored(edges.join(ring, [*KEYS, "edge"]))
    # the ring is cut before its first edge; left counts the edges from one to the cut
    state = stored(edges.select(*KEYS, "edge", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("jump"), F.lit(1).cast("long").alias("left")))
    while state.filter("jump is not null").limit(1).count():
        ahead = state.select(*KEYS, F.col("edge").alias("jump"), F.col("jump").alias("on"), F.col("left").alias("more"))
        state = stored(state.join(ahead, [*KEYS, "jump"], "left").select(*KEYS, "edge", F.col("on").alias("jump"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    sizes = edges.groupBy(*KEYS, "ring").agg(F.count("*").alias("size"))
    out = edges.join(state.select(*KEYS, "edge", "left"), [*KEYS, "edge"]).join(sizes, [*KEYS, "ring"])
    return out.select(*KEYS, "ring", (F.col("size") - F.col("left")).alias("pos"), "r0", "c0", "r1", "c1")


def nested(edges: DataFrame) -> DataFrame:
    """site_id, component, ring, n_edges, area (cells; negative for a hole) and outer: the ring itself, or the one around a hole.

    Left of a hole's first upright edge are cells of its own piece, up to the edge before it in that row; that edge's ring is
    the one around, or another hole nearer to it, whose own is taken then.
    """
    cross = (F.col("c0") * F.col("r1") - F.col("c1") * F.col("r0")).cast("long")
    about = edges.groupBy(*KEYS, "ring").agg(F.count("*").alias("n_edges"), (F.sum(cross) / 2).cast("long").alias("area"))
    upright = edges.filter("c0 = c1").select(*KEYS, "ring", F.least("r0", "r1").alias("row"), F.col("c0").alias("col"))
    line = Window.partitionBy(*KEYS, "row").orderBy("col")
    beside = upright.withColumn("before", F.lag("ring").over(line)).groupBy(*KEYS, "ring").agg(F.min_by("before", F.struct("row", "col")).alias("before"))
    state = stored(about.join(beside, [*KEYS, "ring"]).withColumn("outer", F.when(F.col("area") > 0, F.col("ring")).otherwise(F.col("before"))).drop("before"))
    while True:
        ahead = state.select(*KEYS, F.col("ring").alias("outer"), F.col("outer").alias("on"))
        state = stored(state.join(ahead, [*KEYS, "outer"]).select(*KEYS, "ring", "n_edges", "area", F.col("on").alias("outer"), (F.col("on") != F.col("outer")).alias("moved")))
        if not state.filter("moved").limit(1).count():
            return state.drop("moved")


def corners(edges: DataFrame) -> DataFrame:
    """The points (pos, row, col) of rings where they turn, from the first to the last."""
    around = Window.partitionBy(*KEYS, "ring").orderBy("pos")
    way = F.concat((F.col("r1") - F.col("r0")).cast("string"), F.lit(","), (F.col("c1") - F.col("c0")).cast("string"))
    last = F.max_by("way", "pos").over(Window.partitionBy(*KEYS, "ring"))
    turned = edges.withColumn("way", way).withColumn("came", F.coalesce(F.lag("way").over(around), last))
    return turned.filter("way <> came").select(*KEYS, "ring", "pos", F.col("r0").alias("row"), F.col("c0").alias("col"))


def located(points: DataFrame, origin_x: float, origin_y: float, cell_m: float, zone: int) -> DataFrame:
    """Points with lon and lat, of a grid in a UTM zone."""
    lon, lat = lonlat(origin_x + F.col("col") * cell_m, origin_y - F.col("row") * cell_m, zone)
    return points.withColumns({"lon": lon, "lat": lat})


def polygons(points: DataFrame, nesting: DataFrame, digits: int = 7) -> DataFrame:
    """site_id, component and polygons: an array, for each outer ring, of closed rings of [lon, lat], the outer one first and its holes
    after it, counter-clockwise and clockwise. One row has the whole outline of a component; the tables of points do without."""
    at = F.array(F.round("lon", digits), F.round("lat", digits))
    ring = points.groupBy(*KEYS, "ring").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), at.alias("at")))).alias("p"))
    ring = ring.withColumn("p", F.reverse(F.transform("p", lambda x: x["at"]))).withColumn("p", F.concat("p", F.slice("p", 1, 1)))
    with_outer = ring.join(nesting.select(*KEYS, "ring", "outer"), [*KEYS, "ring"])
    rings_ = F.transform(F.array_sort(F.collect_list(F.struct((F.col("ring") != F.col("outer")).alias("hole"), "ring", "p"))), lambda x: x["p"])
    one = with_outer.groupBy(*KEYS, "outer").agg(rings_.alias("rings"))
    return one.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("outer", "rings"))), lambda x: x["rings"]).alias("polygons"))


def polygon_feature(polygons_: Column | str, *properties: str) -> Column:
    """A GeoJSON MultiPolygon feature."""
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col(polygons_).alias("coordinates") if isinstance(polygons_, str) else polygons_.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def polygon_placemark(name: Column, polygons_: Column, colour: Column) -> Column:
    """A KML placemark of polygons with holes, filled with ``colour`` (aabbggrr)."""
    line = lambda ring: F.concat(F.lit("<LinearRing><coordinates>"), F.array_join(F.transform(ring, lambda p: F.format_string("%.6f,%.6f", p[0], p[1])), " "), F.lit("</coordinates></LinearRing>"))
    inner = lambda rings_: F.array_join(F.transform(F.slice(rings_, F.lit(2), F.greatest(F.size(rings_) - 1, F.lit(0))), lambda r: F.concat(F.lit("<innerBoundaryIs>"), line(r), F.lit("</innerBoundaryIs>"))), "")
    one = lambda rings_: F.concat(F.lit("<Polygon><outerBoundaryIs>"), line(rings_[0]), F.lit("</outerBoundaryIs>"), inner(rings_), F.lit("</Polygon>"))
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Style><PolyStyle><color>"), colour, F.lit("</color></PolyStyle></Style><MultiGeometry>"), F.array_join(F.transform(polygons_, one), ""), F.lit("</MultiGeometry></Placemark>"))
