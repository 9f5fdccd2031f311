"""Queries over grids and terrain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from floodspark.operators import grids, loss, outlines, runs, shapes, terrain
from floodspark.plans.flood import RUN, buildings_by_run, doubles, rounded, run_cells, summary
from floodspark.plans.registry import query
from floodspark.sources import views as v

W, H = v.WIDTH, v.HEIGHT


def tree(spark, sf):
    return terrain.drainage(terrain.fill(v.dem(spark, sf), W, H, 1e-3, tile=8))


def fill_sql(epsilon: str) -> str:
    """SQL of the filled heights ``fl`` (site_id, cell_id, w; infinite below outlets) and of neighbours ``nb``: relaxation of
    a keyed table until no height falls."""
    return f"""g AS MATERIALIZED (SELECT *, row = 0 OR col = 0 OR row = 19 OR col = 24 OR z IS NULL AS seed FROM dem),
nb AS MATERIALIZED (SELECT a.site_id, a.cell_id, a.z, a.seed, b.cell_id AS o FROM g a JOIN g b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.cell_id <> b.cell_id),
f(site_id, cell_id, w) USING KEY (site_id, cell_id) AS (SELECT site_id, cell_id, CASE WHEN NOT seed THEN CAST('inf' AS DOUBLE) WHEN z IS NULL THEN CAST('-inf' AS DOUBLE) ELSE z END FROM g
UNION SELECT nb.site_id, nb.cell_id, min(greatest(nb.z, f.w + {epsilon})) FROM f JOIN nb ON nb.site_id = f.site_id AND nb.o = f.cell_id JOIN recurring.f AS k ON k.site_id = nb.site_id AND k.cell_id = nb.cell_id WHERE NOT nb.seed AND greatest(nb.z, f.w + {epsilon}) < k.w GROUP BY nb.site_id, nb.cell_id),
fl AS MATERIALIZED (SELECT site_id, cell_id, w FROM f)"""


TREE = f"""{fill_sql("1e-3")}, ps AS (SELECT nb.site_id, nb.cell_id, arg_min(nb.o, {{'w': fl.w, 'o': nb.o}}) AS parent FROM nb JOIN fl ON fl.site_id = nb.site_id AND fl.cell_id = nb.o WHERE NOT nb.seed GROUP BY ALL),
tr AS MATERIALIZED (SELECT fl.site_id, fl.cell_id, fl.w, ps.parent FROM fl LEFT JOIN ps ON ps.site_id = fl.site_id AND ps.cell_id = fl.cell_id)"""
DOWN = f"{TREE}, dn AS (SELECT site_id, cell_id, cell_id AS node, 0 AS step FROM tr UNION ALL SELECT dn.site_id, dn.cell_id, tr.parent, dn.step + 1 FROM dn JOIN tr ON tr.site_id = dn.site_id AND tr.cell_id = dn.node WHERE tr.parent IS NOT NULL)"
ACC = f"{DOWN}, ac AS (SELECT site_id, node AS cell_id, count(*) AS accumulation FROM dn GROUP BY ALL)"


@query(f"WITH {fill_sql('1e-3')} SELECT site_id, cell_id, round(CASE WHEN isfinite(w) THEN w END, 6) AS filled FROM fl")
def g1_fill(spark, sf):
    return terrain.fill(v.dem(spark, sf), W, H, 1e-3, tile=8).select("site_id", "cell_id", F.round("filled", 6).alias("filled"))


@query(f"WITH {TREE} SELECT site_id, cell_id, CAST(parent AS DOUBLE) AS parent FROM tr")
def g2_drainage(spark, sf):
    return doubles(tree(spark, sf).select("site_id", "cell_id", "parent"), "parent")


@query(f"WITH {ACC} SELECT site_id, cell_id, accumulation FROM ac")
def g3_accumulation(spark, sf):
    return terrain.accumulation(tree(spark, sf), tile=8)


@query(f"""WITH {ACC}, hit AS (SELECT dn.site_id, dn.cell_id, arg_min(dn.node, dn.step) AS found FROM dn JOIN ac ON ac.site_id = dn.site_id AND ac.cell_id = dn.node AND accumulation >= 20 GROUP BY ALL)
SELECT a.site_id, a.cell_id, round(CAST(CAST(CASE WHEN isfinite(a.w) THEN a.w END AS FLOAT) - CAST(CASE WHEN isfinite(b.w) THEN b.w END AS FLOAT) AS DOUBLE), 4) AS hand FROM tr a LEFT JOIN hit ON hit.site_id = a.site_id AND hit.cell_id = a.cell_id LEFT JOIN tr b ON b.site_id = hit.site_id AND b.cell_id = hit.found""")
def g4_height_above_drainage(spark, sf):
    t = terrain.kept(tree(spark, sf))
    channel = terrain.accumulation(t, tile=8).filter("accumulation >= 20").select("site_id", "cell_id", F.lit(True).alias("channel"))
    out = terrain.height_above(t.join(channel, ["site_id", "cell_id"], "left").na.fill(False, ["channel"]), "channel", tile=8)
    return rounded(doubles(out, "hand"), "hand", digits=4)


@query(f"WITH {DOWN} SELECT site_id, cell_id AS start, step, node AS cell_id FROM dn WHERE cell_id % 25 = 3")
def g5_trace(spark, sf):
    t = terrain.kept(tree(spark, sf))
    return terrain.trace(t, t.filter("col = 3"))


@query("WITH r AS (SELECT hybas_id AS seed, hybas_id, 0 AS hop FROM basins UNION SELECT r.seed, b.hybas_id, r.hop + 1 FROM r JOIN basins b ON b.next_down = r.hybas_id WHERE r.hop < 25) SELECT seed, hybas_id, CAST(hop AS INT) AS hop FROM r")
def g6_upstream(spark, sf):
    b = v.basins(spark, sf)
    return terrain.upstream(b, b)


MASK = "mk AS (SELECT run_id AS site_id, CAST(face_id // 25 AS INT) AS row, CAST(face_id % 25 AS INT) AS col, face_id AS cell_id FROM summary WHERE max_depth > 0.7e0)"


def mask(spark, sf):
    s = summary(spark, sf).filter("max_depth > 0.7")
    return s.select(F.col("run_id").alias("site_id"), F.floor(F.col("face_id") / W).cast("int").alias("row"), (F.col("face_id") % W).alias("col"), F.col("face_id").alias("cell_id"))


@query(f"WITH {MASK}, r AS (SELECT site_id, cell_id, row, col, cell_id AS c FROM mk UNION SELECT m.site_id, m.cell_id, m.row, m.col, r.c FROM r JOIN mk m ON m.site_id = r.site_id AND abs(m.row - r.row) <= 1 AND abs(m.col - r.col) <= 1 AND r.c < m.cell_id) SELECT site_id, cell_id, min(c) AS component FROM r GROUP BY site_id, cell_id")
def g7_components(spark, sf):
    return terrain.components(mask(spark, sf), tile=8)


LABELS = f"{MASK}, r AS (SELECT site_id, cell_id, row, col, cell_id AS c FROM mk UNION SELECT m.site_id, m.cell_id, m.row, m.col, r.c FROM r JOIN mk m ON m.site_id = r.site_id AND abs(m.row - r.row) <= 1 AND abs(m.col - r.col) <= 1 AND r.c < m.cell_id), la AS (SELECT site_id, min(c) AS component, row, col FROM r GROUP BY site_id, cell_id, row, col)"
#: Ring lengths and areas by walking every ring from each of its edges; the outer ring around a hole is the smallest that it lies inside.
RINGS = f"""{LABELS}, sd AS (SELECT unnest([0, 1, 2, 3]) AS side, unnest([-1, 0, 1, 0]) AS a, unnest([0, 1, 0, -1]) AS b, unnest([0, 0, 1, 1]) AS p, unnest([0, 1, 1, 0]) AS q, unnest([0, 1, 1, 0]) AS x, unnest([1, 1, 0, 0]) AS y),
ed AS (SELECT site_id, component, row::BIGINT * 4294967296 + col * 4 + side AS edge, row + p AS r0, col + q AS c0, row + x AS r1, col + y AS c1 FROM la l, sd WHERE NOT EXISTS (SELECT 1 FROM la o WHERE o.site_id = l.site_id AND o.component = l.component AND o.row = l.row + a AND o.col = l.col + b)),
nx AS (SELECT e.site_id, e.component, e.edge, arg_min(f.edge, (e.r1 - e.r0) * (f.c1 - f.c0) - (e.c1 - e.c0) * (f.r1 - f.r0)) AS next FROM ed e JOIN ed f ON f.site_id = e.site_id AND f.component = e.component AND f.r0 = e.r1 AND f.c0 = e.c1 GROUP BY e.site_id, e.component, e.edge),
wk AS (SELECT site_id, component, edge, edge AS at_edge FROM ed UNION SELECT w.site_id, w.component, w.edge, n.next FROM wk w JOIN nx n ON n.site_id = w.site_id AND n.component = w.component AND n.edge = w.at_edge),
rg AS (SELECT ed.*, ring FROM ed JOIN (SELECT site_id, component, edge, min(at_edge) AS ring FROM wk GROUP BY ALL) USING (site_id, component, edge)),
ab AS (SELECT site_id, component, ring, count(*) AS n_edges, CAST(sum(c0 * r1 - c1 * r0) / 2 AS BIGINT) AS area FROM rg GROUP BY ALL),
up AS (SELECT site_id, component, ring, least(r0, r1) AS row, c0 AS col FROM rg WHERE c0 = c1), fi AS (SELECT site_id, component, ring, min({{'r': row, 'c': col}}) AS f FROM up GROUP BY ALL),
ho AS (SELECT a.site_id, a.component, a.ring, o.ring AS o, o.area FROM ab a JOIN fi USING (site_id, component, ring) JOIN ab o ON o.site_id = a.site_id AND o.component = a.component AND o.area > 0 JOIN up ON up.site_id = a.site_id AND up.component = a.component AND up.ring = o.ring AND up.row = f.r AND up.col < f.c WHERE a.area < 0 GROUP BY ALL HAVING count(*) % 2 = 1),
ne AS (SELECT ab.*, coalesce(h.o, ab.ring) AS outer_ring FROM ab LEFT JOIN (SELECT site_id, component, ring, arg_min(o, area) AS o FROM ho GROUP BY ALL) h USING (site_id, component, ring))"""


def labelled(spark, sf):
    m = mask(spark, sf)
    return terrain.components(m).join(m.select("site_id", "cell_id", "row", "col"), ["site_id", "cell_id"])


@query(f"WITH {RINGS} SELECT site_id, component, ring, n_edges, area, outer_ring AS \"outer\" FROM ne")
def g8_outlines(spark, sf):
    """Length, area and outer ring of every ring of every component."""
    return outlines.nested(outlines.rings(labelled(spark, sf)))


@query(f"""WITH {RINGS}, tn AS (SELECT r.site_id, r.component, r.ring, r.r1 AS row, r.c1 AS col FROM rg r JOIN nx USING (site_id, component, edge) JOIN rg n ON n.site_id = r.site_id AND n.component = r.component AND n.edge = nx.next WHERE (r.r1 - r.r0, r.c1 - r.c0) <> (n.r1 - n.r0, n.c1 - n.c0))
SELECT site_id, component, ring, count(*) AS n_corners, sum(row * 31 + col * 17)::BIGINT AS places FROM tn GROUP BY site_id, component, ring""")
def g8_corners(spark, sf):
    """Corners of the rings."""
    return outlines.corners(outlines.rings(labelled(spark, sf))).groupBy("site_id", "component", "ring").agg(F.count("*").alias("n_corners"), F.sum(F.col("row") * 31 + F.col("col") * 17).cast("long").alias("places"))


@query(f"WITH {RINGS} SELECT site_id, component, count(CASE WHEN area > 0 THEN 1 END) AS n_polygons, count(*) AS n_rings, sum(area)::BIGINT AS n_cells FROM ne GROUP BY site_id, component")
def g8_geojson(spark, sf):
    """GeoJSON outlines in lon/lat, read back: polygons, rings, and the area in cells from the projected corners."""
    edges = outlines.rings(labelled(spark, sf))
    shapes_ = outlines.polygons(outlines.located(outlines.corners(edges), 400000.0, 3000000.0, 20.0, 45), outlines.nested(edges))
    text = shapes_.select("site_id", "component", outlines.polygon_feature("polygons", "site_id", "component").alias("feature"))
    kind = "geometry struct<coordinates:array<array<array<array<double>>>>>"
    back = text.select("site_id", "component", F.from_json("feature", kind)["geometry"]["coordinates"].alias("p"))
    ring = back.select("site_id", "component", F.size("p").alias("n_polygons"), F.posexplode(F.flatten("p")).alias("k", "ring"))
    x, y = grids.utm(F.col("at")[0], F.col("at")[1], 45)
    points = ring.select("site_id", "component", "n_polygons", "k", F.posexplode("ring").alias("i", "at")).withColumns({"x": F.round((x - 400000) / 20), "y": F.round((3000000 - y) / 20)})
    following = Window.partitionBy("site_id", "component", "k").orderBy("i")
    cross = F.col("x") * F.lead("y").over(following) - F.lead("x").over(following) * F.col("y")
    sums = points.withColumn("cross", cross).groupBy("site_id", "component", "n_polygons").agg(F.countDistinct("k").alias("n_rings"), (-F.sum("cross") / 2).cast("long").alias("n_cells"))
    return sums.select("site_id", "component", F.col("n_polygons").cast("long").alias("n_polygons"), "n_rings", "n_cells")


@query("WITH f AS (SELECT a.site_id, a.cell_id, sum(b.z / ((a.row - b.row) * (a.row - b.row) * 400e0 + (a.col - b.col) * (a.col - b.col) * 400e0)) / sum(1 / ((a.row - b.row) * (a.row - b.row) * 400e0 + (a.col - b.col) * (a.col - b.col) * 400e0)) AS z FROM dem a JOIN dem b ON a.site_id = b.site_id AND a.z IS NULL AND b.z IS NOT NULL AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 9 GROUP BY ALL) SELECT d.site_id, d.cell_id, round(coalesce(d.z, f.z), 6) AS z FROM dem d LEFT JOIN f ON f.site_id = d.site_id AND f.cell_id = d.cell_id")
def g9_fill_voids(spark, sf):
    return rounded(terrain.fill_voids(v.dem(spark, sf), 60.0, 20.0).select("site_id", "cell_id", "z"), "z")


@query("""WITH dm AS (SELECT site_id, unnest([0, 1, 2]) AS dam_id, unnest([12, 5, 12]) AS pl, unnest([10, 10, 14]) AS mid, unnest([96.5e0, 96.5e0, 95.5e0]) AS crest FROM (SELECT DISTINCT site_id FROM dem)),
l AS (SELECT d.site_id, dam_id, cell_id, z, row - mid AS k, crest FROM dem d JOIN dm ON dm.site_id = d.site_id AND col = pl AND row BETWEEN mid - 6 AND mid + 6), w AS (SELECT site_id, dam_id, min(CASE WHEN k >= 0 AND z >= crest THEN k END) AS a, max(CASE WHEN k <= 0 AND z >= crest THEN k END) AS b FROM l GROUP BY ALL),
i AS (SELECT l.site_id, cell_id, max(crest) AS crest FROM l JOIN w ON w.site_id = l.site_id AND w.dam_id = l.dam_id WHERE k < coalesce(a, k + 1) AND k > coalesce(b, k - 1) GROUP BY ALL) SELECT d.site_id, d.cell_id, round(CASE WHEN z IS NOT NULL THEN greatest(z, coalesce(crest, z)) END, 6) AS z FROM dem d LEFT JOIN i ON i.site_id = d.site_id AND i.cell_id = d.cell_id""")
def g10_burn_crest(spark, sf):
    """Three dams of each site, two of them of the same crest and two on the same column."""
    d = v.dem(spark, sf)
    three = [F.struct(*(F.lit(x).alias(k) for k, x in zip(("dam_id", "row", "col", "dr", "dc", "crest"), dam))) for dam in ((0, 10, 12, 1, 0, 96.5), (1, 10, 5, 1, 0, 96.5), (2, 14, 12, 1, 0, 95.5))]
    dams = d.select("site_id").distinct().select("site_id", F.inline(F.array(*three)))
    return rounded(terrain.burn_crest(d, dams, 6).select("site_id", "cell_id", "z"), "z")


@query("WITH l AS (SELECT site_id, cell_id % 4 AS lab, quantile_cont(z, 0.5) AS surface, min(z) AS bed FROM dem WHERE cell_id % 4 < 3 GROUP BY ALL) SELECT d.site_id, d.cell_id, round(surface, 6) AS surface, round(bed, 6) AS bed FROM dem d LEFT JOIN l ON l.site_id = d.site_id AND l.lab = d.cell_id % 4")
def a23_burn_reservoir(spark, sf):
    d = v.dem(spark, sf).withColumn("lab", F.when(F.col("cell_id") % 4 < 3, F.col("cell_id") % 4))
    return rounded(terrain.burn_reservoir(d, "lab").select("site_id", "cell_id", "surface", "bed"), "surface", "bed")


SLOPE = """sn AS (SELECT *, CASE WHEN lag(col) OVER a = col - 1 THEN lag(z) OVER a END AS w, CASE WHEN lead(col) OVER a = col + 1 THEN lead(z) OVER a END AS e, CASE WHEN lag(row) OVER b = row - 1 THEN lag(z) OVER b END AS u, CASE WHEN lead(row) OVER b = row + 1 THEN lead(z) OVER b END AS d
FROM dem WINDOW a AS (PARTITION BY site_id, row ORDER BY col), b AS (PARTITION BY site_id, col ORDER BY row)),
sg AS (SELECT *, CASE WHEN w IS NOT NULL AND e IS NOT NULL THEN (e - w) / 40 WHEN e IS NOT NULL THEN (e - z) / 20 WHEN w IS NOT NULL THEN (z - w) / 20 ELSE 0 END AS gx, CASE WHEN u IS NOT NULL AND d IS NOT NULL THEN (d - u) / 40 WHEN d IS NOT NULL THEN (d - z) / 20 WHEN u IS NOT NULL THEN (z - u) / 20 ELSE 0 END AS gy FROM sn),
so AS (SELECT site_id, cell_id, z, CASE WHEN z IS NOT NULL THEN sqrt(gx * gx + gy * gy) END AS slope FROM sg)"""


@query(f"WITH {fill_sql('0e0')}, {SLOPE} SELECT so.site_id, so.cell_id, round(greatest(coalesce(CASE WHEN isfinite(fl.w) THEN fl.w END - so.z, 0), 0), 6) AS depression, round(coalesce(slope, 0), 6) AS slope FROM so JOIN fl ON fl.site_id = so.site_id AND fl.cell_id = so.cell_id")
def g11_diagnostics(spark, sf):
    f = terrain.fill(v.dem(spark, sf), W, H, 0.0, tile=8)
    out = grids.terrain_slope(f, v.CELL)
    depression = F.greatest(F.coalesce(F.col("filled") - F.col("z"), F.lit(0.0)), F.lit(0.0))
    return rounded(out.select("site_id", "cell_id", depression.alias("depression"), F.coalesce("slope", F.lit(0.0)).alias("slope")), "depression", "slope")


@query(f"WITH {SLOPE} SELECT site_id, cell_id, round(slope, 6) AS slope, round(degrees(atan(slope)), 5) AS slope_deg FROM so")
def w7_slope(spark, sf):
    return grids.terrain_slope(v.dem(spark, sf), v.CELL).select("site_id", "cell_id", F.round("slope", 6).alias("slope"), F.round("slope_deg", 5).alias("slope_deg"))


@query("SELECT a.site_id, a.cell_id, count(*) AS n, round(min(b.z), 6) AS least FROM dem a JOIN dem b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.cell_id <> b.cell_id GROUP BY ALL")
def j13_neighbours(spark, sf):
    return rounded(grids.neighbours(v.dem(spark, sf), "z").groupBy("site_id", "cell_id").agg(F.count("*").alias("n"), F.min("n_z").alias("least")), "least")


@query("SELECT d.site_id, CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(z), 6) AS z, max(s.max_depth) AS depth_m, round(CASE WHEN max(s.max_depth) > 0 THEN avg(z) + max(s.max_depth) END, 6) AS surface_m FROM dem d LEFT JOIN summary s ON s.run_id = d.site_id AND s.face_id = d.cell_id GROUP BY ALL")
def p6_overview(spark, sf):
    d = v.dem(spark, sf)
    s = summary(spark, sf).select(F.col("run_id").alias("site_id"), F.col("face_id").alias("cell_id"), F.col("max_depth").alias("depth_m"))
    return rounded(grids.overview(d.join(s, ["site_id", "cell_id"], "left"), 4, ("site_id",)), "z", "surface_m")


def one_site(spark, sf):
    """Mean height over all sites."""
    return v.dem(spark, sf).groupBy("row", "col").agg(F.avg("z").alias("z"))


@query("""WITH o AS (SELECT row, col, avg(z) AS z FROM dem GROUP BY ALL), t AS (SELECT unnest(generate_series(0, 16)) AS tr), u AS (SELECT unnest(generate_series(0, 20)) AS tc),
x AS (SELECT tr, tc, z, greatest(least(row * 20e0 + 20, (tr + 1) * 24e0) - greatest(row * 20e0, tr * 24e0), 0) * greatest(least(col * 20e0 + 20, (tc + 1) * 24e0) - greatest(col * 20e0, tc * 24e0), 0) AS w FROM o, t, u)
SELECT CAST(tr AS BIGINT) AS row, CAST(tc AS BIGINT) AS col, round(sum(z * w) / 400, 6) AS total, round(sum(z * w) / sum(CASE WHEN z IS NOT NULL THEN w END), 6) AS mean, round(min(z), 6) AS low, round(max(z), 6) AS high FROM x WHERE w > 0 GROUP BY ALL""")
def p4_resample(spark, sf):
    o = one_site(spark, sf)
    out = None
    for name, method in (("total", "sum"), ("mean", "average"), ("low", "min"), ("high", "max")):
        part = grids.resample(o, "z", 20.0, 24.0, method).withColumn(name, F.round("z", 6)).drop("z")
        out = part if out is None else out.join(part, ["row", "col"])
    return out


@query("""WITH o AS (SELECT row, col, avg(z) AS z FROM dem GROUP BY ALL), p AS (SELECT osm_id AS id, (x_m + 50) % 460 / 20 AS c, (y_m + 50) % 360 / 20 AS r FROM buildings),
k AS (SELECT id, floor(r) + a AS row, floor(c) + b AS col, CASE WHEN a = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END * CASE WHEN b = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END AS w FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT id, round(CASE WHEN count(z) = count(*) THEN sqrt(sum(w * z)) END, 6) AS root_z FROM k LEFT JOIN o ON o.row = k.row AND o.col = k.col WHERE w > 0 GROUP BY id""")
def p5_bilinear(spark, sf):
    p = v.buildings(spark, sf).select(F.col("osm_id").alias("id"), ((F.col("x_m") + 50) % 460 / 20).alias("c"), ((F.col("y_m") + 50) % 360 / 20).alias("r"))
    return grids.bilinear(p, one_site(spark, sf), "z").select("id", F.round(F.sqrt("z"), 6).alias("root_z"))


WARPED = """o AS MATERIALIZED (SELECT row, col, avg(z) AS z FROM dem GROUP BY ALL), t AS (SELECT r AS row, c AS col, round((5e0 + (r + 0.5e0) * 13) / 20 - 0.5e0, 9) AS y, round((-7e0 + (c + 0.5e0) * 13) / 20 - 0.5e0, 9) AS x FROM (SELECT unnest(generate_series(0, 29)) AS r), (SELECT unnest(generate_series(0, 39)) AS c))"""


@query(f"""WITH {WARPED}, k AS (SELECT t.row, t.col, o.z, (CASE WHEN o.row = floor(y) THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN o.col = floor(x) THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w,
(CASE WHEN y > floor(y) THEN 2 ELSE 1 END) * (CASE WHEN x > floor(x) THEN 2 ELSE 1 END) AS need FROM t LEFT JOIN o ON o.row BETWEEN floor(y) AND ceil(y) AND o.col BETWEEN floor(x) AND ceil(x)),
n AS (SELECT t.row, t.col, o.z FROM t LEFT JOIN o ON o.row = floor(y + 0.5e0) AND o.col = floor(x + 0.5e0))
SELECT CAST(k.row AS INT) AS row, CAST(k.col AS INT) AS col, round(sqrt(CASE WHEN count(k.z) = max(need) THEN sum(w * k.z) END), 6) AS root_smooth, round(any_value(n.z), 6) AS near FROM k JOIN n ON n.row = k.row AND n.col = k.col GROUP BY k.row, k.col""")
def p4_warp(spark, sf):
    """Cells of 20 m at the centres of another grid of 13 m, bilinear and nearest."""
    o, shape = one_site(spark, sf), ((0.0, 400.0, 20.0, 45), (-7.0, 395.0, 13.0, 45), 40, 30)
    smooth = grids.warp(o, "z", *shape).select("row", "col", F.round(F.sqrt("z"), 6).alias("root_smooth"))
    return smooth.join(rounded(grids.warp(o, "z", *shape, method="nearest"), "z").withColumnRenamed("z", "near"), ["row", "col"])


@query("""WITH b AS (SELECT osm_id AS id, x_m / 10 AS west, y_m / 20 - 8 AS south FROM buildings), t AS (SELECT id, unnest(generate_series(CAST(floor(south / 3) AS BIGINT), CAST(floor((south + 2) / 3) AS BIGINT))) * 3 AS lat, west FROM b), u AS (SELECT id, lat, unnest(generate_series(CAST(floor(west / 3) AS BIGINT), CAST(floor((west + 4) / 3) AS BIGINT))) * 3 AS lon FROM t)
SELECT id, (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || (CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') AS tile FROM u""")
def p7_tile_names(spark, sf):
    west, south = F.col("x_m") / 10, F.col("y_m") / 20 - 8
    return grids.tile_names(v.buildings(spark, sf).select(F.col("osm_id").alias("id"), west.alias("west"), south.alias("south"), (west + 4).alias("east"), (south + 2).alias("north")), 3)


@query(f"""WITH {fill_sql('0e0')}, {SLOPE}, gr AS (SELECT so.site_id AS run_id, so.cell_id AS face_id, coalesce(greatest(coalesce(CASE WHEN isfinite(fl.w) THEN fl.w END - so.z, 0), 0) >= 0.5e0, false) AS pit, coalesce(slope >= 0.03e0, false) AS steep FROM so JOIN fl ON fl.site_id = so.site_id AND fl.cell_id = so.cell_id),
x AS (SELECT s.*, coalesce(pit, false) AS pit, coalesce(steep, false) AS steep FROM summary s LEFT JOIN gr USING (run_id, face_id))
SELECT run_id, arg_max(pit, {{'d': max_depth, 'f': -face_id}}) FILTER (max_depth IS NOT NULL) AS deepest_in_pit, round(avg(CASE WHEN max_depth > 0.03e0 THEN pit::INT END), 6) AS pit_share, arg_max(steep, {{'d': max_velocity, 'f': -face_id}}) FILTER (max_velocity IS NOT NULL) AS fastest_on_steep, round(avg(CASE WHEN max_depth > 0.03e0 THEN steep::INT END), 6) AS steep_share FROM x GROUP BY run_id""")
def k4_pits_and_steeps(spark, sf):
    """Where the deepest and fastest cells of each run lie in the terrain of its site, by what filling and slopes say."""
    ground = grids.terrain_slope(terrain.fill(v.dem(spark, sf), W, H, 0.0, tile=8), v.CELL)
    ground = ground.select(F.col("site_id").alias("run_id"), F.col("cell_id").alias("face_id"), F.greatest(F.coalesce(F.col("filled") - F.col("z"), F.lit(0.0)), F.lit(0.0)).alias("depression"), "slope")
    return rounded(runs.pits_and_steeps(summary(spark, sf), ground, 0.5, 0.03), "pit_share", "steep_share")


@query("SELECT row, col, arg_min(z, site_id) FILTER (z IS NOT NULL) AS z FROM dem GROUP BY ALL")
def p7_mosaic(spark, sf):
    return grids.mosaic(v.dem(spark, sf).withColumnRenamed("site_id", "tile_order"))


@query("SELECT site_id, cell_id, CASE WHEN cell_id % 11 = 0 THEN 0.035e0 WHEN cell_id % 5 < 4 THEN 0.02e0 * (1 + cell_id % 5) END AS n FROM dem")
def p8_roughness(spark, sf):
    table = spark.createDataFrame([(0, 0.02), (1, 0.04), (2, 0.06), (3, 0.08), (999, 0.035)], "code int, n double")
    c = v.dem(spark, sf).withColumn("code", (F.col("cell_id") % 5).cast("int")).withColumn("channel", F.col("cell_id") % 11 == 0)
    return grids.roughness(c, table).select("site_id", "cell_id", "n")


@query("SELECT DISTINCT CAST(cell_id % 7 AS INT) AS code FROM dem WHERE cell_id % 7 > 3")
def j14_unknown_codes(spark, sf):
    table = spark.createDataFrame([(0, 0.02), (1, 0.04), (2, 0.06), (3, 0.08)], "code int, n double")
    return grids.unknown_codes(v.dem(spark, sf).withColumn("code", (F.col("cell_id") % 7).cast("int")), table)


@query("SELECT osm_id, floor((x_m - 7) / 24) * 24 AS origin_x, ceil((y_m + 9) / 24) * 24 + 0e0 AS origin_y, CAST((ceil((x_m + 11) / 24) * 24 - floor((x_m - 7) / 24) * 24) / 24 AS INT) AS width, CAST((ceil((y_m + 9) / 24) * 24 - floor((y_m - 13) / 24) * 24) / 24 AS INT) AS height FROM buildings")
def p2_snapped_grid(spark, sf):
    b = v.buildings(spark, sf).select(F.col("osm_id").alias("id"), (F.col("x_m") - 7).alias("x0"), (F.col("y_m") - 13).alias("y0"), (F.col("x_m") + 11).alias("x1"), (F.col("y_m") + 9).alias("y1"))
    return grids.snapped_grid(b, 24.0).withColumnRenamed("id", "osm_id").withColumns({"origin_x": F.col("origin_x").cast("double"), "origin_y": F.col("origin_y").cast("double") + 0.0})


@query("SELECT osm_id, round(88 + x_m / 500, 7) + 0e0 AS lon, round(27 + y_m / 500, 7) + 0e0 AS lat FROM buildings")
def p1_utm_round_trip(spark, sf):
    b = v.buildings(spark, sf)
    x, y = grids.utm(88 + F.col("x_m") / 500, 27 + F.col("y_m") / 500, 45)
    lon, lat = grids.lonlat(F.col("x"), F.col("y"), 45)
    return b.withColumn("x", x).withColumn("y", y).select("osm_id", (F.round(lon, 7) + 0.0).alias("lon"), (F.round(lat, 7) + 0.0).alias("lat"))


@query("SELECT run_id, t_s, face_id, depth_m FROM map_steps WHERE t_s BETWEEN 86400 AND 100000 AND depth_m > 0.5e0")
def p3_clip_time(spark, sf):
    return v.map_steps(spark, sf).filter(F.col("t_s").between(86400, 100000) & (F.col("depth_m") > 0.5)).select("run_id", "t_s", "face_id", "depth_m")


WET_CELLS = "wc AS (SELECT run_id, face_id AS cell_id, (face_id % 25 + 0.5e0) * 20 AS cx, 400 - (face_id // 25 + 0.5e0) * 20 AS cy FROM summary WHERE max_depth > 0.3e0)"


@query(f"WITH {WET_CELLS}, n AS (SELECT run_id, osm_id, min({{'d': sqrt((x_m - cx) * (x_m - cx) + (y_m - cy) * (y_m - cy)), 'c': cell_id}}) AS b FROM buildings JOIN wc ON (x_m - cx) * (x_m - cx) + (y_m - cy) * (y_m - cy) <= 3600 GROUP BY run_id, osm_id) SELECT rr.run_id, b.osm_id, CAST(n.b.c AS DOUBLE) AS cell_id, round(n.b.d, 6) AS d FROM buildings b CROSS JOIN (SELECT DISTINCT run_id FROM map_steps) rr LEFT JOIN n ON n.osm_id = b.osm_id AND n.run_id = rr.run_id")
def j5_nearest_wet_cell(spark, sf):
    c = run_cells(spark, sf).filter("max_depth > 0.3")
    c = c.select("run_id", "cell_id", ((F.col("cell_id") % W + 0.5) * 20).alias("cx"), (400 - (F.floor(F.col("cell_id") / W) + 0.5) * 20).alias("cy"))
    return doubles(rounded(grids.nearest_cell(buildings_by_run(spark, sf), c, 60.0, RUN), "d"), "cell_id")


@query("WITH p AS (SELECT row, col, 400 - (row + 0.5e0) * 20 AS cy, (col + 0.5e0) * 20 AS cx, cell_id, (col + 0.5e0) * 20 AS chainage FROM dem WHERE site_id = 0 AND row = 10), n AS (SELECT osm_id, min({'d': sqrt((x_m - cx) * (x_m - cx) + (y_m - cy) * (y_m - cy)), 'c': cell_id}) AS b FROM buildings JOIN p ON (x_m - cx) * (x_m - cx) + (y_m - cy) * (y_m - cy) <= 40000 GROUP BY osm_id) SELECT osm_id, round(chainage, 6) AS chainage_m, round(n.b.d, 6) AS d FROM n JOIN p ON p.cell_id = n.b.c")
def j4_snap_to_centreline(spark, sf):
    p = v.dem(spark, sf).filter("site_id = 0 and row = 10").select("cell_id", ((F.col("col") + 0.5) * 20).alias("cx"), (400 - (F.col("row") + 0.5) * 20).alias("cy"))
    near = grids.nearest_cell(v.buildings(spark, sf), p, 200.0).filter("cell_id is not null")
    return near.join(p, "cell_id").select("osm_id", F.round("cx", 6).alias("chainage_m"), F.round("d", 6).alias("d"))


@query("SELECT a.site_id, a.cell_id AS id, arg_max(b.cell_id, {'q': b.cell_id * 7919 % 101, 'r': -b.cell_id}) AS best FROM dem a JOIN dem b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.site_id, a.cell_id")
def j6_best_in_window(spark, sf):
    d = v.dem(spark, sf).withColumn("acc", F.col("cell_id").cast("long") * 7919 % 101)
    points = d.select("site_id", F.col("cell_id").alias("id"), "row", "col")
    return grids.best_in_window(points, d, "acc", 2).select("site_id", "id", (F.col("row") * W + F.col("col")).alias("best"))


@query(f"WITH {WET_CELLS} SELECT run_id, kind, count(*) AS n FROM buildings b JOIN wc ON floor(x_m / 20) = floor(cx / 20) AND floor((400 - y_m) / 20) = floor((400 - cy) / 20) GROUP BY run_id, kind")
def j7_flooded_by_kind(spark, sf):
    wet = run_cells(spark, sf).filter("max_depth > 0.3").select("run_id", "cell_id")
    b = v.buildings(spark, sf).select("kind", loss.cell_of(F.col("x_m"), F.col("y_m"), origin_x=0.0, origin_y=400.0, cell_m=20.0, width=W, height=H).alias("cell_id"))
    return b.join(wet, "cell_id").groupBy("run_id", "kind").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT osm_id, x_m AS x, y_m AS y, sqrt(area_m2) * 2 AS a FROM buildings), c AS (SELECT osm_id, CAST(r AS BIGINT) AS row, CAST(q AS BIGINT) AS col FROM s, unnest(generate_series(CAST(floor(y / 10) AS INT), CAST(floor((y + a) / 10) AS INT))) t(r), unnest(generate_series(CAST(floor(x / 10) AS INT), CAST(floor((x + a) / 10) AS INT))) u(q) WHERE (r + 0.5e0) * 10 >= y AND (r + 0.5e0) * 10 < y + a AND (q + 0.5e0) * 10 >= x AND (q + 0.5e0) * 10 < x + a) SELECT row, col, max(osm_id) AS face_id FROM c GROUP BY ALL")
def j10_rasterise(spark, sf):
    a = F.sqrt("area_m2") * 2
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x_m"), F.col("y_m")
    p = v.buildings(spark, sf).select(F.col("osm_id").alias("face_id"), F.array(point(x, y), point(x + a, y), point(x + a, y + a), point(x, y + a)).alias("ring"))
    return grids.rasterise(p, 10.0)


@query("""WITH tr AS (SELECT osm_id, area_m2 / 100 AS depth, x_m AS ax, 400 - y_m AS ay, x_m + area_m2 AS bx, 400 - (y_m + 0.3e0 * area_m2) AS b_y, x_m + 0.2e0 * area_m2 AS cx, 400 - (y_m + area_m2) AS cy FROM buildings),
ce AS (SELECT osm_id, depth, ax, ay, bx, b_y, cx, cy, r, q FROM tr, unnest(generate_series(CAST(greatest(0, floor(least(ay, b_y, cy) / 20)) AS INT), CAST(least(19, floor(greatest(ay, b_y, cy) / 20)) AS INT))) t(r), unnest(generate_series(CAST(greatest(0, floor(least(ax, bx, cx) / 20)) AS INT), CAST(least(24, floor(greatest(ax, bx, cx) / 20)) AS INT))) u(q)),
ed AS (SELECT *, unnest([[ax, ay, bx, b_y], [bx, b_y, cx, cy], [cx, cy, ax, ay]]) AS e, sign((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) AS turn FROM ce),
di AS (SELECT osm_id, depth, r, q, list_max(list_transform([[q * 20, r * 20], [q * 20 + 20, r * 20], [q * 20, r * 20 + 20], [q * 20 + 20, r * 20 + 20]], lambda p: turn * ((e[3] - e[1]) * (p[2] - e[2]) - (e[4] - e[2]) * (p[1] - e[1])))) AS most FROM ed),
hit AS (SELECT osm_id, depth, r, q FROM di GROUP BY ALL HAVING min(most) > 1e-6), box AS (SELECT h.* FROM hit h JOIN tr USING (osm_id) WHERE least(ax, bx, cx) < q * 20 + 20 - 1e-9 AND greatest(ax, bx, cx) > q * 20 + 1e-9 AND least(ay, b_y, cy) < r * 20 + 20 - 1e-9 AND greatest(ay, b_y, cy) > r * 20 + 1e-9)
SELECT d.site_id, d.row, d.col, coalesce(t.depth, 0e0) AS depth_m FROM (SELECT DISTINCT site_id, row, col FROM dem WHERE z IS NOT NULL) d LEFT JOIN (SELECT r, q, arg_max(depth, osm_id) AS depth FROM box GROUP BY r, q) t ON t.r = d.row AND t.q = d.col""")
def j10_all_touched(spark, sf):
    """Depth of the cells that slanted polygons touch, in the domain of each site: 0 where none does."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, a = F.col("x_m"), F.col("y_m"), F.col("area_m2")
    p = v.buildings(spark, sf).select(F.col("osm_id").alias("face_id"), (a / 100).alias("depth_m"), F.array(point(x, y), point(x + a, y + 0.3 * a), point(x + 0.2 * a, y + a)).alias("ring"))
    domain = v.dem(spark, sf).filter("z is not null").select("site_id", "row", "col")
    return shapes.burned(p, "depth_m", domain, v.CELL, v.ORIGIN_X, v.ORIGIN_Y, v.WIDTH, v.HEIGHT)


@query("SELECT osm_id, round(area_m2 * 0.5e0 * 3, 6) AS area FROM buildings")
def m8_polygon_area(spark, sf):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, a = F.col("x_m"), F.col("y_m"), F.col("area_m2")
    return v.buildings(spark, sf).select("osm_id", F.round(grids.polygon_area(F.array(point(x, y), point(x + a, y), point(x, y + 3.0))), 6).alias("area"))
