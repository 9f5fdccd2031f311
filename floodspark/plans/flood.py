"""Queries over run summaries, exposure and loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.operators import grids, loss, runs, shapes
from floodspark.plans.registry import query
from floodspark.sources import views as v

GRID = {"origin_x": v.ORIGIN_X, "origin_y": v.ORIGIN_Y, "cell_m": v.CELL, "width": v.WIDTH, "height": v.HEIGHT}
# Damage at the depths of the curves, prices and classes of the loss model; fixed values.
CURVES = {"residential": [(0.0, 0.0), (1.0, 0.49405032354045164), (6.0, 1.0)], "commercial": [(0.0, 0.0), (1.0, 0.5), (6.0, 1.0)], "industrial": [(0.0, 0.0), (1.0, 0.48), (6.0, 1.0)]}
ROAD_CURVE = [(0.0, 0.0), (1.0, 0.37), (6.0, 1.0)]
PRICES = {"residential": 212.78 * 2 * 3, "commercial": 323.98 * 2 * 3}
CLASSES = {"house": "residential", "bungalow": "residential", "retail": "commercial", "hotel": "commercial", "warehouse": "industrial"}
R = 6


def rounded(df, *columns, digits=R):
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def doubles(df, *columns):
    """Whole numbers that may be null, as doubles: both engines then show a null alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def summary(spark, sf):
    return runs.run_summary(v.map_steps(spark, sf))


def run_cells(spark, sf):
    return summary(spark, sf).withColumnRenamed("face_id", "cell_id")


def buildings_by_run(spark, sf):
    return loss.in_each_run(v.buildings(spark, sf), v.run_ids(spark, sf))


RUN = ("run_id",)


@query("SELECT run_id, face_id, max_depth, max_velocity, CAST(arrival_s AS DOUBLE) AS arrival_s FROM summary")
def a1_run_summary(spark, sf):
    return doubles(summary(spark, sf), "arrival_s")


@query("""WITH base AS (SELECT run_id, face_id, arg_min(coalesce(depth_m, 'nan'::DOUBLE), {'t': t_s, 'v': velocity_ms, 'd': coalesce(depth_m, -1)}) AS base FROM map_steps GROUP BY ALL)
SELECT m.run_id, m.face_id, min(CASE WHEN t_s >= 86400 AND depth_m > base + 0.1e0 AND NOT isnan(base) THEN t_s * 1e0 END) AS arrival_s, min(depth_m) AS min_depth, count(CASE WHEN t_s >= 86400 AND depth_m > base + 0.1e0 AND NOT isnan(base) THEN 1 END) AS n_reached
FROM map_steps m JOIN base b ON m.run_id = b.run_id AND m.face_id = b.face_id GROUP BY ALL""")
def a2_rise_summary(spark, sf):
    return doubles(runs.rise_summary(v.map_steps(spark, sf), 86400), "arrival_s")


@query("SELECT run_id, quantile_cont(CAST(dt AS DOUBLE), 0.5) AS interval_s FROM (SELECT run_id, t_s - lag(t_s) OVER (PARTITION BY run_id ORDER BY t_s) AS dt FROM (SELECT DISTINCT run_id, t_s FROM map_steps)) GROUP BY run_id")
def a2_map_interval(spark, sf):
    return runs.map_interval(v.map_steps(spark, sf))


@query("SELECT poi_id, max(depth_m) AS peak_depth, max(q_m3s) AS peak_q, epoch_us(min(CASE WHEN depth_m > 0.1e0 THEN ts END)) AS first_us, CASE WHEN count(depth_m) = 0 THEN 'outside' ELSE 'sampled' END AS status FROM gauges GROUP BY poi_id")
def a3_poi_summary(spark, sf):
    out = runs.poi_summary(v.gauges(spark, sf))
    return out.select("poi_id", "peak_depth", "peak_q", F.unix_micros("first").alias("first_us"), "status")


@query("""SELECT a.poi_id, a.t_s + 30e0 AS t_s, greatest(a.wse_m - 0.5e0 * (a.poi_id % 3), 0e0) AS depth_m, round(sqrt(a.q * a.q + 1e0), 6) AS speed_ms
FROM (SELECT poi_id, epoch(ts) AS t_s, max(depth_m) AS wse_m, max(q_m3s) AS q FROM gauges GROUP BY ALL) a""")
def a4_gauge_series(spark, sf):
    g = v.gauges(spark, sf).groupBy("poi_id", (F.unix_micros("ts") / 1e6).alias("t_s")).agg(F.max("depth_m").alias("wse_m"), F.max("q_m3s").alias("vx"))
    beds = g.select("poi_id").distinct().withColumn("bed_m", 0.5 * (F.col("poi_id") % 3))
    return rounded(runs.gauge_series(g.select("poi_id", "t_s", "wse_m"), g.select("poi_id", "t_s", "vx", F.lit(1.0).alias("vy")), beds, 30.0), "speed_ms")


@query("""WITH l AS (SELECT face_id AS cell_id, t_s, run_id AS level, run_id * 0.5e0 AS z, depth_m AS surface, velocity_ms AS speed FROM map_steps),
m AS (SELECT cell_id, t_s, avg(speed) AS speed, max(surface) AS surface FROM l WHERE level = 0 OR z <= surface GROUP BY ALL)
SELECT cell_id, round(max(speed), 6) AS max_velocity, coalesce(bool_or(surface > 1.5e0), false) AS capped FROM m GROUP BY cell_id""")
def a5_depth_averaged_velocity(spark, sf):
    m = v.map_steps(spark, sf)
    levels = m.select(F.col("face_id").alias("cell_id"), "t_s", F.col("run_id").alias("level"), (F.col("run_id") * 0.5).alias("z"), F.col("depth_m").alias("surface"), F.col("velocity_ms").alias("speed"))
    return rounded(runs.depth_averaged_velocity(levels, 1.5), "max_velocity")


@query("SELECT run_id, count(CASE WHEN max_depth >= 0.3e0 THEN 1 END) AS n_wet, count(CASE WHEN max_depth >= 0.3e0 THEN 1 END) * 400e0 AS area_m2, max(max_depth) AS site_max_depth, max(max_velocity) AS site_max_velocity FROM summary GROUP BY run_id")
def a6_extent(spark, sf):
    return runs.extent(summary(spark, sf))


@query("""WITH c AS (SELECT count(CASE WHEN coalesce(depth_a, 0) > 0.3e0 AND coalesce(depth_b, 0) > 0.3e0 THEN 1 END) AS tp, count(CASE WHEN coalesce(depth_a, 0) <= 0.3e0 AND coalesce(depth_b, 0) > 0.3e0 THEN 1 END) AS fp,
count(CASE WHEN coalesce(depth_a, 0) > 0.3e0 AND coalesce(depth_b, 0) <= 0.3e0 THEN 1 END) AS fn FROM pairs)
SELECT tp, fp, fn, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1 END, 6) AS iou, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 1 END, 6) AS f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS "precision",
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fn > 0 THEN 100e0 * (fp - fn) / (tp + fn) END, 6) AS area_error_pct FROM c""")
def a7_extent_metrics(spark, sf):
    return rounded(runs.extent_metrics(runs.pair_maps(summary(spark, sf), 0, 1)), "iou", "f1", "precision", "recall", "area_error_pct")


@query("""WITH w AS (SELECT *, coalesce(depth_a, 0) > 0.03e0 OR coalesce(depth_b, 0) > 0.03e0 AS wet FROM pairs)
SELECT round(sqrt(avg(CASE WHEN wet THEN (depth_b - depth_a) * (depth_b - depth_a) END)), 6) AS depth_rmse, round(avg(CASE WHEN wet THEN abs(velocity_b - velocity_a) END), 6) AS velocity_mae, round(avg(abs(arrival_b - arrival_a)), 6) AS arrival_mae,
round(sqrt(avg(CAST(arrival_b - arrival_a AS DOUBLE) * (arrival_b - arrival_a))), 6) AS arrival_rmse, count(CASE WHEN wet THEN 1 END) AS n_wet FROM w""")
def a8_error_metrics(spark, sf):
    return rounded(runs.error_metrics(runs.pair_maps(summary(spark, sf), 0, 1)), "depth_rmse", "velocity_mae", "arrival_mae", "arrival_rmse")


@query("SELECT round(avg(CASE WHEN s.max_depth BETWEEN d10 AND d90 THEN 1e0 WHEN s.max_depth IS NOT NULL THEN 0e0 END), 6) AS coverage, count(s.max_depth) AS n FROM summary s JOIN zones z ON s.face_id = z.cell_id")
def a9_interval_coverage(spark, sf):
    s = summary(spark, sf)
    z = runs.exceedance(s).select(F.col("cell_id").alias("face_id"), "d10", "d90")
    return rounded(runs.interval_coverage(s.join(z, "face_id"), "max_depth", "d10", "d90"), "coverage")


@query("""WITH z AS (SELECT CAST(face_id % 25 AS INT) AS zone, avg(CASE WHEN depth_a > 0.3e0 THEN 1e0 ELSE 0e0 END) > 0.5e0 AS truth_wet, avg(CASE WHEN depth_b > 0.3e0 THEN 1e0 ELSE 0e0 END) > 0.5e0 AS pred_wet FROM pairs GROUP BY 1)
SELECT *, truth_wet = pred_wet AS agrees FROM z""")
def a9_zone_agreement(spark, sf):
    p = runs.pair_maps(summary(spark, sf), 0, 1)
    wet = lambda x: F.coalesce(F.col(x) > 0.3, F.lit(False))
    return runs.zone_agreement(p.select((F.col("face_id") % 25).alias("zone"), wet("depth_a").alias("t"), wet("depth_b").alias("p")), "zone", "t", "p")


@query("""WITH f AS (SELECT 'm' || CAST(run_id % 4 AS VARCHAR) AS method, abs(max_depth - 1.0e0) AS score FROM summary), s AS (SELECT method, quantile_cont(score, 0.5) AS median, count(score) AS n FROM f GROUP BY method)
SELECT method, round(median, 6) AS median, n, CASE WHEN median IS NULL THEN 'UNKNOWN' WHEN median <= 0.3e0 THEN 'GOOD' WHEN median <= 0.8e0 THEN 'FAIR' ELSE 'POOR' END AS grade, CAST(rank() OVER (ORDER BY median NULLS LAST) AS INT) AS rank FROM s""")
def a10_fold_summary(spark, sf):
    s = summary(spark, sf).select(F.concat(F.lit("m"), (F.col("run_id") % 4).cast("string")).alias("method"), F.abs(F.col("max_depth") - 1.0).alias("score"))
    return rounded(runs.fold_summary(s, 0.3, 0.8), "median")


FOLDS = """ml AS (SELECT unnest(['gp', 'linear', 'nearest']) AS method, unnest([1, 2, 3]) AS k), pm AS (SELECT method, run_id AS fold, (run_id + k) % 8 AS other FROM ml, (SELECT DISTINCT run_id FROM summary)),
pf AS (SELECT method, fold, coalesce(a.max_depth, 0) AS a, coalesce(b.max_depth, 0) AS b, a.arrival_s - b.arrival_s AS d FROM pm JOIN summary a ON a.run_id = fold JOIN summary b ON b.run_id = other AND b.face_id = a.face_id),
fs AS (SELECT method, fold, sqrt(avg(CASE WHEN a > 0.03e0 OR b > 0.03e0 THEN (a - b) * (a - b) END)) AS depth_rmse, sqrt(avg(d * d)) AS arrival_rmse, CASE WHEN count(CASE WHEN a > 0.3e0 THEN 1 END) + count(CASE WHEN b > 0.3e0 THEN 1 END) = 0 THEN 1e0 ELSE 2e0 * count(CASE WHEN a > 0.3e0 AND b > 0.3e0 THEN 1 END) / (count(CASE WHEN a > 0.3e0 THEN 1 END) + count(CASE WHEN b > 0.3e0 THEN 1 END)) END AS f1 FROM pf GROUP BY ALL)"""


def folds(spark, sf):
    """Every run's map told from the maps of the runs one, two and three further on, as three methods."""
    s = summary(spark, sf).select("run_id", "face_id", F.col("max_depth"), F.col("arrival_s"))
    side = lambda x: s.withColumnsRenamed({"max_depth": f"depth_{x}", "arrival_s": f"arrival_{x}"})
    method = F.explode(F.array(*(F.struct(F.lit(name).alias("method"), F.lit(k).alias("k")) for k, name in enumerate(("gp", "linear", "nearest"), 1))))
    truth = side("a").withColumn("m", method).select(F.col("m.method").alias("method"), F.col("run_id").alias("fold"), ((F.col("run_id") + F.col("m.k")) % 8).alias("run_id"), "face_id", "depth_a", "arrival_a")
    return runs.fold_scores(truth.join(side("b"), ["run_id", "face_id"]))


@query(f"WITH {FOLDS} SELECT method, fold, round(depth_rmse, 6) AS depth_rmse, round(arrival_rmse, 4) AS arrival_rmse, round(f1, 6) AS f1 FROM fs")
def a10_fold_scores(spark, sf):
    return rounded(rounded(folds(spark, sf), "depth_rmse", "f1"), "arrival_rmse", digits=4)


@query(f"""WITH {FOLDS}, md AS (SELECT method, quantile_cont(depth_rmse, 0.5) AS d, quantile_cont(arrival_rmse, 0.5) AS a, quantile_cont(f1, 0.5) AS f FROM fs GROUP BY method), g AS (SELECT * FROM md WHERE method = 'gp'), o AS (SELECT min(d) AS d, min(a) AS a, max(f) AS f FROM md WHERE method <> 'gp'), c AS (SELECT avg(f1) AS c FROM fs WHERE method = 'gp')
SELECT 'A1' AS test, CASE WHEN g.d <= o.d * 0.9e0 AND g.a <= o.a * 0.9e0 AND g.f >= o.f THEN 'PASS' ELSE 'FAIL' END AS status FROM g, o UNION ALL SELECT 'A2', CASE WHEN c BETWEEN 0.8e0 AND 0.95e0 THEN 'PASS' ELSE 'FAIL' END FROM c
UNION ALL SELECT 'A4', 'NOT_EVALUATED' UNION ALL SELECT 'A5', CASE WHEN g.d * 0.4e0 <= 0.5e0 * g.d THEN 'PASS' ELSE 'FAIL' END FROM g""")
def a10_acceptance(spark, sf):
    """The acceptance table of those folds, their F1 taken for coverage and two fifths of their errors for a projection's."""
    f = folds(spark, sf)
    return runs.acceptance(f.withColumn("coverage", F.col("f1")).withColumn("projection_depth", F.col("depth_rmse") * 0.4).withColumn("projection_arrival", F.col("arrival_rmse") * 0.4), "gp", ("linear", "nearest"))


@query("""WITH h AS (SELECT face_id, CAST(least(greatest(floor(depth_m / (2e0 / 64)), 0), 63) AS INT) AS bin, count(*) AS n FROM map_steps WHERE depth_m IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY face_id ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY face_id) AS total FROM h)
SELECT face_id, round(max(CASE WHEN cum >= total * 0.1e0 AND cum - n < total * 0.1e0 THEN (bin + (total * 0.1e0 - (cum - n)) / n) * (2e0 / 64) END), 9) AS p10, round(max(CASE WHEN cum >= total * 0.5e0 AND cum - n < total * 0.5e0 THEN (bin + (total * 0.5e0 - (cum - n)) / n) * (2e0 / 64) END), 9) AS p50,
round(max(CASE WHEN cum >= total * 0.9e0 AND cum - n < total * 0.9e0 THEN (bin + (total * 0.9e0 - (cum - n)) / n) * (2e0 / 64) END), 9) AS p90 FROM c GROUP BY face_id""")
def a11_histogram_percentiles(spark, sf):
    return rounded(runs.histogram_percentiles(v.map_steps(spark, sf), "face_id", "depth_m", 2.0), "p10", "p50", "p90", digits=9)


@query("SELECT cell_id, round(p, 6) AS p, round(d10, 6) AS d10, round(d50, 6) AS d50, round(d90, 6) AS d90, round(a50, 6) AS a50 FROM zones")
def a12_exceedance(spark, sf):
    return rounded(runs.exceedance(summary(spark, sf)), "p", "d10", "d50", "d90", "a50")


@query("""WITH s AS (SELECT run_id, max(max_depth) AS d, count(CASE WHEN max_depth > 0.3e0 THEN 1 END) * 400e0 AS a FROM summary GROUP BY run_id)
SELECT round(quantile_cont(d, 0.1), 6) AS d10, round(quantile_cont(d, 0.5), 6) AS d50, round(quantile_cont(d, 0.9), 6) AS d90, round(quantile_cont(a, 0.5), 6) AS area50 FROM s""")
def a12_sample_summaries(spark, sf):
    e = runs.extent(summary(spark, sf), inclusive=False)
    p = F.percentile("site_max_depth", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return rounded(e.agg(p.alias("d"), F.percentile("area_m2", 0.5).alias("area50")).select(F.col("d")[0].alias("d10"), F.col("d")[1].alias("d50"), F.col("d")[2].alias("d90"), "area50"), "d10", "d50", "d90", "area50")


BUILDING_CELLS = """bc AS (SELECT *, CASE WHEN floor(x_m / 20e0) BETWEEN 0 AND 24 AND floor((400e0 - y_m) / 20e0) BETWEEN 0 AND 19 THEN CAST(floor((400e0 - y_m) / 20e0) * 25 + floor(x_m / 20e0) AS BIGINT) END AS cell_id FROM buildings)"""
DAMAGE = """CASE asset_class WHEN 'residential' THEN {r} WHEN 'commercial' THEN {c} WHEN 'industrial' THEN {i} END""".format(
    **{k[0]: f"CASE WHEN least(greatest(depth_m, 0), 6e0) <= 1 THEN least(greatest(depth_m, 0), 6e0) * {curve[1][1]}e0 ELSE {curve[1][1]}e0 + (least(depth_m, 6e0) - 1) * ((1 - {curve[1][1]}e0) / 5) END" for k, curve in CURVES.items()}
)
CLASS_SQL = "CASE WHEN kind IN ('house', 'bungalow') THEN 'residential' WHEN kind IN ('retail', 'hotel') THEN 'commercial' WHEN kind = 'warehouse' THEN 'industrial' ELSE 'residential' END"
LOSS_SQL = f"({DAMAGE}) * area_m2 * CASE asset_class WHEN 'residential' THEN {PRICES['residential']!r}e0 WHEN 'commercial' THEN {PRICES['commercial']!r}e0 END"
PRICED = f"""b AS (SELECT rr.run_id, bc.*, s.max_depth AS depth_m, CASE WHEN kind IN ('house', 'bungalow') THEN 'residential' WHEN kind IN ('retail', 'hotel') THEN 'commercial' WHEN kind = 'warehouse' THEN 'industrial' ELSE 'residential' END AS asset_class FROM bc CROSS JOIN (SELECT DISTINCT run_id FROM map_steps) rr LEFT JOIN summary s ON s.run_id = rr.run_id AND s.face_id = bc.cell_id),
l AS (SELECT *, CASE WHEN depth_m > 0 THEN ({DAMAGE}) * area_m2 * CASE asset_class WHEN 'residential' THEN {PRICES['residential']!r}e0 WHEN 'commercial' THEN {PRICES['commercial']!r}e0 END END AS loss FROM b)"""


@query(f"WITH {BUILDING_CELLS} SELECT rr.run_id, osm_id, CAST(cell_id AS DOUBLE) AS cell_id, s.max_depth FROM bc CROSS JOIN (SELECT DISTINCT run_id FROM map_steps) rr LEFT JOIN summary s ON s.run_id = rr.run_id AND s.face_id = bc.cell_id")
def j1_sample_depth(spark, sf):
    return loss.sample(buildings_by_run(spark, sf), run_cells(spark, sf), "max_depth", RUN, **GRID).select("run_id", "osm_id", F.col("cell_id").cast("double").alias("cell_id"), "max_depth")


@query("SELECT run_id, face_id, round(CASE WHEN d <= 1 THEN d * 0.49405032354045164e0 ELSE 0.49405032354045164e0 + (d - 1) * (0.50594967645954836e0 / 5) END, 6) AS fraction, coalesce(max_depth > 0.5e0, false) AS over_cap FROM (SELECT run_id, face_id, max_depth, CASE WHEN max_depth IS NOT NULL THEN least(greatest(max_depth, 0), 0.5e0) END AS d FROM summary)")
def m3_damage_fraction(spark, sf):
    c = run_cells(spark, sf)
    return c.select("run_id", F.col("cell_id").alias("face_id"), F.round(loss.damage_fraction(F.col("max_depth"), CURVES["residential"], 0.5), R).alias("fraction"), F.coalesce(F.col("max_depth") > 0.5, F.lit(False)).alias("over_cap"))


def priced(spark, sf):
    return loss.sample(buildings_by_run(spark, sf), run_cells(spark, sf).withColumnRenamed("max_depth", "depth_m"), "depth_m", RUN, **GRID)


@query(f"WITH {BUILDING_CELLS}, {PRICED} SELECT run_id, asset_class, round(sum(loss), 2) AS loss, count(CASE WHEN depth_m > 0 THEN 1 END) AS n_flooded, count(CASE WHEN depth_m IS NULL THEN 1 END) AS n_excluded, count(*) AS n_buildings, count(CASE WHEN depth_m > 6 THEN 1 END) AS n_over_cap FROM l GROUP BY run_id, asset_class")
def a13_building_losses(spark, sf):
    return rounded(loss.building_losses(priced(spark, sf), CURVES, PRICES, CLASSES, "residential", keys=RUN), "loss", digits=2)


#: Roads of five vertices, the second leg of which goes straight up.
ROADS = """rv AS (SELECT osm_id AS road_id, kind, [struct_pack(x := x_m, y := y_m), struct_pack(x := x_m + area_m2, y := y_m + 0.5e0 * area_m2), struct_pack(x := x_m + area_m2, y := y_m + area_m2), struct_pack(x := x_m + 1.5e0 * area_m2, y := y_m + 0.25e0 * area_m2), struct_pack(x := x_m - 0.5e0 * area_m2, y := y_m - 0.5e0 * area_m2)] AS v FROM buildings),
lg AS (SELECT road_id, kind, k, v[k].x AS x0, v[k].y AS y0, v[k + 1].x AS x1, v[k + 1].y AS y1 FROM rv, unnest(generate_series(1, 4)) t(k)),
ln AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM lg),
ch AS (SELECT *, sum(len) OVER (PARTITION BY road_id ORDER BY k) AS b, sum(len) OVER (PARTITION BY road_id) AS total FROM ln)"""
PIECES = """nn AS (SELECT road_id, kind, max(total) AS total, CAST(greatest(1, ceil(max(total) / 10e0)) AS INT) AS n FROM ch GROUP BY road_id, kind),
pp AS (SELECT *, (i + 0.5e0) / n * total AS s FROM nn, unnest(generate_series(0, n - 1)) t(i)),
p AS (SELECT pp.road_id, pp.kind, total_p.x0 + (x1 - x0) * ((s - (b - len)) / len) AS x_m, y0 + (y1 - y0) * ((s - (b - len)) / len) AS y_m, pp.total / n AS piece_m FROM pp JOIN ch total_p ON total_p.road_id = pp.road_id AND s >= b - len AND (s < b OR k = 4))"""
#: Roads cut where they cross grid lines, and the cells that the pieces are in.
CUTS = """ts AS (SELECT road_id, kind, k, x0, y0, x1, y1, len, 0e0 AS t FROM ln UNION SELECT road_id, kind, k, x0, y0, x1, y1, len, 1e0 FROM ln
UNION SELECT road_id, kind, k, x0, y0, x1, y1, len, (g * 20e0 - x0) / (x1 - x0) FROM ln, unnest(generate_series(CAST(floor(least(x0, x1) / 20) AS INT), CAST(ceil(greatest(x0, x1) / 20) AS INT))) u(g) WHERE x0 <> x1
UNION SELECT road_id, kind, k, x0, y0, x1, y1, len, (g * 20e0 - y0) / (y1 - y0) FROM ln, unnest(generate_series(CAST(floor(least(y0, y1) / 20) AS INT), CAST(ceil(greatest(y0, y1) / 20) AS INT))) u(g) WHERE y0 <> y1),
cu AS (SELECT *, lead(t) OVER (PARTITION BY road_id, k ORDER BY t) AS t1 FROM ts WHERE t BETWEEN 0 AND 1),
cp AS (SELECT road_id, kind, len * (t1 - t) AS m, floor((400e0 - (y0 + (y1 - y0) * (t + t1) / 2)) / 20) AS r, floor((x0 + (x1 - x0) * (t + t1) / 2) / 20) AS c FROM cu WHERE t1 - t > 1e-9),
cl AS (SELECT road_id, kind, CASE WHEN r BETWEEN 0 AND 19 AND c BETWEEN 0 AND 24 THEN CAST(r * 25 + c AS BIGINT) END AS cell_id, sum(m) AS length_m FROM cp GROUP BY ALL)"""


def roads(spark, sf):
    x, y, a = F.col("x_m"), F.col("y_m"), F.col("area_m2")
    vertices = [(x, y), (x + a, y + 0.5 * a), (x + a, y + a), (x + 1.5 * a, y + 0.25 * a), (x - 0.5 * a, y - 0.5 * a)]
    return v.buildings(spark, sf).select(F.col("osm_id").alias("road_id"), "kind", F.array(*(F.struct(p.alias("x"), q.alias("y")) for p, q in vertices)).alias("line"))


@query(f"WITH {ROADS}, {PIECES} SELECT road_id, count(*) AS n_pieces, round(sum(piece_m), 6) AS length_m, round(min(x_m), 6) AS first_x, round(sum(y_m), 5) AS sum_y FROM p GROUP BY road_id")
def j8_densify(spark, sf):
    out = shapes.densified(roads(spark, sf), 10.0, "road_id").groupBy("road_id").agg(F.count("*").alias("n_pieces"), F.sum("piece_m").alias("length_m"), F.min("x_m").alias("first_x"), F.round(F.sum("y_m"), 5).alias("sum_y"))
    return rounded(out, "length_m", "first_x")


def road_lengths(spark, sf):
    return shapes.line_lengths(roads(spark, sf), v.CELL, v.ORIGIN_X, v.ORIGIN_Y, v.WIDTH, v.HEIGHT, "road_id")


@query(f"WITH {ROADS}, {CUTS} SELECT road_id, CAST(cell_id AS DOUBLE) AS cell_id, round(length_m, 6) AS length_m FROM cl WHERE round(length_m, 6) > 0")
def j9_line_cells(spark, sf):
    """Exact length of every road in every cell."""
    return doubles(rounded(road_lengths(spark, sf).select("road_id", "cell_id", "length_m"), "length_m"), "cell_id").filter("length_m > 0")


@query(f"WITH {ROADS}, {CUTS} SELECT run_id, road_id, round(sum(length_m), 6) AS flooded_m FROM cl JOIN summary s ON s.face_id = cl.cell_id AND max_depth > 0.3e0 GROUP BY run_id, road_id HAVING round(sum(length_m), 6) > 0")
def j9_flooded_roads(spark, sf):
    """Flooded length by road and run."""
    wet = run_cells(spark, sf).filter("max_depth > 0.3")
    return rounded(shapes.flooded_length(road_lengths(spark, sf), wet, ["road_id"], RUN), "flooded_m").filter("flooded_m > 0")


@query(f"WITH {ROADS}, {CUTS} SELECT run_id, kind, round(sum(length_m), 4) AS flooded_m FROM cl JOIN summary s ON s.face_id = cl.cell_id AND max_depth > 0.3e0 GROUP BY run_id, kind")
def j7_flooded_length_by_kind(spark, sf):
    wet = run_cells(spark, sf).filter("max_depth > 0.3")
    return rounded(shapes.flooded_length(road_lengths(spark, sf), wet, ["kind"], RUN), "flooded_m", digits=4)


PIECE_CELLS = "c AS (SELECT *, CASE WHEN floor(x_m / 20e0) BETWEEN 0 AND 24 AND floor((400e0 - y_m) / 20e0) BETWEEN 0 AND 19 THEN CAST(floor((400e0 - y_m) / 20e0) * 25 + floor(x_m / 20e0) AS BIGINT) END AS cell_id FROM p)"
ROAD_PRICE = "(CASE WHEN least(d, 6e0) <= 1 THEN d * 0.37e0 ELSE 0.37e0 + (least(d, 6e0) - 1) * (0.63e0 / 5) END) * piece_m * 3.75e0 * 17.778e0"


@query(f"""WITH {ROADS}, {PIECES}, {PIECE_CELLS},
d AS (SELECT c.*, rr.run_id, s.max_depth AS d FROM c CROSS JOIN (SELECT DISTINCT run_id FROM map_steps) rr LEFT JOIN summary s ON s.run_id = rr.run_id AND s.face_id = c.cell_id)
SELECT run_id, road_id, round(sum(CASE WHEN d > 0 THEN {ROAD_PRICE} END), 4) AS loss, round(sum(CASE WHEN d > 0 THEN piece_m ELSE 0e0 END), 6) AS flooded_m FROM d GROUP BY run_id, road_id""")
def a14_road_losses(spark, sf):
    p = loss.in_each_run(shapes.densified(roads(spark, sf), 10.0, "road_id"), v.run_ids(spark, sf))
    wet = loss.sample(p, run_cells(spark, sf).withColumnRenamed("max_depth", "depth_m"), "depth_m", RUN, **GRID)
    return rounded(rounded(loss.road_losses(wet, ROAD_CURVE, 17.778, 3.75, keys=RUN), "loss", digits=4), "flooded_m")


BANDS = "bands AS (SELECT cell_id, 'p10' AS band, d10 AS d FROM zones UNION ALL SELECT cell_id, 'p50', d50 FROM zones UNION ALL SELECT cell_id, 'p90', d90 FROM zones)"


def depth_bands(spark, sf):
    """The three depth maps of an answer: cell_id, band and depth_m."""
    z = runs.exceedance(summary(spark, sf))
    return z.select("cell_id", F.explode(F.array(*(F.struct(F.lit(f"p{k}").alias("band"), F.col(f"d{k}").alias("depth_m")) for k in (10, 50, 90)))).alias("m")).select("cell_id", "m.band", "m.depth_m")


@query(f"""WITH {BUILDING_CELLS}, {ROADS}, {PIECES}, {PIECE_CELLS}, {BANDS},
bl AS (SELECT band, {CLASS_SQL} AS asset_class, CASE WHEN d > 0 THEN {LOSS_SQL} END AS loss FROM (SELECT kind, area_m2, bands.band, bands.d, bands.d AS depth_m FROM bc JOIN bands USING (cell_id))),
rl AS (SELECT band, 'infrastructure_roads' AS asset_class, CASE WHEN d > 0 THEN {ROAD_PRICE} END AS loss FROM c JOIN bands USING (cell_id)),
al AS (SELECT asset_class, band, sum(loss) AS loss FROM (SELECT * FROM bl UNION ALL SELECT * FROM rl) GROUP BY asset_class, band)
SELECT asset_class, round(sum(CASE WHEN band = 'p10' THEN loss END), 2) AS p10, round(sum(CASE WHEN band = 'p50' THEN loss END), 2) AS p50, round(sum(CASE WHEN band = 'p90' THEN loss END), 2) AS p90 FROM al GROUP BY ROLLUP (asset_class)""")
def a15_loss_estimate(spark, sf):
    """Loss by class and in total from the three depth maps, buildings and roads."""
    bands = depth_bands(spark, sf)
    b = v.buildings(spark, sf).withColumn("cell_id", loss.cell_of(F.col("x_m"), F.col("y_m"), **GRID)).join(bands, "cell_id")
    built = loss.building_losses(b, CURVES, PRICES, CLASSES, "residential", keys=("band",)).select("band", "asset_class", "loss")
    p = shapes.densified(roads(spark, sf), 10.0, "road_id").withColumn("cell_id", loss.cell_of(F.col("x_m"), F.col("y_m"), **GRID)).join(bands, "cell_id")
    paved = loss.road_losses(p, ROAD_CURVE, 17.778, 3.75, keys=("band",)).groupBy("band").agg(F.sum("loss").alias("loss")).select("band", F.lit("infrastructure_roads").alias("asset_class"), "loss")
    wide = built.unionByName(paved).groupBy("asset_class").pivot("band", ["p10", "p50", "p90"]).agg(F.sum("loss"))
    return rounded(loss.loss_estimate(wide), "p10", "p50", "p90", digits=2)


ZONE = "CASE WHEN p >= 0.9e0 THEN 2 WHEN p >= 0.1e0 THEN 1 ELSE 0 END"


def zoned(spark, sf):
    z = runs.exceedance(summary(spark, sf))
    return z.withColumn("zone", runs.extent_class(F.col("p")))


@query(f"SELECT round(sum(p * pop), 6) AS value, sum(CASE WHEN zone = 2 THEN pop ELSE 0e0 END) AS low, sum(CASE WHEN zone >= 1 THEN pop ELSE 0e0 END) AS high FROM (SELECT p, {ZONE} AS zone, cell_id % 11 * 1e0 AS pop FROM zones)")
def a16_population_at_risk(spark, sf):
    return rounded(loss.population_at_risk(zoned(spark, sf).withColumn("population", (F.col("cell_id") % 11).cast("double"))), "value")


@query(f"WITH {BUILDING_CELLS}, k AS (SELECT kind, {ZONE} AS zone FROM bc JOIN zones z ON z.cell_id = bc.cell_id) SELECT kind, count(CASE WHEN zone = 0 THEN 1 END) AS zone_0, count(CASE WHEN zone = 1 THEN 1 END) AS zone_1, count(CASE WHEN zone = 2 THEN 1 END) AS zone_2 FROM k GROUP BY kind")
def a17_assets_by_zone(spark, sf):
    b = loss.sample(v.buildings(spark, sf), zoned(spark, sf), "zone", **GRID)
    return loss.by_zone(b.filter("zone is not null"))


@query(f"WITH {ROADS}, {CUTS}, k AS (SELECT length_m, {ZONE} AS zone FROM cl JOIN zones z ON z.cell_id = cl.cell_id) SELECT zone, round(sum(length_m), 4) AS roads_m FROM k GROUP BY zone")
def a17_roads_by_zone(spark, sf):
    """Length of roads in each zone."""
    return road_lengths(spark, sf).join(zoned(spark, sf).select("cell_id", "zone"), "cell_id").groupBy("zone").agg(F.round(F.sum("length_m"), 4).alias("roads_m"))


@query("SELECT run_id, max(max_depth) AS source_max, sum(max_depth) IS NOT NULL AS any_value, round(100e0 * avg(CASE WHEN max_depth IS NULL THEN 1e0 ELSE 0e0 END), 6) AS void_pct FROM summary GROUP BY run_id")
def a18_void_statistics(spark, sf):
    s = summary(spark, sf)
    return rounded(s.groupBy("run_id").agg(F.max("max_depth").alias("source_max"), F.sum("max_depth").isNotNull().alias("any_value"), (100 * F.avg(F.col("max_depth").isNull().cast("double"))).alias("void_pct")), "void_pct")


@query(f"WITH {BUILDING_CELLS} SELECT run_id, osm_id, s.arrival_s FROM bc JOIN (SELECT * FROM summary WHERE max_depth > 0.3e0) s ON s.face_id = bc.cell_id QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY arrival_s NULLS LAST, osm_id) <= 10")
def k1_warning_table(spark, sf):
    """The ten earliest buildings of each run: buildings are put in their cells once, then met by the runs' wet cells."""
    wet = run_cells(spark, sf).filter("max_depth > 0.3").select("run_id", "cell_id", "arrival_s")
    b = v.buildings(spark, sf).select("osm_id", loss.cell_of(F.col("x_m"), F.col("y_m"), **GRID).alias("cell_id"))
    return loss.warning_table(b.join(wet, "cell_id").select("run_id", "osm_id", "arrival_s"), 10, RUN)


@query("""WITH best AS (SELECT run_id, arg_max(face_id, {'d': max_depth, 'f': -face_id}) AS face_id FROM summary WHERE max_depth IS NOT NULL GROUP BY run_id), w AS (SELECT run_id, avg(CASE WHEN max_depth > 0.03e0 THEN CASE WHEN face_id % 5 > 2 THEN 1e0 ELSE 0e0 END END) AS s FROM summary WHERE max_depth IS NOT NULL GROUP BY run_id)
SELECT run_id, face_id, face_id % 5 > 2 AS is_steep, round(s, 6) AS steep_share FROM best JOIN w USING (run_id)""")
def k4_maximum_cell(spark, sf):
    s = summary(spark, sf)
    slope = s.select(F.col("face_id").alias("cell_id")).distinct().withColumn("slope", (F.col("cell_id") % 5).cast("double"))
    return rounded(runs.maximum_cell(s, slope, 2.0), "steep_share")


@query("SELECT * REPLACE (CAST(arrival_a AS DOUBLE) AS arrival_a, CAST(arrival_b AS DOUBLE) AS arrival_b) FROM pairs")
def j11_pair_maps(spark, sf):
    return doubles(runs.pair_maps(summary(spark, sf), 0, 1), "arrival_a", "arrival_b")


@query("WITH f AS (SELECT CAST(floor(max_depth / 0.25e0) AS INT) AS c, max_depth FROM summary) SELECT CASE WHEN max_depth IS NULL THEN NULL WHEN max_depth >= 2 THEN 3e0 WHEN max_depth >= 1 THEN 2e0 WHEN max_depth >= 0.3e0 THEN 1e0 ELSE 0e0 END AS class, count(*) AS n FROM f GROUP BY 1")
def p11_depth_class(spark, sf):
    return summary(spark, sf).groupBy(runs.class_of(F.col("max_depth"), [0.3, 1.0, 2.0]).cast("double").alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT cell_id, CASE WHEN cell_id % 7 = 0 THEN 0 ELSE {ZONE} END AS zone FROM zones")
def p12_extent_class(spark, sf):
    z = runs.exceedance(summary(spark, sf))
    return z.select("cell_id", runs.extent_class(F.col("p"), domain=F.col("cell_id") % 7 != 0).alias("zone"))


@query("SELECT run_id, face_id, round(ln(1 + greatest(max_depth, 0)), 6) AS y, round(greatest(exp(ln(1 + greatest(max_depth, 0))) - 1, 0), 6) AS back, least(greatest(coalesce(arrival_s, 86400), 0), 86400) AS arrival FROM summary")
def p13_transforms(spark, sf):
    y = F.log1p(F.greatest("max_depth", F.lit(0.0)))
    y = F.when(F.col("max_depth").isNotNull(), y)
    y = F.when(F.col("max_depth").isNull(), F.lit(0.0)).otherwise(y)
    return summary(spark, sf).select("run_id", "face_id", F.round(y, R).alias("y"), F.round(F.greatest(F.expm1(y), F.lit(0.0)), R).alias("back"), F.least(F.greatest(F.coalesce("arrival_s", F.lit(86400)), F.lit(0)), F.lit(86400)).alias("arrival"))


@query("""WITH c AS (SELECT run_id, t_s, count(CASE WHEN depth_m >= 0.3e0 THEN 1 END) AS n FROM map_steps GROUP BY ALL), p AS (SELECT run_id, max(n) AS peak, max(t_s) AS last FROM c GROUP BY run_id),
k AS (SELECT c.run_id, [min(CASE WHEN n >= peak * 0.05e0 THEN t_s END), min(CASE WHEN n >= peak * 0.35e0 THEN t_s END), min(CASE WHEN n >= peak * 0.75e0 THEN t_s END), min(CASE WHEN n >= peak THEN t_s END), max(last)] AS l FROM c JOIN p USING (run_id) GROUP BY c.run_id)
SELECT run_id, unnest(list_distinct(l)) AS t_s FROM k""")
def w10_representative_steps(spark, sf):
    return runs.representative_steps(runs.wet_counts(v.map_steps(spark, sf)))


@query("""WITH a AS (SELECT min(arrival_s) AS a FROM summary GROUP BY face_id), f AS (SELECT unnest(generate_series(0, 20)) AS frame)
SELECT frame, least(frame * 7200e0, 144000e0) AS t_s, count(a) AS n_cells FROM f LEFT JOIN a ON a <= frame * 7200 AND a <= 144000 GROUP BY frame""")
def w9_timeline(spark, sf):
    cells = summary(spark, sf).groupBy("face_id").agg(F.min("arrival_s").alias("arrival_s"))
    return runs.timeline(cells, "arrival_s", 7200.0, 144000.0)


@query("SELECT DISTINCT run_id FROM summary WHERE max_depth > 1.9e0")
def j14_runs_with_deep_cells(spark, sf):
    s = summary(spark, sf)
    return s.select("run_id").distinct().join(s.filter("max_depth > 1.9").select("run_id"), "run_id", "left_semi")


@query("SELECT face_id FROM summary WHERE run_id = 0 AND max_depth > 0.3e0 INTERSECT SELECT face_id FROM summary WHERE run_id = 1 AND max_depth > 0.3e0")
def u5_common_wet_cells(spark, sf):
    s = summary(spark, sf).filter("max_depth > 0.3")
    return s.filter("run_id = 0").select("face_id").intersect(s.filter("run_id = 1").select("face_id"))


@query("""WITH w AS (SELECT DISTINCT CAST(face_id // 25 AS INT) AS r, CAST(face_id % 25 AS INT) AS c FROM summary WHERE max_depth > 1.5e0), d AS (SELECT unnest(generate_series(-2, 2)) AS a), e AS (SELECT d.a, f.a AS b FROM d, d f WHERE abs(d.a) + abs(f.a) <= 2)
SELECT DISTINCT CAST(r + a AS INT) AS "row", CAST(c + b AS INT) AS col FROM w, e WHERE r + a BETWEEN 0 AND 19 AND c + b BETWEEN 0 AND 24""")
def u4_corridor(spark, sf):
    wet = summary(spark, sf).filter("max_depth > 1.5").select(F.floor(F.col("face_id") / 25).cast("int").alias("row"), (F.col("face_id") % 25).cast("int").alias("col")).distinct()
    return grids.dilate(wet, 2, v.WIDTH, v.HEIGHT)
