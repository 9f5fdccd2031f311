"""Queries of ids, solver logs, campaigns, nested grids, boxes, optical pixels and values scaled by product."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import checks
from floodspark.operators import grids, lake, loss
from floodspark.plans.flood import rounded
from floodspark.plans.registry import query
from floodspark.sources import io
from floodspark.sources import views as v


@query("""WITH i AS (SELECT scene_id, scene_id % 8 AS m, 'site' || site_id AS site, CAST(scene_id AS VARCHAR) AS n, lpad(CAST(scene_id % 1000 AS VARCHAR), 3, '0') AS three, acq_date FROM scenes)
SELECT scene_id, CASE m WHEN 0 THEN 'poi' WHEN 1 THEN 'dam' WHEN 2 THEN 'job' WHEN 3 THEN 'design' WHEN 4 THEN 'historical' WHEN 5 THEN 'run' WHEN 6 THEN 'month' END AS kind, CASE WHEN m NOT IN (2, 6, 7) THEN site END AS site,
CASE m WHEN 0 THEN 'p' || n WHEN 1 THEN 'd' || n WHEN 2 THEN strftime(acq_date, '%Y%m%dT000000Z') || '_' || printf('%06x', scene_id % 16777216) WHEN 3 THEN three WHEN 4 THEN 'e' || strftime(acq_date, '%Y') WHEN 5 THEN 's' || three || '__sph' WHEN 6 THEN strftime(acq_date, '%Y-%m') END AS local FROM i""")
def m12_parsed_ids(spark, sf):
    """Ids of all kinds built and taken apart again; every eighth is none."""
    s, m = v.scenes(spark, sf), F.col("scene_id") % 8
    site, number = F.concat(F.lit("site"), F.col("site_id").cast("string")), F.col("scene_id").cast("string")
    design = checks.scenario_id(site, F.col("scene_id") % 1000)
    made = (
        checks.local_id(site, F.concat(F.lit("p"), number), "poi"), checks.local_id(site, F.concat(F.lit("d"), number)),
        checks.stamped_id("job", F.timestamp_seconds(F.unix_date("acq_date").cast("long") * 86400), F.col("scene_id")), design,
        F.concat(site, F.lit("__hist_e"), F.year("acq_date").cast("string")), F.concat(design, F.lit("__sph")), F.date_format("acq_date", "yyyy-MM"),
    )
    ids = F.coalesce(*(F.when(m == k, c) for k, c in enumerate(made)), F.concat(F.lit("Site "), number))
    return s.select("scene_id", checks.parsed_id(ids).alias("id")).select("scene_id", "id.kind", "id.site", "id.local")


@query("""WITH l AS (SELECT poi_id AS run_id, event_id AS n, event_id % 6 AS k, CAST(epoch(make_timestamp(2020 + event_id % 3, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, event_id % 60, 7e0)) AS BIGINT) AS s FROM gauges),
f AS (SELECT run_id, CAST(arg_min(n * 1000 + 7, n) FILTER (k = 0) AS BIGINT) AS particles, arg_min('5.' || CAST(n % 10 AS VARCHAR), n) FILTER (k = 1) AS version, arg_min(s, n) FILTER (k = 2) AS started_s, arg_min(s, n) FILTER (k = 3) AS finished_s, arg_max(n % 50 + 0.5e0, n) FILTER (k = 4) AS said FROM l GROUP BY run_id)
SELECT run_id, particles, version, started_s, finished_s, coalesce(said, CAST(finished_s - started_s AS DOUBLE)) AS wall_s FROM f""")
def m13_solver_facts(spark, sf):
    n = F.col("event_id")
    at = [c.cast("int") for c in (n % 24, n % 60, n % 28 + 1, n % 12 + 1, n % 3 + 2020)]
    stamp = lambda word: F.format_string(f"Computation {word}  at: %02d:%02d:07, %02d-%02d-%d", *at)
    texts = (F.concat(F.lit("Total particles: "), F.format_number(n * 1000 + 7, 0)), F.format_string("Solver v5.%d", n % 10), stamp("started"), stamp("finished"), F.format_string("total computation time (s) : %d.5", n % 50))
    line = F.coalesce(*(F.when(n % 6 == k, c) for k, c in enumerate(texts)), F.lit("nothing"))
    facts = checks.solver_facts(v.gauges(spark, sf).select(F.col("poi_id").alias("run_id"), n.alias("n"), line.alias("line")), "Solver")
    return facts.select("run_id", "particles", "version", F.unix_seconds("started").alias("started_s"), F.unix_seconds("finished").alias("finished_s"), "wall_s")


@query("""WITH r AS (SELECT run_id, job_id, wall_s, CASE WHEN status = 'queued' AND length(run_id) % 2 = 0 THEN 'running' ELSE status END AS status FROM runs)
SELECT job_id, count(*) FILTER (status = 'postprocessed') AS done, count(*) AS total, coalesce(min(run_id) FILTER (status = 'running'), min(run_id) FILTER (status = 'queued')) AS running, coalesce(string_agg(run_id, ',' ORDER BY run_id) FILTER (status = 'failed'), '') AS failed, round(avg(wall_s) FILTER (status = 'postprocessed') * (count(*) - count(*) FILTER (status = 'postprocessed')), 4) AS eta_s FROM r GROUP BY job_id""")
def a26_campaign_status(spark, sf):
    r = io.parsed_registry(v.runs(spark, sf))
    r = r.withColumn("status", F.when((F.col("status") == "queued") & (F.length("run_id") % 2 == 0), "running").otherwise(F.col("status")))
    return rounded(checks.campaign_status(r).withColumn("failed", F.array_join("failed", ",")), "eta_s", digits=4)


@query("SELECT 'site' || osm_id % 20 || '__poi__p' || osm_id AS poi_id, 'p' || osm_id AS name, (floor(x_m / 20) + 0.5e0) * 20 AS chainage_m FROM buildings WHERE x_m >= 0 AND x_m < 500 AND y_m > 0 AND y_m <= 400")
def w11_pois_on_profile(spark, sf):
    b = v.buildings(spark, sf).filter("x_m >= 0 and x_m < 500 and y_m > 0 and y_m <= 400")
    cell = F.floor((v.ORIGIN_Y - F.col("y_m")) / v.CELL) * v.WIDTH + F.floor(F.col("x_m") / v.CELL)
    pois = b.select(F.concat(F.lit("site"), (F.col("osm_id") % 20).cast("string")).alias("site"), F.concat(F.lit("p"), F.col("osm_id").cast("string")).alias("name"), cell.alias("cell_id"))
    return checks.profile_points(pois, v.WIDTH, v.CELL)


@query("""WITH b AS (SELECT osm_id AS id, CASE WHEN osm_id % 5 = 0 THEN 7e0 ELSE 8e0 END AS m, -72 + floor((x_m - 7 + 72) / 24) * 24 AS l, -72 + ceil((x_m + 11 + 72) / 24) * 24 AS r, 480 + floor((y_m - 13 - 480) / 24) * 24 AS b, 480 + ceil((y_m + 9 - 480) / 24) * 24 AS t FROM buildings),
p AS (SELECT *, CASE WHEN m = 7 THEN 'cell does not divide' WHEN l < -72 OR t > 480 OR r > 528 OR b < -24 THEN 'outside far grid' END AS problem FROM b)
SELECT id, CASE WHEN problem IS NULL THEN l + 0e0 END AS origin_x, CASE WHEN problem IS NULL THEN t + 0e0 END AS origin_y, CASE WHEN problem IS NULL THEN CAST(round((r - l) / m) AS INT) END AS width, CASE WHEN problem IS NULL THEN CAST(round((t - b) / m) AS INT) END AS height, problem FROM p""")
def p2_nested_grid(spark, sf):
    """Near grids of 8 m (every fifth 7 m, which does not divide) in a far grid of 25 x 21 cells of 24 m."""
    far = {"far_x": -72.0, "far_y": 480.0, "far_width": 25, "far_height": 21, "far_m": 24.0}
    b = v.buildings(spark, sf).select(F.col("osm_id").alias("id"), (F.col("x_m") - 7).alias("x0"), (F.col("y_m") - 13).alias("y0"), (F.col("x_m") + 11).alias("x1"), (F.col("y_m") + 9).alias("y1"), F.when(F.col("osm_id") % 5 == 0, 7.0).otherwise(8.0).alias("cell_m"), *(F.lit(x).alias(k) for k, x in far.items()))
    out = grids.nested_grid(b)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("origin_x", "origin_y")})


@query("SELECT site_id, cell_id, z FROM dem WHERE (col + 0.5e0) * 20 BETWEEN 30 + site_id * 10 AND 250 + site_id * 20 AND 400 - (row + 0.5e0) * 20 BETWEEN 50 + site_id * 10 AND 390")
def p3_clip_boxes(spark, sf):
    """Cells whose centre lies in their site's box, edges included."""
    d, s = v.dem(spark, sf), F.col("site_id")
    boxes = d.select("site_id").distinct().select("site_id", (30 + s * 10).alias("x0"), (50 + s * 10).alias("y0"), (250 + s * 20).alias("x1"), F.lit(390).alias("y1"))
    points = d.withColumns({"x_m": (F.col("col") + 0.5) * v.CELL, "y_m": v.ORIGIN_Y - (F.col("row") + 0.5) * v.CELL})
    return grids.clip_to_boxes(points, boxes, ["site_id"]).select("site_id", "cell_id", "z")


@query("""WITH p AS (SELECT l_suppkey % 8 AS site_id, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 3000 AS DOUBLE) AS b3, l_quantity * 100e0 AS b8, l_partkey % 12 AS scl FROM lineitem),
i AS (SELECT *, scl NOT IN (3, 8, 9, 10) AS valid, CASE WHEN scl NOT IN (3, 8, 9, 10) AND b3 + b8 <> 0 THEN (b3 - b8) / (b3 + b8) END AS index FROM p)
SELECT site_id, round(100 * avg(CAST(valid AS INT)), 6) AS valid_pct, round(100 * avg(CASE WHEN scl = 11 THEN 1 ELSE 0 END), 6) AS snow_ice_pct, count(*) FILTER (valid AND index >= 0 AND b8 * 0.0001e0 <= 0.15e0) AS n_water, round(avg(index), 6) AS mean_index FROM i GROUP BY site_id""")
def p10_optical_pixels(spark, sf):
    t = v.load(spark, sf, "lineitem")
    pixels = lake.optical(t.select((F.col("l_suppkey") % 8).alias("site_id"), (F.floor("l_extendedprice").cast("long") % 3000).cast("double").alias("b3"), (F.col("l_quantity") * 100).cast("double").alias("b8"), (F.col("l_partkey") % 12).alias("scl")))
    water = pixels.groupBy("site_id").agg(F.count_if(lake.water_mask(F.col("index"), 0.0, nir=F.col("nir"))).alias("n_water"), F.avg("index").alias("mean_index"))
    return rounded(lake.optical_shares(pixels, ["site_id"]).join(water, "site_id"), "valid_pct", "snow_ice_pct", "mean_index")


@query("""WITH c AS (SELECT n_nationkey AS country, n_regionkey AS region, avg(c_acctbal) AS gdp FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT n_regionkey AS region, max(c_acctbal) AS max_damage, avg(c_acctbal) AS gdp FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
x AS (SELECT country, c.gdp * (max_damage / nullif(r.gdp, 0)) AS e FROM c LEFT JOIN r USING (region)) SELECT country, round(e, 4) AS value_eur, CASE WHEN country % 4 <> 0 THEN round(e * 60.6683e0 * 2.171e0, 3) END AS value_inr, CASE WHEN country % 4 <> 0 THEN 'sourced' ELSE 'placeholder' END AS status FROM x""")
def m4_gdp_scaled(spark, sf):
    """Accounts stand for products; every fourth country's rate is a placeholder."""
    c = v.load(spark, sf, "customer").join(v.load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    countries = c.groupBy(F.col("n_nationkey").alias("country"), F.col("n_regionkey").alias("region")).agg(F.avg("c_acctbal").alias("gdp"))
    regions = c.groupBy(F.col("n_regionkey").alias("region")).agg(F.max("c_acctbal").alias("max_damage"), F.avg("c_acctbal").alias("gdp"))
    out = loss.priced(loss.scaled_by_product(countries, regions), 60.6683, 2.171, F.col("country") % 4 != 0)
    return out.select("country", F.round("value_eur", 4).alias("value_eur"), F.round("value_inr", 3).alias("value_inr"), "status")
