"""Queries over registries, documents of results, checks, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floodspark.functions import checks
from floodspark.operators import loss, runs
from floodspark.plans.flood import doubles, rounded, summary
from floodspark.plans.registry import query
from floodspark.sources import io
from floodspark.sources import views as v
from floodspark.streaming import streams


def folder(spark) -> str:
    """A new folder in the shared directory."""
    return f"{io.shared_dir(spark).rstrip('/')}/q-{uuid.uuid4().hex}"


@query("SELECT run_id, CAST(face_id // 25 AS INT) AS row, CAST(face_id % 25 AS INT) AS col, round(max_depth, 3) AS max_depth, CAST(arrival_s AS DOUBLE) AS arrival_s FROM summary")
def s1_s2_cells_round_trip(spark, sf):
    s = summary(spark, sf)
    cells = s.select(F.lit(0).alias("site_id"), "run_id", F.floor(F.col("face_id") / v.WIDTH).cast("int").alias("row"), (F.col("face_id") % v.WIDTH).alias("col"), "max_depth", "max_velocity", F.col("arrival_s").cast("float").alias("arrival_s"))
    path = folder(spark)
    io.write_cells(cells, path, 8)
    back = io.load_cells(spark, path, v.WIDTH, v.HEIGHT)
    return back.select("run_id", "row", "col", F.round(F.col("max_depth").cast("double"), 3).alias("max_depth"), F.col("arrival_s").cast("double").alias("arrival_s"))


@query("SELECT strftime(d, '%Y-%m-%d') AS d, round(sum(mm), 6) AS precip_mm FROM rain GROUP BY 1")
def s3_csv_round_trip(spark, sf):
    daily = v.rain(spark, sf).groupBy(F.col("d").alias("date")).agg(F.round(F.sum("mm"), 9).alias("precip_mm")).select("date", "precip_mm", F.lit("r").alias("dataset"), F.lit(None).cast("string").alias("aggregation"))
    path = folder(spark)
    io.write_csv(daily, path)
    return io.read_csv(spark, path, "rainfall").select(F.date_format("date", "yyyy-MM-dd").alias("d"), F.round("precip_mm", 6).alias("precip_mm"))


@query("""SELECT 'timeseries' AS name, count(*) AS n, round(sum(depth_m), 3) AS total, count(*) AS n_null FROM gauges UNION ALL SELECT 'damage_curves', count(*), round(sum(area_m2), 3), 0 FROM buildings UNION ALL SELECT 'asset_values', count(*), round(sum(area_m2), 3), count(*) FROM buildings
UNION ALL SELECT 'manning_n', count(*), round(sum(0.01e0 * (cell_id % 12)), 3), 0 FROM dem UNION ALL SELECT 'lake_area', count(*), round(sum(cloud_pct) * 1e0, 3), count(*) - count(cloud_pct) FROM scenes UNION ALL SELECT 'rainfall', count(*), round(sum(mm), 3), count(*) FROM rain
UNION ALL SELECT 'scenes', count(*), round(sum(cloud_pct) * 1e0, 3), count(*) - count(cloud_pct) FROM scenes UNION ALL SELECT 'routed_discharge', count(*), round(sum(q_m3s), 3), 0 FROM gauges""")
def s3_csv_schemas(spark, sf):
    """Every schema written and read again: rows, the total of its main number, and how many of its optional values are null."""
    g, b, sc, none = v.gauges(spark, sf), v.buildings(spark, sf), v.scenes(spark, sf), F.lit(None)
    t, cloud = (F.unix_micros("ts") / 1e6).alias("t_s"), F.col("cloud_pct").cast("double")
    tables = {
        "timeseries": (g.select(F.col("poi_id").cast("string"), t, "depth_m", none.cast("double").alias("velocity_ms"), F.col("q_m3s").alias("wse_m")), "depth_m", "velocity_ms"),
        "damage_curves": (b.select(F.col("kind").alias("asset_class"), F.col("area_m2").alias("depth_m"), F.lit(0.5).alias("damage_fraction"), F.lit("s").alias("source")), "depth_m", "source"),
        "asset_values": (b.select(F.col("kind").alias("asset_class"), F.col("area_m2").alias("value_inr_per_unit"), F.lit("m2").alias("unit"), none.cast("string").alias("source"), F.lit("ok").alias("status")), "value_inr_per_unit", "source"),
        "manning_n": (v.dem(spark, sf).select((F.col("cell_id") % 12).cast("int").alias("worldcover_code"), F.lit("c").alias("class"), (0.01 * (F.col("cell_id") % 12)).alias("n_default"), F.lit(0.01).alias("n_min"), F.lit(0.2).alias("n_max"), F.lit("s").alias("source")), "n_default", "class"),
        "lake_area": (sc.select(F.col("acq_date").alias("date"), cloud.alias("area_m2"), F.lit("s2").alias("method"), cloud.alias("cloud_pct"), F.col("scene_id").cast("string").alias("scene_ids")), "area_m2", "cloud_pct"),
        "rainfall": (v.rain(spark, sf).select(F.col("d").alias("date"), F.col("mm").alias("precip_mm"), F.lit("r").alias("dataset"), none.cast("string").alias("aggregation")), "precip_mm", "aggregation"),
        "scenes": (sc.select(F.col("scene_id").cast("string"), "satellite", F.col("acq_date").alias("date"), cloud.alias("cloud_pct")), "cloud_pct", "cloud_pct"),
        "routed_discharge": (g.select(t, "q_m3s"), "q_m3s", "t_s"),
    }
    out = None
    for name, (df, number, optional) in tables.items():
        path = folder(spark)
        io.write_csv(df, path)
        row = io.read_csv(spark, path, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(number), 3).alias("total"), F.count_if(F.col(optional).isNull()).alias("n_null"))
        out = row if out is None else out.unionAll(row)
    return out


@query("SELECT kind, count(*) AS n, round(sum(area_m2), 3) AS area FROM buildings GROUP BY kind")
def s4_geojson_round_trip(spark, sf):
    b = v.buildings(spark, sf).select("kind", F.col("area_m2").cast("string").alias("area"), (88 + F.col("x_m") / 1e5).alias("lon"), (27 + F.col("y_m") / 1e5).alias("lat"))
    doc = io.feature_json(b, "kind", "area").select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("feature"), F.lit("]}")).alias("value"))
    path = folder(spark)
    doc.write.text(path)
    return io.features(spark, path, one_a_line=True).groupBy(F.col("properties")["kind"].alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("properties")["area"].cast("double")), 3).alias("area"))


@query("SELECT site_id, status, count(*) AS n, round(avg(wall_s), 4) AS mean_s, count(DISTINCT model) AS models FROM runs GROUP BY ALL")
def s5_registry(spark, sf):
    r = io.parsed_registry(v.runs(spark, sf))
    return rounded(r.groupBy("site_id", "status").agg(F.count("*").alias("n"), F.avg("wall_s").alias("mean_s"), F.countDistinct("model").alias("models")), "mean_s", digits=4)


@query("SELECT CASE WHEN osm_id % 2 = 0 THEN 'building' ELSE kind END AS kind, count(*) AS n, 5e0 AS points FROM buildings WHERE osm_id % 4 > 0 GROUP BY 1")
def s6_osm_elements(spark, sf):
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    b = v.buildings(spark, sf)
    x, y = F.col("x_m"), F.col("y_m")
    ring = F.array(point(x, y), point(x + 1, y), point(x + 1, y + 1), point(x, y + 1))
    short = F.slice(ring, 1, 2)
    e = b.select(F.lit("way").alias("type"), F.col("osm_id").alias("id"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.create_map(F.lit("building"), F.when(F.col("osm_id") % 2 == 0, "yes").otherwise(F.col("kind"))).alias("tags"), F.when(F.col("osm_id") % 4 == 0, short).otherwise(ring).alias("geometry"))
    return io.osm_rows(e, "building").groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.size("geometry")).alias("points"))


@query("SELECT osm_id, printf('<Placemark><name>%s</name><Point><coordinates>%.6f,%.6f</coordinates></Point></Placemark>', kind, x_m / 8, y_m / 8) AS kml FROM buildings")
def s7_placemarks(spark, sf):
    return io.placemarks(v.buildings(spark, sf).select("osm_id", "kind", (F.col("x_m") / 8).alias("lon"), (F.col("y_m") / 8).alias("lat")))


@query("SELECT url, CASE WHEN length(html) > 254 THEN substr(html, 1, 253) || '…' ELSE html END AS body FROM pages")
def s8_short_attributes(spark, sf):
    return v.load(spark, sf, "pages").select("url", loss.shorten(F.col("html")).alias("body"))


@query("SELECT job_id, count(CASE WHEN status = 'postprocessed' THEN 1 END) AS done, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(*) AS total, round(avg(CASE WHEN status = 'postprocessed' THEN wall_s END) * (count(*) - count(CASE WHEN status IN ('postprocessed', 'failed') THEN 1 END)), 4) AS eta_s FROM runs GROUP BY job_id")
def a26_progress(spark, sf):
    return rounded(checks.progress(io.parsed_registry(v.runs(spark, sf))), "eta_s", digits=4)


@query("SELECT site_id, string_agg(DISTINCT model, ',' ORDER BY model) AS models, bool_or(status = 'failed') AS any_failed FROM runs GROUP BY site_id")
def a25_merged_metadata(spark, sf):
    r = io.parsed_registry(v.runs(spark, sf))
    return r.groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.bool_or(F.col("status") == "failed").alias("any_failed"))


@query("SELECT site_id, CAST(floor(z / 2) AS INT) AS col, count(CASE WHEN z <= 92 THEN 1 END) AS n_low, round(coalesce(avg(CASE WHEN z <= 92 THEN 0.02e0 + cell_id % 5 * 0.01e0 END), 0.04e0), 6) AS n_manning FROM dem WHERE z IS NOT NULL GROUP BY ALL")
def a24_channel_width(spark, sf):
    low = F.col("z") <= 92
    d = v.dem(spark, sf).filter("z is not null")
    return d.groupBy("site_id", F.floor(F.col("z") / 2).cast("int").alias("col")).agg(F.count_if(low).alias("n_low"), F.round(F.coalesce(F.avg(F.when(low, 0.02 + F.col("cell_id") % 5 * 0.01)), F.lit(0.04)), 6).alias("n_manning"))


@query("SELECT cell_id, CASE WHEN d90 - d10 IS NULL THEN NULL WHEN d90 - d10 <= 0.5e0 OR (abs(d50) > 0 AND d90 - d10 <= 0.5e0 * abs(d50)) THEN 'NARROW' WHEN d90 - d10 <= 1 OR (abs(d50) > 0 AND d90 - d10 <= abs(d50)) THEN 'MEDIUM' ELSE 'WIDE' END AS spread, CASE WHEN cell_id % 3 = 0 OR cell_id % 5 = 0 THEN 'Low' WHEN cell_id % 3 = 2 AND cell_id % 5 >= 2 THEN 'High' ELSE 'Medium' END AS level FROM zones")
def m9_confidence(spark, sf):
    z = runs.exceedance(summary(spark, sf))
    c = F.col("cell_id")
    return z.select("cell_id", checks.spread(F.col("d90") - F.col("d10"), F.col("d50"), (0.5, 0.5), (1.0, 1.0)).alias("spread"), checks.combined(F.array(c % 3, F.least(c % 5, F.lit(2)))).alias("level"))


@query("SELECT scene_id, 'site' || site_id AS site, CAST(scene_id % 1000 AS INT) AS number, 'sfincs' AS model FROM scenes")
def m12_identifiers(spark, sf):
    s = v.scenes(spark, sf)
    run_id = F.concat(checks.scenario_id(F.concat(F.lit("site"), F.col("site_id").cast("string")), F.col("scene_id") % 1000), F.lit("__sfincs"))
    site, number, model = checks.parts_of(run_id)
    return s.select("scene_id", site.alias("site"), number.alias("number"), model.alias("model"))


@query("""WITH l AS (SELECT poi_id AS run_id, event_id AS n, CASE event_id % 4 WHEN 0 THEN event_id % 100 END AS e, CASE event_id % 4 WHEN 1 THEN event_id % 7 * 3600 + event_id % 60 * 60 + 5 END AS s, CASE WHEN event_id % 4 = 2 THEN 1 END AS r FROM gauges)
SELECT run_id, CAST(arg_max(e, n) FILTER (e IS NOT NULL) AS DOUBLE) AS error_pct, CAST(arg_max(s, n) FILTER (s IS NOT NULL) AS DOUBLE) AS elapsed_s, count(r) AS n_errors FROM l GROUP BY run_id""")
def m13_log_facts(spark, sf):
    k = F.col("event_id")
    line = F.when(k % 4 == 0, F.format_string("volume error = %d %%", k % 100)).when(k % 4 == 1, F.format_string("elapsed %d:%d:05", k % 7, k % 60)).when(k % 4 == 2, "ERROR step rejected").otherwise("ok")
    lines = v.gauges(spark, sf).select(F.col("poi_id").alias("run_id"), k.alias("n"), line.alias("line"))
    return doubles(checks.log_facts(lines), "elapsed_s")


@query("SELECT event_id, epoch_us(ts) - CAST(q_m3s AS BIGINT) * 500000 AS t0_us FROM gauges")
def m14_start_time(spark, sf):
    g = v.gauges(spark, sf)
    return g.select("event_id", F.unix_micros(checks.start_time(F.col("ts"), F.round("q_m3s").cast("long"))).alias("t0_us"))


@query("SELECT dam_id, CASE k WHEN 0 THEN 'below_range' ELSE 'above_range' END AS rule FROM (SELECT dam_id, unnest([CASE WHEN h_w < 10 THEN 0 END, CASE WHEN h_w > 25 THEN 1 END]) AS k FROM dams) WHERE k IS NOT NULL UNION ALL SELECT dam_id, 'null_without_placeholder' FROM dams WHERE dam_id % 9 = 10")
def m15_violations(spark, sf):
    d = v.dams(spark, sf).select(F.col("dam_id").alias("path"), F.col("h_w").alias("value"), F.lit("measured").alias("status"), F.lit(10.0).alias("low"), F.lit(25.0).alias("high"))
    return checks.violations(d).withColumnRenamed("path", "dam_id")


@query("SELECT scene_id, strftime(acq_date, '%Y') AS onset_year, 'lake' AS kind FROM scenes")
def m16_stamped_properties(spark, sf):
    s = v.scenes(spark, sf).select("scene_id", F.create_map(F.lit("date"), F.date_format("acq_date", "yyyy-MM-dd"), F.lit("kind"), F.lit("old")).alias("properties"))
    return checks.stamped(s, kind="lake").select("scene_id", F.col("properties")["onset_year"].alias("onset_year"), F.col("properties")["kind"].alias("kind"))


@query("SELECT r.run_id, replace(r.run_id, '__r', '__demo_r') AS demo_id, s.n_scenes FROM runs r JOIN (SELECT site_id, count(*) AS n_scenes FROM scenes WHERE satellite = 'sentinel-1' GROUP BY site_id) s USING (site_id) WHERE status = 'postprocessed'")
def j2_run_selection(spark, sf):
    r = v.runs(spark, sf).filter("status = 'postprocessed'")
    s = v.scenes(spark, sf).filter("satellite = 'sentinel-1'").groupBy("site_id").agg(F.count("*").alias("n_scenes"))
    return r.join(s, "site_id").select("run_id", F.regexp_replace("run_id", "__r", "__demo_r").alias("demo_id"), "n_scenes")


@query("SELECT d.site_id, d.col, round((d.col + 0.5e0) * 20, 3) AS chainage_m, round(z.a50, 6) AS arrival_s FROM dem d JOIN zones z ON z.cell_id = d.cell_id WHERE d.row = 10 AND z.a50 IS NOT NULL")
def w11_arrival_profile(spark, sf):
    d = v.dem(spark, sf).filter("row = 10")
    return rounded(d.join(runs.exceedance(summary(spark, sf)), "cell_id").filter("a50 is not null").select("site_id", "col", F.round((F.col("col") + 0.5) * 20, 3).alias("chainage_m"), F.col("a50").alias("arrival_s")), "arrival_s")


#: Files that one micro-batch of the streamed queries reads.
FILES = 4


def arriving(spark, df, batches=5, shuffled="0 seconds"):
    """Write ``df`` as a source of several micro-batches of FILES files each: in order of ts, but that each row comes
    up to ``shuffled`` later, by a hash of the row."""
    path, cols = folder(spark), df.columns
    second = F.col("ts").cast("timestamp").cast("double")
    delay = F.pmod(F.xxhash64(*cols), F.lit(1000)) / 1000 * F.expr(f"cast(interval {shuffled} as bigint)")
    lo, hi = df.agg(F.min(second), F.max(second)).first()
    part = F.floor((second + delay - (lo or 0)) / max((hi or 0) - (lo or 0), 1) * batches)
    marked = df.withColumn("part", F.least(part, F.lit(batches - 1)))
    for k in range(batches):
        marked.filter(F.col("part") == k).drop("part").repartition(FILES).write.mode("append").parquet(path)
    return path


def streamed(spark, df, build, mode="append", path=None):
    """Stream ``df`` from files (those in ``path``, if given) through ``build``, and read what the stream wrote."""
    out, state = folder(spark), folder(spark)
    if path is None:
        df.repartition(3 * FILES).write.parquet(path := folder(spark))
    result = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path))
    if mode == "append":
        q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        q = result.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


@query("SELECT run_id, face_id, max_depth, max_velocity, CAST(arrival_s AS DOUBLE) AS arrival_s FROM summary")
def t1_summary_stream(spark, sf):
    return doubles(streamed(spark, v.map_steps(spark, sf), streams.summary_stream, "complete"), "arrival_s")


@query("WITH g AS (SELECT poi_id, epoch(ts) AS t, q_m3s AS q, lag(epoch(ts)) OVER w AS t0, lag(q_m3s) OVER w AS q0 FROM gauges WHERE q_m3s IS NOT NULL WINDOW w AS (PARTITION BY poi_id ORDER BY ts, q_m3s)), f AS (SELECT poi_id, arg_min(CASE WHEN t0 IS NULL OR q = q0 THEN t ELSE t0 + (1200 - q0) / (q - q0) * (t - t0) END, {'t': t, 'q': q}) FILTER (q >= 1200) AS t_cross, min(t) FILTER (q >= 1200) AS t FROM g GROUP BY poi_id) SELECT poi_id, round(t_cross, 1) AS t_cross FROM f WHERE t <= (SELECT epoch_ms(max(ts)) - 3600000 FROM gauges) / 1000e0")
def t2_crossing_stream(spark, sf):
    """Crossings up to the last watermark; samples come up to half an hour late, in five micro-batches."""
    g = v.gauges(spark, sf).select("poi_id", "ts", "q_m3s")
    path = arriving(spark, g, shuffled="30 minutes")
    return streamed(spark, g, lambda s: streams.crossing_stream(s, 1200.0, "1 hour"), path=path).select("poi_id", F.round("t_cross", 1).alias("t_cross"))


GAUGE_RAIN = "r AS (SELECT CAST(poi_id % 20 AS BIGINT) AS site_id, date_trunc('day', ts) AS d, q_m3s AS mm FROM gauges), e AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM gauges)"


def gauge_rain(spark, sf):
    """Rain at the sites, and a source that brings it up to two days late."""
    g = v.gauges(spark, sf).select((F.col("poi_id") % 20).alias("site_id"), "ts", F.col("q_m3s").alias("mm"))
    return g, arriving(spark, g, shuffled="2 days")


@query(f"WITH {GAUGE_RAIN} SELECT site_id, strftime(d, '%Y-%m-%d') AS day, round(sum(mm), 4) AS mm FROM r, e WHERE d + INTERVAL 1 DAY <= mark GROUP BY ALL")
def t3_daily_rain_stream(spark, sf):
    """Days that the watermark has closed."""
    g, path = gauge_rain(spark, sf)
    return streamed(spark, g, streams.daily_rain_stream, path=path).select("site_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("mm", 4).alias("mm"))


@query(f"WITH {GAUGE_RAIN} SELECT site_id, strftime(s, '%Y-%m-%d') AS start, round(sum(mm), 3) AS mm FROM (SELECT site_id, mm, unnest(generate_series(d - INTERVAL 6 DAY, d, INTERVAL 1 DAY)) AS s FROM r), e WHERE s + INTERVAL 7 DAY <= mark GROUP BY ALL")
def t3_trailing_rain_stream(spark, sf):
    """Seven-day totals, sliding by a day, of the windows that the watermark has closed."""
    g, path = gauge_rain(spark, sf)
    out = streamed(spark, g, lambda s: streams.trailing_rain_stream(s, 7), path=path)
    return out.select("site_id", F.date_format("start", "yyyy-MM-dd").alias("start"), F.round("mm", 3).alias("mm"))


@query("SELECT site_id, month, arg_max(cloud, v) AS cloud, max(v) AS version FROM (SELECT site_id, strftime(acq_date, '%Y-%m') AS month, coalesce(cloud_pct, -1) AS cloud, scene_id AS v FROM scenes) GROUP BY site_id, month")
def t4_revisions(spark, sf):
    """Late revisions: batches come in any order of the versions; the newest of each key is read."""
    rows = v.scenes(spark, sf).select("site_id", F.date_format("acq_date", "yyyy-MM").alias("month"), F.coalesce("cloud_pct", F.lit(-1)).alias("cloud"), F.col("scene_id").alias("version"))
    path, base, state = folder(spark), folder(spark), folder(spark)
    rows.repartition(3 * FILES, "version").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    q = stream.writeStream.foreachBatch(streams.revisions(base)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return streams.current(spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(base), ["site_id", "month"])


@query("SELECT scene_id, site_id, satellite FROM scenes")
def t4_new_scenes_stream(spark, sf):
    """Scenes that two searches find, the second up to twenty days later."""
    s = v.scenes(spark, sf).select("scene_id", "site_id", "satellite", F.col("acq_date").cast("timestamp").alias("ts"))
    twice = s.withColumn("search", F.explode(F.array(F.lit(1), F.lit(2))))
    path = arriving(spark, twice, shuffled="20 days")
    return streamed(spark, twice, streams.new_scenes_stream, path=path).select("scene_id", "site_id", "satellite")


@query("SELECT p_partkey, round(p_retailprice * 60.6683e0 * 2.171e0, 4) AS value, p_size % 10 = 0 AS stale FROM part")
def m4_asset_values(spark, sf):
    p = v.load(spark, sf, "part")
    value = loss.asset_value(F.col("p_retailprice"), 60.6683, 2.171)
    kept = p.select("p_partkey", F.col("p_retailprice").alias("value_eur"), (value * F.when(F.col("p_size") % 10 == 0, 1.01).otherwise(1.0)).alias("value"))
    stale = loss.stale_values(kept, 60.6683, 2.171).select("p_partkey", F.lit(True).alias("stale"))
    return p.select("p_partkey", F.round(value, 4).alias("value")).join(stale, "p_partkey", "left").na.fill(False, ["stale"])


@query("WITH g AS (SELECT DISTINCT poi_id, epoch(ts) AS t_s, event_id % 10 AS k FROM gauges) SELECT poi_id, t_s, 'levels' AS only_in FROM (SELECT poi_id, t_s FROM g WHERE k < 8 EXCEPT ALL SELECT poi_id, t_s FROM g WHERE k > 1) UNION ALL SELECT poi_id, t_s, 'speeds' FROM (SELECT poi_id, t_s FROM g WHERE k > 1 EXCEPT ALL SELECT poi_id, t_s FROM g WHERE k < 8)")
def a4_axis_mismatch(spark, sf):
    g = v.gauges(spark, sf).select("poi_id", (F.unix_micros("ts") / 1e6).alias("t_s"), (F.col("event_id") % 10).alias("k")).distinct()
    return runs.axis_mismatch(g.filter("k < 8"), g.filter("k > 1"))


@query("""WITH w AS (SELECT run_id, face_id, max(depth_m) AS d FROM map_steps WHERE t_s BETWEEN 36000 AND 200000 GROUP BY ALL), p AS (SELECT face_id, a.d AS x, b.d AS y FROM (SELECT * FROM w WHERE run_id = 2) a JOIN (SELECT * FROM w WHERE run_id = 3) b USING (face_id)),
c AS (SELECT count(CASE WHEN x >= 0.3e0 AND y >= 0.3e0 THEN 1 END) AS tp, count(CASE WHEN coalesce(x, 0) < 0.3e0 AND y >= 0.3e0 THEN 1 END) AS fp, count(CASE WHEN x >= 0.3e0 AND coalesce(y, 0) < 0.3e0 THEN 1 END) AS fn, sqrt(avg(CASE WHEN coalesce(x, 0) > 0.03e0 OR coalesce(y, 0) > 0.03e0 THEN (y - x) * (y - x) END)) AS rmse FROM p)
SELECT tp, fp, fn, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1 END, 6) AS iou, round(rmse, 6) AS depth_rmse FROM c""")
def f15_solver_comparison(spark, sf):
    """Two solvers' maxima in a time window on their common cells; at or over the extent depth counts as wet."""
    s = runs.run_summary(v.map_steps(spark, sf).filter(F.col("t_s").between(36000, 200000)))
    a, b = s.filter("run_id = 2").select("face_id"), s.filter("run_id = 3").select("face_id")
    common = runs.pair_maps(s.join(a.intersect(b), "face_id", "left_semi"), 2, 3)
    return rounded(runs.extent_metrics(common, inclusive=True).select("tp", "fp", "fn", "iou").join(F.broadcast(runs.error_metrics(common).select("depth_rmse"))), "iou", "depth_rmse")


@query("WITH q AS (SELECT site_id, cell_id, col, greatest(CASE WHEN col <= 12 THEN 2.5e0 ELSE 1.5e0 END - abs(row - 10) * 0.3e0, 0) AS depth FROM dem WHERE z IS NOT NULL) SELECT site_id, cell_id, round(depth, 6) AS depth_m, CASE WHEN depth > 0.3e0 THEN 2 WHEN depth > 0 THEN 1 ELSE 0 END AS zone FROM q")
def m6_fallback_map(spark, sf):
    """Depth of a flood stage by column over the height above drainage, here 0.3 m a row from the channel."""
    d = v.dem(spark, sf).filter("z is not null")
    stage, hand = F.when(F.col("col") <= 12, 2.5).otherwise(1.5), F.abs(F.col("row") - 10) * 0.3
    depth = F.greatest(stage - hand, F.lit(0.0))
    return d.select("site_id", "cell_id", F.round(depth, 6).alias("depth_m"), F.when(depth > 0.3, 2).when(depth > 0, 1).otherwise(0).alias("zone"))
