"""Queries of impact products, fallback maps, survey curves and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import checks, impact
from floodspark.operators import breach, fallback, grids, terrain
from floodspark.plans.flood import ZONE, doubles, rounded, summary, zoned
from floodspark.plans.registry import query
from floodspark.plans.terrain import MASK, mask
from floodspark.sources import views as v


def sql_class(value: str, edges: list[float]) -> str:
    """SQL of the number of edges that a value reaches."""
    return f"CASE WHEN {value} IS NOT NULL THEN " + " + ".join(f"CASE WHEN {value} >= {e!r}e0 THEN 1 ELSE 0 END" for e in edges) + " END"


@query(f"SELECT run_id, face_id, CAST({sql_class('(max_depth * max_velocity)', impact.HAZARD_M2S)} AS DOUBLE) AS hazard, CAST({sql_class('(arrival_s / 60e0)', impact.ARRIVAL_MIN)} AS DOUBLE) AS band, CAST(CASE WHEN arrival_s IS NOT NULL THEN greatest(arrival_s - 600, 0) END AS DOUBLE) AS lead_s FROM summary")
def p11_hazard_and_lead_time(spark, sf):
    s = summary(spark, sf)
    lead = F.when(F.col("arrival_s").isNotNull(), impact.lead_time(F.col("arrival_s")))
    out = s.select("run_id", "face_id", impact.hazard_class(F.col("max_depth"), F.col("max_velocity")).alias("hazard"), impact.arrival_band(F.col("arrival_s")).alias("band"), lead.alias("lead_s"))
    return doubles(out, "hazard", "band", "lead_s")


@query(f"""WITH q AS (SELECT {sql_class('(a50 / 60)', impact.ARRIVAL_MIN)} AS band, CASE WHEN d90 - d10 > 1 THEN greatest({ZONE} - 1, 0) ELSE {ZONE} END AS zone, cell_id % 11 * 7e0 AS pop FROM zones),
g AS (SELECT band, sum(CASE WHEN zone = 2 THEN pop ELSE 0 END) AS high, sum(CASE WHEN zone >= 1 THEN pop ELSE 0 END) AS hp FROM q GROUP BY band),
r AS (SELECT *, power(10e0, floor(log10(CASE WHEN hp > 0 THEN hp ELSE 1 END)) - 1) AS u FROM g)
SELECT CAST(band AS DOUBLE) AS band, high, hp AS high_or_possible, CASE WHEN hp < 50 THEN '< 50' ELSE CAST(CAST(floor(hp / u + 0.5e0) * u AS BIGINT) AS VARCHAR) END AS shown FROM r""")
def a16_people_by_band(spark, sf):
    """People by arrival band; where the depth percentiles are over 1 m apart, confidence is low."""
    z = zoned(spark, sf)
    low = F.coalesce(F.col("d90") - F.col("d10") > 1, F.lit(False))
    cells = z.select(impact.lowered(F.col("zone"), low).alias("zone"), impact.arrival_band(F.col("a50")).alias("band"), (F.col("cell_id") % 11 * 7.0).alias("population"))
    out = impact.people_by_band(cells)
    return doubles(out.withColumn("shown", impact.shown(F.col("high_or_possible"))), "band")


COLUMNS = """cl AS (SELECT site_id, cell_id, row, col, z IS NOT NULL AS d, z - min(z) OVER (PARTITION BY site_id, col) AS hand, 0.02e0 * (1 + cell_id % 4) AS n, min(z) OVER (PARTITION BY site_id, col) AS bed FROM dem),
ch AS (SELECT site_id, col, greatest(count(CASE WHEN d AND hand <= 2 THEN 1 END), 1) * 20e0 AS width_m, coalesce(avg(CASE WHEN d AND hand <= 2 THEN n END), avg(CASE WHEN d THEN n END)) AS n, max(bed) AS bed_m, (col + 0.5e0) * 20 AS x FROM cl GROUP BY site_id, col)"""
FLOW = f"""{COLUMNS}, g AS (SELECT *, lag(x) OVER w AS x0, lead(x) OVER w AS x1, lag(bed_m) OVER w AS y0, lead(bed_m) OVER w AS y1 FROM ch WINDOW w AS (PARTITION BY site_id ORDER BY x)),
sl AS (SELECT *, greatest(abs(CASE WHEN x0 IS NULL THEN (y1 - bed_m) / (x1 - x) WHEN x1 IS NULL THEN (bed_m - y0) / (x - x0) ELSE ((x - x0) * (x - x0) * y1 - (x1 - x) * (x1 - x) * y0 + ((x1 - x) * (x1 - x) - (x - x0) * (x - x0)) * bed_m) / ((x - x0) * (x1 - x) * (x1 - x0)) END), 1e-4) AS slope FROM g),
dp AS (SELECT *, power(500e0 / width_m * n / sqrt(slope), 0.6e0) AS depth_m FROM sl), ve AS (SELECT *, 500e0 / width_m / depth_m AS v FROM dp),
fl AS (SELECT *, sum((x - coalesce(x0, 0)) / greatest(v * 5 / 3, 0.1e0)) OVER (PARTITION BY site_id ORDER BY x) AS a FROM ve)"""


def columns(spark, sf):
    """Cells with their height over the lowest cell of their column, and the columns as stations."""
    d = v.dem(spark, sf)
    low = d.groupBy("site_id", "col").agg(F.min("z").alias("bed_m"))
    cells = d.join(low, ["site_id", "col"]).select("site_id", "cell_id", "col", (F.col("z") - F.col("bed_m")).alias("hand"), (0.02 * (1 + F.col("cell_id") % 4)).alias("n"), F.col("z").isNotNull().alias("in_domain"))
    return cells, low.select("site_id", "col", ((F.col("col") + 0.5) * 20).alias("chainage_m"), "bed_m")


def flow(spark, sf):
    cells, stations = columns(spark, sf)
    return cells, fallback.column_flow(fallback.channel_by_column(cells, 20.0), stations, 500.0)


@query(f"WITH {COLUMNS} SELECT site_id, col, width_m, round(n, 6) AS n FROM ch")
def a24_channel_by_column(spark, sf):
    return rounded(fallback.channel_by_column(columns(spark, sf)[0], 20.0), "n")


@query(f"WITH {FLOW} SELECT site_id, col, round(slope, 6) AS slope, round(depth_m, 5) AS depth_m, round(v, 5) AS velocity_ms, round(a, 3) AS arrival_s FROM fl")
def m6_column_flow(spark, sf):
    out = flow(spark, sf)[1].select("site_id", "col", "slope", "depth_m", "velocity_ms", "arrival_s")
    return rounded(rounded(rounded(out, "slope"), "depth_m", "velocity_ms", digits=5), "arrival_s", digits=3)


@query(f"""WITH {FLOW}, m AS (SELECT cl.site_id, cell_id, CASE WHEN d THEN greatest(fl.depth_m - hand, 0) ELSE 0 END AS depth, fl.v, fl.a FROM cl JOIN fl ON fl.site_id = cl.site_id AND fl.col = cl.col)
SELECT site_id, cell_id, round(depth, 5) AS depth_m, round(CASE WHEN depth > 0.1e0 THEN v ELSE 0 END, 5) AS velocity_ms, round(CASE WHEN depth > 0.1e0 THEN a END, 3) AS arrival_s, CASE WHEN depth > 0.3e0 THEN 2 ELSE 0 END AS zone FROM m""")
def m6_fallback_flood(spark, sf):
    out = fallback.fallback_map(*flow(spark, sf))
    return rounded(rounded(out, "depth_m", "velocity_ms", digits=5), "arrival_s", digits=3)


@query("""WITH s AS (SELECT dam_id, v_w, h_w, h_w * 0.25e0 AS invert FROM dams), c AS (SELECT *, v_w * 0.1e0 + (invert - h_w * 0.2e0) * (v_w * 0.3e0) / (h_w * 0.3e0) AS base FROM s)
SELECT dam_id, round(v_w * 0.4e0 - base, 3) AS volume, round(h_w * 0.5e0 - invert, 6) AS head, round(v_w - base, 3) AS full_volume FROM c""")
def m5_surveyed_curve(spark, sf):
    """Volume and head over a breach invert at a quarter of the height, on a surveyed curve of four points."""
    h, vol = F.col("h_w"), F.col("v_w")
    curve = F.array(*(F.struct((h * a).alias("x"), (vol * b).alias("y")) for a, b in ((0.0, 0.0), (0.2, 0.1), (0.5, 0.4), (1.0, 1.0))))
    d = v.dams(spark, sf).withColumn("curve", breach.above_invert(curve, h * 0.25))
    volume = breach.interpolated(F.col("curve"), h * 0.25)
    return d.select("dam_id", F.round(volume, 3).alias("volume"), F.round(breach.interpolated(F.col("curve"), volume, "y", "x"), 6).alias("head"), F.round(breach.interpolated(F.col("curve"), h * 9), 3).alias("full_volume"))


@query("SELECT dam_id, CASE WHEN dam_id % 5 = 0 THEN NULL ELSE w_ave BETWEEN h_w AND h_w * 2 END AS in_range FROM dams")
def m2_peak_in_range(spark, sf):
    low = F.when(F.col("dam_id") % 5 != 0, F.col("h_w"))
    return v.dams(spark, sf).select("dam_id", breach.peak_in_range(F.col("w_ave"), low, F.col("h_w") * 2).alias("in_range"))


@query("""WITH e AS (SELECT dam_id AS series_id, 5e0 + dam_id % 3 AS base, 100e0 + w_ave AS peak, 3000e0 + dam_id % 4 * 500 AS dur FROM dams),
t AS (SELECT DISTINCT series_id, base, peak, dur, unnest(list_concat(list_transform(generate_series(0, CAST(floor(dur / 400) AS INT)), lambda k: k * 400e0), [dur / 2, dur])) AS t FROM e)
SELECT series_id, count(*) AS n, round(max(q), 6) AS peak, round(sum(q), 4) AS total FROM (SELECT series_id, base + (peak - base) * (1 - abs(t - dur / 2) / (dur / 2)) AS q FROM t) GROUP BY series_id""")
def w12_symmetric_triangle(spark, sf):
    k = F.col("dam_id")
    e = v.dams(spark, sf).select(k.alias("series_id"), (5.0 + k % 3).alias("base"), (100.0 + F.col("w_ave")).alias("peak"), (3000.0 + k % 4 * 500).alias("duration_s"))
    out = breach.symmetric_triangle(e, 400.0).groupBy("series_id").agg(F.count("*").alias("n"), F.max("q_m3s").alias("peak"), F.sum("q_m3s").alias("total"))
    return rounded(rounded(out, "peak"), "total", digits=4)


@query("SELECT osm_id, round(x_m + area_m2 / 3, 5) AS cx, round(y_m + 1, 5) AS cy, round(area_m2 + sqrt(area_m2 * area_m2 + 9), 5) AS length FROM buildings")
def m8_centroid_and_length(spark, sf):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, a = F.col("x_m"), F.col("y_m"), F.col("area_m2")
    b = v.buildings(spark, sf).withColumn("ring", F.array(point(x, y), point(x + a, y), point(x, y + 3.0)))
    c = grids.polygon_centroid(F.col("ring"))
    return b.select("osm_id", F.round(c["x"], 5).alias("cx"), F.round(c["y"], 5).alias("cy"), F.round(grids.line_length(F.col("ring")), 5).alias("length"))


BODIES = f"{MASK}, rc AS (SELECT site_id, cell_id, row, col, cell_id AS c FROM mk UNION SELECT m.site_id, m.cell_id, m.row, m.col, r.c FROM rc r JOIN mk m ON m.site_id = r.site_id AND abs(m.row - r.row) <= 1 AND abs(m.col - r.col) <= 1 AND r.c < m.cell_id), lb AS (SELECT site_id, cell_id, row, col, min(c) AS component FROM rc GROUP BY ALL)"


def bodies(spark, sf):
    m = mask(spark, sf)
    return terrain.components(m).join(m, ["site_id", "cell_id"])


@query(f"WITH {BODIES} SELECT site_id, component, count(*) AS n_cells, count(*) * 400e0 AS area_m2 FROM lb WHERE (site_id, component) IN (SELECT (site_id, component) FROM lb WHERE row = 4) GROUP BY ALL")
def g7_channel_bodies(spark, sf):
    """Area of the water bodies that touch the channel, here the fifth row."""
    b = bodies(spark, sf)
    return terrain.component_areas(terrain.touching(b, b.filter("row = 4")), 20.0)


@query(f"WITH {BODIES}, p AS (SELECT DISTINCT site_id, col AS id, 2 AS row, col FROM dem), n AS (SELECT p.site_id, p.id, min({{'d': (l.row - p.row) * (l.row - p.row) + (l.col - p.col) * (l.col - p.col), 'c': component}}) AS b FROM p JOIN lb l ON l.site_id = p.site_id AND (l.row - p.row) * (l.row - p.row) + (l.col - p.col) * (l.col - p.col) <= 9 GROUP BY ALL) SELECT p.site_id, p.id, CAST(b.c AS DOUBLE) AS component, CAST(b.d AS DOUBLE) AS d2 FROM p LEFT JOIN n ON n.site_id = p.site_id AND n.id = p.id")
def g7_nearest_body(spark, sf):
    points = v.dem(spark, sf).select("site_id", F.col("col").alias("id"), F.lit(2).alias("row"), "col").distinct()
    return doubles(terrain.nearest_component(bodies(spark, sf), points, 3), "component", "d2")


@query("WITH r AS (SELECT CAST(o_custkey % 20 AS INT) AS site_id, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS created, o_orderstatus AS s FROM orders) SELECT site_id, arg_min(run_id, {'c': created, 'r': run_id}) AS run_id, count(*) AS n_active FROM r WHERE s = 'O' GROUP BY site_id")
def a26_oldest_active(spark, sf):
    o = v.load(spark, sf, "orders")
    r = o.select((F.col("o_custkey") % 20).cast("int").alias("site_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("created"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return checks.oldest_active(r)


@query("WITH s AS (SELECT site_id, min(acq_date) AS trained, max(CASE WHEN satellite = 'sentinel-1' AND scene_id % 50 = 0 THEN acq_date END) AS checked FROM scenes GROUP BY site_id), d AS (SELECT *, coalesce(checked, trained) + INTERVAL 30 DAY AS due FROM s) SELECT site_id, CAST(datediff('day', trained, DATE '1998-06-01') AS INT) AS age_days, strftime(due, '%Y-%m-%d') AS due, due <= DATE '1998-06-01' AS is_due FROM d")
def m11_library_age(spark, sf):
    s = v.scenes(spark, sf).groupBy("site_id").agg(F.min("acq_date").alias("trained"), F.max(F.when((F.col("satellite") == "sentinel-1") & (F.col("scene_id") % 50 == 0), F.col("acq_date"))).alias("checked"))
    return checks.library_age(s, "1998-06-01", 30).withColumn("due", F.date_format("due", "yyyy-MM-dd"))


@query("WITH z AS (SELECT row, col, avg(z) AS z FROM dem GROUP BY ALL) SELECT round(sum(z), 4) AS source, round(sum(z), 4) AS resampled FROM z")
def a18_sum_preservation(spark, sf):
    """Totals before and after resampling that keeps sums."""
    z = v.dem(spark, sf).groupBy("row", "col").agg(F.avg("z").alias("z"))
    after = grids.resample(z, "z", 20.0, 24.0, "sum").agg(F.round(F.sum("z"), 4).alias("resampled"))
    return z.agg(F.round(F.sum("z"), 4).alias("source")).join(F.broadcast(after))  # one row each


@query(f"SELECT run_id, frame, count(*) AS n_cells FROM (SELECT run_id, unnest(generate_series(CAST(ceil(arrival_s / 7200e0) AS INT), 20)) AS frame FROM summary WHERE arrival_s <= 144000) GROUP BY ALL")
def w9_lit_cells(spark, sf):
    """Cells lit in each frame of each run: every cell is put in its first frame, then counted up over frames."""
    from pyspark.sql import Window

    first = summary(spark, sf).filter("arrival_s <= 144000").groupBy("run_id", F.ceil(F.col("arrival_s") / 7200).cast("int").alias("frame")).agg(F.count("*").alias("n"))
    every = first.groupBy("run_id").agg(F.min("frame").alias("least")).select("run_id", F.explode(F.sequence("least", F.lit(20))).alias("frame"))
    w = Window.partitionBy("run_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)  # a row a frame
    return every.join(first, ["run_id", "frame"], "left").select("run_id", "frame", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n_cells"))
