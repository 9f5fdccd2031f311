"""Queries over breaches, hydrographs, series, lakes and rain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from floodspark.operators import breach, lake, series
from floodspark.plans.flood import doubles, rounded
from floodspark.plans.registry import SQL, query
from floodspark.sources import views as v

BREACH = """SELECT dam_id, 0.0175e0 * CASE failure_mode WHEN 'O' THEN 1.85e0 ELSE 1e0 END * CASE WHEN h_b <= 6.1e0 THEN 1e0 ELSE power(h_b / 6.1e0, 0.125e0) END * sqrt(9.81e0 * h_w * v_w * h_b * h_b / w_ave) AS qp_f16,
CASE dam_type WHEN 'HD' THEN sqrt(9.81e0) * power(h_w, -0.5e0) * v_w * power(power(v_w, 0.333e0) / h_w, -1.58e0) * power(h_w / h_b, -0.76e0) * power(h_d, 0.1e0) * exp(-4.55e0)
 WHEN 'CD' THEN sqrt(9.81e0) * power(h_w, -0.5e0) * v_w * power(power(v_w, 0.333e0) / h_w, -1.51e0) * power(h_w / h_b, -1.09e0) * power(h_d, -0.12e0) * exp(-3.61e0) END AS qp_z20,
0.0212e0 * power(v_w, 0.5429e0) * power(h_w, 0.8713e0) AS qp_h14,
0.1803e0 * CASE failure_mode WHEN 'O' THEN 1.4e0 ELSE 1e0 END * power(v_w, 0.32e0) * power(h_b, 0.19e0) AS width_f95, 0.27e0 * CASE failure_mode WHEN 'O' THEN 1.3e0 ELSE 1e0 END * power(v_w, 0.32e0) * power(h_b, 0.04e0) AS width_f8,
0.787e0 * h_b * power(h_d / 15e0, 0.133e0) * power(power(v_w, 1e0 / 3) / h_w, 0.652e0) * exp(CASE dam_type WHEN 'CD' THEN -0.041e0 WHEN 'FD' THEN 0.026e0 ELSE -0.226e0 END + CASE failure_mode WHEN 'O' THEN 0.149e0 ELSE -0.389e0 END + CASE erodibility WHEN 'H' THEN 0.291e0 WHEN 'M' THEN -0.140e0 ELSE -0.391e0 END) AS width_xz9,
3600 * 0.00254e0 * power(v_w, 0.53e0) * power(h_b, -0.9e0) AS time_f95, 63.2e0 * sqrt(v_w / (9.81e0 * h_b * h_b)) AS time_f8, 3600 * 0.0179e0 * power(0.0261e0 * power(v_w * h_w, 0.769e0), 0.364e0) AS time_mclm FROM dams"""
FUSED = f"fused AS (SELECT *, -0.8220e0 * width_f95 + 1.0021e0 * width_f8 + 1.1031e0 * width_xz9 AS width_fused, -1.0648e0 * time_f95 + 1.5875e0 * time_f8 + 0.6189e0 * time_mclm AS time_fused FROM ({BREACH}))"


@query(f"SELECT dam_id, round(qp_f16, 3) AS qp_f16, round(qp_z20, 3) AS qp_z20, round(qp_h14, 3) AS qp_h14, round(width_f95, 4) AS width_f95, round(width_f8, 4) AS width_f8, round(width_xz9, 4) AS width_xz9, round(time_f95, 3) AS time_f95, round(time_f8, 3) AS time_f8, round(time_mclm, 3) AS time_mclm FROM ({BREACH})")
def m1_breach_equations(spark, sf):
    b = breach.breach_parameters(v.dams(spark, sf))
    names = ["qp_f16", "qp_z20", "qp_h14", "width_f95", "width_f8", "width_xz9", "time_f95", "time_f8", "time_mclm"]
    return b.select("dam_id", *(F.round(n, 4 if n.startswith("width") else 3).alias(n) for n in names))


@query(f"""WITH {FUSED} SELECT dam_id, round(width_fused, 4) AS width_fused, round(time_fused, 3) AS time_fused, round(least(width_fused, width_xz9), 4) AS width_low, round(greatest(width_fused, width_xz9), 4) AS width_high, round(least(time_fused, time_f8), 3) AS time_low, round(greatest(time_fused, time_f8), 3) AS time_high,
concat_ws(',', 'qp_blocked', CASE WHEN width_fused <= 0 THEN 'width_nonpositive' END, CASE WHEN time_fused <= 0 THEN 'time_nonpositive' END) AS warnings FROM fused""")
def m2_fused_parameters(spark, sf):
    b = breach.breach_parameters(v.dams(spark, sf))
    return b.select("dam_id", *(F.round(n, 4 if n.startswith("width") else 3).alias(n) for n in ("width_fused", "time_fused", "width_low", "width_high", "time_low", "time_high")), "warnings")


@query(f"""WITH f AS MATERIALIZED ({SQL['m2_fused_parameters']}), x AS (SELECT d.dam_id, erodibility <> 'L' AS ok, unnest(['peak_discharge_m3s', 'breach_width_m', 'failure_time_s']) AS output, unnest([NULL, width_low, time_low]) AS l, unnest([NULL, width_high, time_high]) AS h,
unnest([CASE WHEN d.dam_id % 5 > 0 THEN h_w * 9 END, h_w, NULL]) AS il, unnest([CASE WHEN d.dam_id % 5 > 0 THEN h_w * 4 END, h_w * 2, NULL]) AS ih FROM dams d JOIN f ON f.dam_id = d.dam_id),
y AS (SELECT dam_id, output, ok, CASE WHEN ok THEN l ELSE il END AS a, CASE WHEN ok THEN h ELSE ih END AS b FROM x)
SELECT dam_id, output, round(CASE WHEN a + b IS NOT NULL THEN least(a, b) END, 4) AS low, round(CASE WHEN a + b IS NOT NULL THEN greatest(a, b) END, 4) AS high, CASE WHEN ok THEN 'method_range' ELSE 'imposed' END AS interval, CASE WHEN a + b IS NOT NULL THEN 'ok' ELSE 'blocked' END AS status FROM y""")
def m2_ranges(spark, sf):
    """Ranges of all dams: those that erode least take imposed ones, some of which are not given yet."""
    d, h, none = v.dams(spark, sf), F.col("h_w"), F.lit(None).cast("array<double>")
    given = lambda value: F.struct(value.alias("value"))
    imposed = F.struct(given(F.when(F.col("dam_id") % 5 > 0, F.array(h * 9, h * 4))).alias("peak_discharge_m3s"), given(F.array(h, h * 2)).alias("breach_width_m"), given(none).alias("failure_time_s"))
    rounded_ = [F.round(F.col(n), 4 if n.startswith("width") else 3).alias(n) for n in ("width_low", "width_high", "time_low", "time_high")]
    parameters = breach.breach_parameters(d).select("dam_id", *rounded_)
    out = breach.ranges(parameters, d.select("dam_id", (F.col("erodibility") != "L").alias("equations_applicable"), imposed.alias("imposed_ranges")))
    return out.withColumn("low", F.round("low", 4)).withColumn("high", F.round("high", 4))


@query("SELECT dam_id, round(v_w * power(0.4e0, 1.5e0), 3) AS volume, round(h_w * power(0.3e0, 1e0 / 1.5e0), 6) AS head FROM dams")
def m5_storage(spark, sf):
    d = v.dams(spark, sf)
    return d.select("dam_id", F.round(breach.storage_volume(F.col("v_w"), F.col("h_w"), F.col("h_w") * 0.4, 3.0), 3).alias("volume"), F.round(breach.storage_head(F.col("v_w"), F.col("h_w"), F.col("v_w") * 0.3, 3.0), 6).alias("head"))


@query("SELECT dam_id, round(CASE WHEN h_w - 12 <= 0 THEN 0e0 ELSE 1.7e0 * w_ave * power(h_w - 12, 1.5e0) + 1.35e0 * 0.5e0 * power(h_w - 12, 2.5e0) END, 6) AS q FROM dams")
def m7_weir(spark, sf):
    return v.dams(spark, sf).select("dam_id", F.round(breach.weir_discharge(F.col("w_ave"), F.lit(0.5), F.col("h_w") - 12, 1.7, 1.35), 6).alias("q"))


TRI = "t AS (SELECT dam_id AS series_id, 100e0 + dam_id % 50 AS q_p, 200000e0 + dam_id % 7 * 50000e0 AS v, 600e0 + dam_id % 5 * 900e0 AS t_f FROM dams), b AS (SELECT *, 2 * v / q_p AS t_b FROM t WHERE 2 * v / q_p > t_f)"
TRIANGLES = f"""{TRI}, p AS (SELECT DISTINCT series_id, q_p, t_f, t_b, unnest(list_concat(list_transform(generate_series(0, CAST(floor((300e0 + t_b) / 600) AS INT)), lambda k: k * 600e0), [300e0, 300e0 + t_f, 300e0 + t_b])) AS t_s FROM b),
h AS (SELECT series_id, t_s, CASE WHEN t_s <= 300 THEN 0e0 WHEN t_s <= 300 + t_f THEN q_p * (t_s - 300) / t_f ELSE q_p * (300 + t_b - t_s) / (t_b - t_f) END AS q_m3s FROM p)"""


def triangles(spark, sf):
    key = F.col("dam_id")
    p = v.dams(spark, sf).select(key.alias("series_id"), (100.0 + key % 50).alias("q_p"), (200000.0 + key % 7 * 50000.0).alias("v"), (600.0 + key % 5 * 900.0).alias("t_f"))
    return breach.triangular(p, 600.0, 300.0)


@query(f"WITH {TRIANGLES} SELECT series_id, count(*) AS n, round(max(q_m3s), 6) AS peak, round(max(t_s), 4) AS t_end, round(sum(q_m3s), 4) AS total FROM h GROUP BY series_id")
def w12_triangular(spark, sf):
    out = triangles(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.max("q_m3s").alias("peak"), F.max("t_s").alias("t_end"), F.sum("q_m3s").alias("total"))
    return rounded(rounded(out, "peak"), "t_end", "total", digits=4)


@query(f"WITH {TRI} SELECT series_id, round(v, 2) AS volume_m3, true AS increasing FROM b")
def w3_trapezoid_volume(spark, sf):
    return rounded(breach.trapezoid_volume(triangles(spark, sf)), "volume_m3", digits=2)


@query(f"""WITH {TRIANGLES}, l AS (SELECT *, lag(t_s) OVER w AS t0, lag(q_m3s) OVER w AS q0 FROM h WINDOW w AS (PARTITION BY series_id ORDER BY t_s, q_m3s))
SELECT series_id, round(arg_min(CASE WHEN t0 IS NULL OR q_m3s = q0 THEN t_s ELSE t0 + (60 - q0) / (q_m3s - q0) * (t_s - t0) END, t_s) FILTER (q_m3s >= 60), 6) AS t_cross FROM l GROUP BY series_id""")
def w1_first_crossing(spark, sf):
    return rounded(series.first_crossing(triangles(spark, sf), "series_id", 60.0), "t_cross")


@query(f"""WITH {TRIANGLES}, l AS (SELECT *, lag(t_s) OVER w AS t0, lag(q_m3s) OVER w AS q0 FROM h WINDOW w AS (PARTITION BY series_id ORDER BY t_s, q_m3s)),
x AS (SELECT series_id, arg_min(CASE WHEN t0 IS NULL OR q_m3s = q0 THEN t_s ELSE t0 + (60 - q0) / (q_m3s - q0) * (t_s - t0) END, t_s) FILTER (q_m3s >= 60) AS t FROM l GROUP BY series_id),
c AS (SELECT dam_id, CASE WHEN dam_id % 3 > 0 THEN dam_id - 1 END AS up FROM dams)
SELECT c.dam_id, round(CASE c.dam_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 120 + a.t ELSE 240 + a.t + b.t END, 6) AS t_trigger FROM c LEFT JOIN x a ON a.series_id = c.dam_id LEFT JOIN x b ON b.series_id = c.up""")
def w2_cascade(spark, sf):
    key = F.col("dam_id")
    d = v.dams(spark, sf).select("dam_id", F.when(key % 3 > 0, key - 1).alias("upstream_id"), F.lit(60.0).alias("threshold"), F.lit(120.0).alias("delay_s"))
    return rounded(series.cascade(d, triangles(spark, sf).withColumnRenamed("series_id", "dam_id"), 2), "t_trigger")


@query()
def w13_breach_growth(spark, sf):
    d = breach.breach_parameters(v.dams(spark, sf)).join(v.dams(spark, sf), "dam_id")
    s = d.select(F.col("dam_id").alias("series_id"), "v_w", "h_w", F.col("width_f8").alias("width"), "h_b", F.col("time_f8").alias("t_f"), F.lit(0.5).alias("z"), F.lit(3.0).alias("exponent"))
    return breach.grow_breach(s)


@query(f"WITH {TRIANGLES}, l AS (SELECT *, lag(t_s) OVER w AS t0, lag(q_m3s) OVER w AS q0, max(t_s) OVER (PARTITION BY series_id) AS e FROM h WINDOW w AS (PARTITION BY series_id ORDER BY t_s)), c AS (SELECT series_id, t_s - 450 AS t_s, q_m3s / 20 AS v FROM h JOIN (SELECT series_id, max(t_s) AS e FROM h GROUP BY ALL) USING (series_id) WHERE e >= 2000 AND t_s > 450 AND t_s < 2000 UNION ALL SELECT series_id, unnest([450e0, 2000e0]) - 450 AS t_s, NULL FROM (SELECT series_id, max(t_s) AS e FROM h GROUP BY ALL) WHERE e >= 2000) SELECT series_id, count(*) AS n, round(max(t_s), 6) AS t_end FROM c GROUP BY series_id")
def w15_clip_series(spark, sf):
    out = series.clip_series(triangles(spark, sf), "series_id", 450.0, 2000.0, 20.0)
    return out.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.max("t_s"), 6).alias("t_end"))


@query(f"WITH {TRIANGLES}, g AS (SELECT series_id, unnest(generate_series(0, CAST(floor(e / 1000) AS INT))) AS k FROM (SELECT series_id, max(t_s) AS e FROM h GROUP BY ALL)), n AS (SELECT g.series_id, k, arg_min(t_s, {{'d': abs(t_s - k * 1000e0), 't': t_s}}) AS t_s FROM g JOIN h ON g.series_id = h.series_id GROUP BY ALL) SELECT DISTINCT series_id, round(t_s, 6) AS t_s FROM n")
def w14_nearest_samples(spark, sf):
    return rounded(series.nearest_samples(triangles(spark, sf), "series_id", 1000.0), "t_s")


@query(f"WITH {BREACH.replace('SELECT dam_id,', 'b AS (SELECT dam_id, v_w,', 1)}), l AS (SELECT qp_h14 * 1.1e0 AS obs, 'f16' AS method, qp_f16 AS x FROM b UNION ALL SELECT qp_h14 * 1.1e0, 'z20', qp_z20 FROM b), p AS (SELECT method, (x - obs) / obs * 100 AS pe FROM l WHERE x IS NOT NULL), m AS (SELECT method, quantile_cont(pe, 0.5) AS med FROM p GROUP BY method) SELECT method, round(med, 6) AS median_pe, round(quantile_cont(abs(pe - med), 0.5), 6) AS mad, count(*) AS n FROM p JOIN m USING (method) GROUP BY method, med")
def a28_method_errors(spark, sf):
    b = breach.breach_parameters(v.dams(spark, sf)).withColumn("obs", F.col("qp_h14") * 1.1).select("obs", F.col("qp_f16").alias("f16"), F.col("qp_z20").alias("z20"))
    return rounded(breach.method_errors(b, ["f16", "z20"], "obs"), "median_pe", "mad")


@query("""WITH w AS (SELECT poi_id AS run_id, CASE event_id % 3 WHEN 0 THEN 'error' ELSE 'inflow' END || CASE WHEN event_id % 3 = 2 THEN '2' ELSE '' END AS quantity, event_id AS t, q_m3s - 500 AS value FROM gauges),
x AS (SELECT run_id, CASE quantity WHEN 'inflow2' THEN 'inflow' ELSE quantity END AS quantity, t, value FROM w), l AS (SELECT run_id, quantity, arg_max(value, t) AS value FROM x GROUP BY ALL),
s AS (SELECT run_id, sum(CASE WHEN quantity = 'inflow' THEN greatest(value, 0) END) AS i, max(CASE WHEN quantity = 'error' THEN value END) AS e FROM l GROUP BY run_id) SELECT run_id, round(CASE WHEN i > 0 THEN e / i * 100 END, 6) AS error_pct FROM s""")
def a27_mass_balance(spark, sf):
    g = v.gauges(spark, sf).select(F.col("poi_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("inflow").alias("quantity"), F.col("event_id").alias("t"), (F.col("q_m3s") - 500).alias("value"))
    return rounded(breach.mass_balance(g), "error_pct")


PATHS = "p AS (SELECT site_id AS path_id, cell_id AS step, col * 20e0 + row * 1e0 AS x_m, 400 - row * 20e0 AS y_m, row, col, coalesce(z, 90e0) AS bed_m FROM dem WHERE row = 10)"


def paths(spark, sf):
    d = v.dem(spark, sf).filter("row = 10")
    return d.select(F.col("site_id").alias("path_id"), F.col("cell_id").alias("step"), (F.col("col") * 20.0 + F.col("row")).alias("x_m"), (400 - F.col("row") * 20.0).alias("y_m"), "row", "col", F.coalesce("z", F.lit(90.0)).alias("bed_m"))


CHAIN = f"{PATHS}, c AS (SELECT *, sum(d) OVER (PARTITION BY path_id ORDER BY step) AS chainage_m FROM (SELECT *, coalesce(sqrt((x_m - lag(x_m) OVER w) * (x_m - lag(x_m) OVER w) + (y_m - lag(y_m) OVER w) * (y_m - lag(y_m) OVER w)), 0) AS d FROM p WINDOW w AS (PARTITION BY path_id ORDER BY step)))"


@query(f"WITH {CHAIN} SELECT path_id, step, round(chainage_m, 6) AS chainage_m FROM c")
def w4_chainage(spark, sf):
    return rounded(series.chainage(paths(spark, sf)), "chainage_m").select("path_id", "step", "chainage_m")


@query(f"WITH {CHAIN} SELECT path_id, CAST(floor(max(chainage_m) / 30) AS BIGINT) + 1 AS n, round(max(x_m), 6) AS last_x FROM c GROUP BY path_id")
def w4_resample_chainage(spark, sf):
    p = series.chainage(paths(spark, sf))
    out = series.resample_chainage(p, 30.0).groupBy("path_id").agg(F.count("*").alias("n"))
    return out.join(p.groupBy("path_id").agg(F.round(F.max("x_m"), 6).alias("last_x")), "path_id")


SLOPED = f"""{CHAIN}, s AS (SELECT path_id, step, chainage_m, bed_m, greatest(abs(CASE WHEN x0 IS NULL THEN (y1 - bed_m) / (x1 - chainage_m) WHEN x1 IS NULL THEN (bed_m - y0) / (chainage_m - x0) ELSE ((chainage_m - x0) * (chainage_m - x0) * y1 - (x1 - chainage_m) * (x1 - chainage_m) * y0 + ((x1 - chainage_m) * (x1 - chainage_m) - (chainage_m - x0) * (chainage_m - x0)) * bed_m) / ((chainage_m - x0) * (x1 - chainage_m) * (x1 - x0)) END), 1e-4) AS slope
FROM (SELECT *, lag(chainage_m) OVER w AS x0, lead(chainage_m) OVER w AS x1, lag(bed_m) OVER w AS y0, lead(bed_m) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY path_id ORDER BY chainage_m)))"""


@query(f"WITH {SLOPED} SELECT path_id, step, round(slope, 6) AS slope FROM s")
def w5_bed_slope(spark, sf):
    return rounded(series.bed_slope(series.chainage(paths(spark, sf))), "slope").select("path_id", "step", "slope")


MANNING = f"{SLOPED}, m AS (SELECT *, power(5e0 * 0.035e0 / sqrt(slope), 0.6e0) AS depth FROM s), q AS (SELECT *, 5e0 / depth AS velocity, greatest(5e0 / depth * (5e0 / 3), 0.1e0) AS celerity FROM m)"


def manning_path(spark, sf):
    p = series.bed_slope(series.chainage(paths(spark, sf)))
    depth, velocity, celerity = series.manning(F.lit(5.0), F.lit(0.035), F.col("slope"))
    return p.withColumn("depth", depth).withColumn("velocity", velocity).withColumn("celerity", celerity)


@query(f"WITH {MANNING} SELECT path_id, step, round(depth, 6) AS depth, round(velocity, 6) AS velocity, round(celerity, 6) AS celerity FROM q")
def m6_manning(spark, sf):
    return rounded(manning_path(spark, sf).select("path_id", "step", "depth", "velocity", "celerity"), "depth", "velocity", "celerity")


@query(f"WITH {MANNING} SELECT path_id, step, round(60 + sum(ds / celerity) OVER (PARTITION BY path_id ORDER BY chainage_m), 4) AS arrival_s FROM (SELECT *, coalesce(chainage_m - lag(chainage_m) OVER (PARTITION BY path_id ORDER BY chainage_m), chainage_m) AS ds FROM q)")
def w6_cumulative_arrival(spark, sf):
    return rounded(series.cumulative_arrival(manning_path(spark, sf), offset_s=60.0).select("path_id", "step", "arrival_s"), "arrival_s", digits=4)


@query("""WITH g AS (SELECT site_id, d, sum(mm) AS mm FROM rain GROUP BY ALL) SELECT a.site_id, strftime(a.d, '%Y-%m-%d') AS d, round(any_value(a.mm), 6) AS mm, round(sum(CASE WHEN b.d > a.d - INTERVAL 7 DAY THEN b.mm END), 6) AS mm_7d, round(sum(b.mm), 6) AS mm_30d FROM g a JOIN g b ON a.site_id = b.site_id AND b.d <= a.d AND b.d > a.d - INTERVAL 30 DAY GROUP BY a.site_id, a.d""")
def w8_trailing_totals(spark, sf):
    return rounded(series.trailing_totals(v.rain(spark, sf)), "mm", "mm_7d", "mm_30d")


@query("SELECT site_id, round(sum(CASE WHEN d > DATE '1997-06-01' - INTERVAL 7 DAY AND d <= DATE '1997-06-01' THEN mm END), 6) AS mm_7d, round(sum(CASE WHEN d > DATE '1997-06-01' - INTERVAL 30 DAY AND d <= DATE '1997-06-01' THEN mm END), 6) AS mm_30d FROM rain GROUP BY site_id")
def w8_totals_as_of(spark, sf):
    return rounded(series.totals_as_of(v.rain(spark, sf), "1997-06-01"), "mm_7d", "mm_30d")


@query("SELECT site_id, satellite, rank, scene_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id, satellite ORDER BY acq_date DESC, scene_id) AS INT) AS rank FROM scenes WHERE cloud_pct <= 30 OR satellite = 'sentinel-1') WHERE rank <= 5")
def k2_search_scenes(spark, sf):
    return lake.search_scenes(v.scenes(spark, sf), 30, 5).select("site_id", "satellite", "rank", "scene_id")


@query("SELECT site_id, strftime(acq_date, '%Y-%m') AS month, arg_min(scene_id, {'c': coalesce(cloud_pct, 100), 's': scene_id}) AS scene_id, min(coalesce(cloud_pct, 100)) AS cloud FROM scenes GROUP BY 1, 2")
def k2_clearest(spark, sf):
    return lake.clearest(v.scenes(spark, sf))


LAKES = "lk AS (SELECT site_id, acq_date AS d, max(CASE WHEN cloud_pct < 60 THEN 1000e0 + cloud_pct * 10 END) AS area_m2 FROM scenes GROUP BY ALL), lib AS (SELECT DISTINCT site_id, DATE '1998-01-01' + INTERVAL (90 * site_id) DAY AS trained_at FROM scenes)"


def lakes(spark, sf):
    s = v.scenes(spark, sf)
    area = F.max(F.when(F.col("cloud_pct") < 60, 1000.0 + F.col("cloud_pct") * 10))
    return s.groupBy("site_id", F.col("acq_date").alias("d")).agg(area.alias("area_m2")), s.select("site_id", F.date_add(F.lit("1998-01-01").cast("date"), (F.col("site_id") * 90).cast("int")).alias("trained_at")).distinct()


@query(f"WITH {LAKES} SELECT lib.site_id, arg_max(area_m2, d) FILTER (d <= trained_at AND area_m2 IS NOT NULL) AS reference_m2 FROM lib LEFT JOIN lk ON lk.site_id = lib.site_id GROUP BY lib.site_id")
def j3_reference_area(spark, sf):
    return lake.reference_area(*lakes(spark, sf))


@query(f"WITH {LAKES} SELECT site_id, arg_max(area_m2, d) AS latest_m2, strftime(max(d), '%Y-%m-%d') AS d FROM lk WHERE area_m2 IS NOT NULL GROUP BY site_id")
def k5_latest_valid(spark, sf):
    return lake.latest_valid(lakes(spark, sf)[0]).withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query(f"""WITH {LAKES}, a AS (SELECT lib.site_id, arg_max(area_m2, d) FILTER (d <= trained_at AND area_m2 IS NOT NULL) AS r, arg_max(area_m2, d) FILTER (area_m2 IS NOT NULL) AS l FROM lib LEFT JOIN lk ON lk.site_id = lib.site_id GROUP BY lib.site_id), c AS (SELECT *, 100 * (l - r) / r AS c FROM a)
SELECT site_id, round(c, 6) AS change_pct, coalesce(abs(c) >= 15, false) AS outdated, CASE WHEN l IS NULL THEN 'no_lake_area_data' WHEN r IS NULL THEN 'no_trained_library' WHEN abs(c) >= 15 THEN 'outdated_lake_area_change' ELSE 'within_threshold' END AS reason FROM c""")
def m11_recheck(spark, sf):
    series_, libs = lakes(spark, sf)
    areas = lake.reference_area(series_, libs).join(lake.latest_valid(series_), "site_id", "left")
    return rounded(lake.recheck(areas, 15.0), "change_pct")


PIXELS = "px AS (SELECT run_id AS site_id, run_id * 1000 + face_id % 9 AS scene_id, face_id AS cell_id, velocity_ms / 5e0 + CASE WHEN face_id % 3 = 0 THEN 1.2e0 ELSE 0e0 END AS index, CASE WHEN depth_m IS NULL THEN NULL ELSE CAST(t_s // 60 % 12 AS INT) END AS scl, CAST(t_s // 43200 AS INT) AS month FROM map_steps)"


def pixels(spark, sf):
    m = v.map_steps(spark, sf)
    day = F.floor(F.col("t_s") / 60)
    return m.select(F.col("run_id").alias("site_id"), (F.col("run_id") * 1000 + F.col("face_id") % 9).alias("scene_id"), F.col("face_id").alias("cell_id"), (F.col("velocity_ms") / 5 + F.when(F.col("face_id") % 3 == 0, 1.2).otherwise(0.0)).alias("index"), F.when(F.col("depth_m").isNotNull(), (day % 12).cast("int")).alias("scl"), F.floor(F.col("t_s") / 43200).cast("int").alias("month"))


@query(f"WITH {PIXELS} SELECT scene_id, round(coalesce(avg(CASE WHEN scl IN (3, 8, 9, 10) THEN 1e0 WHEN scl IS NOT NULL THEN 0e0 END), 1), 6) AS cloud, round(avg(CASE WHEN scl = 11 THEN 1e0 WHEN scl IS NOT NULL THEN 0e0 END), 6) AS ice, round(avg(CASE WHEN scl IS NULL THEN 0e0 ELSE 1e0 END), 6) AS valid FROM px GROUP BY scene_id")
def a19_cloud_fraction(spark, sf):
    return rounded(lake.cloud_fraction(pixels(spark, sf)), "cloud", "ice", "valid")


@query(f"WITH {PIXELS} SELECT month, cell_id, round(quantile_cont(index, 0.5), 6) AS vv, count(index) AS n FROM px GROUP BY ALL")
def a20_monthly_median(spark, sf):
    return rounded(lake.monthly_median(pixels(spark, sf).withColumnRenamed("index", "vv")), "vv")


@query("SELECT poi_id % 20 AS site_id, strftime(ts, '%Y-%m-%d') AS d, round(sum(r) * 0.5, 4) AS mm FROM (SELECT poi_id % 20 AS poi_id, ts, avg(q_m3s) AS r FROM gauges GROUP BY ALL) GROUP BY ALL")
def a21_daily_rainfall(spark, sf):
    out = lake.halfhourly_to_daily(v.gauges(spark, sf).select((F.col("poi_id") % 20).alias("site_id"), "ts", F.col("q_m3s").alias("rate")))
    return rounded(out.withColumn("d", F.date_format("d", "yyyy-MM-dd")), "mm", digits=4)


@query(f"""WITH {PIXELS}, e AS (SELECT site_id, min(index) AS lo, max(index) AS hi FROM px GROUP BY site_id), b AS (SELECT site_id, unnest(generate_series(0, 255)) AS bin, lo, hi FROM e WHERE hi > lo),
h AS (SELECT px.site_id, CAST(least(floor((index - lo) / ((hi - lo) / 256)), 255) AS INT) AS bin, count(*) AS n FROM px JOIN e ON e.site_id = px.site_id WHERE hi > lo GROUP BY ALL),
c AS (SELECT b.site_id, b.bin, lo + (b.bin + 0.5e0) * ((hi - lo) / 256) AS c, coalesce(n, 0) AS n FROM b LEFT JOIN h ON h.site_id = b.site_id AND h.bin = b.bin),
s AS (SELECT *, sum(n) OVER u AS w1, sum(n * c) OVER u AS s1, sum(n) OVER (PARTITION BY site_id) AS w, sum(n * c) OVER (PARTITION BY site_id) AS t FROM c WINDOW u AS (PARTITION BY site_id ORDER BY bin)),
v AS (SELECT site_id, bin, c, round(w1 * (w - w1) * power(s1 / greatest(w1, 1) - (t - s1) / greatest(w - w1, 1), 2), 6) AS between_ FROM s WHERE bin < 255),
m AS (SELECT site_id, list(c ORDER BY c) AS cs FROM v WHERE between_ = (SELECT max(between_) FROM v x WHERE x.site_id = v.site_id) GROUP BY site_id)
SELECT e.site_id, round(least(greatest(coalesce(cs[len(cs) // 2 + 1], 0.35e0), 0e0), 0.7e0), 6) AS threshold FROM e LEFT JOIN m ON m.site_id = e.site_id""")
def a22_otsu(spark, sf):
    return rounded(lake.otsu(pixels(spark, sf), "site_id", "index", 0.0, 0.7), "threshold")


@query(f"WITH {PIXELS} SELECT site_id, count(CASE WHEN index >= 0.8e0 AND scl <= 6 THEN 1 END) AS n_water FROM px GROUP BY site_id")
def p9_water_mask(spark, sf):
    p = pixels(spark, sf).withColumn("water", lake.water_mask(F.col("index"), 0.8, nir=F.col("scl"), nir_max=6))
    return p.groupBy("site_id").agg(F.count_if("water").alias("n_water"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity + l_tax * 100 <> 0 THEN (l_quantity - l_tax * 100) / (l_quantity + l_tax * 100) END, 6) + 0e0 AS ndwi FROM lineitem")
def p10_normalised_difference(spark, sf):
    t = v.load(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", (F.round(lake.normalised_difference(F.col("l_quantity"), F.col("l_tax") * 100), 6) + 0.0).alias("ndwi"))


@query("SELECT scene_id, CASE WHEN scene_id % 17 > 14 THEN 'skip' WHEN cloud_pct <= 40 THEN 's2_water_index' WHEN satellite = 'sentinel-1' THEN 's1_threshold' ELSE 'skip' END AS method, CASE WHEN scene_id % 17 > 14 THEN 'snow_ice' WHEN cloud_pct <= 40 OR satellite = 'sentinel-1' THEN NULL ELSE 'no_usable_scene' END AS reason FROM scenes")
def m10_choose_method(spark, sf):
    method, reason = lake.choose_method(F.col("scene_id") % 17, F.col("cloud_pct"), F.col("satellite") == "sentinel-1", F.lit(None).cast("double"), 14, 40, 50)
    return v.scenes(spark, sf).select("scene_id", method.alias("method"), reason.alias("reason"))


@query("WITH c AS (SELECT site_id, d, sum(mm) AS mm FROM rain GROUP BY ALL), f AS (SELECT site_id, d, -1e0 AS mm FROM c WHERE d >= DATE '1998-01-01') SELECT site_id, strftime(d, '%Y-%m-%d') AS d, round(mm, 6) AS mm FROM (SELECT * FROM c WHERE d < DATE '1998-01-01' UNION ALL SELECT * FROM f)")
def u1_upsert(spark, sf):
    daily = v.rain(spark, sf).groupBy("site_id", "d").agg(F.sum("mm").alias("mm"))
    fresh = daily.filter("d >= date'1998-01-01'").withColumn("mm", F.lit(-1.0))
    return rounded(lake.upsert(daily, fresh, ["site_id", "d"]).withColumn("d", F.date_format("d", "yyyy-MM-dd")), "mm")


@query("WITH h AS (SELECT DISTINCT site_id, strftime(acq_date, '%Y-%m') AS month FROM scenes WHERE cloud_pct < 20), w AS (SELECT DISTINCT site_id, strftime(m, '%Y-%m') AS month FROM (SELECT DISTINCT site_id FROM h), (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1998-06-01', INTERVAL 1 MONTH)) AS m)) SELECT w.* FROM w LEFT JOIN h ON h.site_id = w.site_id AND h.month = w.month WHERE h.month IS NULL OR w.month >= '1998-05'")
def u2_months_to_fetch(spark, sf):
    have = v.scenes(spark, sf).filter("cloud_pct < 20").select("site_id", F.date_format("acq_date", "yyyy-MM").alias("month")).distinct()
    return lake.months_to_fetch(have, "1996-01-01", "1998-06-01")


@query("SELECT scene_id, 'archive' AS source FROM scenes WHERE acq_date < DATE '1996-01-01' UNION ALL SELECT scene_id, 'live' FROM scenes WHERE acq_date >= DATE '1995-06-01'")
def u3_union_sources(spark, sf):
    s = v.scenes(spark, sf)
    old, new = s.filter("acq_date < date'1996-01-01'"), s.filter("acq_date >= date'1995-06-01'")
    return old.select("scene_id", F.lit("archive").alias("source")).unionByName(new.select("scene_id", F.lit("live").alias("source")))
