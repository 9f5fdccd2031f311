"""Queries over the surrogate of solver runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from floodspark.operators import emulator as e
from floodspark.operators import surrogate as s
from floodspark.plans.flood import rounded, summary
from floodspark.plans.registry import query
from floodspark.sources import views as v

NAMES = ["a", "b"]
#: Runs of the map stack: the positions of a vector, folded. Its cells are the vectors, so they grow with the table.
RUNS = 16
STACK = f"st AS (SELECT CAST(cell_id % {RUNS} AS INT) AS run_id, run_id AS cell_id, sum(CASE WHEN isfinite(value) THEN value ELSE 0e0 END) AS x FROM vectors GROUP BY ALL)"
MAPS = f"{STACK}, mz AS (SELECT run_id, cell_id, ln(1 + greatest(x, 0) * 4) AS y FROM st)"
DESIGN = "dz AS (SELECT run_id, avg(velocity_ms) AS a, avg(coalesce(depth_m, 0)) AS b, count(*) * 1e0 AS c FROM (SELECT CAST(l_orderkey % 16 AS INT) AS run_id, m.velocity_ms, m.depth_m FROM (SELECT l_orderkey, l_discount * 50e0 AS velocity_ms, CASE WHEN l_linenumber = 7 THEN NULL ELSE greatest(l_quantity - 30 - 0.8e0 * (l_partkey % 25), 0e0) / 10e0 END AS depth_m FROM lineitem) m) GROUP BY run_id)"


def maps(spark, sf):
    """log1p depths of each run and cell (one vector is one cell)."""
    x = v.vectors(spark, sf).select((F.col("cell_id") % RUNS).cast("int").alias("run_id"), F.col("run_id").alias("cell_id"), F.when(F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("x"))
    x = x.groupBy("run_id", "cell_id").agg(F.sum("x").alias("x"))
    return x.select("run_id", "cell_id", F.log1p(F.greatest("x", F.lit(0.0)) * 4).alias("y"))


def raw_design(spark, sf):
    t = v.load(spark, sf, "lineitem")
    depth = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.greatest(F.col("l_quantity") - 30 - F.lit(0.8) * (F.col("l_partkey") % v.WIDTH), F.lit(0.0)) / 10)
    t = t.select((F.col("l_orderkey") % RUNS).cast("int").alias("run_id"), (F.col("l_discount") * 50).alias("velocity_ms"), depth.alias("depth_m"))
    return t.groupBy("run_id").agg(F.avg("velocity_ms").alias("a"), F.avg("depth_m").alias("b"), F.count("*").cast("double").alias("c"))


def design(spark, sf):
    d = raw_design(spark, sf).select("run_id", *NAMES)
    return s.scaled(d, s.scaler(d, set(), NAMES), set())


def asked(spark, sf, by=0.9):
    return design(spark, sf).select(F.col("run_id").cast("long").alias("query_id"), *((F.col(n) * by).alias(n) for n in NAMES))


@query(f"WITH {DESIGN} SELECT run_id, round((log10(c) - (SELECT avg(log10(c)) FROM dz)) / (SELECT stddev_pop(log10(c)) FROM dz), 5) AS c, round((a - (SELECT avg(a) FROM dz)) / (SELECT stddev_pop(a) FROM dz), 5) AS a, a >= (SELECT quantile_cont(a, 0.25) FROM dz) AND a <= (SELECT quantile_cont(a, 0.75) FROM dz) AND c >= (SELECT min(c) FROM dz) AND c <= (SELECT max(c) FROM dz) AS inside FROM dz")
def p14_input_scaler(spark, sf):
    """Scaled inputs, and whether the raw ones are in a box: the middle half of one, all of the other."""
    d = raw_design(spark, sf).select("run_id", "a", "c")
    low, high = d.agg(F.percentile("a", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    boxed = d.withColumn("inside", s.inside_box({"a": (low, high), **s.box_of(d, ["c"])}))
    return rounded(s.scaled(boxed, s.scaler(d, {"c"}, ["a", "c"]), {"c"}), "a", "c", digits=5)


@query(f"WITH {MAPS} SELECT run_id, count(*) AS n, round(sum(y), 6) AS total FROM mz GROUP BY run_id")
def f2_training_matrix(spark, sf):
    return rounded(maps(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("y").alias("total")), "total")


@query(f"WITH {MAPS}, c AS (SELECT run_id, cell_id, y - avg(y) OVER (PARTITION BY cell_id) AS y FROM mz) SELECT a.run_id AS i, b.run_id AS j, round(sum(a.y * b.y), 5) + 0e0 AS g FROM c a JOIN c b ON a.cell_id = b.cell_id AND a.run_id <= b.run_id GROUP BY ALL")
def f3_gram(spark, sf):
    m = maps(spark, sf)
    return s.gram_rows(s.wide(m, list(range(RUNS))), RUNS).select("i", "j", (F.round("g", 5) + 0.0).alias("g"))


@query()
def f3_reconstruction(spark, sf):
    m = maps(spark, sf)
    basis = s.Basis(m, 0.9)
    back = basis.decode(basis.encode(m))
    return m.join(back.withColumnRenamed("y", "back"), ["run_id", "cell_id"]).groupBy("run_id").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("back"), 2))).alias("rmse"))


@query()
def f4_gaussian_process(spark, sf):
    return s.gp_scores(s.Basis(maps(spark, sf)), design(spark, sf), asked(spark, sf), NAMES)


@query()
def f5_linear_scores(spark, sf):
    return s.linear_scores(s.Basis(maps(spark, sf)), design(spark, sf), asked(spark, sf), NAMES)


def decoded(spark, sf):
    basis = s.Basis(maps(spark, sf))
    return basis.decode(s.gp_scores(basis, design(spark, sf), asked(spark, sf), NAMES), "query_id", "sd")


@query()
def f6_predicted_maps(spark, sf):
    return s.predicted_maps(decoded(spark, sf))


@query()
def f7_scenario_query(spark, sf):
    return s.inundation(decoded(spark, sf))


U = "CAST(('0x' || substr(md5('{0}|' || CAST(sample_id AS VARCHAR) || '|{1}'), 1, 8)) AS BIGINT) / 4294967296e0"


@query(f"WITH {DESIGN}, i AS (SELECT unnest(generate_series(0, 1999)) AS sample_id) SELECT sample_id, round((SELECT min(a) FROM dz) + {U.format(0, 'a')} * ((SELECT max(a) FROM dz) - (SELECT min(a) FROM dz)), 6) AS a, round(power(10e0, log10((SELECT min(c) FROM dz)) + {U.format(0, 'c')} * (log10((SELECT max(c) FROM dz)) - log10((SELECT min(c) FROM dz)))), 4) AS c FROM i")
def f8_sample_inputs(spark, sf):
    r = raw_design(spark, sf).agg(*(f(n).alias(f"{k}{n}") for n in ("a", "c") for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = s.sample_inputs(spark, {"a": (r.loa, r.hia), "c": (r.loc, r.hic)}, 2000, {"c"})
    return out.select("sample_id", F.round("a", 6).alias("a"), F.round("c", 4).alias("c"))


def sampled(spark, sf, n=2000):
    """The basis and the scores of ``n`` samples in the box of the design."""
    basis, d = s.Basis(maps(spark, sf)), design(spark, sf)
    r = d.agg(*(f(n).alias(f"{k}{n}") for n in NAMES for k, f in (("lo", F.min), ("hi", F.max)))).first()
    q = s.sample_inputs(spark, {n: (r[f"lo{n}"], r[f"hi{n}"]) for n in NAMES}, n, set()).withColumnRenamed("sample_id", "query_id")
    return basis, s.gp_scores(basis, d, q, NAMES)


@query()
def f9_monte_carlo(spark, sf):
    return s.monte_carlo(*sampled(spark, sf))


@query()
def f10_upper_bound(spark, sf):
    basis = s.Basis(maps(spark, sf))
    d = design(spark, sf)
    r = d.agg(*(f(n).alias(f"{k}{n}") for n in NAMES for k, f in (("lo", F.min), ("hi", F.max)))).first()
    corners = spark.createDataFrame([(i * 2 + j, float(r[("loa", "hia")[i]]), float(r[("lob", "hib")[j]])) for i in (0, 1) for j in (0, 1)], "query_id long, a double, b double")
    return s.upper_bound(basis, s.gp_scores(basis, d, corners, NAMES))


@query()
def f11_leave_one_out(spark, sf):
    return s.leave_one_out(maps(spark, sf), design(spark, sf), NAMES)


@query()
def f9_sample_summaries(spark, sf):
    """Deepest cell and inundated area of each of the samples."""
    basis, scores = sampled(spark, sf)
    return s.sample_summaries(basis, scores, 20.0)


@query()
def f12_input_sensitivity(spark, sf):
    """Shares of the inputs by the lengths that the processes learned."""
    return s.sensitivity(s.gp_lengths(s.Basis(maps(spark, sf)), design(spark, sf), NAMES))


@query("WITH l AS (SELECT face_id % 3 AS input, 1e0 / (1 + face_id % 5) AS evr, 0.5e0 + face_id % 4 AS len FROM summary), x AS (SELECT input, sum(evr / len) AS s FROM l GROUP BY input) SELECT input, round(s / sum(s) OVER (), 6) AS share FROM x")
def f12_sensitivity(spark, sf):
    f = F.col("face_id")
    return rounded(s.sensitivity(summary(spark, sf).select((f % 3).alias("input"), (1 / (1 + f % 5)).alias("evr"), (0.5 + f % 4).alias("length"))), "share")


@query("SELECT round(avg(CASE WHEN depth_b IS NULL OR depth_a IS NULL THEN NULL WHEN depth_b >= depth_a THEN 1e0 ELSE 0e0 END), 6) AS share, count(*) AS n FROM pairs")
def f13_monotone(spark, sf):
    from floodspark.operators.runs import pair_maps

    return rounded(s.monotone(pair_maps(summary(spark, sf), 0, 1), "depth_a", "depth_b"), "share")


@query("""WITH sc AS (SELECT dam_id * 2 + j AS run_id, dam_id AS pair_id, j = 1 AS raised, power(10e0, 5 + dam_id % 4) * CASE WHEN j = 1 THEN 1 + dam_id % 5 ELSE 1 END AS volume, 20e0 + dam_id % 130 AS breach_m, 300e0 + dam_id % 100 * 100 AS time_s FROM dams, (SELECT unnest([0, 1]) AS j)),
al AS (SELECT run_id, pair_id, raised, time_s, c AS col, 20 + 0.05e0 * (c + 0.5e0) * 200 AS half, 2000 * power(volume / 1e7, 0.55e0) * power(breach_m / 50, 0.25e0) * power(1800 / time_s, 0.35e0) AS q0 FROM sc, (SELECT unnest(generate_series(0, 49)) AS c)),
qs AS (SELECT *, 0.9e0 * sqrt(q0 * exp(-sum(half * 200 * 1e-6) OVER (PARTITION BY run_id ORDER BY col)) / (2 * half)) AS m FROM al), tr AS (SELECT *, sum(200 / greatest(1.5e0 * power(m, 2e0 / 3) * sqrt(0.01e0) / 0.04e0, 0.1e0)) OVER (PARTITION BY run_id ORDER BY col) + 0.05e0 * time_s AS travel FROM qs),
mp AS (SELECT pair_id, raised, r AS row, col, m * least(greatest((half * 1.6e0 - abs(r - 3.5e0) * 200) / (half * 0.6e0), 0), 1) AS d, travel + 2 * abs(r - 3.5e0) * 200 AS t FROM tr, (SELECT unnest(generate_series(0, 7)) AS r)),
wt AS (SELECT pair_id, count(CASE WHEN raised AND d > 0.3e0 THEN 1 END) >= count(CASE WHEN NOT raised AND d > 0.3e0 THEN 1 END) AS e FROM mp GROUP BY pair_id),
pt AS (SELECT a.pair_id, bool_and(b.d >= a.d - 1e-9) AS d, bool_and(NOT (a.d > 0.1e0 AND b.d > 0.1e0) OR b.t <= a.t + 1e-6) AS t FROM mp a JOIN mp b ON a.pair_id = b.pair_id AND a.row = b.row AND a.col = b.col AND NOT a.raised AND b.raised WHERE a.row = 3 AND a.col % 7 = 0 GROUP BY a.pair_id)
SELECT count(*) AS n, avg(e::INT) AS extent, avg(d::INT) AS depth, avg(t::INT) AS arrival, CASE WHEN least(avg(e::INT), avg(d::INT), avg(t::INT)) >= 0.95e0 THEN 'PASS' ELSE 'FAIL' END AS status FROM wt JOIN pt USING (pair_id)""")
def f13_paired_queries(spark, sf):
    """Each dam's breach with its volume and with a larger one, all else equal: extent and depth must not fall nor arrival be later."""
    k = F.col("dam_id")
    sc = v.dams(spark, sf).select(k.alias("pair_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"), F.pow(F.lit(10.0), 5 + k % 4).alias("v1"), (1 + k % 5).alias("more"), (20.0 + k % 130).alias("breach_m"), (300.0 + k % 100 * 100.0).alias("time_s"))
    sc = sc.select((F.col("pair_id") * 2 + F.col("j")).alias("run_id"), F.when(F.col("j") == 1, F.col("v1") * F.col("more")).otherwise(F.col("v1")).alias("volume"), "breach_m", "time_s")
    maps = s.valley(sc, 50, 8, 200.0).withColumn("pair_id", F.floor(F.col("run_id") / 2)).withColumn("raised", F.col("run_id") % 2 == 1)
    return s.monotone_pairs(maps, spark.range(0, 50, 7).select(F.lit(3).alias("row"), F.col("id").cast("int").alias("col")))


@query()
def f14_valley(spark, sf):
    key = F.col("dam_id")
    sc = v.dams(spark, sf).select(key.alias("run_id"), F.pow(F.lit(10.0), 5 + key % 4).alias("volume"), (20.0 + key % 130).alias("breach_m"), (300.0 + key % 100 * 100.0).alias("time_s"))
    return s.valley(sc, 50, 8, 200.0).groupBy("run_id").agg(F.max("depth_m").alias("max_depth"), F.count("arrival_s").alias("n_wet"), F.max("arrival_s").alias("t_end"))


@query(f"""WITH {DESIGN}, z AS (SELECT run_id, (a - (SELECT avg(a) FROM dz)) / (SELECT stddev_pop(a) FROM dz) AS a, (b - (SELECT avg(b) FROM dz)) / (SELECT stddev_pop(b) FROM dz) AS b FROM dz), d AS (SELECT q.run_id AS q, t.run_id, sqrt(power(q.a * 1.2e0 - t.a, 2) + power(q.b * 1.2e0 - t.b, 2)) AS dist, q.a * 1.2e0 BETWEEN (SELECT min(a) FROM z) AND (SELECT max(a) FROM z) AND q.b * 1.2e0 BETWEEN (SELECT min(b) FROM z) AND (SELECT max(b) FROM z) AS inside FROM z q, z t),
n AS (SELECT min(sqrt(power(q.a - t.a, 2) + power(q.b - t.b, 2))) AS d FROM z q JOIN z t ON q.run_id <> t.run_id GROUP BY q.run_id), r AS (SELECT q AS query_id, min(dist) / (SELECT quantile_cont(d, 0.5) FROM n) AS r, min(inside) AS inside FROM d GROUP BY q) SELECT CAST(query_id AS BIGINT) AS query_id, round(r, 6) AS r, CASE WHEN NOT inside THEN 'OUTSIDE' WHEN r <= 1 THEN 'INSIDE' WHEN r <= 2 THEN 'EDGE' ELSE 'OUTSIDE' END AS label FROM r""")
def j12_coverage(spark, sf):
    return rounded(s.coverage(asked(spark, sf, 1.2), design(spark, sf), NAMES), "r")


@query(f"""WITH {DESIGN}, {MAPS}, z AS (SELECT run_id, (a - (SELECT avg(a) FROM dz)) / (SELECT stddev_pop(a) FROM dz) AS a, (b - (SELECT avg(b) FROM dz)) / (SELECT stddev_pop(b) FROM dz) AS b FROM dz), d AS (SELECT q.run_id AS q, t.run_id, sqrt(power(q.a * 0.9e0 - t.a, 2) + power(q.b * 0.9e0 - t.b, 2)) AS dist FROM z q, z t),
k AS (SELECT q, run_id, 1 / (dist * dist) AS w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, run_id) AS rank FROM d) WHERE rank <= 3) SELECT CAST(q AS BIGINT) AS query_id, cell_id, round(sum(w * y) / sum(w), 5) AS y FROM k JOIN mz ON mz.run_id = k.run_id GROUP BY q, cell_id""")
def k3_nearest_blend(spark, sf):
    return rounded(s.nearest_blend(asked(spark, sf), design(spark, sf), maps(spark, sf), NAMES, 3), "y", digits=5)


@query()
def f1_latin_hypercube(spark, sf):
    """Design over the 20 % widened ranges of the runs' inputs."""
    r = raw_design(spark, sf).agg(*(f(n).alias(f"{k}{n}") for n in ("a", "c") for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = s.latin_hypercube(spark, 30, ["a", "c"])
    lo, hi = r.loa * 0.8, r.hia * 1.2
    clo, chi = math.log10(r.loc * 0.8), math.log10(r.hic * 1.2)
    return out.select("point", (lo + F.col("a") * (hi - lo)).alias("a"), F.pow(F.lit(10.0), clo + F.col("c") * (chi - clo)).alias("c"))


T_END = 86400.0
#: Depth, velocity and arrival of eight runs over the grid, and the inputs of the runs.
THREE = "m3 AS (SELECT run_id, CAST(face_id AS BIGINT) AS cell_id, greatest(coalesce(max_depth, 0), 0) AS d, greatest(coalesce(max_velocity, 0), 0) AS v, CASE WHEN arrival_s IS NULL THEN 86400e0 ELSE least(greatest(arrival_s, 0), 86400) * 1e0 END AS t, arrival_s FROM summary)"
NEAR = "st AS (SELECT unnest([0, 1, -1, 0, 0]) AS a, unnest([0, 0, 0, 1, -1]) AS b)"
INPUTS = "ri AS (SELECT run_id, avg(velocity_ms) AS a, avg(coalesce(depth_m, 0)) AS b FROM map_steps GROUP BY run_id), ru AS (SELECT run_id, (a - (SELECT avg(a) FROM ri)) / (SELECT stddev_pop(a) FROM ri) AS a, (b - (SELECT avg(b) FROM ri)) / (SELECT stddev_pop(b) FROM ri) AS b FROM ri)"
#: Wet limit of the corridor: high, as nearly every cell is wet in every run.
WET = 1.6


def three_maps(spark, sf):
    return summary(spark, sf).select("run_id", F.col("face_id").alias("cell_id"), F.col("max_depth").alias("depth_m"), F.col("max_velocity").alias("velocity_ms"), "arrival_s")


def run_inputs(spark, sf):
    d = v.map_steps(spark, sf).groupBy("run_id").agg(F.avg("velocity_ms").alias("a"), F.avg(F.coalesce("depth_m", F.lit(0.0))).alias("b"))
    return s.scaled(d, s.scaler(d, set(), NAMES), set())


def emulator(spark, sf, fit=True):
    m = e.Emulator(three_maps(spark, sf), v.WIDTH, v.HEIGHT, T_END, wet_m=WET, buffer=1)
    if fit:
        m.fit(run_inputs(spark, sf), NAMES)
    return m


def scenarios(spark, sf):
    return run_inputs(spark, sf).select(F.col("run_id").cast("long").alias("query_id"), *((F.col(n) * 0.9).alias(n) for n in NAMES))


CORRIDOR = f"""wt AS (SELECT cell_id, min(run_id) AS lo, max(run_id) AS hi FROM m3 WHERE d > {WET}e0 GROUP BY cell_id), {NEAR},
co AS (SELECT CAST(r * 25 + c AS BIGINT) AS cell_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT cell_id // 25 + a AS r, cell_id % 25 + b AS c, lo, hi FROM wt, st) WHERE r BETWEEN 0 AND 19 AND c BETWEEN 0 AND 24 GROUP BY ALL)"""


@query(f"WITH {THREE}, {CORRIDOR}, f AS (SELECT c.cell_id, lo, hi, r.run_id, coalesce(d, 0) AS d, coalesce(v, 0) AS v, coalesce(t, 86400e0) AS t FROM co c CROSS JOIN (SELECT DISTINCT run_id FROM m3) r LEFT JOIN m3 ON m3.cell_id = c.cell_id AND m3.run_id = r.run_id) SELECT run_id, count(*) AS n, count(CASE WHEN lo = hi THEN 1 END) AS n_only, round(sum(ln(1 + d)), 6) AS depth, round(sum(ln(1 + v)), 6) AS velocity, round(sum(t), 4) AS arrival FROM f GROUP BY run_id")
def f2_three_outputs(spark, sf):
    """The training matrix of depth, velocity and arrival over the corridor, summed by run."""
    m = emulator(spark, sf, False)
    n = m.n
    at = [F.element_at("ys", F.col("k") + 1 + o * n) for o in range(3)]
    rows = m.wide.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sums = rows.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("only") >= 0).alias("n_only"), *(F.round(F.sum(x), 6 if o < 2 else 4).alias(name) for o, (x, name) in enumerate(zip(at, e.OUTPUTS))))
    return sums.select(F.element_at(F.array(*map(F.lit, m.runs)), F.col("k") + 1).alias("run_id"), "n", "n_only", *e.OUTPUTS)


@query()
def f6_three_outputs(spark, sf):
    """Central, low and high maps of the three outputs for each scenario."""
    return emulator(spark, sf).bands(scenarios(spark, sf))


@query()
def f7_scenario_answer(spark, sf):
    """Percentile bands, zones and inundation probabilities of each scenario."""
    return emulator(spark, sf).scenario(scenarios(spark, sf))


@query()
def f7_site_values(spark, sf):
    """Area, site maxima, coverage, spread and confidence of each scenario."""
    from floodspark.functions import checks

    d, q = run_inputs(spark, sf), scenarios(spark, sf)
    maps = emulator(spark, sf).scenario(q)
    site = e.site_values(maps, v.CELL, ("query_id",)).join(s.coverage(q, d, NAMES), "query_id")
    extent = checks.combined_level(F.lit("GOOD"), F.col("label"), checks.spread_of_extent(F.col("possible_share")))
    return site.withColumn("confidence", extent)


def unknown(spark, sf, n=1000):
    """An emulator, samples of its inputs over the design's box, and the corners of that."""
    m = emulator(spark, sf)
    box = s.box_of(run_inputs(spark, sf), NAMES)
    corners = [[box["a"][i], box["b"][j]] for i in (0, 1) for j in (0, 1)]
    return m, s.sample_inputs(spark, box, n, set()).withColumnRenamed("sample_id", "query_id"), corners


@query()
def f9_unknown_breach(spark, sf):
    """Maps of an unknown breach from 64-bin histograms of all samples."""
    import numpy as np

    m, samples, corners = unknown(spark, sf)
    return e.histogram_maps(m.histograms(samples, np.array(corners)), T_END)


@query()
def f9_points(spark, sf):
    """Percentiles of the samples at the buildings' cells."""
    m, samples, _ = unknown(spark, sf)
    from floodspark.operators.loss import cell_of

    points = v.buildings(spark, sf).select(F.col("osm_id").alias("poi_id"), cell_of(F.col("x_m"), F.col("y_m"), v.ORIGIN_X, v.ORIGIN_Y, v.CELL, v.WIDTH, v.HEIGHT).alias("cell_id")).filter("cell_id is not null")
    first = points.groupBy("cell_id").agg(F.min("poi_id").alias("poi_id"))
    return m.at_points(samples, first)


@query()
def f11_three_outputs(spark, sf):
    """Leave-one-out of processes, linear scores, nearest runs and the projection, over the three outputs."""
    return emulator(spark, sf, False).leave_one_out(run_inputs(spark, sf), NAMES)


@query(f"""WITH {THREE}, {CORRIDOR}, {INPUTS}, dd AS (SELECT q.run_id AS f, t.run_id, sqrt(power(q.a - t.a, 2) + power(q.b - t.b, 2)) AS dist FROM ru q JOIN ru t ON q.run_id <> t.run_id),
kk AS (SELECT f, run_id, 1 / (dist * dist) AS w FROM dd QUALIFY row_number() OVER (PARTITION BY f ORDER BY dist, run_id) <= 3),
fu AS (SELECT c.cell_id, lo, hi, r.run_id, coalesce(d, 0) AS d, coalesce(v, 0) AS v, coalesce(t, 86400e0) AS t FROM co c CROSS JOIN (SELECT DISTINCT run_id FROM m3) r LEFT JOIN m3 ON m3.cell_id = c.cell_id AND m3.run_id = r.run_id),
bl AS (SELECT f, cell_id, sum(w * d) / sum(w) AS d, sum(w * v) / sum(w) AS v, sum(w * t) / sum(w) AS t FROM kk JOIN fu USING (run_id) GROUP BY f, cell_id),
pr AS (SELECT t.run_id, t.d, t.v, t.t, CASE WHEN lo = hi AND lo = t.run_id THEN 0 ELSE b.d END AS pd, CASE WHEN lo = hi AND lo = t.run_id THEN 0 ELSE b.v END AS pv, CASE WHEN lo = hi AND lo = t.run_id THEN 86400e0 ELSE b.t END AS pt FROM fu t JOIN bl b ON b.f = t.run_id AND b.cell_id = t.cell_id)
SELECT run_id, round(count(CASE WHEN d > 0.3e0 AND pd > 0.3e0 THEN 1 END) / count(CASE WHEN d > 0.3e0 OR pd > 0.3e0 THEN 1 END), 6) AS iou, round(sqrt(avg(CASE WHEN d > 0.03e0 OR pd > 0.03e0 THEN power(pd - d, 2) END)), 6) AS depth_rmse, round(avg(CASE WHEN d > 0.03e0 OR pd > 0.03e0 THEN abs(pv - v) END), 6) AS velocity_mae,
round(avg(CASE WHEN t < 86400 AND pd > 0.1e0 THEN abs(pt - t) END), 4) AS arrival_mae, round(2 * count(CASE WHEN d > 0.1e0 AND pd > 0.1e0 THEN 1 END) / (count(CASE WHEN d > 0.1e0 THEN 1 END) + count(CASE WHEN pd > 0.1e0 THEN 1 END)), 6) AS f1_010 FROM pr GROUP BY run_id""")
def f11_nearest_baseline(spark, sf):
    """The baseline that blends the three nearest runs, with a corridor for each fold."""
    out = emulator(spark, sf, False).leave_one_out(run_inputs(spark, sf), NAMES, methods=("nearest",))
    return out.select("run_id", *(F.round(x, 4 if x == "arrival_mae" else 6).alias(x) for x in ("iou", "depth_rmse", "velocity_mae", "arrival_mae", "f1_010")))
