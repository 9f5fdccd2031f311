"""Hand-computed cases, numpy twins and properties of the operators without SQL."""

import heapq
import math
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.functions import checks
from floodspark.sources.io import stored
from floodspark.streaming import streams
from floodspark.operators import breach, grids, lake, loss, outlines, runs, series, shapes, surrogate, terrain


def test_run_summary_ignores_nan_and_is_strict_at_the_arrival_depth(spark):
    rows = [(0, 0, 0, 0.0, 1.0), (0, 0, 60, 0.1, 2.0), (0, 0, 120, 0.4, float("nan")), (0, 1, 0, None, None), (0, 1, 60, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "run_id int, face_id int, t_s long, depth_m double, velocity_ms double")
    got = {r.face_id: tuple(r)[2:] for r in runs.run_summary(df).collect()}
    assert got == {0: (0.4, 2.0, 120), 1: (None, 1.0, None)}
    assert runs.run_summary(df.limit(0)).count() == 0


def test_extent_metrics_of_empty_maps(spark):
    empty = spark.createDataFrame([(0, 0.0, 0.3)], "face_id int, depth_a double, depth_b double")
    r = runs.extent_metrics(empty).first()
    assert (r.iou, r.f1, r.precision, r.recall, r.area_error_pct) == (1.0, 1.0, None, None, None)
    r = runs.extent_metrics(empty, inclusive=True).first()
    assert (r.tp, r.fp, r.fn, r.iou) == (0, 1, 0, 0.0)


def test_first_crossing(spark):
    rows = [("a", 0.0, 0.0), ("a", 10.0, 20.0), ("a", 20.0, 30.0), ("b", 5.0, 50.0), ("c", 0.0, 1.0), ("d", 0.0, None)]
    df = spark.createDataFrame(rows, "k string, t_s double, q_m3s double")
    got = {r.k: r.t_cross for r in series.first_crossing(df, "k", 10.0).collect()}
    assert got == {"a": 5.0, "b": 5.0, "c": None}


def test_triangle_keeps_its_volume_and_infeasible_ones_give_no_rows(spark):
    df = spark.createDataFrame([(1, 100.0, 2e5, 600.0), (2, 100.0, 1e4, 600.0)], "series_id int, q_p double, v double, t_f double")
    out = breach.trapezoid_volume(breach.triangular(df, 60.0, 30.0)).collect()
    assert len(out) == 1 and out[0].volume_m3 == pytest.approx(2e5) and out[0].increasing


def test_breach_methods_are_null_for_missing_sizes(spark):
    rows = [(1, 1e6, 10.0, 12.0, 15.0, 30.0, "FD", "O", "M"), (2, None, 10.0, 12.0, 15.0, 30.0, "HD", "O", "M"), (3, -1.0, 10.0, 12.0, 15.0, 30.0, "HD", "O", "X")]
    df = spark.createDataFrame(rows, "dam_id int, v_w double, h_w double, h_b double, h_d double, w_ave double, dam_type string, failure_mode string, erodibility string")
    got = {r.dam_id: r for r in breach.breach_parameters(df).collect()}
    assert got[1].qp_z20 is None and got[1].qp_f16 == pytest.approx(0.0175 * 1.85 * (12 / 6.1) ** 0.125 * math.sqrt(9.81 * 10 * 1e6 * 144 / 30))
    assert got[2].width_fused is None and got[3].time_f8 is None


def test_breach_growth_balances_its_volume(spark):
    df = spark.createDataFrame([(1, 1e6, 10.0, 60.0, 12.0, 1800.0, 0.5, 3.0), (2, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 3.0)], "series_id long, v_w double, h_w double, width double, h_b double, t_f double, z double, exponent double")
    got = {r.series_id: r for r in breach.grow_breach(df).collect()}
    assert abs(got[1].error_pct) < 1 and got[1].peak_q > 0 and got[2].peak_q is None


def test_damage_is_held_at_the_cap(spark):
    curve = [(0.0, 0.0), (1.0, 0.5), (6.0, 1.0)]
    df = spark.createDataFrame([(0.5,), (6.0,), (9.0,), (-1.0,), (None,)], "d double")
    assert [r[0] for r in df.select(loss.damage_fraction(F.col("d"), curve, 6.0)).collect()] == [0.25, 1.0, 1.0, 0.0, None]


def test_resampling_keeps_the_sum(spark):
    df = spark.createDataFrame([(r, c, float(r * 7 + c)) for r in range(9) for c in range(9)], "row int, col int, p double")
    for method in ("sum", "average", "min", "max", "mode", "nearest"):
        assert grids.resample(df, "p", 30.0, 45.0, method).count() == 36
    total = grids.resample(df, "p", 30.0, 45.0, "sum").agg(F.sum("p")).first()[0]
    assert total == pytest.approx(sum(r * 7 + c for r in range(9) for c in range(9)))


def test_otsu_splits_two_groups_and_falls_back(spark):
    rows = [("a", v) for v in [0.1] * 50 + [0.9] * 50] + [("b", 0.3)] * 3 + [("c", None)]
    got = {r.k: r.threshold for r in lake.otsu(spark.createDataFrame(rows, "k string, v double"), "k", "v", 0.0, 1.0).collect()}
    assert 0.2 < got["a"] < 0.8 and got["b"] == 0.5 and got["c"] == 0.5


def brute_fill(z, eps):
    h, w = z.shape
    filled, heap = np.full(z.shape, np.inf), []
    for r in range(h):
        for c in range(w):
            if r in (0, h - 1) or c in (0, w - 1) or np.isnan(z[r, c]):
                filled[r, c] = -np.inf if np.isnan(z[r, c]) else z[r, c]
                heapq.heappush(heap, (filled[r, c], r, c))
    while heap:
        e, r, c = heapq.heappop(heap)
        if e > filled[r, c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                y, x = r + a, c + b
                if 0 < y < h - 1 and 0 < x < w - 1 and not np.isnan(z[y, x]) and max(z[y, x], e + eps) < filled[y, x]:
                    filled[y, x] = max(z[y, x], e + eps)
                    heapq.heappush(heap, (filled[y, x], y, x))
    return filled


def test_fill_and_accumulation_equal_a_heap(spark):
    rng = np.random.default_rng(3)
    z = np.round(rng.uniform(0, 10, (14, 11)), 1)
    z[5, 5] = np.nan
    df = spark.createDataFrame([(0, r, c, r * 11 + c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(14) for c in range(11)], "site_id int, row int, col int, cell_id int, z double")
    want = brute_fill(z, 1e-3)
    for tile in (4, 256):
        t = terrain.kept(terrain.fill(df, 11, 14, 1e-3, tile=tile))
        for r in t.collect():
            assert (r.filled is None and np.isnan(z[r.row, r.col])) or r.filled == pytest.approx(want[r.row, r.col])
    tree = terrain.kept(terrain.drainage(t))
    parent = {r.cell_id: r.parent for r in tree.collect()}
    count = dict.fromkeys(parent, 0)
    for k in parent:
        at = k
        while at is not None:
            count[at] += 1
            at = parent[at]
    assert {r.cell_id: r.accumulation for r in terrain.accumulation(tree).collect()} == count
    assert {r.cell_id: r.accumulation for r in terrain.accumulation(tree, tile=3).collect()} == count
    for tile in (3, 256):
        marked = tree.withColumn("channel", F.when(F.col("cell_id") % 7 == 0, True))
        got = {r.cell_id: r.found for r in terrain.first_ancestor(marked, "channel", tile).collect()}
        for k in parent:
            at = k
            while at is not None and at % 7:
                at = parent[at]
            assert got[k] == at
    path, at = [], 7 * 11 + 5
    while at is not None:
        path.append(at)
        at = parent[at]
    got = terrain.trace(tree, tree.filter(f"cell_id = {7 * 11 + 5}")).orderBy("step").collect()
    assert [r.cell_id for r in got] == path


def test_outlines_with_holes_islands_and_touching_corners(spark):
    picture = ["#######..", "#.#...#..", "#.#.#.#.#", "#.#...#..", "#######.."]  # holes, an island in one of them, a cell apart
    cells = [(0, r, c, 1 if c < 8 else 2) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"] + [(1, 0, 0, 5), (1, 1, 1, 5)]
    edges = outlines.rings(spark.createDataFrame(cells, "site_id int, row int, col int, component int"))
    rows = edges.orderBy("site_id", "component", "ring", "pos").collect()
    by = {}
    for r in rows:
        by.setdefault((r.site_id, r.component, r.ring), []).append(r)
    for ring in by.values():
        assert [r.pos for r in ring] == [*range(len(ring))]
        assert all((a.r1, a.c1) == (b.r0, b.c0) for a, b in zip(ring, ring[1:] + ring[:1]))
    got = {(r.site_id, r.component, r.n_edges, r.area): r for r in outlines.nested(edges).collect()}
    assert sorted(got) == [(0, 1, 4, 1), (0, 1, 8, -3), (0, 1, 12, -9), (0, 1, 24, 35), (0, 2, 4, 1), (1, 5, 4, 1)]
    whole, island = got[0, 1, 24, 35].ring, got[0, 1, 4, 1]
    assert got[0, 1, 8, -3].outer == got[0, 1, 12, -9].outer == whole and island.outer == island.ring
    assert outlines.nested(edges).filter("site_id = 1").count() == 2  # cells that touch in a corner are two rings
    assert outlines.corners(edges).filter("site_id = 0 and component = 1").count() == 16
    shapes_ = outlines.polygons(outlines.located(outlines.corners(edges), 400000.0, 3000000.0, 20.0, 45), outlines.nested(edges))
    one = shapes_.filter("site_id = 0 and component = 1").select("polygons", outlines.polygon_placemark(F.lit("lake"), F.col("polygons"), F.lit("ff0000ff")).alias("kml")).first()
    assert sorted(len(p) for p in one.polygons) == [1, 3] and all(r[0] == r[-1] for p in one.polygons for r in p)
    turn = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))
    assert all(turn(p[0]) > 0 and all(turn(h) < 0 for h in p[1:]) for p in one.polygons)
    assert one.kml.count("<outerBoundaryIs>") == 2 and one.kml.count("<innerBoundaryIs>") == 2 and "ff0000ff" in one.kml


def test_a_long_outline_takes_few_rounds(spark, monkeypatch):
    """A comb of one component with a ring of some thousand edges."""
    cells = [(0, 0, c, 1) for c in range(200)] + [(0, r, c, 1) for c in range(0, 200, 2) for r in range(1, 12)]
    calls = []
    monkeypatch.setattr(outlines, "stored", lambda df: (calls.append(1), stored(df))[1])
    edges = outlines.rings(spark.createDataFrame(cells, "site_id int, row int, col int, component int"))
    assert edges.agg(F.max("pos")).first()[0] == edges.count() - 1 > 2000 and len(calls) < 35


def test_principal_components_recover_low_rank_maps(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(9, 2)), rng.normal(size=(2, 40))
    y = a @ b + 3
    df = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(9) for j in range(40)], "run_id int, cell_id int, y double")
    basis = surrogate.Basis(df)
    assert basis.count <= 2
    back = basis.decode(basis.encode(df)).withColumnRenamed("y", "z").join(df, ["run_id", "cell_id"])
    assert back.agg(F.max(F.abs(F.col("y") - F.col("z")))).first()[0] < 0.6
    design = spark.createDataFrame([(i, float(a[i, 0]), float(a[i, 1])) for i in range(9)], "run_id int, a double, b double")
    loo = {r.method: r[1] for r in surrogate.leave_one_out(df, design, ["a", "b"]).groupBy("method").agg(F.avg("rmse")).collect()}
    assert loo["linear"] < loo["nearest"]


def test_process_interpolates_and_grows_unsure():
    x = np.linspace(0, 3, 8)[:, None]
    m = surrogate.fit_process(x, np.sin(x[:, 0]))
    mean, sd = surrogate.predict_process(m, x, np.array([[1.5], [9.0]]))
    assert abs(mean[0] - math.sin(1.5)) < 0.05 and sd[1] > sd[0]


def test_hash_uniforms_do_not_depend_on_partitions(spark):
    one = spark.range(100).repartition(7).select("id", surrogate.hash_uniform(F.lit(1), "id").alias("u"))
    two = spark.range(100).coalesce(1).select("id", surrogate.hash_uniform(F.lit(1), "id").alias("u"))
    assert one.exceptAll(two).count() == 0
    mean = spark.range(5000).agg(F.avg(surrogate.hash_normal("id")), F.stddev(surrogate.hash_normal("id"))).first()
    assert abs(mean[0]) < 0.06 and abs(mean[1] - 1) < 0.06


def test_latin_hypercube_has_one_point_in_each_slice(spark):
    rows = surrogate.latin_hypercube(spark, 12, ["a", "b"]).collect()
    for k in ("a", "b"):
        assert sorted(int(r[k] * 12) for r in rows) == list(range(12))


def test_normal_cdf(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-2.0, 0.0, 1.28155)], "x double").select(surrogate.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.0227501, 0.5, 0.9], abs=1e-5)


def test_curves_that_do_not_increase_are_found(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0)]), (2, [(0.0, 0.0), (0.0, 1.0)]), (3, [(1.0, 1.0)])], "curve_id int, points array<struct<x:double,y:double>>")
    assert [r[0] for r in checks.not_increasing(df).collect()] == [2]


def test_late_samples_take_their_place_in_time(spark, tmp_path):
    """Batches out of order, late by less than the watermark's delay; a sample that comes late makes the crossing."""

    t = lambda minute: datetime(2026, 1, 1, tzinfo=UTC) + timedelta(minutes=minute)
    batches = [[(1, t(0), 0.0), (1, t(30), 50.0), (2, t(10), 20.0)], [(1, t(20), 10.0), (1, t(10), 4.0), (2, t(5), 0.0)], [(1, t(200), 99.0), (2, t(400), 1.0)], [(3, t(500), 30.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "poi_id long, ts timestamp, q_m3s double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("poi_id long, ts timestamp, q_m3s double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.crossing_stream(stream, 10.0, "1 hour").writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.poi_id: (r.t_cross - t(0).timestamp()) / 60 for r in spark.table("late").collect()}
    assert got == {1: 20.0, 2: 7.5}  # the watermark has not passed poi 3


def test_leave_one_out_ranks_methods_and_covers(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (12, 2))
    cells = rng.uniform(0.2, 1, (2, 60))
    y = np.log1p(np.exp(x @ cells) + 0.5 * np.sin(2 * x[:, :1]))
    df = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(12) for j in range(60)], "run_id int, cell_id int, y double")
    design = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1])) for i in range(12)], "run_id int, a double, b double")
    got = {(r.method, r.run_id): r for r in surrogate.leave_one_out(df, design, ["a", "b"]).collect()}
    mean = {m: np.mean([got[m, f].rmse for f in range(12)]) for m in ("gp", "linear", "nearest")}
    assert mean["gp"] < mean["nearest"] and all(0 <= got["gp", f].coverage_90 <= 1 and got["linear", f].coverage_90 is None for f in range(12))
    rest = np.arange(1, 12)
    d = np.linalg.norm(x[rest] - x[0], axis=1)
    near = rest[np.argsort(d)[:3]]
    w = 1 / np.linalg.norm(x[near] - x[0], axis=1) ** 2
    want = np.sqrt(np.mean((w / w.sum() @ y[near] - y[0]) ** 2))
    assert abs(got["nearest", 0].rmse - want) < 1e-9


def test_gram_and_samples_equal_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(7, 50))
    df = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(7) for j in range(50)], "run_id int, cell_id int, y double").repartition(5)
    c = y - y.mean(axis=0)
    assert np.allclose(surrogate.gram(surrogate.wide(df, list(range(7))), 7), c @ c.T)
    basis = surrogate.Basis(df, 0.9)
    scores = spark.createDataFrame([(q, k, float(rng.normal()), 0.1) for q in range(30) for k in range(basis.count)], "query_id long, component int, score double, sd double")
    cells = {r.cell_id: r for r in basis.cells.collect()}
    s = surrogate.drawn(scores, 0)
    depth = {k: np.maximum(np.expm1(r.mean + s @ np.array(r.w)), 0) for k, r in cells.items()}
    for r in surrogate.monte_carlo(basis, scores).collect():
        assert abs(r.p - (depth[r.cell_id] > 0.3).mean()) < 1e-12 and abs(r.p50 - np.median(depth[r.cell_id])) < 1e-9
        assert r.zone == (2 if r.p >= 0.9 else 1 if r.p >= 0.1 else 0)
    for r in surrogate.sample_summaries(basis, scores, 10.0).collect():
        assert abs(r.site_max - max(x[r.sample] for x in depth.values())) < 1e-9 and r.area_m2 == 100.0 * sum(x[r.sample] > 0.3 for x in depth.values())


def test_lines_of_many_vertices(spark):
    point = "array<struct<x:double,y:double>>"
    rows = [(1, [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 10.0)]), (2, [(5.0, 5.0), (5.0, 5.0)]), (3, [(1.0, 2.0)]), (4, []), (5, None), (6, [(0.0, 10.0), (30.0, 10.0)])]
    df = spark.createDataFrame(rows, f"line_id int, line {point}")
    got = {}
    for r in shapes.densified(df, 4.0).orderBy("line_id", "y_m").collect():
        got.setdefault(r.line_id, []).append((round(r.x_m, 6), round(r.y_m, 6), round(r.piece_m, 6)))
    step = 11 / 3
    assert got[1] == [tuple(round(v, 6) for v in p) for p in ((0.3 * step, 0.4 * step, step), (3.0, 4 + 1.5 * step - 5, step), (3.0, 4 + 2.5 * step - 5, step))]
    assert got[2] == [(5.0, 5.0, 0.0)] and got[3] == [(1.0, 2.0, 0.0)] and not {4, 5} & set(got) and len(got[6]) == 8
    cells = shapes.line_lengths(df, 10.0, 0.0, 20.0, 2, 2).collect()
    assert {(r.line_id, r.cell_id): round(r.length_m, 6) for r in cells if r.length_m > 0} == {(1, 2): 11.0, (6, 2): 10.0, (6, 3): 10.0, (6, None): 10.0}


def test_all_touched_cells_of_concave_rings(spark):
    """Against clipping of the ring by every cell."""
    rng = np.random.default_rng(4)
    rings = []
    for _ in range(6):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
        radius = rng.uniform(3, 40, 9)
        rings.append([(float(50 + r * np.cos(a)), float(50 + r * np.sin(a))) for a, r in zip(angle, radius)])

    def clipped_area(ring, x0, y0, x1, y1):
        for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
            out = []
            for p, q in zip(ring, ring[1:] + ring[:1]):
                a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
                if a >= 0:
                    out.append(p)
                if (a > 0 > b) or (a < 0 < b):
                    out.append(tuple(p[k] + a / (a - b) * (q[k] - p[k]) for k in (0, 1)))
            ring = out
            if not ring:
                return 0.0
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2

    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "face_id int, ring array<struct<x:double,y:double>>")
    got = {tuple(r) for r in shapes.touched(df, 10.0, 0.0, 100.0, 10, 10).collect()}
    want = {(k, r, c) for k, ring in enumerate(rings) for r in range(10) for c in range(10) if clipped_area(ring, c * 10, 90 - r * 10, c * 10 + 10, 100 - r * 10) > 1e-9}
    assert got == want
    values = df.select("face_id", "ring", F.when(F.col("face_id") != 5, F.col("face_id").cast("double")).alias("depth_m"))
    domain = spark.createDataFrame([(r, c) for r in range(10) for c in range(9)], "row int, col int")
    burned = {(r.row, r.col): r.depth_m for r in shapes.burned(values, "depth_m", domain, 10.0, 0.0, 100.0, 10, 10).collect()}
    assert burned == {(r, c): float(max((k for k, a, b in want if (a, b) == (r, c) and k != 5), default=0)) for r in range(10) for c in range(9)}


def test_two_dams_of_one_crest_do_not_stop_each_other(spark):
    cells = spark.createDataFrame([(0, r, c, r * 9 + c, 10.0 if (r, c) in ((2, 1), (4, 1)) else 1.0) for r in range(7) for c in range(9)], "site_id int, row int, col int, cell_id int, z double")
    dams = spark.createDataFrame([(1, 0, 3, 6, 1, 0, 5.0), (2, 0, 3, 1, 1, 0, 5.0)], "dam_id int, site_id int, row int, col int, dr int, dc int, crest double")
    got = {(r.row, r.col) for r in terrain.burn_crest(cells, dams, 2).filter("z = 5").collect()}
    assert got == {(r, 6) for r in range(1, 6)} | {(3, 1)}


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/Lima"])
def test_crossings_in_other_time_zones(spark, tmp_path, zone):
    base = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(p, base + timedelta(minutes=m), q) for p in (1, 2) for m, q in ((0, 0.0), (50, 20.0))] + [(9, base + timedelta(days=2), 0.0)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        spark.createDataFrame(rows, "poi_id long, ts timestamp, q_m3s double").coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("poi_id long, ts timestamp, q_m3s double").parquet(f"{tmp_path}/in")
        q = streams.crossing_stream(stream, 10.0).writeStream.format("memory").queryName("zones").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {r.poi_id: r.t_cross - base.timestamp() for r in spark.table("zones").collect()} == {1: 1500.0, 2: 1500.0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_queries_just_outside_the_box(spark):
    design = spark.createDataFrame([(i, float(i % 3), float(i // 3)) for i in range(9)], "run_id int, a double, b double")
    asked = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.001, 1.0), (3, 1.0, 0.5)], "query_id int, a double, b double")
    got = {r.query_id: r.label for r in surrogate.coverage(asked, design, ["a", "b"]).collect()}
    assert got == {1: "INSIDE", 2: "OUTSIDE", 3: "INSIDE"}
    wide = {n: (-1.0, 3.0) for n in "ab"}
    assert {r.label for r in surrogate.coverage(asked, design, ["a", "b"], box=wide).collect()} == {"INSIDE"}


def snake(n):
    """Rows and columns of a path that fills n x n cells but for walls between its lanes."""
    cells = []
    for r in range(0, n, 2):
        cells += [(r, c) for c in (range(n) if r % 4 == 0 else range(n - 1, -1, -1))]
        if r + 2 <= n:
            cells.append((r + 1, n - 1 if r % 4 == 0 else 0))
    return [(r, c) for r, c in cells if r < n]


def test_long_paths_across_many_tiles(spark):
    n = 41
    path = snake(n)
    ids = [r * n + c for r, c in path]
    rows = [(s, r, c, i, ids[k + 1] if k + 1 < len(ids) else None) for s in (0, 1) for k, ((r, c), i) in enumerate(zip(path, ids))]
    tree = terrain.kept(spark.createDataFrame(rows, "site_id int, row int, col int, cell_id long, parent long"))
    for tile in (4, 256):
        got = {(r.site_id, r.cell_id): r.accumulation for r in terrain.accumulation(tree, tile).collect()}
        assert got == {(s, i): k + 1 for s in (0, 1) for k, i in enumerate(ids)}
        found = terrain.first_ancestor(tree.withColumn("end", F.col("parent").isNull()), "end", tile)
        assert {r.found for r in found.collect()} == {ids[-1]} and found.count() == len(rows)
        assert {r.component for r in terrain.components(tree, tile).collect()} == {0}
    # nothing, repeated cells, a single cell, negative ids and places
    assert terrain.components(tree.limit(0), 4).count() == terrain.accumulation(tree.limit(0), 4).count() == terrain.first_ancestor(tree.limit(0).withColumn("end", F.lit(True)), "end", 4).count() == 0
    odd = spark.createDataFrame([(0, -1, -1, -5), (0, 0, 0, 2**60), (0, 0, 0, 2**60), (0, 9, 9, 3)], "site_id int, row int, col int, cell_id long")
    assert sorted((r.cell_id, r.component) for r in terrain.components(odd, 4).collect()) == [(-5, -5), (3, 3), (2**60, -5), (2**60, -5)]


def test_warp_through_another_zone(spark):
    """A plane is told exactly by four corners, whatever projection the centres come from."""
    lon, lat = 84.0, 27.0
    x, y = grids.utm(F.lit(lon), F.lit(lat), 45)
    u, w = grids.utm(F.lit(lon), F.lit(lat), 44)
    x, y, u, w = spark.range(1).select(x, y, u, w).first()
    source, target = (x - 1500.0, y + 1500.0, 30.0, 45), (u - 300.0, w + 300.0, 50.0, 44)
    at = lambda o, m, c: o + (F.col(c) + 0.5) * m
    cells = spark.range(100 * 100).select(F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    cells = cells.withColumn("z", at(source[0], 30.0, "col") * 2 - (source[1] - (F.col("row") + 0.5) * 30.0))
    got = grids.warp(cells, "z", source, target, 12, 12)
    lon2, lat2 = grids.lonlat(at(target[0], 50.0, "col"), target[1] - (F.col("row") + 0.5) * 50.0, 44)
    p, q = grids.utm(F.col("lon"), F.col("lat"), 45)
    rows = got.withColumn("lon", lon2).withColumn("lat", lat2).withColumn("want", p * 2 - q).collect()
    assert len(rows) == 144 and all(abs(r.z - r.want) < 1e-3 for r in rows)
    near = grids.warp(cells, "z", source, target, 12, 12, "nearest").join(got.withColumnRenamed("z", "exact"), ["row", "col"]).collect()
    assert all(abs(r.z - r.exact) <= 45.0 + 1e-3 for r in near)
    assert grids.warp(cells.limit(0), "z", source, target, 2, 3).filter("z is null").count() == 6
    far = (x + 1e5, y, 30.0, 45)
    assert grids.warp(cells, "z", far, target, 2, 3, "nearest").filter("z is null").count() == 6


def test_tiles_of_mixed_projections_and_names(spark):
    tiles = spark.createDataFrame([(1, 0, 0, None, 44), (2, 0, 0, 5.0, 44), (3, 0, 0, 6.0, 45)], "tile_order int, row int, col int, z double, zone int")
    assert [r.z for r in grids.mosaic(tiles.filter("zone = 44"), "zone").collect()] == [5.0]
    with pytest.raises(ValueError, match="more than one zone"):
        grids.mosaic(tiles, "zone")
    boxes = spark.createDataFrame([("a", 86.9, 26.9, 90.0, 27.1), ("b", -0.5, -0.5, 0.0, 0.0)], "id string, west double, south double, east double, north double")
    got = grids.tile_names(boxes, 3).collect()
    assert sorted(r.tile for r in got if r.id == "a") == ["N24E084", "N24E087", "N24E090", "N27E084", "N27E087", "N27E090"]
    assert sorted(r.tile for r in got if r.id == "b") == ["N00E000", "N00W003", "S03E000", "S03W003"]


def test_acceptance_of_folds(spark):
    kind = "method string, fold int, depth_rmse double, arrival_rmse double, f1 double, coverage double, terrace_ok boolean, projection_depth double, projection_arrival double"
    def status(gp, f1=0.9, coverage=0.9, terrace=None, projection=None):
        rows = [("gp", f, gp, gp, f1, coverage, terrace, projection, projection) for f in range(3)] + [(m, f, 1.0, 1.0, 0.9, None, None, None, None) for m in ("linear", "nearest") for f in range(3)]
        return {r.test: r.status for r in runs.acceptance(spark.createDataFrame(rows, kind), "gp", ("linear", "nearest")).collect()}

    assert status(0.9, projection=0.45) == {"A1": "PASS", "A2": "PASS", "A4": "NOT_EVALUATED", "A5": "PASS"}
    assert status(0.91, coverage=0.96, terrace=False, projection=0.46) == {"A1": "FAIL", "A2": "FAIL", "A4": "FAIL", "A5": "FAIL"}
    assert status(0.5, f1=0.89, terrace=True)["A1"] == "FAIL" and status(0.5, terrace=True)["A4"] == "PASS"
    assert status(float("inf"), coverage=None) == {"A1": "FAIL", "A2": "FAIL", "A4": "NOT_EVALUATED", "A5": "NOT_EVALUATED"}
    empty = runs.acceptance(spark.createDataFrame([], kind), "gp", ("linear",))
    assert {r.test: r.status for r in empty.collect()} == {"A1": "FAIL", "A2": "FAIL", "A4": "NOT_EVALUATED", "A5": "NOT_EVALUATED"}


def test_pits_steeps_and_pairs_that_fall(spark):
    cells = spark.createDataFrame([(0, 1, 2.0, 1.0), (0, 2, 2.0, 3.0), (0, 3, 0.02, 3.0), (1, 1, None, None)], "run_id int, face_id int, max_depth double, max_velocity double")
    ground = spark.createDataFrame([(0, 1, 0.5, 0.0), (0, 2, 0.0, 0.2), (0, 3, 0.6, None)], "run_id int, face_id int, depression double, slope double")
    got = {r.run_id: tuple(r)[1:] for r in runs.pits_and_steeps(cells, ground, 0.5, 0.1).collect()}
    assert got == {0: (True, 0.5, True, 0.5), 1: (None, None, None, None)}
    kind = "pair_id int, raised boolean, row int, col int, depth_m double, arrival_s double"
    maps = spark.createDataFrame([(0, False, 0, 0, 1.0, 9.0), (0, True, 0, 0, 2.0, 8.0), (1, False, 0, 0, 1.0, 9.0), (1, True, 0, 0, 0.2, 10.0), (2, False, 0, 0, 0.0, None), (2, True, 0, 0, 0.4, 5.0)], kind)
    points = spark.createDataFrame([(0, 0)], "row int, col int")
    r = surrogate.monotone_pairs(maps, points).first()
    assert (r.n, round(r.extent, 6), round(r.depth, 6), round(r.arrival, 6), r.status) == (3, 0.666667, 0.666667, 0.666667, "FAIL")
    assert surrogate.monotone_pairs(maps.filter("pair_id <> 1"), points).first().status == "PASS" and surrogate.monotone_pairs(maps.limit(0), points).first().status is None


def test_ranges_of_dams_with_and_without_equations(spark):
    box = "struct<value:array<double>>"
    dams = spark.createDataFrame(
        [(1, True, None), (2, False, (([9.0, 4.0],), (None,), ([1.0],))), (3, False, None), (4, None, (([1.0, 2.0],), None, None))],
        f"dam_id int, equations_applicable boolean, imposed_ranges struct<peak_discharge_m3s:{box},breach_width_m:{box},failure_time_s:{box}>")
    parameters = spark.createDataFrame([(1, 2.0, 3.0, None, 5.0)], "dam_id int, width_low double, width_high double, time_low double, time_high double")
    got = {(r.dam_id, r.output): (r.low, r.high, r.interval, r.status) for r in breach.ranges(parameters, dams).collect()}
    assert got[1, "breach_width_m"] == (2.0, 3.0, "method_range", "ok") and got[2, "peak_discharge_m3s"] == (4.0, 9.0, "imposed", "ok")
    blocked = {k for k, x in got.items() if x[3] == "blocked"}
    assert len(got) == 12 and blocked == set(got) - {(1, "breach_width_m"), (2, "peak_discharge_m3s")} and all(got[k][:2] == (None, None) for k in blocked)
