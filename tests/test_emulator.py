"""The surrogate of three outputs against numpy on small maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.functions import checks
from floodspark.operators import emulator as e
from floodspark.operators import surrogate as s

W, H, N, T_END = 12, 10, 9, 5000.0


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (N, 2))
    shape = rng.uniform(0.2, 1.2, (3, W * H))
    depth = np.maximum(np.exp(x[:, :1] * shape[0]) * (np.arange(W * H) % W) / W - 0.6 + 0.3 * x[:, 1:], 0)
    depth.reshape(N, H, W)[:, :6, 6:] = 0
    depth.reshape(N, H, W)[4, 1, 10] = 2.0  # a patch that no other run wets
    velocity = depth * shape[1]
    arrival = np.where(depth > 0.1, 300 + 900 * shape[2] - 200 * x[:, :1], np.nan)
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(r * 10, c, none(depth[r, c]), float(velocity[r, c]), none(arrival[r, c])) for r in range(N) for c in range(W * H)]
    maps = spark.createDataFrame(rows, "run_id int, cell_id long, depth_m double, velocity_ms double, arrival_s double")
    design = spark.createDataFrame([(r * 10, float(x[r, 0]), float(x[r, 1])) for r in range(N)], "run_id int, a double, b double")
    return x, depth, velocity, np.where(np.isnan(arrival), T_END, arrival), maps, design


def corridor(wet):
    """Cells within two steps of a wet one."""
    grid, out = wet.any(axis=0).reshape(H, W), np.zeros((H, W), bool)
    for r, c in zip(*np.nonzero(grid)):
        for a in range(-2, 3):
            for b in range(-2, 3):
                if abs(a) + abs(b) <= 2 and 0 <= r + a < H and 0 <= c + b < W:
                    out[r + a, c + b] = True
    return np.flatnonzero(out)


def fitted(y, share=0.99):
    """Scores, loadings and mean of runs x cells by the singular value decomposition."""
    mean = y.mean(axis=0)
    u, d, v = np.linalg.svd(y - mean, full_matrices=False)
    part = np.cumsum(d**2) / (d**2).sum()
    k = min(max(1, len(y) - 2), int(np.searchsorted(part, share - 1e-12)) + 1)
    return u[:, :k] * d[:k], v[:k], mean


def model(world):
    x, depth, velocity, arrival, maps, design = world
    m = e.Emulator(maps, W, H, T_END, buffer=2)
    m.fit(design, ["a", "b"])
    return m


def test_bands_equal_those_of_numpy(spark, world):
    x, depth, velocity, arrival, maps, design = world
    m = model(world)
    cells = corridor(depth > 0.03)
    assert sorted(r.cell_id for r in m.wide.select("cell_id").collect()) == cells.tolist() and len(cells) < W * H
    q = np.array([[0.3, -0.2], [0.9, 0.9]])
    got = {(r.query_id, r.cell_id): r for r in m.bands(spark.createDataFrame([(5, 0.3, -0.2), (6, 0.9, 0.9)], "query_id long, a double, b double")).collect()}
    stacks = np.log1p(depth[:, cells]), np.log1p(velocity[:, cells]), arrival[:, cells]
    back = [lambda z: np.maximum(np.expm1(z), 0)] * 2 + [lambda z: np.clip(z, 0, T_END)]
    central, p = {}, None
    for o, y in enumerate(stacks):
        scores, loadings, mean = fitted(y)
        both = [s.predict_process(s.fit_process(x, scores[:, k] * np.sign(m.parts[o].scores[:, k] @ scores[:, k])), x, q) for k in range(scores.shape[1])]
        sign = np.sign([m.parts[o].scores[:, k] @ scores[:, k] for k in range(scores.shape[1])])
        z = mean + np.stack([b[0] for b in both], axis=1) * sign @ loadings
        sd = np.sqrt(np.stack([b[1] for b in both], axis=1) ** 2 @ loadings**2)
        central[o] = back[o](z), np.minimum(back[o](z - 1.645 * sd), back[o](z + 1.645 * sd))
    for i, k in enumerate((5, 6)):
        for j, c in enumerate(cells):
            r = got[k, int(c)]
            assert r.depth_central == pytest.approx(central[0][0][i, j], abs=1e-6) and r.depth_low == pytest.approx(central[0][1][i, j], abs=1e-6)
            assert r.velocity_central == pytest.approx(central[1][0][i, j], abs=1e-6)
            assert (r.arrival_central is None) == (central[0][0][i, j] <= 0.1)
            assert r.arrival_central is None or r.arrival_central == pytest.approx(central[2][0][i, j], abs=1e-4)
            assert 0 <= r.p <= 1 and (r.p > 0.5) == (central[0][0][i, j] > 0.3)


def test_a_fold_has_the_corridor_and_components_of_the_others(spark, world):
    """Linear and projected folds against fits on the other runs alone."""
    x, depth, velocity, arrival, maps, design = world
    m = e.Emulator(maps, W, H, T_END, buffer=2)
    got = {(r.method, r.run_id): r for r in m.leave_one_out(design, ["a", "b"], methods=("linear", "nearest", "projection")).collect()}
    everywhere = corridor(depth > 0.03)
    for f in range(N):
        rest = np.delete(np.arange(N), f)
        cells = corridor(depth[rest] > 0.03)
        pred = {k: [np.zeros(W * H), np.zeros(W * H), np.full(W * H, T_END)] for k in ("linear", "projection")}
        for o, y in enumerate((np.log1p(depth), np.log1p(velocity), arrival)):
            scores, loadings, mean = fitted(y[rest][:, cells])
            coef = np.linalg.lstsq(np.column_stack([np.ones(N - 1), x[rest]]), scores, rcond=None)[0]
            for k, way in (("linear", np.concatenate([[1.0], x[f]]) @ coef), ("projection", loadings @ (y[f, cells] - mean))):
                z = mean + way @ loadings
                pred[k][o][cells] = np.clip(z, 0, T_END) if o == 2 else np.maximum(np.expm1(z), 0)
        for k, (d, v, a) in pred.items():
            at = everywhere
            wet = (depth[f, at] > 0.03) | (d[at] > 0.03)
            arrived = (arrival[f, at] < T_END) & (d[at] > 0.1)
            r = got[k, f * 10]
            assert r.depth_rmse == pytest.approx(np.sqrt(((d - depth[f])[at][wet] ** 2).mean()), abs=1e-6)
            assert r.velocity_mae == pytest.approx(np.abs((v - velocity[f])[at][wet]).mean(), abs=1e-6)
            assert (r.arrival_rmse is None) == (not arrived.any())
            assert not arrived.any() or r.arrival_rmse == pytest.approx(np.sqrt(((a - arrival[f])[at][arrived] ** 2).mean()), abs=1e-4)
            one, two = depth[f, at] > 0.3, d[at] > 0.3
            assert r.iou == pytest.approx((one & two).sum() / (one | two).sum() if (one | two).any() else 1.0)
            assert r.area_error_pct == (pytest.approx(100 * (two.sum() - one.sum()) / one.sum()) if one.any() else None)
    # cells that only run 4 wets are in no corridor of its own fold
    assert m.wide.filter("only = 4").count() > 0 and len(corridor(np.delete(depth, 4, axis=0) > 0.03)) < len(everywhere)


def test_processes_cover_the_truth(spark, world):
    m = e.Emulator(world[4], W, H, T_END, buffer=2)
    got = m.leave_one_out(world[5], ["a", "b"], methods=("gp", "nearest")).groupBy("method").agg(F.avg("depth_rmse").alias("rmse"), F.avg("coverage_depth").alias("inside"), F.avg("coverage_arrival").alias("arrived")).collect()
    by = {r.method: r for r in got}
    assert by["gp"].rmse < by["nearest"].rmse and 0.3 < by["gp"].inside <= 1 and 0 <= by["gp"].arrived <= 1 and by["nearest"].inside is None


def test_histograms_of_several_passes_add_up_and_tell_the_percentiles(spark, world, monkeypatch):
    m = model(world)
    samples = spark.range(700).select(F.col("id").alias("query_id"), (s.hash_uniform(F.lit(1), "id") * 2 - 1).alias("a"), (s.hash_uniform(F.lit(2), "id") * 2 - 1).alias("b"))
    corners = np.array([[a, b] for a in (-1, 1) for b in (-1, 1)], float)
    one = {r.cell_id: r for r in m.histograms(samples, corners).collect()}
    monkeypatch.setattr(e, "PASS", 200)
    more = m.histograms(samples, corners)
    assert {r.cell_id: (r.n, r.wet, r.counts, r.tops) for r in more.collect()} == {k: (r.n, r.wet, r.counts, r.tops) for k, r in one.items()}
    assert all(r.n == 700 and [sum(r.counts[k : k + 64]) for k in (0, 64, 128)] == [700] * 3 for r in one.values())
    draws, y = m.draws(samples.toPandas(), 0), {r.cell_id: np.array(r.ys).reshape(1, 3, N) for r in m.wide.collect()}
    maps = {r.cell_id: r for r in e.histogram_maps(more, T_END).collect()}
    for c, r in maps.items():
        depth, _, arrival = (v[0] for v in e.sampled(y[c], draws, m.weights, T_END))
        assert r.p == pytest.approx((depth > 0.3).mean())
        for name, q in (("depth_central", 50), ("depth_low", 10), ("depth_high", 90)):
            assert abs(r[name] - np.percentile(depth, q)) <= 1.01 * one[c].tops[0] / 64
        came = np.where(depth > 0.1, arrival, T_END)
        if r.arrival_low is not None:
            slack, (lo, hi) = 1.01 * one[c].tops[2] / 64, (np.percentile(came, 10, method=k) for k in ("lower", "higher"))
            assert np.percentile(depth, 90) > 0.09 and lo - slack <= r.arrival_low <= hi + slack
        if np.percentile(depth, 90) < 0.09:
            assert r.arrival_low is None
    points = spark.createDataFrame([("x", 5), ("out", 10**6)], "poi_id string, cell_id long")
    got = m.at_points(samples, points).collect()
    depth = e.sampled(y[5], draws, m.weights, T_END)[0][0]
    assert [r.poi_id for r in got] == ["x"] and got[0].depth_low == pytest.approx(np.percentile(depth, 10)) and got[0].depth_central == pytest.approx(np.percentile(depth, 50))


def test_scenario_zones_and_site_values(spark, world):
    m = model(world)
    maps = m.scenario(spark.createDataFrame([(1, 0.0, 0.0)], "query_id long, a double, b double"))
    rows = maps.collect()
    assert all(r.zone == (2 if r.p >= 0.9 else 1 if r.p >= 0.1 else 0) and r.depth_low <= r.depth_central <= r.depth_high for r in rows)
    assert all((r.arrival_low is None) == (r.depth_high <= 0.1) and (r.arrival_high is None) == (r.depth_low <= 0.1) for r in rows)
    site = e.site_values(maps, 20.0, ("query_id",)).first()
    flooded = sum(r.zone >= 1 for r in rows)
    assert site.area_m2 == flooded * 400 and site.max_depth == max(r.depth_central for r in rows) and site.possible_share == pytest.approx(sum(r.zone == 1 for r in rows) / flooded)


def test_normal_deviates_are_normal():
    x = e.normal(np.arange(200_000, dtype=np.uint64))
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs((x > 1.645).mean() - 0.05) < 0.003
    assert np.allclose(e.cdf(np.array([-1.96, 0.0, 1.2815515655446004])), [0.024998, 0.5, 0.9], atol=1e-5)


def test_levels_of_confidence(spark):
    rows = [("GOOD", "INSIDE", "NARROW", False, "HIGH"), ("FAIR", "INSIDE", "NARROW", False, "MODERATE"), ("FAIR", "EDGE", "NARROW", False, "LOW"), ("GOOD", "OUTSIDE", "NARROW", False, "LOW"), ("GOOD", "INSIDE", "NARROW", True, "MODERATE"), (None, "INSIDE", "WIDE", False, "LOW")]
    df = spark.createDataFrame(rows, "skill string, coverage string, width string, placeholder boolean, want string")
    got = df.select("want", checks.combined_level(F.col("skill"), F.col("coverage"), F.col("width"), F.col("placeholder")).alias("level")).collect()
    assert all(r.want == r.level for r in got)
    grades = spark.createDataFrame([(x,) for x in (None, 0.2, 0.3, 0.5)], "x double").select(checks.spread_of_extent(F.col("x")).alias("w"), checks.coverage_of_samples(1 - F.col("x")).alias("c")).collect()
    assert [r.w for r in grades] == ["NARROW", "NARROW", "MEDIUM", "WIDE"] and [r.c for r in grades][1:] == ["EDGE", "OUTSIDE", "OUTSIDE"]
    levels = spark.createDataFrame([(["HIGH", "LOW"],), (["HIGH", "MODERATE"],), (["HIGH"],)], "x array<string>").select(checks.overall_level(F.col("x")).alias("o")).collect()
    assert [r.o for r in levels] == ["LOW", "MODERATE", "HIGH"]
