"""Hand-computed cases of ids, solver logs, campaigns, nested grids, optical pixels and scaled values."""

import datetime

import pytest
from pyspark.sql import functions as F

from floodspark.functions import checks
from floodspark.operators import grids, lake, loss


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("teesta__south_lhonak", ("dam", "teesta", "south_lhonak")),
        ("teesta__poi__chungthang", ("poi", "teesta", "chungthang")),
        ("teesta__s007", ("design", "teesta", "007")),
        ("teesta__s007__sph", ("run", "teesta", "s007__sph")),
        ("teesta__hist_2023", ("historical", "teesta", "2023")),
        ("teesta__demo_s003", ("demo", "teesta", "003")),
        ("teesta__n_holdout001", ("named", "teesta", "holdout001")),
        ("job_20260924T101500Z_b17e02", ("job", None, "20260924T101500Z_b17e02")),
        ("q_20260924T101500Z_3fa9c1", ("query", None, "20260924T101500Z_3fa9c1")),
        ("2024-12", ("month", None, "2024-12")),
        ("2024-13", None), ("", None), ("Teesta__x", None), ("ab__x", None), (None, None),
    ],
)
def test_ids_are_parsed(spark, text, want):
    got = spark.createDataFrame([(text,)], "id string").select(checks.parsed_id(F.col("id"))).first()[0]
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_solver_facts_do_not_depend_on_the_session_zone(spark, zone):
    lines = [
        (1, 0, "Solver v5.4.1 here"), (1, 1, "Solver v6"), (1, 2, "Total particles: 1,234,567"),
        (1, 3, "Computation started  at: 23:59:30, 31-12-2024"), (1, 4, "Computation finished at: 00:00:15, 01-01-2025"),
        (2, 0, "Computation started at: 10:00:00, 01-02-2024"), (2, 1, "Total computation time (s) : 12.5"), (2, 2, "total computation time (s): 13"),
        (3, 0, "Computation started at: 99:00:00, 01-02-2024"), (3, 1, None),
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        out = checks.solver_facts(spark.createDataFrame(lines, "run_id int, n int, line string"), "Solver")
        got = {r.run_id: tuple(r)[1:] for r in out.select("run_id", "particles", "version", F.unix_seconds("started"), F.unix_seconds("finished"), "wall_s").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    at = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.UTC).timestamp())
    assert got[1] == (1234567, "5.4.1", at(2024, 12, 31, 23, 59, 30), at(2025, 1, 1, 0, 0, 15), 45.0)
    assert got[2] == (None, None, at(2024, 2, 1, 10), None, 13.0)
    assert got[3] == (None, None, None, None, None)


def test_campaign_status(spark):
    rows = [("j", "b", "postprocessed", 10.0), ("j", "a", "postprocessed", 20.0), ("j", "d", "queued", None), ("j", "e", "running", None), ("j", "c", "failed", None), ("k", "x", "queued", None), ("l", "y", "failed", 5.0)]
    got = {r.job_id: tuple(r)[1:] for r in checks.campaign_status(spark.createDataFrame(rows, "job_id string, run_id string, status string, wall_s double")).collect()}
    assert got == {"j": (2, 5, "e", ["c"], 45.0), "k": (0, 1, "x", [], None), "l": (0, 1, None, ["y"], None)}


def test_nested_grid(spark):
    far = (0.0, 100.0, 10, 10, 10.0)
    rows = [(1, 12.0, 33.0, 18.0, 50.0, 5.0, *far), (2, 12.0, 33.0, 18.0, 50.0, 4.0, *far), (3, -1.0, 33.0, 18.0, 50.0, 5.0, *far), (4, 1.0, 1.0, 2.0, 2.0, 20.0, *far)]
    got = {r.id: tuple(r)[1:] for r in grids.nested_grid(spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double, cell_m double, far_x double, far_y double, far_width int, far_height int, far_m double")).collect()}
    assert got[1] == (10.0, 50.0, 2, 4, None)
    assert got[2][4] == got[4][4] == "cell does not divide" and got[2][:4] == (None,) * 4
    assert got[3][4] == "outside far grid"


def test_optical_pixels(spark):
    rows = [(1, 300.0, 100.0, 6), (1, 300.0, 100.0, 9), (1, 0.0, 0.0, 11), (1, 1.0, 1.0, None)]
    p = lake.optical(spark.createDataFrame(rows, "k int, b3 double, b8 double, scl int"))
    assert [(r["index"], r.nir, r.valid, r.ice) for r in p.collect()] == [(0.5, 0.01, True, False), (None, None, False, False), (None, 0.0, True, True), (None, None, False, False)]
    assert tuple(lake.optical_shares(p, ["k"]).first()) == (1, 50.0, 25.0)


def test_values_scaled_by_product(spark):
    countries = spark.createDataFrame([("a", "x", 10.0), ("b", "y", 10.0), ("c", "z", 10.0)], "country string, region string, gdp double")
    regions = spark.createDataFrame([("x", 6.0, 3.0), ("y", 6.0, 0.0)], "region string, max_damage double, gdp double")
    out = loss.priced(loss.scaled_by_product(countries, regions), 2.0, 3.0, F.col("country") != "b")
    got = {r.country: (r.value_eur, r.value_inr, r.status) for r in out.collect()}
    assert got == {"a": (20.0, 120.0, "sourced"), "b": (None, None, "placeholder"), "c": (None, None, "sourced")}
