"""What tasks and driver hold must not grow faster than the input."""

import random
import re
import tracemalloc
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from floodspark.operators import breach, grids, series, shapes, surrogate
from floodspark.streaming import streams


#: Seconds; Spark takes rows of before 1970 for late.
START = 1_700_000_000


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_cell_never_sends_points_to_the_driver(spark):
    points = spark.range(50).selectExpr("id as osm_id", "id * 7.0D % 100 as x_m", "id * 3.0D % 100 as y_m")
    cells = spark.range(4000).selectExpr("id as cell_id", "id % 40 * 5.0D as cx", "id div 40 * 5.0D as cy")
    got = grids.nearest_cell(points, cells, 12.0)
    plan = physical(got)
    assert "BuildLeft" not in plan and len(re.findall(r"(?:HashJoin|MergeJoin)", plan)) == 1
    want = {r.osm_id: min((((r.x_m - c % 40 * 5) ** 2 + (r.y_m - c // 40 * 5) ** 2) ** 0.5, c) for c in range(4000)) for r in points.collect()}
    assert {r.osm_id: r.cell_id for r in got.collect()} == {k: c if d <= 12 else None for k, (d, c) in want.items()}


def test_nearest_samples_need_no_join(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 900.0), (1, 1100.0), (1, 2600.0), (2, 1600.0), (3, -500.0), (4, 10.0), (4, 4000.0)], "s int, t_s double")
    got = series.nearest_samples(df, "s", 1000.0)
    assert "Join" not in physical(got)
    assert sorted(map(tuple, got.collect())) == [(1, 0.0), (1, 900.0), (1, 2600.0), (2, 1600.0), (4, 10.0), (4, 4000.0)]


def test_legs_are_dealt_before_they_are_cut(spark):
    lines = spark.range(3).selectExpr("id as line_id", "array(named_struct('x', 0d, 'y', id * 1d), named_struct('x', 95d, 'y', id * 1d)) as line")
    got = shapes.line_lengths(lines, 10.0, 0.0, 100.0, 10, 10)
    plan = physical(got)  # from the result down: sums, shuffle of the sums, sums of a task, cuts, legs dealt
    assert "REPARTITION_BY_COL" in plan[plan.rindex("HashAggregate") :]
    assert [r.s for r in got.groupBy("line_id").sum("length_m").toDF("i", "s").collect()] == [95.0] * 3


def test_breaches_grow_on_all_cores(spark):
    columns = dict(v_w=1e6, h_w=20.0, width=60.0, h_b=20.0, t_f=3600.0, z=0.5, exponent=3.0)
    s = spark.range(0, 40, 1, 1).selectExpr("id as series_id", *(f"{v}D as {k}" for k, v in columns.items()))
    got = breach.grow_breach(s)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.filter("peak_q > 0").count() == 40


def test_a_curve_is_worked_out_once(spark):

    @F.udf("array<struct<x:double,y:double>>")
    def curve(i):
        return [(0.0, 0.0), (1.0, 2.0 + i), (3.0, 8.0 + i)]

    one = F.element_at(F.array(F.lit(2.0)), 1)
    expression = breach.interpolated(F.col("curve"), breach.interpolated(F.col("curve"), one), "y", "x")
    text = expression._jc.toString() if hasattr(expression, "_jc") else str(expression)
    assert len(re.findall(r"\bcurve\b", text)) == 2
    assert [r[0] for r in spark.range(3).withColumn("curve", curve("id")).select(expression).collect()] == [2.0] * 3


def test_little_text_makes_few_pairs_of_chunk_and_bucket(spark):
    from floodspark.llm import common

    few, key = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "211")
        assert common.parts(few) == 16 and common.parts(few, 100 << 20) == 50 and common.parts(few, 4 << 30) == 1024
        spark.conf.set(key, "4")
        assert common.parts(few) == 8 and common.parts(few, 100 << 20) == 25
    finally:
        spark.conf.set(key, before)


def test_crossings_keep_a_row_of_state_for_a_bucket(spark, tmp_path):
    """Many points, late rows, ties, nulls and a point without an id, in five batches."""
    rng = random.Random(2)
    rows = [(None if p == 0 else p, 60 * k + rng.randint(0, 59), rng.choice([None, 0.0, 3.0, 9.0, 10.0, rng.uniform(0, 13)])) for p in range(1500) for k in range(6)]
    rows += [(p, t, 1.0 + q) for p, t, q in rows[:600] if q is not None] + [(-5, 2000, 1.0)]
    arrived = sorted((t + rng.randint(0, 29), p, t, q) for p, t, q in ((-1 if p is None else p, t, -1.0 if q is None else q) for p, t, q in rows))
    size = -(-len(arrived) // 5)
    for k in range(5):
        part = [(None if p == -1 else p, datetime.fromtimestamp(START + t * 60, UTC), None if q == -1 else q) for _, p, t, q in arrived[k * size : (k + 1) * size]]
        spark.createDataFrame(part, "poi_id long, ts timestamp, q_m3s double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want, mark = {}, max(t for _, t, _ in rows) - 60
    for p in {p for p, _, _ in rows}:
        own, before = sorted((t, q) for x, t, q in rows if x == p and q is not None), None
        for t, q in own:
            if q >= 10:
                if t <= mark:
                    want[p] = 60.0 * (t if before is None else before[0] + (10 - before[1]) / (q - before[1]) * (t - before[0]))
                break
            before = t, q
    stream = spark.readStream.schema("poi_id long, ts timestamp, q_m3s double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.crossing_stream(stream, 10.0, "1 hour", buckets=16).writeStream.format("memory").queryName("buckets").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("buckets").collect()]
    assert {p for p, _ in got} == set(want) and len(got) == len(want) > 900 and None in want
    assert all(abs(t - START - want[p]) < 1e-3 for p, t in got)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 17


def test_depths_of_samples_are_decoded_in_small_blocks():
    rng = np.random.default_rng(1)
    sample, w = rng.normal(size=(2000, 3)), rng.normal(size=(3000, 3))
    mean = rng.normal(size=3000)
    batch = pa.record_batch({"mean": mean, "w": pa.array(list(w))})
    tracemalloc.start()
    rows = 0
    for part, depth in surrogate.depths(3, sample, batch):
        assert np.allclose(depth[0], np.maximum(np.expm1(mean[rows] + sample @ w[rows]), 0))
        rows += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 8e6
