"""Flood tables as views over the order-and-event tables of the test data.

One site with a grid of 25 x 20 cells of 20 m, upper-left corner at (0, 400). ``WIDTH`` and the other
constants describe that grid; the operators take them as parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT, CELL, ORIGIN_X, ORIGIN_Y = 25, 20, 20.0, 0.0, 400.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, face_id, t_s, depth_m and velocity_ms: time x face stack of a solver, with nulls."""
    t = load(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    depth = F.when(F.col("l_linenumber") == 7, None).otherwise(F.greatest(F.col("l_quantity") - 30 - F.lit(0.8) * (part % WIDTH), F.lit(0.0)) / 10)
    return t.select(
        (F.col("l_suppkey") % 8).cast("int").alias("run_id"), (part % (WIDTH * HEIGHT)).cast("int").alias("face_id"),
        (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long") * 60).alias("t_s"),
        depth.alias("depth_m"), (F.col("l_discount") * 50).alias("velocity_ms"),
    )


def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_steps(spark, sf_dir).select("run_id").distinct()


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("poi_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 100).alias("depth_m"), (F.col("value") * 20).alias("q_m3s"), "event_id", "event_type")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    kinds = {"ECONOMY": "house", "SMALL": "bungalow", "MEDIUM": "retail", "LARGE": "warehouse", "PROMO": "hotel"}
    kind = F.coalesce(*(F.when(F.col("p_type") == k, v) for k, v in kinds.items()), F.lit("building"))
    key = F.col("p_partkey")
    return p.select(key.alias("osm_id"), kind.alias("kind"), ((key * 37 % 6000) / 10 - 50).alias("x_m"), ((key * 53 % 5000) / 10 - 50).alias("y_m"), (F.col("p_size") * 4.0).alias("area_m2"))


def dams(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    return load(spark, sf_dir, "part").select(
        key.alias("dam_id"), (F.col("p_retailprice") * F.pow(F.lit(10.0), 2 + size % 4)).alias("v_w"), (5 + size * 0.5).alias("h_w"), (6 + size * 0.5).alias("h_b"), (8 + size * 0.6).alias("h_d"),
        (10.0 + key % 40).alias("w_ave"), pick(["HD", "CD", "FD", "ZD"]).alias("dam_type"), pick(["O", "P"]).alias("failure_mode"), pick(["H", "M", "L"]).alias("erodibility"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    cloud = F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice").cast("long") % 101)
    return o.select(F.col("o_orderkey").alias("scene_id"), (F.col("o_custkey") % 20).cast("int").alias("site_id"), F.col("o_orderdate").cast("date").alias("acq_date"), F.when(F.col("o_orderstatus") == "F", "sentinel-1").otherwise("sentinel-2").alias("satellite"), cloud.alias("cloud_pct"))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 20).cast("int").alias("site_id"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_totalprice") / 10000).alias("mm"))


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") + 1
    return load(spark, sf_dir, "customer").select(key.alias("hybas_id"), F.floor(key / 2).cast("long").alias("next_down"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run registry with a JSON column."""
    o = load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "queued").otherwise("postprocessed")
    return o.select(F.format_string("s%d__r%d", F.col("o_custkey") % 20, F.col("o_orderkey")).alias("run_id"), (F.col("o_custkey") % 20).cast("int").alias("site_id"), F.col("o_custkey").alias("job_id"), status.alias("status"), F.to_json(F.struct(F.col("o_totalprice").alias("wall_s"), F.col("o_orderpriority").alias("model"))).alias("meta_json"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, cell_id, value: a stack of maps, one for each embedding."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("run_id"), F.posexplode("embedding").alias("cell_id", "value")).withColumn("value", F.col("value").cast("double"))


def dem(spark: SparkSession, sf_dir: str, sites: int = 8) -> DataFrame:
    """site_id, row, col, z: a sloping valley for each site, with a pit and holes where the data say so."""
    s = load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % sites).cast("int").alias("site_id"), (F.col("l_partkey") % (WIDTH * HEIGHT)).cast("int").alias("cell_id")).agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    row, col = F.floor(F.col("cell_id") / WIDTH).cast("int"), (F.col("cell_id") % WIDTH).cast("int")
    z = F.lit(100.0) - 0.5 * col + 0.3 * F.abs(row - 10) + F.col("q") % 7 * 0.1 - F.when(F.col("cell_id") % 37 == 0, 3.0).otherwise(0.0)
    return s.select("site_id", row.alias("row"), col.alias("col"), "cell_id", F.when(F.col("cell_id") % 83 != 5, z).alias("z"))


#: The same views for DuckDB.
SQL = {
    "map_steps": """SELECT CAST(l_suppkey % 8 AS INT) AS run_id, CAST(l_partkey % 500 AS INT) AS face_id, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 60 AS t_s,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE greatest(l_quantity - 30 - 0.8e0 * (l_partkey % 25), 0e0) / 10e0 END AS depth_m, l_discount * 50e0 AS velocity_ms FROM lineitem""",
    "gauges": "SELECT user_id AS poi_id, ts, value / 100e0 AS depth_m, value * 20e0 AS q_m3s, event_id, event_type FROM events",
    "buildings": """SELECT p_partkey AS osm_id, CASE p_type WHEN 'ECONOMY' THEN 'house' WHEN 'SMALL' THEN 'bungalow' WHEN 'MEDIUM' THEN 'retail' WHEN 'LARGE' THEN 'warehouse' WHEN 'PROMO' THEN 'hotel' ELSE 'building' END AS kind,
      (p_partkey * 37 % 6000) / 10e0 - 50e0 AS x_m, (p_partkey * 53 % 5000) / 10e0 - 50e0 AS y_m, p_size * 4e0 AS area_m2 FROM part""",
    "dams": """SELECT p_partkey AS dam_id, p_retailprice * power(10e0, 2 + p_size % 4) AS v_w, 5e0 + p_size * 0.5e0 AS h_w, 6e0 + p_size * 0.5e0 AS h_b, 8e0 + p_size * 0.6e0 AS h_d, 10e0 + p_partkey % 40 AS w_ave,
      CASE p_partkey % 4 WHEN 0 THEN 'HD' WHEN 1 THEN 'CD' WHEN 2 THEN 'FD' ELSE 'ZD' END AS dam_type, CASE p_partkey % 2 WHEN 0 THEN 'O' ELSE 'P' END AS failure_mode, CASE p_partkey % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'M' ELSE 'L' END AS erodibility FROM part""",
    "scenes": """SELECT o_orderkey AS scene_id, CAST(o_custkey % 20 AS INT) AS site_id, CAST(o_orderdate AS DATE) AS acq_date, CASE WHEN o_orderstatus = 'F' THEN 'sentinel-1' ELSE 'sentinel-2' END AS satellite,
      CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 101 END AS cloud_pct FROM orders""",
    "rain": "SELECT CAST(o_custkey % 20 AS INT) AS site_id, CAST(o_orderdate AS DATE) AS d, o_totalprice / 10000e0 AS mm FROM orders",
    "basins": "SELECT c_custkey + 1 AS hybas_id, CAST(floor((c_custkey + 1) / 2e0) AS BIGINT) AS next_down FROM customer",
    "runs": """SELECT printf('s%d__r%d', o_custkey % 20, o_orderkey) AS run_id, CAST(o_custkey % 20 AS INT) AS site_id, o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'postprocessed' END AS status,
      o_totalprice AS wall_s, o_orderpriority AS model FROM orders""",
    "vectors": "SELECT vec_id AS run_id, CAST(i - 1 AS INT) AS cell_id, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)",
    "dem": """SELECT site_id, cell_id, CAST(cell_id // 25 AS INT) AS row, CAST(cell_id % 25 AS INT) AS col, CASE WHEN cell_id % 83 <> 5 THEN 100e0 - 0.5e0 * (cell_id % 25) + 0.3e0 * abs(cell_id // 25 - 10) + q % 7 * 0.1e0 - CASE WHEN cell_id % 37 = 0 THEN 3e0 ELSE 0e0 END END AS z
      FROM (SELECT CAST(l_suppkey % 8 AS INT) AS site_id, CAST(l_partkey % 500 AS INT) AS cell_id, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""",
    "summary": "SELECT run_id, face_id, max(depth_m) AS max_depth, max(velocity_ms) AS max_velocity, min(CASE WHEN depth_m > 0.1e0 THEN t_s END) AS arrival_s FROM map_steps GROUP BY run_id, face_id",
    "pairs": "SELECT coalesce(a.face_id, b.face_id) AS face_id, a.max_depth AS depth_a, b.max_depth AS depth_b, a.max_velocity AS velocity_a, b.max_velocity AS velocity_b, a.arrival_s AS arrival_a, b.arrival_s AS arrival_b FROM (SELECT * FROM summary WHERE run_id = 0) a FULL JOIN (SELECT * FROM summary WHERE run_id = 1) b USING (face_id)",
    "zones": "SELECT face_id AS cell_id, avg(CASE WHEN max_depth > 0.3e0 THEN 1e0 ELSE 0e0 END) AS p, quantile_cont(max_depth, 0.1) AS d10, quantile_cont(max_depth, 0.5) AS d50, quantile_cont(max_depth, 0.9) AS d90, quantile_cont(CAST(arrival_s AS DOUBLE), 0.5) AS a50 FROM summary GROUP BY face_id",
}


def sql(query: str) -> str:
    """A DuckDB query with the views it names put in front."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in used and re.search(rf"\b{name}\b", text):
                need(SQL[name])
                used.append(name)

    need(query)
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    if query.startswith("WITH "):
        return f"WITH RECURSIVE {heads}, {query.removeprefix('WITH ').removeprefix('RECURSIVE ')}" if heads else query
    return f"WITH {heads} {query}" if heads else query
