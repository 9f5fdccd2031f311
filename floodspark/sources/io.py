"""Readers and writers with explicit schemas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0
CELLS = "site_id int, run_id int, row int, col int, max_depth float, max_velocity float, arrival_s float"
CSV = {
    "timeseries": "poi_id string, t_s double, depth_m double, velocity_ms double, wse_m double",
    "damage_curves": "asset_class string, depth_m double, damage_fraction double, source string",
    "asset_values": "asset_class string, value_inr_per_unit double, unit string, source string, status string",
    "manning_n": "worldcover_code int, class string, n_default double, n_min double, n_max double, source string",
    "lake_area": "date date, area_m2 double, method string, cloud_pct double, scene_ids string",
    "rainfall": "date date, precip_mm double, dataset string, aggregation string",
    "scenes": "scene_id string, satellite string, date date, cloud_pct double",
    "routed_discharge": "t_s double, q_m3s double",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is
    configured and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_shared_dir", None) or tempfile.mkdtemp(prefix="spark-")
        spark._shared_dir = path
    return path


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later jobs read it, not the lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back. For loops of joins: a checkpoint keeps the optimiser's constraints of
    all rounds before, whose number can double with each."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_cells(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Cells with nodata as null; a cell off the grid is an error."""
    cells = spark.read.schema(CELLS).parquet(path)
    off = cells.filter(~(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))).limit(1).count()
    if off:
        raise ValueError("cells outside the grid")
    return cells.withColumns({c: F.when(F.col(c) != NODATA, F.col(c)) for c in ("max_depth", "max_velocity", "arrival_s")}).withColumn("cell_id", F.col("row").cast("long") * width + F.col("col"))


def write_cells(cells: DataFrame, path: str, tile: int = 256) -> None:
    """By site and run, each file a tile's cells in row-major order; null as nodata."""
    t = [F.floor(F.col(x) / tile).alias(f"_{x}") for x in ("row", "col")]
    values = {c: F.coalesce(F.col(c).cast("float"), F.lit(NODATA).cast("float")) for c in ("max_depth", "max_velocity", "arrival_s")}
    cells.withColumns(values).repartition("site_id", "run_id", *t).sortWithinPartitions("site_id", "run_id", *t, "row", "col").write.mode("overwrite").partitionBy("site_id", "run_id").parquet(path)


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A typed table; an empty string is null and a wrong header an error."""
    return spark.read.schema(CSV[kind]).option("header", True).option("enforceSchema", False).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def features(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """Features of GeoJSON documents, one in each file or on each line: kind, geometry type, coordinates of rings as JSON, and properties."""
    schema = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    return spark.read.schema(schema).option("multiLine", not one_a_line).json(path).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"))


def parsed_registry(runs: DataFrame) -> DataFrame:
    """Registry rows with their JSON column typed; a broken document gives nulls."""
    meta = F.from_json("meta_json", "wall_s double, model string")
    return runs.withColumn("meta", meta).select("*", F.col("meta.wall_s").alias("wall_s"), F.col("meta.model").alias("model")).drop("meta", "meta_json")


def osm_rows(elements: DataFrame, category: str) -> DataFrame:
    """Typed rows of map elements (type, id, lon, lat, tags, geometry): polygons of ``building`` (closed, four points or
    more), lines of ``highway`` (two or more), points of ``amenity`` (a way counts by its middle vertex)."""
    tag = F.col("tags")[category]
    g = F.col("geometry")
    closed = F.when(F.element_at(g, 1) == F.element_at(g, -1), g).otherwise(F.concat(g, F.slice(g, 1, 1)))
    kind = F.when(tag == "yes", F.lit(category)).otherwise(tag)
    base = elements.filter(tag.isNotNull()).select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_id"), kind.alias("kind"), F.col("tags")["name"].alias("name"), "type", "lon", "lat", g.alias("geometry"), closed.alias("closed"))
    if category == "building":
        return base.filter(F.col("type") == "way").filter(F.size("closed") >= 4).select("osm_id", "kind", "name", F.col("closed").alias("geometry"))
    if category == "highway":
        return base.filter((F.col("type") == "way") & (F.size("geometry") >= 2)).select("osm_id", "kind", "name", "geometry")
    middle = F.element_at("geometry", F.greatest(F.lit(1), (F.size("geometry") / 2 + 1).cast("int")))
    point = F.when(F.col("type") == "node", F.struct("lon", "lat")).otherwise(F.struct(middle["lon"].alias("lon"), middle["lat"].alias("lat")))
    return base.select("osm_id", "kind", "name", point.alias("point")).filter("point.lon is not null")


def kml_colour(rgb: Column, alpha: Column) -> Column:
    """aabbggrr of #rrggbb and an opacity from 0 to 1."""
    a = F.lpad(F.lower(F.hex(F.round(alpha * 255).cast("int"))), 2, "0")
    return F.lower(F.concat(a, F.substring(rgb, 6, 2), F.substring(rgb, 4, 2), F.substring(rgb, 2, 2)))


def placemarks(points: DataFrame) -> DataFrame:
    """A KML placemark for each point (osm_id, kind, lon, lat)."""
    return points.select("osm_id", F.format_string("<Placemark><name>%s</name><Point><coordinates>%.6f,%.6f</coordinates></Point></Placemark>", "kind", "lon", "lat").alias("kml"))


def feature_json(rows: DataFrame, *properties: str) -> DataFrame:
    """A GeoJSON feature for each point (lon, lat)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(*properties, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
