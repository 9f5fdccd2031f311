"""Nested JSON documents with explicit schemas: site configurations, run records, scenario designs and breach parameters.

A document is a file of any number of lines, or one line of a file. What cannot be parsed, has a value of another type, or lacks its key
is kept apart with its text, so one bad file stops nothing. Blank files and lines are no documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = "struct<value:double,status:string,source:string,unit:string>"
#: Several sourced numbers: a box, or the ends of a range.
BOX = "struct<value:array<double>,status:string,source:string>"
DOMAIN = f"struct<bbox:{BOX},grid_resolution:{NUMBER},inflow:struct<`from`:string>>"
PARAMS = "map<string,double>"
METHODS = "methods:map<string,struct<value:double,status:string,reason:string,in_valid_range:boolean>>,low:double,high:double,unit:string,status:string"

#: Kind -> its key and its fields.
KINDS = {
    "site": (
        "site.id",
        f"""schema_version int, site struct<id:string,name:string>, domains struct<far_field:{DOMAIN},near_field:{DOMAIN}>,
        dams array<struct<id:string,name:string,kind:string,triggered_by:string,trigger:struct<stage_m:double>,equations_applicable:boolean,imposed_ranges:struct<peak_discharge_m3s:{BOX},breach_width_m:{BOX},failure_time_s:{BOX}>,
        breach_inputs:struct<water_volume:{NUMBER},height_of_water:{NUMBER},breach_height:{NUMBER},dam_height:{NUMBER},average_width:{NUMBER}>>>,
        cascade struct<approach:string>, points_of_interest array<struct<id:string,name:string,category:string>>, events array<struct<id:string,breach_times:{PARAMS}>>,
        simulation struct<sph:struct<scenarios:array<string>>>""",
    ),
    "run_meta": (
        "run_id",
        """contract_version string, run_id string, scenario_id string, model string, status string, solver_version string, resolution_m double, sim_duration_s double, wall_time_s double,
        mass_balance_error_pct double, thresholds struct<extent_m:double,arrival_m:double>, warnings array<string>, caveats array<string>, has_placeholders boolean, placeholder_fields array<string>,
        started_at timestamp, finished_at timestamp""",
    ),
    "scenario_design": (
        "site_id",
        f"""contract_version string, site_id string, model string, method string, seed long, n int, inputs array<struct<name:string,dam_id:string,low:double,high:double,unit:string>>,
        scenarios array<struct<scenario_id:string,kind:string,params:{PARAMS}>>, extra array<struct<scenario_id:string,kind:string,params:{PARAMS}>>, has_placeholders boolean, caveats array<string>""",
    ),
    "breach_params": (
        "site_id",
        f"""contract_version string, site_id string, has_placeholders boolean, placeholder_fields array<string>,
        dams array<struct<dam_id:string,equations_applicable:boolean,inputs_used:map<string,string>,parameters:map<string,struct<{METHODS}>>>>""",
    ),
}


def documents(spark: SparkSession, path: str, kind: str, one_a_line: bool = False) -> DataFrame:
    """Every document with its file, the fields of its kind in ``doc``, and ``rejected``: why it is none (null if it is one)."""
    key, fields = KINDS[kind]
    text = spark.read.text(path, wholetext=not one_a_line).select(F.col("_metadata.file_path").alias("file"), "value")
    read = text.withColumn("doc", F.from_json("value", f"{fields}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    why = F.when(broken, F.lit("not a document of this kind")).when(F.col(f"doc.{key}").isNull(), F.lit(f"no {key}"))
    return read.filter(F.col("value").rlike(r"\S")).withColumn("rejected", why).withColumn("doc", F.when(F.col("rejected").isNull(), F.col("doc").dropFields("_corrupt")))


def accepted(read: DataFrame) -> DataFrame:
    """The fields of the documents that could be read, and their file."""
    return read.filter("rejected is null").select("file", "doc.*")


def rejected(read: DataFrame) -> DataFrame:
    """file, text and reason of the others."""
    return read.filter("rejected is not null").select("file", F.col("value").alias("text"), F.col("rejected").alias("reason"))


def design_rows(designs: DataFrame) -> DataFrame:
    """site_id, scenario_id, kind, is_extra, input and value: a row for each parameter of each scenario; outside of the input's range is ``outside``."""
    both = lambda c, extra: F.transform(F.coalesce(F.col(c), F.array().cast(designs.schema["scenarios"].dataType)), lambda s: F.struct(s.alias("s"), F.lit(extra).alias("extra")))
    rows = designs.select("site_id", "inputs", F.explode(F.concat(both("scenarios", False), both("extra", True))).alias("e"))
    rows = rows.select("site_id", "inputs", F.col("e.s.scenario_id").alias("scenario_id"), F.col("e.s.kind").alias("kind"), F.col("e.extra").alias("is_extra"), F.explode("e.s.params").alias("input", "value"))
    limits = F.get(F.filter("inputs", lambda i: i["name"] == F.col("input")), 0)
    return rows.withColumn("limits", limits).select("site_id", "scenario_id", "kind", "is_extra", "input", "value", (~F.col("value").between(F.col("limits.low"), F.col("limits.high"))).alias("outside"))


def method_rows(params: DataFrame) -> DataFrame:
    """site_id, dam_id, output, method, value, status (ok without one) and reason of breach parameters."""
    dam = params.select("site_id", F.explode("dams").alias("d"))
    out = dam.select("site_id", F.col("d.dam_id").alias("dam_id"), F.explode("d.parameters").alias("output", "p"))
    return out.select("site_id", "dam_id", "output", F.explode("p.methods").alias("method", "m")).select("site_id", "dam_id", "output", "method", F.col("m.value").alias("value"), F.coalesce("m.status", F.lit("ok")).alias("status"), F.col("m.reason").alias("reason"))
