"""Queries over nested documents that Spark writes from the dams: reading, rejecting, unfolding, and the rules of sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark.functions import site_checks
from floodspark.plans.other import folder
from floodspark.plans.registry import query
from floodspark.sources import documents
from floodspark.sources import views as v

#: Four dams a site, with faults that the key decides; the same columns for both engines.
DAM_COLUMNS = (
    "dam_id", "CAST(floor(dam_id / 4) AS BIGINT) AS s", "dam_id % 4 AS i", "concat('d', CASE WHEN dam_id % 28 = 5 THEN dam_id - 1 ELSE dam_id END) AS id",
    "CASE WHEN dam_type = 'CD' THEN 'concrete_dam' ELSE 'embankment_dam' END AS kind", "CASE WHEN dam_id % 11 = 0 THEN concat('d', dam_id + 1) WHEN dam_id % 4 > 0 THEN concat('d', dam_id - 1) END AS triggered_by",
    "dam_id % 3 = 0 AS has_trigger", "erodibility <> 'L' AS applies", "dam_id % 5 = 0 AS imposed", "h_b", "h_d - 6 AS h_d", "dam_id % 13 = 0 AS missing", "CASE WHEN dam_id % 26 = 0 THEN 'placeholder' ELSE 'measured' END AS status",
)


def texts(spark, sf) -> str:
    """A folder with one document a line; of every tenth site the last third is cut off."""
    d = v.dams(spark, sf).selectExpr(*DAM_COLUMNS)
    number = lambda value, status: F.struct(value.alias("value"), status.alias("status"))
    dam = F.struct(
        F.col("i"), F.col("id"), F.col("kind"), F.col("triggered_by"), F.when(F.col("has_trigger"), F.struct(F.lit(1.0).alias("stage_m"))).alias("trigger"), F.col("applies").alias("equations_applicable"),
        F.when(F.col("imposed"), F.struct(number(F.array(F.lit(600.0), F.lit(900.0)), F.lit("measured")).alias("failure_time_s"))).alias("imposed_ranges"),
        F.struct(number(F.col("h_b"), F.lit("measured")).alias("breach_height"), number(F.when(~F.col("missing"), F.col("h_d")), F.col("status")).alias("dam_height")).alias("breach_inputs"),
    )
    s = F.col("s")
    name = F.concat(F.lit("v"), s.cast("string"))
    domain = lambda box, metres, inflow: F.struct(number(box, F.lit("measured")).alias("bbox"), number(metres, F.lit("measured")).alias("grid_resolution"), F.struct(inflow.alias("from")).alias("inflow"))
    boxes = lambda *x: F.array(*(F.lit(float(y)) if isinstance(y, int) else y for y in x))
    first = F.concat(F.lit("d"), (s * 4).cast("string"))
    doc = d.groupBy("s").agg(F.array_sort(F.collect_list(dam)).alias("dams")).select(
        "s", F.to_json(F.struct(
            F.lit(1).alias("schema_version"), F.struct(name.alias("id")).alias("site"), "dams",
            F.struct(
                domain(boxes(0, 0, 10, 10), F.lit(20.0), F.when(s % 9 == 0, F.lit("zzz")).otherwise(first)).alias("far_field"),
                domain(boxes(1, 1, (5 + s % 8).cast("double"), 5), F.element_at(F.array(*map(F.lit, (10.0, 5.0, 8.0, 40.0))), (s % 4 + 1).cast("int")), F.lit("far_field")).alias("near_field"),
            ).alias("domains"),
            F.when(s % 3 != 0, F.struct(F.when(s % 2 == 0, "two_stage_imposed").otherwise("coupled").alias("approach"))).alias("cascade"),
            F.array(F.struct(F.lit("e1").alias("id"), F.create_map(F.when(s % 4 == 1, F.concat(F.lit("x"), s.cast("string"))).otherwise(first), F.lit(0.0)).alias("breach_times"))).alias("events"),
            F.struct(F.struct(F.array(F.concat(F.when(s % 5 == 0, F.lit("x")).otherwise(name), F.lit("__s001")), F.concat(name, F.when(s % 6 == 0, F.lit("__q1")).otherwise(F.lit("__hist_a1")))).alias("scenarios")).alias("sph")).alias("simulation"),
        )).alias("value"))
    path = folder(spark)
    doc.select(F.when(s % 10 == 3, F.substring("value", F.lit(1), (F.length("value") * 2 / 3).cast("int"))).otherwise(F.col("value")).alias("value")).write.text(path)
    return path


SITES = f"w AS MATERIALIZED (SELECT {', '.join(DAM_COLUMNS)} FROM dams), dm AS MATERIALIZED (SELECT *, 'dams[' || row_number() OVER (PARTITION BY s ORDER BY i) - 1 || ']' AS at_path FROM w WHERE s % 10 <> 3), st AS (SELECT DISTINCT s FROM dm)"


@query(f"""WITH {SITES}, x AS (SELECT s, 'dam:' || id AS path, 'duplicate_id' AS rule FROM dm GROUP BY s, id HAVING count(*) > 1
UNION ALL SELECT s, at_path, 'triggered_by_not_before' FROM dm a WHERE triggered_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dm b WHERE b.s = a.s AND b.i < a.i AND b.id = a.triggered_by)
UNION ALL SELECT s, at_path, 'trigger_without_triggered_by' FROM dm WHERE triggered_by IS NULL AND has_trigger
UNION ALL SELECT s, at_path, 'triggered_without_cascade' FROM dm WHERE triggered_by IS NOT NULL AND s % 3 = 0
UNION ALL SELECT s, at_path, 'two_stage_without_trigger' FROM dm WHERE triggered_by IS NOT NULL AND s % 3 <> 0 AND s % 2 = 0 AND NOT has_trigger
UNION ALL SELECT s, at_path, 'concrete_with_equations' FROM dm WHERE kind = 'concrete_dam' AND applies
UNION ALL SELECT s, at_path, 'no_imposed_ranges' FROM dm WHERE NOT applies AND NOT imposed
UNION ALL SELECT s, at_path, 'warn_breach_over_dam' FROM dm WHERE NOT missing AND h_b > h_d
UNION ALL SELECT s, at_path || '.breach_inputs.dam_height', 'null_without_placeholder' FROM dm WHERE missing AND status <> 'placeholder'
UNION ALL SELECT s, 'events.e1.x' || s, 'unknown_dam' FROM st WHERE s % 4 = 1
UNION ALL SELECT s, 'events.e1.d' || s * 4, 'unknown_dam' FROM st WHERE s % 4 <> 1 AND NOT EXISTS (SELECT 1 FROM dm WHERE dm.s = st.s AND id = 'd' || st.s * 4)
UNION ALL SELECT s, 'domains.far_field.inflow', 'unknown_inflow' FROM st WHERE s % 9 = 0 OR NOT EXISTS (SELECT 1 FROM dm WHERE dm.s = st.s AND id = 'd' || st.s * 4)
UNION ALL SELECT s, 'domains.near_field.bbox', 'outside_far_field' FROM st WHERE 5 + s % 8 > 10
UNION ALL SELECT s, 'domains.near_field.grid_resolution', 'does_not_divide' FROM st WHERE s % 4 IN (2, 3)
UNION ALL SELECT s, 'scenarios.x__s001', 'other_site' FROM st WHERE s % 5 = 0 UNION ALL SELECT s, 'scenarios.v' || s || '__q1', 'unknown_shape' FROM st WHERE s % 6 = 0)
SELECT 'v' || s AS site_id, path, rule FROM x""")
def m15_site_rules(spark, sf):
    return site_checks.site_violations(documents.accepted(documents.documents(spark, texts(spark, sf), "site", one_a_line=True)))


@query(f"WITH {SITES} SELECT 'v' || s AS site_id, coalesce(string_agg(CASE WHEN missing AND status = 'placeholder' OR status = 'placeholder' THEN at_path || '.breach_inputs.dam_height' END, ',' ORDER BY at_path), '') AS paths FROM dm GROUP BY s")
def m15_placeholders(spark, sf):
    sites = documents.accepted(documents.documents(spark, texts(spark, sf), "site", one_a_line=True))
    return site_checks.placeholders(sites).select("site_id", F.array_join("paths", ",").alias("paths"))


@query("SELECT rejected, count(*) AS n, sum(CASE WHEN NOT rejected THEN k ELSE 0 END)::BIGINT AS dams FROM (SELECT dam_id // 4 AS s, (dam_id // 4) % 10 = 3 AS rejected, count(*) AS k FROM dams GROUP BY ALL) GROUP BY rejected")
def s4_site_documents(spark, sf):
    """Documents read and rejected, and the dams of those read."""
    read = documents.documents(spark, texts(spark, sf), "site", one_a_line=True)
    return read.groupBy(F.col("rejected").isNotNull().alias("rejected")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("rejected").isNull(), F.size("doc.dams"))), F.lit(0)).alias("dams"))


@query("SELECT 'v' || dam_id // 16 AS site_id, 'v' || dam_id // 16 || '__s' || lpad(CAST(dam_id % 16 AS VARCHAR), 3, '0') AS scenario_id, dam_id % 16 > 12 AS is_extra, unnest(['height_m', 'width_m']) AS input, unnest([h_w, w_ave]) AS value, unnest([h_w NOT BETWEEN 6 AND 25, w_ave NOT BETWEEN 12 AND 40]) AS outside FROM dams")
def s4_scenario_designs(spark, sf):
    """Designs written as documents, read, and unfolded into a row for each parameter."""
    k, place = F.col("dam_id"), F.col("dam_id") % 16
    site = F.concat(F.lit("v"), F.floor(k / 16).cast("string"))
    one = F.struct(F.concat(site, F.lit("__s"), F.lpad(place.cast("string"), 3, "0")).alias("scenario_id"), F.lit("m5").alias("kind"), F.create_map(F.lit("height_m"), F.col("h_w"), F.lit("width_m"), F.col("w_ave")).alias("params"))
    limit = lambda name, low, high: F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    doc = v.dams(spark, sf).groupBy(site.alias("site_id")).agg(F.collect_list(F.when(place <= 12, one)).alias("scenarios"), F.collect_list(F.when(place > 12, one)).alias("extra"))
    path = folder(spark)
    doc.select(F.to_json(F.struct("*", F.array(limit("height_m", 6.0, 25.0), limit("width_m", 12.0, 40.0)).alias("inputs"))).alias("value")).write.text(path)
    return documents.design_rows(documents.accepted(documents.documents(spark, path, "scenario_design", one_a_line=True))).drop("kind")
