"""Rules that hold between the parts of a site configuration (``sources.documents``, kind site). Each is an expression over one document;
a document is a row, so sites are checked side by side and nothing is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Shapes of a scenario id behind <site>__; fixed values.
SUFFIX = r"^(s\d{3}|demo_s\d{3}|hist_[a-z][a-z0-9_]*|n_[a-z][a-z0-9_]*)$"

LEAF = "array<struct<path:string,status:string,missing:boolean>>"
BROKEN = "array<struct<path:string,rule:string>>"


def leaves(column: Column, kind: DataType, path: Column) -> Column:
    """All sourced values (structs with value and status) below a column, with dotted paths: an array of path, status, missing."""
    none = F.array().cast(LEAF)
    if isinstance(kind, StructType):
        if {"value", "status"} <= set(kind.fieldNames()):
            leaf = F.struct(path.alias("path"), column["status"].alias("status"), column["value"].isNull().alias("missing"))
            return F.when(column.isNull(), none).otherwise(F.array(leaf).cast(LEAF))
        parts = [leaves(column[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if isinstance(f.dataType, (StructType, ArrayType, MapType))]
        return F.concat(none, *parts)
    if isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, (StructType, ArrayType, MapType)):
            return none
        each = F.transform(column, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), none)
    if isinstance(kind, MapType):
        if not isinstance(kind.valueType, (StructType, ArrayType, MapType)):
            return none
        each = F.transform(F.map_entries(column), lambda e: leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"])))
        return F.coalesce(F.flatten(each), none)
    return none


def sourced_values(sites: DataFrame) -> DataFrame:
    """site_id, path, status and missing of every sourced value of every site."""
    parts = [leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in sites.schema.fields if isinstance(f.dataType, (StructType, ArrayType, MapType))]
    return sites.select(F.col("site.id").alias("site_id"), F.explode(F.concat(*parts)).alias("v")).select("site_id", "v.*")


def placeholders(sites: DataFrame) -> DataFrame:
    """site_id and the paths whose values are placeholders, sorted; sites without one have an empty list."""
    found = sourced_values(sites).filter("status = 'placeholder'").groupBy("site_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return sites.select(F.col("site.id").alias("site_id")).join(found, "site_id", "left").select("site_id", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def when(bad: Column, path: Column, rule: str) -> Column:
    """An array with the broken rule, or without anything (also where the test is null)."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array()).cast(BROKEN)


def over(items: Column, check) -> Column:
    """The broken rules of all items (item, its number from 0) of an array; none if it is null."""
    return F.coalesce(F.flatten(F.transform(items, check)), F.array().cast(BROKEN))


def repeated(ids: Column, label: str) -> Column:
    twice = lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1
    return over(F.array_distinct(ids), lambda x: when(twice(x), F.concat(F.lit(f"{label}:"), x), "duplicate_id"))


def site_violations(sites: DataFrame) -> DataFrame:
    """site_id, path and rule of everything that breaks a rule. Rules: at least one dam; ids of dams, points and events occur once; a dam
    is triggered by one listed before it, has a trigger only if so, and needs a cascade; an imposed cascade in two stages needs a
    trigger at each triggered dam; concrete dams take no equations, and dams without equations have imposed ranges; inflows come from a
    dam (or, near, from the far field); breach times and scenario ids name what exists; the near box lies in the far one and its
    resolution divides the far one's; values are null only as placeholders. A breach higher than its dam is ``warn_breach_over_dam``."""
    ids = F.coalesce(F.col("dams")["id"], F.array().cast("array<string>"))
    site = F.col("site.id")
    far, near = F.col("domains.far_field"), F.col("domains.near_field")

    def dam(d: Column, i: Column) -> Column:
        at = F.concat(F.lit("dams["), i.cast("string"), F.lit("]"))
        by, applies = d["triggered_by"], F.coalesce(d["equations_applicable"], F.lit(True))
        cascade = F.col("cascade")
        return F.concat(
            when(by.isNotNull() & ~F.coalesce(F.array_contains(F.slice(ids, F.lit(1), i), by), F.lit(False)), at, "triggered_by_not_before"),
            when(by.isNull() & d["trigger"].isNotNull(), at, "trigger_without_triggered_by"),
            when(by.isNotNull() & cascade.isNull(), at, "triggered_without_cascade"),
            when(by.isNotNull() & (cascade["approach"] == "two_stage_imposed") & d["trigger"].isNull(), at, "two_stage_without_trigger"),
            when((d["kind"] == "concrete_dam") & applies, at, "concrete_with_equations"),
            when(~applies & d["imposed_ranges"].isNull(), at, "no_imposed_ranges"),
            when(d["breach_inputs"]["breach_height"]["value"] > d["breach_inputs"]["dam_height"]["value"], at, "warn_breach_over_dam"),
        )

    def event(e: Column) -> Column:
        return over(F.map_keys(e["breach_times"]), lambda k: when(~F.array_contains(ids, k), F.concat(F.lit("events."), e["id"], F.lit("."), k), "unknown_dam"))

    def scenario(s: Column) -> Column:
        head = F.concat(site, F.lit("__"))
        rest = F.substring(s, F.length(head) + 1, F.length(s))
        return F.concat(when(~F.startswith(s, head), F.concat(F.lit("scenarios."), s), "other_site"), when(F.startswith(s, head) & ~rest.rlike(SUFFIX), F.concat(F.lit("scenarios."), s), "unknown_shape"))

    box = lambda d, k: F.get(d["bbox"]["value"], k)
    inside = (box(far, 0) <= box(near, 0)) & (box(far, 1) <= box(near, 1)) & (box(near, 2) <= box(far, 2)) & (box(near, 3) <= box(far, 3))
    ratio = far["grid_resolution"]["value"] / near["grid_resolution"]["value"]
    known = lambda d, more: F.coalesce(F.array_contains(F.concat(ids, F.array(*map(F.lit, more)).cast("array<string>")), d["inflow"]["from"]), F.lit(False))
    values = F.concat(*(leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in sites.schema.fields if isinstance(f.dataType, (StructType, ArrayType, MapType))))
    every = F.concat(
        when(F.size(ids) == 0, F.lit("dams"), "no_dams"),
        repeated(ids, "dam"), repeated(F.col("points_of_interest")["id"], "point_of_interest"), repeated(F.col("events")["id"], "event"),
        over(F.col("dams"), dam), over(F.col("events"), event), over(F.col("simulation.sph.scenarios"), scenario),
        when(~known(far, []), F.lit("domains.far_field.inflow"), "unknown_inflow"), when(~known(near, ["far_field"]), F.lit("domains.near_field.inflow"), "unknown_inflow"),
        when(~inside, F.lit("domains.near_field.bbox"), "outside_far_field"),
        when((ratio < 1) | (F.abs(ratio - F.round(ratio)) > 1e-9), F.lit("domains.near_field.grid_resolution"), "does_not_divide"),
        over(values, lambda x: when(x["missing"] & (F.coalesce(x["status"], F.lit("")) != "placeholder"), x["path"], "null_without_placeholder")),
    )
    return sites.select(site.alias("site_id"), F.explode(every).alias("v")).select("site_id", "v.*")
