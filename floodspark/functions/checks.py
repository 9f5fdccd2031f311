"""Small rules: confidence, names, log facts, times, contract checks and job progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(width: Column, centre: Column, narrow: tuple[float, float], medium: tuple[float, float]) -> Column:
    """NARROW, MEDIUM or WIDE by an absolute or a relative width (relative to 0 never holds)."""
    within = lambda limits: (width <= limits[0]) | ((F.abs(centre) > 0) & (width <= limits[1] * F.abs(centre)))
    return F.when(width.isNull(), None).when(within(narrow), "NARROW").when(within(medium), "MEDIUM").otherwise("WIDE")


def spread_of_extent(possible_share: Column) -> Column:
    """By the share of the flooded area that is only possible; NARROW where nothing is flooded (null)."""
    return F.when(possible_share.isNull() | (possible_share <= 0.2), "NARROW").when(possible_share <= 0.4, "MEDIUM").otherwise("WIDE")


def coverage_of_samples(inside_share: Column) -> Column:
    """INSIDE, EDGE or OUTSIDE by the share of samples inside the training box."""
    return F.when(inside_share >= 0.95, "INSIDE").when(inside_share >= 0.8, "EDGE").otherwise("OUTSIDE")


def combined_level(skill: Column, coverage: Column, width: Column, placeholder: Column | None = None, fallback: Column | None = None) -> Column:
    """HIGH, MODERATE or LOW from validation skill (FAIR, POOR and UNKNOWN are weak), coverage (EDGE, OUTSIDE) and spread (MEDIUM,
    WIDE): LOW outside the box, from an empirical fallback or with two weak ones, MODERATE with one or with placeholder inputs."""
    weak = sum(F.when(F.coalesce(c.isin(*names), F.lit(True)), 1).otherwise(0) for c, names in ((skill, ("FAIR", "POOR", "UNKNOWN")), (coverage, ("EDGE", "OUTSIDE")), (width, ("MEDIUM", "WIDE"))))
    low = (coverage == "OUTSIDE") | F.coalesce(F.lit(False) if fallback is None else fallback, F.lit(False)) | (weak >= 2)
    capped = (weak == 1) | F.coalesce(F.lit(False) if placeholder is None else placeholder, F.lit(False))
    return F.when(low, "LOW").when(capped, "MODERATE").otherwise("HIGH")


def overall_level(levels: Column) -> Column:
    """The lowest of an array of levels."""
    has = lambda x: F.array_contains(levels, x)
    return F.when(has("LOW"), "LOW").when(has("MODERATE"), "MODERATE").otherwise("HIGH")


def combined(checks: Column) -> Column:
    """Level of an array of grades 2 (good), 1 (fair), 0 (poor): Low with a poor one, High with all good, else Medium."""
    return F.when(F.exists(checks, lambda x: x == 0), "Low").when(F.forall(checks, lambda x: x == 2), "High").otherwise("Medium")


def worst(levels: DataFrame, key: str) -> DataFrame:
    rank = F.when(F.col("level") == "Low", 0).when(F.col("level") == "Medium", 1).otherwise(2)
    return levels.groupBy(key).agg(F.min_by("level", F.struct(rank, "level")).alias("level"))


def scenario_id(site: Column, number: Column) -> Column:
    return F.concat(site, F.lit("__s"), F.lpad(number.cast("string"), 3, "0"))


def parts_of(run_id: Column) -> tuple[Column, Column, Column]:
    """Site, scenario number and model of <site>__s001__<model>; null where the pattern does not hold."""
    ok = run_id.rlike(r"^[a-z0-9_]+?__s\d{3}__[a-z0-9]+$")
    part = lambda k: F.when(ok, F.regexp_extract(run_id, r"^([a-z0-9_]+?)__s(\d{3})__([a-z0-9]+)$", k))
    return part(1), part(2).cast("int"), part(3)


#: What ids look like; fixed values. The first group is the site where an id has one.
SITE, SLUG = "[a-z][a-z0-9_]{2,31}?", "[a-z][a-z0-9_]*"
STAMP = "[0-9]{8}T[0-9]{6}Z_[0-9a-f]{6}"
ID_KINDS = {
    "job": f"^job_({STAMP})$",
    "query": f"^q_({STAMP})$",
    "month": "^([0-9]{4}-(?:0[1-9]|1[0-2]))$",
    "poi": f"^({SITE})__poi__({SLUG})$",
    "design": f"^({SITE})__s([0-9]{{3}})$",
    "historical": f"^({SITE})__hist_([a-z0-9_]*?[a-z0-9])$",
    "demo": f"^({SITE})__demo_s([0-9]{{3}})$",
    "named": f"^({SITE})__n_([a-z0-9_]*?[a-z0-9])$",
    "dam": f"^({SITE})__({SLUG})$",
}
RUN = f"^({SITE})__((?:s[0-9]{{3}}|demo_s[0-9]{{3}}|hist_[a-z0-9_]+?|n_[a-z0-9_]+?)__[a-z0-9]+)$"


def parsed_id(value: Column) -> Column:
    """kind, site (null for jobs, queries and months) and local part of an id; null where no pattern holds. A scenario
    with a model behind it is a run; what has no other form is a dam."""
    kinds = [("run", RUN), *ID_KINDS.items()]
    local = lambda kind, p: (F.lit(None).cast("string"), F.regexp_extract(value, p, 1)) if kind in ("job", "query", "month") else (F.regexp_extract(value, p, 1), F.regexp_extract(value, p, 2))
    parts = [(kind, p, *local(kind, p)) for kind, p in kinds]
    return F.coalesce(*(F.when(value.rlike(p), F.struct(F.lit(kind).alias("kind"), site.alias("site"), rest.alias("local"))) for kind, p, site, rest in parts))


def local_id(site: Column, slug: Column, kind: str = "dam") -> Column:
    """Id of a dam or of a point of interest of a site."""
    return F.concat_ws("__", site, *([F.lit("poi")] if kind == "poi" else []), slug)


def stamped_id(prefix: str, at: Column, number: Column) -> Column:
    """Id of a job or a query: time in UTC and the last six hex digits of a number."""
    utc = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(F.lit(f"{prefix}_"), utc, F.lit("_"), F.lpad(F.lower(F.hex(F.pmod(number, F.lit(1 << 24)))), 6, "0"))


def profile_points(pois: DataFrame, width: int, cell_m: float) -> DataFrame:
    """Points (site, name, cell_id) on the profile: their id, and the chainage of the middle of their column."""
    return pois.select(local_id(F.col("site"), F.col("name"), "poi").alias("poi_id"), "name", ((F.col("cell_id") % width + 0.5) * cell_m).alias("chainage_m"))


def solver_facts(lines: DataFrame, solver: str) -> DataFrame:
    """Per run what its log (run_id, n, line) says: the first number of particles, version after the solver's name, begin and end (UTC),
    and the last computation time in seconds, or the time from begin to end if none is said; null where the log is silent or a stamp
    is no time."""
    line = F.col("line")
    part = lambda pattern, k=1: F.when(line.rlike(pattern), F.regexp_extract(line, pattern, k))
    known = lambda c: F.when(c.isNotNull(), F.struct("n", "line"))

    def stamp(word: str) -> Column:
        at = rf"(?i)computation {word}\s+at:\s*(\d\d):(\d\d):(\d\d),\s*(\d\d)-(\d\d)-(\d{{4}})"
        return F.try_make_timestamp(*(part(at, k).cast("int") for k in (6, 5, 4, 1, 2)), part(at, 3).cast("decimal(8,6)"), F.lit("UTC"))

    found = {
        "particles": F.regexp_replace(part(r"Total particles:\s*(\d[\d,]*)"), ",", "").try_cast("bigint"),
        "version": part(rf"{solver}\s+v?(\d[\d.]*)"),
        "started": stamp("started"),
        "finished": stamp("finished"),
    }
    said = part(r"(?i)total computation time\s*\(s\)\s*:\s*(\d+(?:\.\d+)?)").cast("double")
    out = lines.groupBy("run_id").agg(*(F.min_by(c, known(c)).alias(name) for name, c in found.items()), F.max_by(said, known(said)).alias("said_s"))
    between = (F.unix_micros("finished") - F.unix_micros("started")) / 1e6
    return out.select("run_id", *found, F.coalesce("said_s", between).alias("wall_s"))


def log_facts(lines: DataFrame) -> DataFrame:
    """Per run the last error percentage, clock time in seconds and the number of error lines of its log (run_id, n, line)."""
    value = lambda pattern: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("n")))
    clock = F.when(F.col("line").rlike(r"elapsed (\d+):(\d+):(\d+)"), sum(F.regexp_extract("line", r"elapsed (\d+):(\d+):(\d+)", k).cast("int") * s for k, s in ((1, 3600), (2, 60), (3, 1))))
    return lines.groupBy("run_id").agg(last(value(r"error\s*=\s*([-0-9.]+)\s*%")).cast("double").alias("error_pct"), last(clock).alias("elapsed_s"), F.count_if(F.col("line").rlike("(?i)^\\s*error\\b")).alias("n_errors"))


def start_time(peak: Column, duration_s: Column) -> Column:
    """Time of the begin of an event of known peak and duration."""
    return F.timestamp_micros(F.unix_micros(peak) - (duration_s * 500_000).cast("long"))


def violations(values: DataFrame) -> DataFrame:
    """Broken rules of sourced values (path, value, status, low, high): null only for placeholders, and in range."""
    rule = F.array_compact(F.array(F.when(F.col("value").isNull() & (F.col("status") != "placeholder"), "null_without_placeholder"), F.when(F.col("value") < F.col("low"), "below_range"), F.when(F.col("value") > F.col("high"), "above_range")))
    return values.select("path", F.explode(rule).alias("rule"))


def not_increasing(curves: DataFrame) -> DataFrame:
    """Curves (curve_id, points array of x, y) whose x or y do not increase strictly."""
    bad = F.exists(F.sequence(F.lit(1), F.size("points") - 1), lambda i: (F.element_at("points", i + 1)["x"] <= F.element_at("points", i)["x"]) | (F.element_at("points", i + 1)["y"] <= F.element_at("points", i)["y"]))
    return curves.filter(F.when(F.size("points") > 1, bad).otherwise(F.lit(False))).select("curve_id")


def progress(runs: DataFrame) -> DataFrame:
    """Per job: runs done, failed and in all, and the time left at the mean time of those done."""
    done = F.col("status") == "postprocessed"
    out = runs.groupBy("job_id").agg(F.count_if(done).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"), F.avg(F.when(done, F.col("wall_s"))).alias("mean_s"))
    return out.withColumn("eta_s", F.col("mean_s") * (F.col("total") - F.col("done") - F.col("failed"))).drop("mean_s")


def campaign_status(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """Per job: runs done and in all, the first run in ``order`` that is running (else the first queued), the failed ones in order, and
    the time that all runs not done take at the mean time of those done (null if none is; a failed run is to be done again)."""
    done, status = F.col("status") == "postprocessed", F.col("status")
    first = lambda x: F.min_by(F.when(status == x, F.col("run_id")), F.when(status == x, F.struct(order, "run_id")))
    failed = F.array_sort(F.collect_list(F.when(status == "failed", F.struct(F.col(order).alias("at"), "run_id"))))
    out = runs.groupBy("job_id").agg(F.count_if(done).alias("done"), F.count("*").alias("total"), F.coalesce(first("running"), first("queued")).alias("running"), F.transform(failed, lambda x: x["run_id"]).alias("failed"), F.avg(F.when(done, F.col("wall_s"))).alias("mean_s"))
    return out.withColumn("eta_s", F.col("mean_s") * (F.col("total") - F.col("done"))).drop("mean_s")


def oldest_active(runs: DataFrame, active: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """site_id and the run that has waited longest (created, then run_id) of those active; sites without one are left out."""
    return runs.filter(F.col("status").isin(*active)).groupBy("site_id").agg(F.min_by("run_id", F.struct("created", "run_id")).alias("run_id"), F.count("*").alias("n_active"))


def library_age(sites: DataFrame, today: str, every_days: int) -> DataFrame:
    """site_id, age_days of the surrogate (trained) and the due date of the next check (checked, or trained if never
    checked, plus ``every_days``), and whether it is due."""
    due = F.date_add(F.coalesce("checked", "trained"), every_days)
    return sites.select("site_id", F.datediff(F.lit(today).cast("date"), "trained").alias("age_days"), due.alias("due"), (due <= F.lit(today).cast("date")).alias("is_due"))


def stamped(features: DataFrame, **constants: str) -> DataFrame:
    """Properties (a map) with constants set and the year of ``date`` as onset_year."""
    more = F.create_map(*(y for k, x in constants.items() for y in (F.lit(k), F.lit(x))), F.lit("onset_year"), F.substring(F.col("properties")["date"], 1, 4))
    kept = F.map_filter("properties", lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return features.withColumn("properties", F.map_concat(kept, more))
