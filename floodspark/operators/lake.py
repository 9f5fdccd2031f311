"""Lake area and scenes: indices, masks, thresholds, composites and rechecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised_difference(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, (a - b) / (a + b))


#: Scene classes of cloud, that of snow and ice, and the reflectance of a digital number; fixed values.
CLOUD_CLASSES, ICE_CLASS, REFLECTANCE = (3, 8, 9, 10), 11, 1e-4


def optical(pixels: DataFrame) -> DataFrame:
    """Pixels (digital numbers b3 and b8, scene class scl) with the water index and near infrared reflectance, both null under
    cloud, and whether a pixel is valid and whether it is ice. A pixel without a class is not valid."""
    scl = F.col("scl")
    valid = F.coalesce(~scl.isin(*CLOUD_CLASSES), F.lit(False))
    return pixels.withColumns({"index": F.when(valid, normalised_difference(F.col("b3"), F.col("b8"))), "nir": F.when(valid, F.col("b8") * REFLECTANCE), "valid": valid, "ice": F.coalesce(scl == ICE_CLASS, F.lit(False))})


def optical_shares(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of all pixels that are valid and that are ice."""
    percent = lambda c: 100 * F.avg(F.col(c).cast("int"))
    return pixels.groupBy(*keys).agg(percent("valid").alias("valid_pct"), percent("ice").alias("snow_ice_pct"))


def water_mask(index: Column, threshold: float | Column, below: bool = False, nir: Column | None = None, nir_max: float = 0.15, slope: Column | None = None, slope_max: float = 10.0) -> Column:
    """Water where the index is at or over the threshold (at or below it for radar) and near infrared and
    slope are low; null is never water."""
    out = (index <= threshold) if below else (index >= threshold)
    for value, most in ((nir, nir_max), (slope, slope_max)):
        out = out if value is None else out & (value <= most)
    return F.coalesce(out, F.lit(False))


def otsu(values: DataFrame, key: str, value: str, low: float, high: float, bins: int = 256) -> DataFrame:
    """Otsu's threshold of each key's finite values, held to [low, high]; the middle of tied bins; the middle of
    the clamp for fewer than two or equal values. Values are counted by bin before any window."""
    v = values.filter(F.abs(value) < float("inf")).select(key, F.col(value).alias("v"))
    ends = v.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    keys = values.select(key).distinct().join(ends, key, "left")
    width = (F.col("hi") - F.col("lo")) / bins
    which = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = v.join(ends.filter("hi > lo"), key).groupBy(key, "lo", "hi", which.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.filter("hi > lo").select(key, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    c = every.join(counts.select(key, "bin", "n"), [key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("c", F.col("lo") + (F.col("bin") + 0.5) * width)
    w = Window.partitionBy(key).orderBy("bin")
    up, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    c = c.withColumn("w1", F.sum("n").over(up)).withColumn("s1", F.sum(F.col("n") * F.col("c")).over(up)).withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * F.col("c")).over(whole))
    w2, m1 = F.col("w") - F.col("w1"), F.col("s1") / F.greatest("w1", F.lit(1))
    m2 = (F.col("s") - F.col("s1")) / F.greatest(w2, F.lit(1))
    c = c.filter(F.col("bin") < bins - 1).withColumn("between", F.round(F.col("w1") * w2 * F.pow(m1 - m2, 2), 6))
    tied = c.withColumn("best", F.max("between").over(whole)).filter(F.col("between") == F.col("best"))
    middle = tied.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cs")).select(key, F.col("cs")[F.floor(F.size("cs") / 2).cast("int")].alias("t"))
    return keys.join(middle, key, "left").select(key, F.least(F.greatest(F.coalesce("t", F.lit((low + high) / 2)), F.lit(low)), F.lit(high)).alias("threshold"))


def cloud_fraction(pixels: DataFrame, classes: tuple[int, ...] = (3, 8, 9, 10)) -> DataFrame:
    """Cloudy share of each scene's pixels (scene_id, scl); a scene without pixels with a class is fully cloudy."""
    return pixels.groupBy("scene_id").agg(F.coalesce(F.avg(F.col("scl").isin(*classes).cast("double")), F.lit(1.0)).alias("cloud"), F.avg((F.col("scl") == 11).cast("double")).alias("ice"), F.avg(F.col("scl").isNotNull().cast("double")).alias("valid"))


def monthly_median(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("month", "cell_id").agg(F.percentile("vv", 0.5).alias("vv"), F.count("vv").alias("n"))


def search_scenes(scenes: DataFrame, cloud_max: float, most: int) -> DataFrame:
    """The newest scenes of each site and satellite with little enough cloud (radar has none); ties by id."""
    clear = scenes.filter((F.col("cloud_pct") <= cloud_max) | (F.col("satellite") == "sentinel-1"))
    w = Window.partitionBy("site_id", "satellite").orderBy(F.desc("acq_date"), "scene_id")
    return clear.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def clearest(scenes: DataFrame) -> DataFrame:
    """Clearest scene of each site and month; unknown cloud counts as 100; ties by id."""
    month = F.date_format("acq_date", "yyyy-MM")
    cloud = F.coalesce(F.col("cloud_pct"), F.lit(100))
    return scenes.groupBy("site_id", month.alias("month")).agg(F.min(F.struct(cloud.alias("cloud"), "scene_id")).alias("b")).select("site_id", "month", F.col("b.scene_id").alias("scene_id"), F.col("b.cloud").alias("cloud"))


def choose_method(ice: Column, cloud: Column, radar: Column, valid: Column, ice_max: float, cloud_max: float, valid_min: float) -> tuple[Column, Column]:
    """A month's product and, if it is skipped, the reason: ice first, then cloud, then radar."""
    usable = radar & (valid.isNull() | (valid >= valid_min))
    method = F.when(ice > ice_max, "skip").when(cloud <= cloud_max, "s2_water_index").when(usable, "s1_threshold").otherwise("skip")
    return method, F.when(ice > ice_max, "snow_ice").when((method == "skip"), "no_usable_scene")


def reference_area(series: DataFrame, libraries: DataFrame) -> DataFrame:
    """As of each library's training date: the latest area that is not null, that day included; null if none."""
    old = libraries.join(series.filter("area_m2 is not null"), "site_id").filter("d <= trained_at")
    found = old.groupBy("site_id").agg(F.max_by("area_m2", F.struct("d", "area_m2")).alias("reference_m2"))
    return libraries.select("site_id").join(found, "site_id", "left")


def latest_valid(series: DataFrame) -> DataFrame:
    return series.filter("area_m2 is not null").groupBy("site_id").agg(F.max_by("area_m2", F.struct("d", "area_m2")).alias("latest_m2"), F.max("d").alias("d"))


def recheck(areas: DataFrame, threshold_pct: float) -> DataFrame:
    """Change of the lake against the library's reference, whether the library is outdated, and why."""
    change = F.when(F.col("reference_m2") != 0, 100 * (F.col("latest_m2") - F.col("reference_m2")) / F.col("reference_m2"))
    outdated = F.coalesce(F.abs(change) >= threshold_pct, F.lit(False))
    reason = F.when(F.col("latest_m2").isNull(), "no_lake_area_data").when(F.col("reference_m2").isNull(), "no_trained_library").when(outdated, "outdated_lake_area_change").otherwise("within_threshold")
    return areas.select("site_id", change.alias("change_pct"), outdated.alias("outdated"), reason.alias("reason"))


def upsert(cached: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows replace cached ones of the same key."""
    return cached.join(fresh, keys, "left_anti").unionByName(fresh)


def months_to_fetch(have: DataFrame, first: str, last: str) -> DataFrame:
    """Months from first to last that a site lacks, and always the last two."""
    every = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    wanted = have.select("site_id").distinct().select("site_id", every.alias("m")).select("site_id", F.date_format("m", "yyyy-MM").alias("month"))
    recent = wanted.filter(F.col("month") >= F.date_format(F.add_months(F.lit(last).cast("date"), -1), "yyyy-MM"))
    return wanted.join(have, ["site_id", "month"], "left_anti").union(recent).distinct()


def halfhourly_to_daily(rates: DataFrame) -> DataFrame:
    """Catchment mean of half-hourly rates (mm/h), halved and summed by day."""
    mean = rates.groupBy("site_id", "ts").agg(F.avg("rate").alias("rate"))
    return mean.groupBy("site_id", F.to_date("ts").alias("d")).agg(F.sum(F.col("rate") * 0.5).alias("mm"))
