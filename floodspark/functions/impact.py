"""Rules of impact products: hazard and arrival classes, zones under low confidence, rounded numbers of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.operators.runs import class_of

# Edges of the hazard (depth x velocity, m2/s) and arrival (minutes) classes; fixed values, and parameters of the rules.
HAZARD_M2S = [0.5, 1.0, 3.0]
ARRIVAL_MIN = [15.0, 30.0, 60.0, 120.0, 180.0, 360.0]


def hazard_class(depth_m: Column, velocity_ms: Column, edges: list[float] = HAZARD_M2S) -> Column:
    """Number of edges that depth x velocity reaches; null where either is null. The two maxima may fall in different
    moments, so their product is on the safe side."""
    return class_of(depth_m * velocity_ms, edges)


def arrival_band(arrival_s: Column, edges_min: list[float] = ARRIVAL_MIN) -> Column:
    """Number of edges that the arrival reaches; null where the water never arrives."""
    return class_of(arrival_s / 60, edges_min)


def lead_time(arrival_s: Column, delay_s: float = 600.0) -> Column:
    """Time left after detection, not below 0."""
    return F.greatest(arrival_s - delay_s, F.lit(0.0))


def lowered(zone: Column, low_confidence: Column) -> Column:
    """A zone of low confidence counts as the next lower one."""
    return F.when(low_confidence, F.greatest(zone - 1, F.lit(0))).otherwise(zone)


def significant(value: Column, figures: int = 2) -> Column:
    """Rounded to so many significant figures, halves up; 0 stays 0."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - (figures - 1))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(value / step + 0.5) * step)


def shown(people: Column, floor: int = 50) -> Column:
    """Number of people as text: two significant figures, and no figure below ``floor``."""
    return F.when(people < floor, F.lit(f"< {floor}")).otherwise(significant(people).cast("long").cast("string"))


def people_by_band(cells: DataFrame) -> DataFrame:
    """band, high and high_or_possible: people of cells (zone, band, population) by arrival band; null: never."""
    people = F.col("population")
    return cells.groupBy("band").agg(F.sum(F.when(F.col("zone") == 2, people).otherwise(0.0)).alias("high"), F.sum(F.when(F.col("zone") >= 1, people).otherwise(0.0)).alias("high_or_possible"))
