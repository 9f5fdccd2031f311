"""Positions inside groups and joins on hot keys, without a large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm import common as c

#: Keys with more than one in ``HOT`` of all rows are hot, so there are fewer than ``HOT`` of them.
HOT = 128


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` (stored) with pos, the place from 0 of each row in its group by ``order``, nulls first; rows equal in all
    of these take any order among themselves.

    Rows are range-partitioned by group and order, so that a group of any size is spread, and numbered inside each
    partition. A partition continues the group of those before it at most once, so the offsets that are broadcast are no more
    than the partitions.
    """
    pid, salt, base = c.unused(rows, "pid", "salt", "base")
    by = [F.asc_nulls_first(x) for x in (*group, *order)]
    ranged = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*by, F.asc(salt)).withColumn(pid, F.spark_partition_id())
    ranged = c.stored(ranged)
    counts = ranged.groupBy(*group, pid).agg(F.count("*").alias(base))
    before = Window.partitionBy(*group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(base, F.sum(base).over(before)).filter(F.col(base).isNotNull())
    place = F.row_number().over(Window.partitionBy(pid, *group).orderBy(*(F.asc_nulls_first(x) for x in order), salt))
    numbered = ranged.withColumn("pos", (place - 1).cast("long"))
    same = [numbered[x].eqNullSafe(offsets[x]) for x in (*group, pid)]
    joined = numbered.join(F.broadcast(offsets), same, "left")
    return joined.select(*(numbered[x] for x in rows.columns), (numbered["pos"] + F.coalesce(offsets[base], F.lit(0))).alias("pos"))


def attached(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """``many`` (stored) left-joined with ``one``, whose ``keys`` are unique and not null, whatever the keys' frequencies.

    Keys with over 1/HOT of the rows of ``many`` are fewer than HOT: their rows of ``one`` are broadcast. All others are
    shuffled, and none of them has more than 1/HOT of the rows.
    """
    counts = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = many.count()
    hot = c.cut(counts.filter(F.col("_n") > max(total // HOT, 256)).drop("_n"))  # the bound: fewer than HOT keys
    few = one.join(F.broadcast(hot), keys, "left_semi")
    is_hot = hot.withColumn("_hot", F.lit(True))
    marked = many.join(F.broadcast(is_hot), keys, "left")
    own = [x for x in one.columns if x not in keys]
    first = marked.filter("_hot").drop("_hot").join(F.broadcast(few), keys, "left")
    rest = marked.filter("_hot is null").drop("_hot").join(one, keys, "left")
    return first.select(*many.columns, *own).unionByName(rest.select(*many.columns, *own))


def sized(text: str | Column) -> Column:
    """Byte count, a colon and the value, so that values set side by side stay apart."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
