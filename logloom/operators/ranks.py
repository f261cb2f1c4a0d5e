"""Exact order statistics of groups of any size, by distributed selection: no task holds more of a group than one range of its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.shared import cut


def nearest(p: float) -> Column:
    """The place, from 1, of the nearest-rank p quantile among n ascending values."""
    return F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).cast("long")


def upper_middle() -> Column:
    """The place of the median, the larger of two: the element at floor(n / 2) from 0."""
    return (F.floor(F.col("n") / 2) + 1).cast("long")


def at_places(rows: DataFrame, group: str, value: str, **places: Column) -> DataFrame:
    """(group, n, one column for each of places): the group's value at a place in ascending order, a column over n, the number of its non-null values.

    Equal values are counted first; the counts are sorted in ranges, added up by range, and only the range that holds a place is counted through. A
    null group is a group; one without values has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.struct(F.col(group)).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("m"))
    x = cut(counts.repartitionByRange("g", "v").withColumn("r", F.spark_partition_id()), "ranks")
    by_group = Window.partitionBy("g").orderBy("r")
    bins = x.groupBy("g", "r").agg(F.sum("m").alias("s"))
    bins = bins.withColumns({
        "ahead": F.coalesce(F.sum("s").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("s").over(Window.partitionBy("g")),
    })
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), p.alias("place")) for k, p in places.items()])
    asked = cut(bins.select("g", "r", "n", "s", "ahead", F.inline(wanted)).where("ahead < place and place <= ahead + s").select("g", "r", "n", "name", (F.col("place") - F.col("ahead")).alias("place")), "ranks-asked")
    inside = Window.partitionBy("g", "r").orderBy("v")
    x = x.join(asked.select("g", "r").distinct(), ["g", "r"], "left_semi")
    x = x.withColumn("upto", F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    found = x.join(asked, ["g", "r"]).where("upto - m < place and place <= upto")
    out = found.groupBy("g").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])
    return out.select(F.col(f"g.{group}").alias(group), "n", *places)


def beside(summary: DataFrame, group: str, ranks: DataFrame, *names: str) -> DataFrame:
    """summary with the named columns of at_places() for its group; null groups meet."""
    y = ranks.select(F.col(group).alias("__g"), *names)
    return summary.join(y, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
