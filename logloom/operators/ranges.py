"""Ordered work over keys of any size: rows are sorted in ranges that may split a key, and one carried row per range joins them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.shared import cut, running


def following(rows: DataFrame, group: str, order: list[str], value: Column, name: str = "next") -> DataFrame:
    """rows with the first non-null value of the rows after each, in order inside its group; null where none follows.

    Inside a range it is the last value seen from behind; what a range lacks comes from the nearest later range of the same group. A null group is a group.
    """
    x = rows.withColumn("__v", value).repartitionByRange(F.asc(group), *[F.asc(c) for c in order])
    x = cut(x.withColumn("__range", F.spark_partition_id()), "following")
    behind = Window.partitionBy("__range", group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    heads = x.where("__v is not null").groupBy(group, "__range").agg(F.min_by("__v", F.struct(*order)).alias("__head"))
    spans = x.select(group, "__range").distinct().withColumnsRenamed({group: "__g", "__range": "__q"})
    heads = spans.join(heads, F.col("__g").eqNullSafe(F.col(group)) & (F.col("__q") == F.col("__range")), "left").select("__g", "__q", "__head")
    later = Window.partitionBy("__g").orderBy(F.desc("__q")).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("__c", F.last("__head", ignorenulls=True).over(later)).where("__c is not null").select("__g", "__q", "__c")
    # Only the last group of a range goes on in another: at most one row per range.
    x = x.withColumn("__n", F.last("__v", ignorenulls=True).over(behind))
    x = x.join(F.broadcast(carried), F.col("__g").eqNullSafe(F.col(group)) & (F.col("__q") == F.col("__range")), "left")
    return x.withColumn(name, F.coalesce("__n", "__c")).drop("__v", "__range", "__n", "__g", "__q", "__c")


def places(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place (from 0) in order inside their group, which may span many ranges. A null group is a group."""
    x = rows.repartitionByRange(F.asc(group), *[F.asc(c) for c in order]).withColumn("__range", F.spark_partition_id())
    x = cut(x, "places")
    earlier = Window.partitionBy("__g").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    ahead = x.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__q")).agg(F.count("*").alias("__n"))
    ahead = ahead.withColumn("__a", F.sum("__n").over(earlier)).where("__a > 0").drop("__n")  # one row per range at most: only its first group began before it
    inside = Window.partitionBy("__range", group).orderBy(*[F.asc(c) for c in order])
    x = x.withColumn("__r", F.row_number().over(inside) - 1)
    x = x.join(F.broadcast(ahead), F.col("__g").eqNullSafe(F.col(group)) & (F.col("__q") == F.col("__range")), "left")
    return x.withColumn(name, (F.col("__r") + F.coalesce("__a", F.lit(0))).cast("long")).drop("__range", "__r", "__a", "__g", "__q")


def overlaps(intervals: DataFrame, others: DataFrame) -> DataFrame:
    """(id, n): how many of others(a, z) share a moment with each of intervals(id, a, z), counted without making a pair.

    Those that start up to an interval's end, less those that end before its start: two ranks in one merged order of all four kinds of ends. A row without one of
    its ends, or that ends before it starts, shares nothing.
    """
    fine = (F.col("a") <= F.col("z"))
    i, o = intervals.where(fine), others.where(fine)
    none, zero, one = F.lit(None).cast(dict(intervals.dtypes)["id"]), F.lit(0), F.lit(1)
    # At one moment: first questions about ends before it, then ends and starts, then questions about starts up to it.
    points = (
        i.select(F.col("a").alias("t"), F.lit(0).alias("k"), "id", zero.alias("start"), zero.alias("end"))
        .unionByName(i.select(F.col("z").alias("t"), F.lit(2).alias("k"), "id", zero.alias("start"), zero.alias("end")))
        .unionByName(o.select(F.col("a").alias("t"), F.lit(1).alias("k"), none.alias("id"), one.alias("start"), zero.alias("end")))
        .unionByName(o.select(F.col("z").alias("t"), F.lit(1).alias("k"), none.alias("id"), zero.alias("start"), one.alias("end")))
    )
    points = points.withColumn("tie", F.xxhash64("id", F.monotonically_increasing_id()))  # a moment that many share is split, too
    x = running(points, ["t", "k", "tie"], "overlaps", starts="start", ends="end").where("k <> 1")
    return x.groupBy("id").agg(F.sum(F.when(F.col("k") == 2, F.col("starts")).otherwise(-F.col("ends"))).cast("long").alias("n"))
