"""Activity over time: prompts, months without gaps, skills, aging, shares and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.operators import ranks


def prompts_by_hour(prompts: DataFrame, tz: str = "UTC") -> DataFrame:
    """All 24 hours of the local day, with zeros."""
    hour = F.hour(F.from_utc_timestamp("ts", tz))
    spine = prompts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    n = prompts.where("ts is not null").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    return spine.join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def prompts_by_day(prompts: DataFrame) -> DataFrame:
    return prompts.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def prompt_stats(prompts: DataFrame) -> DataFrame:
    """Per project: prompts, pastes, first and last, upper-median length."""
    out = prompts.groupBy("project").agg(
        F.count("*").alias("n"),
        F.count_if("had_paste").alias("pastes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return ranks.beside(out, "project", ranks.at_places(prompts, "project", "length", median_length=ranks.upper_middle()), "median_length")


def month_spine(rows: DataFrame, ts: str, last=None, most: int = 120) -> DataFrame:
    """Every month from the first row's to `last` (a column; default the last row's), at most the newest `most`, with zeros.

    The spine comes from one aggregated row. What lies outside is counted in one row each, as the month 'before' and 'after', where there is any.
    """
    m = F.trunc(ts, "month")
    ends = rows.agg(F.min(m).alias("a"), F.max(m).alias("z"))
    end = F.trunc(last, "month") if last is not None else F.col("z")
    start = F.greatest("a", F.add_months(end, -(most - 1)))
    spine = ends.where(F.col("a").isNotNull() & (start <= end)).select(
        F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("month")
    )
    n = rows.where(F.col(ts).isNotNull()).groupBy(m.alias("month")).agg(F.count("*").alias("n"))
    inside = spine.join(n, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))
    bounds = ends.select(start.alias("a"), end.alias("z"))
    side = F.when(F.col("month") < F.col("a"), "before").when(F.col("month") > F.col("z"), "after")
    outside = n.join(F.broadcast(bounds)).withColumn("side", side).where("side is not null")  # one row of bounds
    return inside.unionByName(outside.groupBy(F.col("side").alias("month")).agg(F.sum("n").alias("n")))


def skill_activity(records: DataFrame) -> DataFrame:
    """Per skill of records(skill, ts, session_id, project, is_delegated): counts by site, undated, span, distinct sessions and projects, busiest month.

    Months are counted first, so the busiest one (the earliest of equals) is an argmax over few rows.
    """
    months = records.where("ts is not null").groupBy("skill", X.month_of(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))
    rank = Window.partitionBy("skill").orderBy(F.desc("n"), "month")
    busiest = months.withColumn("r", F.row_number().over(rank)).where("r = 1").select(
        "skill", F.col("month").alias("busiest_month"), F.col("n").alias("busiest_n")
    )
    active = months.groupBy("skill").agg(F.count("*").alias("active_months"))
    out = records.groupBy("skill").agg(
        F.count("*").alias("n"),
        F.count_if("is_delegated").alias("delegated"),
        F.count_if(~F.col("is_delegated")).alias("mainline"),
        F.count_if(F.col("ts").isNull()).alias("undated"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("project").alias("projects"),
    )
    return out.join(busiest, "skill", "left").join(active, "skill", "left")


def peak(rows: DataFrame, key: str) -> DataFrame:
    """The key with most rows, the smallest of equals: counted first, then an argmax."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.max(F.struct("n", (-F.col(key)).alias("k"))).alias("x")).select(
        (-F.col("x.k")).alias(key), F.col("x.n").alias("n")
    )


def shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by key and their share of the total (a floor of 1 under the line), by a window over counted groups."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return n.withColumn("share", F.col("n") / F.greatest(F.lit(1), total))


def aging(entries: DataFrame, now) -> DataFrame:
    """entries(ts, status, resolved_ts) with whole days open (or to close) and the age band of open ones."""
    days = X.days_between(F.coalesce("resolved_ts", now), F.col("ts"))
    return entries.withColumn("days", days).withColumn("band", F.when(F.col("status") == "open", X.age_band(F.col("days"))))


def aging_summary(aged: DataFrame) -> DataFrame:
    open_, closed = F.col("status") == "open", F.col("status") == "resolved"
    closing = aged.where(closed).select(F.lit(1).alias("one"), "days")
    middle = ranks.at_places(closing, "one", "days", median=ranks.upper_middle()).agg(F.max("median").cast("long").alias("median_days_to_close"))
    return aged.agg(
        F.count_if(open_).alias("open"),
        F.count_if(closed).alias("resolved"),
        F.max(F.when(open_, F.col("days"))).alias("oldest_days"),
        (F.count_if(closed) / F.nullif(F.count_if(open_ | closed), F.lit(0))).alias("resolution_rate"),
    ).join(F.broadcast(middle))  # one row each


def outcome_tallies(judged: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n, share) of several columns in one pass: rows are unpivoted after they are counted together."""
    n = judged.groupBy(*columns).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    x = n.select("n", F.inline(pairs)).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def coverage(judged: DataFrame, population: DataFrame, key: str) -> DataFrame:
    """One row: rows judged, measured and both, against the population."""
    j = judged.select(key).distinct().withColumn("__j", F.lit(1))
    p = population.select(key).distinct().withColumn("__p", F.lit(1))
    return j.join(p, key, "full_outer").agg(
        F.count("__p").alias("population"),
        F.count("__j").alias("judged"),
        F.count_if(F.col("__j").isNotNull() & F.col("__p").isNotNull()).alias("measured"),
        F.count_if(F.col("__p").isNull()).alias("judged_unknown"),
    )


def pacing(samples: DataFrame) -> DataFrame:
    """One row: samples, those without limits, and the newest sample that has them."""
    has = F.col("limits").isNotNull()
    newest = F.max_by(F.when(has, F.struct("session_id", "limits")), F.when(has, F.struct("ts", "session_id")))
    return samples.agg(
        F.count("*").alias("samples"), F.count_if(~has).alias("without_limits"), newest.alias("x"),
        F.max(F.when(has, F.col("ts"))).alias("ts"),
    ).select("samples", "without_limits", "ts", "x.session_id", "x.limits")


def size_budget(sources: DataFrame, warn: int = 38_000, over: int = 40_000, per_token: int = 4) -> DataFrame:
    """Per bucket of sources(bucket, name, chars): files, characters, estimated tokens, banded files, and the largest one."""
    n = F.col("chars")
    return sources.groupBy("bucket").agg(
        F.count("*").alias("files"),
        F.sum(n).alias("chars"),
        F.floor(F.sum(n) / per_token + 0.5).cast("long").alias("tokens"),
        F.count_if((n >= warn) & (n < over)).alias("warn"),
        F.count_if(n >= over).alias("over"),
        F.max(n).alias("largest"),
        F.max_by("name", F.struct(n, -F.col("name"))).alias("largest_name"),
        X.half_up(100.0 * F.max(n) / over, 1).alias("percent_of_ceiling"),
    )


def disk_rollup(files: DataFrame, categories: DataFrame) -> DataFrame:
    """Bytes, files and newest per declared category of files(prefix, bytes, ts); undeclared ones are 'other'. categories(prefix, category) is configuration."""
    x = files.join(categories, "prefix", "left")
    return x.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.max("ts").alias("newest")
    )
