"""Tokens, cost and latency: usage blocks and totals, hook health, and the relational roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.functions.secrets import masked_command
from logloom.operators import ranks

TIERS = ("input", "output", "cache_read", "cache_creation")
BLOCK = "5 hours"


def priced(usage: DataFrame, rates: DataFrame, unbilled: str = "<synthetic>") -> DataFrame:
    """usage with rate_in and rate_out: by exact model id, else by the id without a trailing -yyyymmdd; never by prefix.

    rates(model, input_per_million, output_per_million) is configuration of one row per model, so it is broadcast.
    The unbilled model costs 0; a model without a rate stays null.
    """
    r = rates.select("model", "input_per_million", "output_per_million")
    exact = r.select(F.col("model").alias("__m1"), F.struct("input_per_million", "output_per_million").alias("__r1"))
    dated = r.select(F.col("model").alias("__m2"), F.struct("input_per_million", "output_per_million").alias("__r2"))
    x = usage.join(exact, F.col("model") == F.col("__m1"), "left").join(
        dated, F.regexp_replace("model", r"-\d{8}$", "") == F.col("__m2"), "left"
    )
    rate = F.coalesce("__r1", "__r2")
    zero = F.when(F.col("model") == unbilled, F.lit(0.0))
    return x.withColumn("rate_in", F.coalesce(zero, rate["input_per_million"])).withColumn(
        "rate_out", F.coalesce(zero, rate["output_per_million"])
    ).drop("__m1", "__m2", "__r1", "__r2")


def _with_cost(by_model: DataFrame, rates: DataFrame) -> DataFrame:
    x = priced(by_model, rates).withColumn("__t", F.struct(*TIERS))
    return x.withColumn("cost", X.cost_of("__t", F.col("rate_in"), F.col("rate_out"))).drop("__t", "rate_in", "rate_out")


def usage_blocks(usage: DataFrame, rates: DataFrame, size: str = BLOCK) -> DataFrame:
    """Epoch-aligned windows of usage(ts, session_id, model, four tiers). A block with any unpriced model has a null cost; null times are in no block.

    First by (block, model), which is priced, then by block; sessions are distinct over the whole block.
    """
    u = usage.where("ts is not null").withColumn("block", F.window("ts", size)["start"])
    per = u.groupBy("block", "model").agg(*[F.sum(t).alias(t) for t in TIERS], F.count("*").alias("turns"))
    per = _with_cost(per, rates)
    blocks = per.groupBy("block").agg(
        *[F.sum(t).alias(t) for t in TIERS],
        F.sum("turns").alias("turns"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.when(F.count_if(F.col("cost.total").isNull()) == 0, F.sum("cost.total")).alias("cost"),
    )
    sessions = u.groupBy("block").agg(F.countDistinct("session_id").alias("sessions"))
    return blocks.join(sessions, "block")


#: Relative error (three standard deviations) of a distinct count by a theta sketch of 2^12 entries; up to so many distinct values it is exact.
SKETCH_BITS = 12
SKETCH_ERROR = 3 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, sketch, n): a mergeable sketch of the distinct values of each group, at most 32 KB however large the group. An option beside exact counts, for tables that are
    kept: sketches of hours or days answer for any span of them."""
    return rows.groupBy(*by).agg(F.theta_sketch_agg(value, SKETCH_BITS).alias("sketch"), F.count("*").alias("n"))


def distinct_over(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, distinct, n): about how many distinct values (within SKETCH_ERROR) the united sketches of each group have seen."""
    x = sketches.groupBy(*by).agg(F.theta_union_agg("sketch", SKETCH_BITS).alias("sketch"), F.sum("n").alias("n"))
    return x.select(*by, F.theta_sketch_estimate("sketch").alias("distinct"), "n")


def usage_totals(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Per model: tokens, and cost in four parts, null if the model has no rate."""
    per = usage.groupBy("model").agg(*[F.sum(t).alias(t) for t in TIERS])
    x = _with_cost(per, rates)
    return x.select("model", *TIERS, *[F.col(f"cost.{t}").alias(f"{t}_cost") for t in TIERS], F.col("cost.total").alias("cost"))


def total_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """One row: cost of priced models, and the number of unpriced ones and of their tokens."""
    x = usage_totals(usage, rates)
    tokens = sum((F.col(t) for t in TIERS), F.lit(0))
    return x.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.count_if(F.col("cost").isNull()).alias("unpriced_models"),
        F.coalesce(F.sum(F.when(F.col("cost").isNull(), tokens)), F.lit(0)).cast("long").alias("unpriced_tokens"),
    )


def hook_health(hooks: DataFrame) -> DataFrame:
    """Per command: runs, missing durations, nearest-rank p50 and p95, maximum, total (0 without any), sessions."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = hooks.groupBy("command").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("duration_ms").isNull()).alias("missing"),
        zero(F.max("duration_ms")).alias("max_ms"),
        zero(F.sum("duration_ms")).alias("total_ms"),
        F.countDistinct("session_id").alias("sessions"),
    )
    at = ranks.at_places(hooks, "command", "duration_ms", p50=ranks.nearest(0.5), p95=ranks.nearest(0.95))
    out = ranks.beside(out, "command", at, "p50", "p95")
    return out.select("command", "n", "missing", zero("p50").alias("p50"), zero("p95").alias("p95"), "max_ms", "total_ms", "sessions")


def hook_report(hooks: DataFrame) -> DataFrame:
    """hook_health() with each command's label, and the command as it may be shown: secrets masked."""
    return hook_health(hooks).withColumns({"label": X.hook_label(F.col("command")), "shown": masked_command(F.col("command"))})


def daily_trend(sessions: DataFrame) -> DataFrame:
    """Cost, tokens and sessions by day of first_ts; rows without a date are left out."""
    return (
        sessions.where("first_ts is not null")
        .groupBy(F.to_date("first_ts").alias("day"))
        .agg(
            F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
            F.sum(F.coalesce("tokens", F.lit(0.0))).alias("tokens"),
            F.count("*").alias("sessions"),
        )
    )


def by_key(rows: DataFrame, key: str, *sums: str) -> DataFrame:
    """Sums and counts by a key, for tables ordered by cost."""
    return rows.groupBy(key).agg(*[F.sum(F.coalesce(s, F.lit(0.0))).alias(s) for s in sums], F.count("*").alias("n"))


def headline(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row: totals, the mean cache hit rate over values in [0, 1], and the size of a second table."""
    rate = F.col("cache_hit_rate")
    a = sessions.agg(
        F.sum("cost").alias("cost"),
        F.count("*").alias("sessions"),
        X.clamp(F.avg(F.when(rate.between(0, 1), rate)), 0.0, 1.0).alias("hit_rate"),
    )
    b = events.agg(F.count("*").alias("events"))
    one = lambda d: d.withColumn("__one", F.lit(1))  # noqa: E731  two tables of one row each
    return one(a).join(one(b), "__one").drop("__one")
