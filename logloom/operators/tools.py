"""Tool and server usage, trigger coverage, settings and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.functions.shell import invoked_commands


def server_usage(calls: DataFrame) -> DataFrame:
    """Per server of calls(name, ts, session_id, project, is_delegated): sites apart, tools, sessions, projects, span."""
    x = calls.withColumn("__n", X.tool_name(F.col("name"))).where("__n is not null")
    return x.groupBy(F.col("__n.server").alias("server")).agg(
        F.count_if(~F.col("is_delegated")).alias("mainline"), F.count_if("is_delegated").alias("delegated"),
        F.countDistinct("__n.tool").alias("tools"), F.countDistinct("session_id").alias("sessions"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def unparsed_names(calls: DataFrame, prefix: str = "mcp__") -> DataFrame:
    x = calls.where(F.col("name").startswith(prefix) & X.tool_name(F.col("name"), prefix).isNull())
    return x.agg(F.countDistinct("name").alias("names"), F.count("*").alias("occurrences"))


def server_decay(usage: DataFrame, configured: DataFrame) -> DataFrame:
    """Each configured and each used server in one of: used, never-called, elsewhere (bare name matched), unaccounted.

    usage(server, calls); configured(name). Names meet on canonical keys; `collisions` counts configured names of one key.
    """
    used = usage.withColumn("__s", X.server_naming(F.col("server"))).select(
        "server", "calls", F.col("__s.key").alias("key"), F.col("__s.bare_key").alias("bare_key")
    )
    names = configured.select(X.canonical_key(F.col("name")).alias("key"), "name")
    names = names.groupBy("key").agg(F.count("*").alias("collisions"), F.min("name").alias("name"))
    keys = names.select(F.col("key").alias("__k"))
    x = used.join(keys, F.col("key") == F.col("__k"), "left").withColumnRenamed("__k", "__full")
    x = x.join(keys, F.col("bare_key") == F.col("__k"), "left")
    seen = x.select(
        F.coalesce("__full", "__k", "key").alias("key"), "calls",
        F.when(F.col("__full").isNotNull(), "used").when(F.col("__k").isNotNull(), "elsewhere").otherwise("unaccounted").alias("bucket"),
    ).groupBy("key", "bucket").agg(F.sum("calls").alias("calls"))
    idle = names.join(seen.select("key"), "key", "left_anti").select(
        "key", F.lit("never-called").alias("bucket"), F.lit(0).cast("long").alias("calls")
    )
    return seen.unionByName(idle).join(names, "key", "left").select(
        "key", "bucket", "calls", F.coalesce("collisions", F.lit(0)).alias("collisions")
    )


def trigger_coverage(events: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe: occurrences, sessions, last seen; probes without any stay with zeros.

    events(kind, name, session_id, ts), already cut to the window; probes(probe, kind, match) is configuration.
    """
    hits = events.join(probes, (events.kind == probes.kind) & (events.name == probes.match)).select(
        "probe", "session_id", "ts"
    )
    n = hits.groupBy("probe").agg(
        F.count("*").alias("occurrences"), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last_ts")
    )
    x = probes.select("probe").distinct().join(n, "probe", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    state = F.when(F.col("occurrences").isNull(), "silent").otherwise("observed").alias("state")
    return x.select("probe", zero("occurrences"), zero("sessions"), "last_ts", state)


def commands(lines: DataFrame, column: str) -> DataFrame:
    """One row per program that a shell line runs."""
    return lines.withColumn("name", F.explode(invoked_commands(F.col(column))))


def prefer(rows: DataFrame, key: str, *order) -> DataFrame:
    """One row per key, the first in order of precedence."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def allow_listed(entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """entries(key, v VARIANT) with `shown`: the value of an allowed scalar, 'N items' for containers, else 'set (type), not shown'."""
    kind = F.schema_of_variant("v")
    shape = (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )
    size = F.coalesce(
        F.size(F.try_variant_get("v", "$", "array<variant>")), F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))
    )
    x = entries.join(allowed.select(F.col("key").alias("__k")).distinct(), F.col("key") == F.col("__k"), "left")
    shown = (
        F.when(shape.isin("object", "array"), F.concat(size.cast("string"), F.lit(" items")))
        .when(F.col("__k").isNotNull(), F.try_variant_get("v", "$", "string"))
        .otherwise(F.format_string("set (%s), not shown", shape))
    )
    return x.withColumn("kind", shape).withColumn("shown", shown).drop("__k", "v")


def deletion_shortlist(entries: DataFrame, activity: DataFrame, now, window_days: int) -> DataFrame:
    """Verdicts over entries(name, uses, last_used): no-evidence, bursty, stale or keep, with the age of the newest evidence.

    Bursty needs a wide window, all activity in one month, and 90 quiet days; stale needs 120 days without evidence.
    """
    x = entries.join(activity.select("name", "last_ts", "active_months", "busiest_month"), "name", "left")
    newest = F.greatest("last_used", "last_ts")
    age = X.days_between(now, newest)
    quiet = X.days_since_month_end(F.col("busiest_month"), now)
    verdict = (
        F.when(newest.isNull(), "no-evidence")
        .when((F.col("active_months") == 1) & (quiet > 90) & F.lit(window_days >= 90) & (age <= 120), "bursty")
        .when(age > 120, "stale").otherwise("keep")
    )
    rank = F.element_at(
        F.create_map(*[F.lit(v) for p in (("no-evidence", 0), ("stale", 1), ("bursty", 2), ("keep", 3)) for v in p]), F.col("verdict")
    )
    return x.withColumn("age_days", age).withColumn("verdict", verdict).withColumn("rank", rank).select(
        "name", "uses", "age_days", "verdict", "rank",
        F.format_string("%s: %s uses, newest evidence %s days ago", "verdict", F.coalesce(F.col("uses").cast("string"), F.lit("no")), F.coalesce(F.col("age_days").cast("string"), F.lit("?"))).alias("reason"),
    )


def _quoted_after(lead: str) -> str:
    """A pattern of a quoted text after lead, which is no part of a longer name; the text is its last group."""
    return rf"(?<![A-Za-z0-9_$]){lead}\s*([\"'])([^\"'\n]+)\1"


def script_features(scripts: DataFrame, text: str = "text", calls: str = "agent", flags: tuple[str, ...] = ("parallel", "pipeline")) -> DataFrame:
    """scripts with what their source declares, read as text and never run: name, description, phases (titles, then phase() calls that name others), bytes, lines,
    call sites of `calls`, whether each of `flags` is called, and whether worktrees isolate it. What is not declared is null."""
    x = F.col(text)
    one = lambda key: F.nullif(F.regexp_extract(x, _quoted_after(rf"{key}\s*:"), 2), F.lit(""))
    every = lambda lead: F.regexp_extract_all(x, F.lit(_quoted_after(lead)), F.lit(2))
    called = lambda name: rf"(?<![A-Za-z0-9_$]){name}\s*\("
    titles = every(r"title\s*:")
    return scripts.select(
        "*", one("name").alias("declared_name"), one("description").alias("description"), F.concat(titles, F.array_except(every(r"phase\("), titles)).alias("phases"),
        F.octet_length(x).alias("bytes"), F.size(F.split(x, "\n")).alias("lines"), F.size(F.regexp_extract_all(x, F.lit(called(calls)), F.lit(0))).alias("call_sites"),
        *[x.rlike(called(f)).alias(f"uses_{f}") for f in flags], F.exists(every(r"isolation\s*:"), lambda v: v == "worktree").alias("uses_worktrees"),
    )


def open_boards(tasks: DataFrame, live: DataFrame) -> DataFrame:
    """Boards with open tasks whose session isn't live: tasks(board, task_id, status), live(session_id); a board is a full id or an 8-character prefix."""
    ids = live.select(F.col("session_id").alias("__id")).union(live.select(F.substring("session_id", 1, 8))).distinct()
    gone = tasks.join(ids, F.col("board") == F.col("__id"), "left_anti")
    return gone.groupBy("board").agg(
        F.count_if(F.col("status") != "completed").alias("open_tasks"), F.count("*").alias("tasks"),
        F.min(F.when(F.col("status") != "completed", F.col("task_id"))).alias("next_task"),
    ).where("open_tasks > 0")


def latest_state(beats: DataFrame, key: str, now, fresh: str = "INTERVAL 15 MINUTES") -> DataFrame:
    """Newest beat per key and whether it is fresh."""
    x = beats.groupBy(key).agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.max("ts").alias("ts"))
    return x.withColumn("live", F.col("ts") > now - F.expr(fresh))


def script_inventory(scripts: DataFrame, pattern: str) -> DataFrame:
    """Per kind of scripts(kind, text): files, bytes, call sites of the pattern, files that fan out (two or more)."""
    x = scripts.withColumn("calls", F.regexp_count("text", F.lit(pattern)))
    return x.groupBy("kind").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.sum("calls").alias("calls"),
        F.count_if(F.col("calls") > 1).alias("fan_out"),
    )


#: Rows of versions that one task sorts, about.
SORTED = 2_000_000


def version_chains(versions: DataFrame) -> DataFrame:
    """Per (hash, session): count, first, highest, gaps; versions(hash, session_id, version, size). Rows are counted and dealt to as many tasks as they need,
    so what a task sorts doesn't grow with them."""
    versions = versions.repartition(1 + versions.count() // SORTED, "hash", "session_id")
    w = Window.partitionBy("hash", "session_id").orderBy("version")
    x = versions.withColumn("gap", F.coalesce(F.col("version") - F.lag("version").over(w) > 1, F.lit(False)))
    return x.groupBy("hash", "session_id").agg(
        F.count("*").alias("n"), F.min("version").alias("first"), F.max("version").alias("highest"),
        F.count_if("gap").alias("gaps"), F.sum("size").alias("size"),
    )


def file_summary(chains: DataFrame) -> DataFrame:
    return chains.groupBy("hash").agg(
        F.count("*").alias("sessions"), F.sum("n").alias("versions"), F.max("highest").alias("highest"), F.sum("size").alias("size")
    )
