"""Sessions from transcript records: summaries, timelines, forks, touched files and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.shared import running

#: Line order: file, split, then position inside the split (see sources.transcripts).
ORDER = ("file_path", "split_start", "line_seq")


def _order() -> Column:
    return F.struct(*ORDER)


def _first(c: Column) -> Column:
    """The first non-empty value in line order, as an aggregate."""
    ok = c.isNotNull() & (c != "")
    return F.min_by(F.when(ok, c), F.when(ok, _order()))


def mainline(records: DataFrame) -> DataFrame:
    """User and assistant rows that are neither sidechain nor meta; a missing flag is false."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return records.where(F.col("type").isin("user", "assistant") & no("is_sidechain") & no("is_meta"))


def forks(records: DataFrame) -> DataFrame:
    """records with is_branch: more than one user or assistant row has this one as parent."""
    kids = (
        records.where(F.col("type").isin("user", "assistant") & F.col("parent_uuid").isNotNull())
        .groupBy("session_id", F.col("parent_uuid").alias("uuid"))
        .agg(F.count("*").alias("kids"))
        .where("kids > 1")
    )
    x = records.join(kids, ["session_id", "uuid"], "left")
    return x.withColumn("is_branch", F.col("kids").isNotNull()).drop("kids")


def summaries(records: DataFrame) -> DataFrame:
    """One row per session, in one pass over records (with v, a VARIANT): title and its source, span, first cwd, version and branch, turns, tokens, bad lines."""
    is_user, is_assistant = F.col("type") == "user", F.col("type") == "assistant"
    side = F.coalesce("is_sidechain", F.lit(False))
    meta = F.coalesce("is_meta", F.lit(False))
    tokens = F.when(is_assistant, X.usage_tokens("v"))
    title = F.when(F.col("type") == "ai-title", X.typed("v", "$.aiTitle", "string"))
    prose = F.when(is_user & ~meta & ~side, X.title_line(X.strip_ansi(X.content_text("v"))))
    x = records.withColumns(
        {
            "__t": tokens, "__title": title, "__prose": prose, "__cwd": X.typed("v", "$.cwd", "string"),
            "__version": X.typed("v", "$.version", "string"), "__branch": X.typed("v", "$.gitBranch", "string"),
        }
    )
    sums = [F.coalesce(F.sum(f"__t.{t}"), F.lit(0)).alias(t) for t in ("input", "output", "cache_read", "cache_creation")]
    out = x.groupBy("session_id").agg(
        F.min("project_dir").alias("project_dir"),
        F.max_by("__title", F.when(F.col("__title") != "", _order())).alias("ai_title"),
        _first(F.col("__prose")).alias("first_prompt"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        _first(F.col("__cwd")).alias("cwd"),
        _first(F.col("__version")).alias("version"),
        _first(F.col("__branch")).alias("branch"),
        F.count_if(is_user).alias("user_turns"),
        F.count_if(is_assistant).alias("assistant_turns"),
        F.count_if(side & (is_user | is_assistant)).alias("sidechain_turns"),
        F.count_if(F.col("type") == "system").alias("system_records"),
        *sums,
        F.count_if(~F.col("ok")).alias("bad_lines"),
        F.count("*").alias("lines"),
    )
    title = F.coalesce("ai_title", F.nullif("first_prompt", F.lit("")), "session_id")
    source = F.when(F.col("ai_title").isNotNull(), "title").when(F.col("first_prompt").isNotNull(), "prompt").otherwise("id")
    return out.withColumn("title", X.clip(title, 140)).withColumn("title_source", source)


def tokens_by_model(records: DataFrame) -> DataFrame:
    """Four token tiers per session and model, one row of usage per record (not merged by message id)."""
    x = records.where("type = 'assistant'").withColumns(
        {"t": X.usage_tokens("v"), "model": X.typed("v", "$.message.model", "string")}
    )
    return x.where("t is not null").groupBy("session_id", "model").agg(
        *[F.sum(f"t.{c}").alias(c) for c in ("input", "output", "cache_read", "cache_creation")]
    )


def named_counts(rows: DataFrame, owner: str, name: str) -> DataFrame:
    """(owner, name, n, position): a histogram per owner, by count then name."""
    n = rows.groupBy(owner, name).agg(F.count("*").alias("n"))
    return n.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("n"), name)))


def timeline(records: DataFrame, size: int = 600) -> DataFrame:
    """One row per user, assistant or system record: excerpt, tools, tokens, denial, branch flag."""
    x = forks(records).where(F.col("type").isin("user", "assistant", "system"))
    blocks = F.try_variant_get("v", "$.message.content", "array<variant>")
    tools = F.transform(
        F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"),
        lambda b: F.try_variant_get(b, "$.name", "string"),
    )
    return x.select(
        "session_id", *ORDER, "type", "ts", "uuid", X.excerpt(X.content_text("v"), size).alias("text"),
        F.coalesce(tools, F.array().cast("array<string>")).alias("tools"), X.usage_tokens("v").alias("tokens"),
        X.typed("v", "$.toolDenialKind", "string").alias("denial"), "is_branch",
    )


def blocks_of(records: DataFrame) -> DataFrame:
    """Content blocks of records as rows: block_ix, block_type, tool_name, tool_use_id, input."""
    x = records.select(*ORDER, "session_id", "type", "ts", F.posexplode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("block_ix", "b"))
    get = lambda p, t="string": F.try_variant_get("b", p, t)
    return x.select(
        *ORDER, "session_id", "type", "ts", "block_ix", get("$.type").alias("block_type"), get("$.name").alias("tool_name"),
        F.coalesce(get("$.id"), get("$.tool_use_id")).alias("tool_use_id"), get("$.input", "variant").alias("input"),
    )


def edits_of(records: DataFrame) -> DataFrame:
    """One row per edit result: path, lines added and removed (by the first character of patch lines, else by hunk sizes), user_modified."""
    patch = F.try_variant_get(
        "v", "$.toolUseResult.structuredPatch", "array<struct<lines:array<string>,newLines:int,oldLines:int>>"
    )
    lines = F.flatten(F.transform(patch, lambda h: F.coalesce(h["lines"], F.array().cast("array<string>"))))
    n = lambda c: F.size(F.filter(lines, lambda x: x.startswith(c)))
    total = lambda f: F.aggregate(patch, F.lit(0), lambda a, h: a + F.coalesce(h[f], F.lit(0)))
    some = F.size(lines) > 0
    return records.select(
        *ORDER, "session_id", "ts", X.typed("v", "$.toolUseResult.filePath", "string").alias("path"),
        F.when(some, n("+")).otherwise(total("newLines")).alias("added"),
        F.when(some, n("-")).otherwise(total("oldLines")).alias("removed"),
        F.coalesce(X.typed("v", "$.toolUseResult.userModified", "boolean"), F.lit(False)).alias("user_modified"),
        patch.isNotNull().alias("__edit"),
    ).where("path is not null and __edit").drop("__edit")


def touched_files(edits: DataFrame) -> DataFrame:
    return edits.groupBy("session_id", "path").agg(
        F.count("*").alias("edits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or("user_modified").alias("user_modified"),
    )


def blast_radius(files: DataFrame) -> DataFrame:
    return files.groupBy("session_id").agg(
        F.count("*").alias("files"), F.sum("edits").alias("edits"), F.sum("added").alias("added"),
        F.sum("removed").alias("removed"), F.count_if("user_modified").alias("user_modified"),
    )


def newest(rows: DataFrame, n: int, *order) -> DataFrame:
    """The newest n rows by a total order: a top-k, not a sort of everything."""
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, *order, limit: int = 30, offset: int = 0, most: int = 200) -> DataFrame:
    """Clamped paging over a total order."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their position in a total order."""
    return running(rows, list(order), "numbered").withColumnRenamed("__position", "position")


def totals(per_session: DataFrame, n: int) -> DataFrame:
    """Totals over the newest n sessions, and how many that were."""
    x = newest(per_session, n, F.desc_nulls_last("last_ts"), "session_id")
    return x.agg(
        F.count("*").alias("sessions"), F.sum("user_turns").alias("user_turns"), F.sum("assistant_turns").alias("assistant_turns"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )
