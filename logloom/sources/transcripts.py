"""JSON-lines corpora as tables. Bad lines are kept and flagged, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import expr as X

LINE_CAP = 8 << 20
_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def pack(lines: DataFrame, root: str) -> None:
    """Write lines(path, value) as a packed corpus: a file per task, each line a path, a tab and the line. Small files need no file each; the lines of one path must lie in one task, in order."""
    lines.select(F.concat_ws("\t", "path", "value").alias("value")).write.text(root)


def lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", modified_after: str | None = None, packed: bool = False) -> DataFrame:
    """Non-blank lines of all files below root, with file facts and line order. modified_after prunes files before they are read. In a packed corpus each line names its file; size and time are the pack's."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    path, value = F.col("_metadata.file_path"), F.col("value")
    if packed:
        path, value = F.substring_index("value", "\t", 1), F.expr("substring(value, locate('\t', value) + 1)")
    return (
        reader.text(root)
        .select(
            path.alias("file_path"),
            F.col("_metadata.file_modification_time").alias("file_mtime"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("line_seq"),
            value.alias("value"),
        )
        .where(F.trim("value") != "")
    )


def _place(path: Column) -> dict[str, Column]:
    """Project, session, owner and depth from <root>/projects/<project>/[<owner>/subagents/**/]<name>.jsonl."""
    below = F.regexp_extract(path, r"/projects/(.*)$", 1)
    parts = F.split(below, "/")
    owner = F.regexp_extract(below, rf"^[^/]+/({_UUID})/", 1)
    return {
        "project_dir": F.get(parts, F.lit(0)),
        "session_id": F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", ""),
        "owner_session_id": F.nullif(owner, F.lit("")),
        "depth": F.size(parts),
    }


def records(spark: SparkSession, root: str, **options) -> DataFrame:
    """The canonical record table: a line is ok if it is an object whose `type` is a string and not longer than LINE_CAP.

    Set spark.sql.variant.allowDuplicateKeys=true in the session to keep the last of repeated keys.
    """
    x = lines(spark, root, **options).withColumns(_place(F.col("file_path")))
    small = F.length("value") <= LINE_CAP
    x = x.withColumn("v", F.when(small, F.try_parse_json("value")))
    kind = X.typed("v", "$.type", "string")
    x = x.withColumn("type", kind).withColumn("ok", F.col("type").isNotNull())
    raw = X.typed("v", "$.timestamp", "string")
    return x.select(
        "file_path", "project_dir", "session_id", "owner_session_id", F.col("owner_session_id").isNotNull().alias("is_delegated"),
        "depth", "file_mtime", "file_size", "split_start", "line_seq", "ok", "type", F.try_to_timestamp(raw).alias("ts"),
        raw.alias("ts_raw"), X.typed("v", "$.uuid", "string").alias("uuid"), X.typed("v", "$.parentUuid", "string").alias("parent_uuid"),
        X.typed("v", "$.isSidechain", "boolean").alias("is_sidechain"), X.typed("v", "$.isMeta", "boolean").alias("is_meta"),
        F.when(F.col("ok"), F.col("v")).alias("v"),
    )


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Metadata only (no content column is read): path, size, mtime."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )


def session_files(spark: SparkSession, root: str, pattern: str = "*.jsonl", parts: str | None = None) -> DataFrame:
    """Mainline files: exactly <project>/<session>.jsonl, newest first by (mtime, path).

    A long session may lie in several files: with parts, a regular expression whose first group is what their names share, such files of one folder are one
    row, with the first path, the newest time and the sum of their sizes.
    """
    x = files(spark, root, pattern)
    if parts is not None:
        whole = F.regexp_extract(F.substring_index("path", "/", -1), parts, 1)
        below = F.regexp_replace("path", "[^/]*$", "")
        x = x.groupBy(below.alias("folder"), F.coalesce(F.nullif(whole, F.lit("")), "path").alias("whole"))
        x = x.agg(F.min("path").alias("path"), F.sum("size").alias("size"), F.max("mtime").alias("mtime")).select("path", "size", "mtime")
    return x.withColumns(_place(F.col("path"))).where("depth = 2").orderBy(F.desc("mtime"), "path")


def delegated_files(spark: SparkSession, root: str, most_depth: int = 6, pattern: str = "*.jsonl") -> DataFrame:
    """Nested files with `skip`: null if owned by a session folder within the depth, else the reason."""
    x = files(spark, root, pattern).withColumns(_place(F.col("path"))).where("depth > 2")
    skip = F.when(F.col("owner_session_id").isNull(), "no-owner").when(F.col("depth") - 2 > most_depth, "too-deep")
    return x.withColumn("skip", skip)


def version_files(listing: DataFrame) -> DataFrame:
    """listing(path, ...) of version files <hash>@v<number> with hash and version; `skip` is the reason why a name is neither."""
    name = F.substring_index("path", "/", -1)
    hash_, number = F.regexp_extract(name, "^([0-9a-f]{16})(?:@v[0-9]+)?$", 1), F.regexp_extract(name, "@v([0-9]+)$", 1)
    skip = F.when(number == "", "no-version").when(hash_ == "", "no-hash")
    x = listing.withColumn("skip", skip)
    return x.withColumns({"hash": F.when(F.col("skip").isNull(), hash_), "version": F.when(F.col("skip").isNull(), number).cast("long")})


def newest_files(listing: DataFrame, n: int) -> list[str]:
    """The paths of the newest n files, to be read alone: n is a parameter, so this list is bounded."""
    return [r.path for r in listing.orderBy(F.desc("mtime"), "path").limit(n).select("path").collect()]


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt history: blank texts go; pasted content is never read, only whether there was any."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    pasted = F.size(F.map_keys(F.try_variant_get("v", "$.pastedContents", "map<string,variant>")))
    ms = X.typed("v", "$.timestamp", "number").cast("long")
    x = v.select(
        X.typed("v", "$.display", "string").alias("text"), F.timestamp_millis(ms).alias("ts"),
        X.typed("v", "$.project", "string").alias("project"), X.typed("v", "$.sessionId", "string").alias("session_id"),
        F.coalesce(pasted > 0, F.lit(False)).alias("had_paste"),
    )
    return x.where(F.trim("text") != "").withColumn("length", F.length("text"))


def pacing_samples(spark: SparkSession, path: str) -> DataFrame:
    """Pacing samples with a session id; reset times are epoch seconds."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    num = lambda p: X.typed("v", p, "number")
    window = lambda w: F.when(
        num(f"$.rate_limits.{w}.used_percentage").isNotNull(),
        F.struct(
            num(f"$.rate_limits.{w}.used_percentage").alias("used"),
            F.timestamp_seconds(num(f"$.rate_limits.{w}.resets_at").cast("long")).alias("resets_at"),
        ),
    )
    five, seven = window("five_hour"), window("seven_day")
    return v.select(
        X.typed("v", "$.session_id", "string").alias("session_id"),
        F.coalesce(
            F.try_to_timestamp(X.typed("v", "$.captured_at", "string")), F.timestamp_seconds(num("$.captured_at").cast("long"))
        ).alias("ts"),
        X.typed("v", "$.model.id", "string").alias("model"), num("$.cost.total_cost_usd").alias("cost"),
        num("$.context_window.used_percentage").alias("context_used"),
        F.when(five.isNotNull() | seven.isNotNull(), F.struct(five.alias("five_hour"), seven.alias("seven_day"))).alias("limits"),
    ).where("session_id is not null and session_id <> ''")
