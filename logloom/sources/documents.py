"""One file, one row: JSON folders, markdown notes, scripts, log files, nested settings, relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import expr as X


#: Ends each record of an archive.
RECORD_END = "\x1e"


def archive(documents: DataFrame, root: str) -> None:
    """Write documents(path, text) as archives: one file per task, each record a path, a line end and the text. Small documents need no file each."""
    documents.select(F.concat_ws("\n", "path", F.coalesce("text", F.lit(""))).alias("value")).write.option("lineSep", RECORD_END).text(root)


def archived(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, mtime, text) of the documents in archives; the reader splits large ones. The time is the archive's."""
    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", RECORD_END).text(root)
    return x.select(F.substring_index("value", "\n", 1).alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.expr("substring(value, locate('\n', value) + 1)").alias("text"))


def whole_files(spark: SparkSession, root: str, pattern: str, packed: bool = False) -> DataFrame:
    """(path, mtime, text): one row per file, or per document of the archives below root."""
    if packed:
        return archived(spark, root, pattern)
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            F.col("value").alias("text"),
        )
    )


def json_files(spark: SparkSession, root: str, key: str = "session_id", pattern: str = "*.json", packed: bool = False) -> DataFrame:
    """JSON files with their key and `readable`: false for what is no object or has no key; those stay and can be counted."""
    x = whole_files(spark, root, pattern, packed).withColumn("v", F.try_parse_json("text"))
    return x.select("path", "mtime", X.typed("v", f"$.{key}", "string").alias(key), "v").withColumn(
        "readable", F.col(key).isNotNull()
    )


def category_counts(rows: DataFrame, path: str, *keep: str) -> DataFrame:
    """(…keep, category, n): a nested object's numeric members as rows."""
    m = X.numeric_only(F.try_variant_get("v", path, "map<string,variant>"))
    return rows.select(*keep, F.explode(m).alias("category", "n"))


def tasks(spark: SparkSession, root: str, pattern: str = "*.json", packed: bool = False) -> DataFrame:
    """Task files: board is the folder's session id, or the 8 characters of a 'session-' folder."""
    x = whole_files(spark, root, pattern, packed).withColumn("v", F.try_parse_json("text"))
    folder = F.element_at(F.split("path", "/"), -2)
    return x.select(
        F.regexp_replace(folder, "^session-", "").alias("board"), X.typed("v", "$.id", "string").alias("task_id"),
        X.typed("v", "$.subject", "string").alias("subject"), X.typed("v", "$.status", "string").alias("status"),
        F.coalesce(F.try_variant_get("v", "$.blockedBy", "array<string>"), F.array().cast("array<string>")).alias("blocked_by"),
    ).where("task_id is not null")


def notes(spark: SparkSession, root: str, pattern: str = "*.md", packed: bool = False) -> DataFrame:
    """Markdown notes with front matter: name, description, type, body, links, time and slug from the file name."""
    x = whole_files(spark, root, pattern, packed).withColumn("file", F.substring_index("path", "/", -1))
    return x.select(
        "path", "mtime", "file", F.coalesce(X.front_matter(F.col("text"), "name"), F.regexp_replace("file", r"\.md$", "")).alias("name"),
        X.front_matter(F.col("text"), "description").alias("description"), X.front_matter(F.col("text"), "type").alias("type"),
        X.body_of(F.col("text")).alias("body"), X.links_of(X.body_of(F.col("text"))).alias("links"),
        X.stamp_of_name(F.col("file")).alias("ts"), X.slug_of_name(F.col("file")).alias("slug"),
    )


def sections(texts: DataFrame, markers: list[str]) -> DataFrame:
    """(id, marker, body): each document's text from a marker line to the next; the first of each kind wins."""
    rows = texts.select("id", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    name = F.regexp_extract("line", rf"^#*\s*\**({'|'.join(markers)})\**:?\s*$", 1)
    w = Window.partitionBy("id").orderBy("ix")
    x = rows.withColumn("m", F.nullif(name, F.lit(""))).withColumn("marker", F.last("m", True).over(w))
    x = x.withColumn("part", F.count("m").over(w)).where("marker is not null and m is null")
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "line"))), lambda s: s["line"]), "\n"))
    x = x.groupBy("id", "marker", "part").agg(body.alias("body"))
    first = Window.partitionBy("id", "marker").orderBy("part")
    return x.withColumn("r", F.row_number().over(first)).where("r = 1").select("id", "marker", "body")


def log_entries(texts: DataFrame, types: list[str]) -> DataFrame:
    """Entries of a log in its three line forms, from texts(log_id, text): (log_id, seq, date_raw, type, text, supersedes, format).

    'time | [Type] | text', '## date' with '[Type] text' paragraphs and their continuation lines, and '| date | Type | scope | note |'.
    A section's date carries down; lines of no form continue the section entry above them, or are skipped.
    """
    known = "|".join(types)
    rows = texts.select("log_id", F.posexplode(F.split("text", "\n")).alias("ix", "line"))
    get = lambda p, g: F.nullif(F.trim(F.regexp_extract("line", p, g)), F.lit(""))
    pipe = rf"(?i)^\s*(\d{{4}}-\d{{2}}-\d{{2}}\S*)\s*\|\s*\[({known})\]\s*\|\s*(.+)$"
    table = rf"(?i)^\s*\|\s*(\d{{4}}-\d{{2}}-\d{{2}})\s*\|\s*({known})\s*\|([^|]*)\|\s*(.+?)\s*\|?\s*$"
    head, para = r"^##\s+(\d{4}-\d{2}-\d{2})", rf"(?i)^\s*\[({known})\]\s*(.+)$"
    x = rows.withColumns({"h": get(head, 1), "p": get(pipe, 1), "t": get(table, 1), "s": get(para, 1)})
    w = Window.partitionBy("log_id").orderBy("ix")
    x = x.withColumn("section", F.last("h", True).over(w))
    kind = F.when(F.col("p").isNotNull(), "pipe").when(F.col("t").isNotNull(), "table").when(
        F.col("s").isNotNull() & F.col("section").isNotNull(), "section"
    )
    x = x.withColumn("format", kind)
    starts = F.col("format").isNotNull() | F.col("h").isNotNull() | (F.trim("line") == "")
    x = x.withColumn("seq", F.sum(F.col("format").isNotNull().cast("int")).over(w)).withColumn("piece", F.sum(starts.cast("int")).over(w))
    x = x.withColumn("own", F.first("format", True).over(Window.partitionBy("log_id", "piece")))
    x = x.where((F.col("format").isNotNull()) | (F.col("own") == "section")).where("h is null and trim(line) <> ''")
    said = F.coalesce(get(pipe, 3), F.when(F.col("t").isNotNull(), get(table, 4)), F.when(F.col("format") == "section", get(para, 2)), F.trim("line"))
    x = x.withColumns({"said": said, "type0": F.coalesce(get(pipe, 2), get(table, 2), "s"), "date0": F.coalesce("p", "t", "section")})
    out = x.groupBy("log_id", "seq").agg(
        F.min_by("date0", "ix").alias("date_raw"), F.min_by("type0", "ix").alias("type"), F.min_by("format", "ix").alias("format"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "said"))), lambda s: s["said"]), " ").alias("all"),
    )
    parts = X.split_supersedes(F.col("all"))
    return out.select("log_id", "seq", "date_raw", F.initcap("type").alias("type"), parts["text"].alias("text"), parts["supersedes"].alias("supersedes"), "format")


def map_rows(rows: DataFrame, column: str, origin: str, *keep: str) -> DataFrame:
    """(…keep, origin, name, v): the members of a JSON object column as rows."""
    m = F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")
    return rows.select(*keep, F.lit(origin).alias("origin"), F.explode(m).alias("name", "v"))


def table(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """A relational table: Parquet, or any JDBC source whose driver is on the class path (partitioned by partitionColumn and its bounds)."""
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
