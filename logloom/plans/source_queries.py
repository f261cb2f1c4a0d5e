"""Queries of sources and scalar rules: given tables are written as files of the wanted form and read back, with DuckDB twins over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.operators import pairing, sessions, text, tools, usage
from logloom.plans.base import r6, snapshots, stamp, t
from logloom.shared import cut, scratch_dir
from logloom.sources import documents, sync, transcripts
from logloom.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _place(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"


def _documents(rows: DataFrame, folder: str, root: str) -> str:
    """rows(folder, value) under root: a document for each row, named by folder, in one archive per task."""
    path = F.concat(F.lit(f"{folder}="), F.col(folder).cast("string"), F.lit("/"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    documents.archive(rows.select(path.alias("path"), F.concat("value", F.lit("\n")).alias("text")), root)
    return root


# --- listings -------------------------------------------------------------------------------------------------


@query(
    """SELECT 'lang=' || lang AS project_dir, CAST(1 AS BIGINT) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, 2 AS depth FROM documents GROUP BY lang"""
)
def session_listing(spark, d):
    """Documents as one session for each language, written in parts where they lie; a nested copy of each is no session."""
    root = _place(spark, "sessions")
    x = t(spark, d, "documents").select("lang", F.col("text").alias("value"))
    x.write.partitionBy("lang").text(f"{root}/projects")
    x.withColumn("deep", F.lit("a")).write.mode("append").partitionBy("lang", "deep").text(f"{root}/projects")
    out = transcripts.session_files(spark, root, "*.txt", parts="^part-[0-9]+-(.*)\\.c[0-9]+\\.txt$")
    return out.groupBy("project_dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("depth").alias("depth"))


_OWNER = "0a1b2c3d-0000-4000-8000-00000000000"


@query(
    f"""WITH n AS (SELECT n_regionkey AS r, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1)
SELECT CASE r % 3 WHEN 1 THEN 'no-owner' WHEN 2 THEN 'too-deep' END AS skip, CASE WHEN r % 3 <> 1 THEN '{_OWNER}' || CAST(r AS VARCHAR) END AS owner, bytes FROM n"""
)
def delegated_listing(spark, d):
    """A region's nations as a file that a session owns, that none owns, or that lies too deep; each region is one folder."""
    root, n = _place(spark, "delegated"), cut(t(spark, d, "nation"), "nations")
    for (r,) in n.select("n_regionkey").distinct().collect():  # the regions: five
        below = {0: f"{_OWNER}{r}/subagents/run", 1: "someone/subagents", 2: f"{_OWNER}{r}/subagents/a/b/c/d/e/f"}[r % 3]
        n.where(F.col("n_regionkey") == r).select("n_name").coalesce(1).write.text(f"{root}/projects/p{r}/{below}")
    x = transcripts.delegated_files(spark, root, pattern="*.txt")
    return x.select("skip", F.col("owner_session_id").alias("owner"), F.col("size").alias("bytes"))


@query("""SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(count(DISTINCT source) AS BIGINT) AS files FROM documents GROUP BY lang""")
def disk_walk(spark, d):
    """Bytes and files below each folder, from metadata alone."""
    root = _place(spark, "walk")
    x = t(spark, d, "documents").select("lang", F.coalesce("source", F.lit("-")).alias("source"), F.col("text").alias("value"))
    x.repartition("lang", "source").write.partitionBy("lang", "source").text(root)
    files = transcripts.files(spark, root, "*.txt").withColumn("lang", F.regexp_extract("path", "lang=([^/]*)", 1))
    return files.groupBy("lang").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query("""SELECT l_linestatus AS status, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def newest_files(spark, d):
    """The rows of the files that were written last; only these are read."""
    root, x = _place(spark, "newest"), t(spark, d, "lineitem")
    line = F.concat_ws("|", "l_linestatus", "l_linenumber").alias("value")
    x.where("l_returnflag <> 'R'").select(line).write.text(root)
    before = transcripts.files(spark, root, "*.txt").count()
    x.where("l_returnflag = 'R'").select(line).write.mode("append").text(root)
    listing = cut(transcripts.files(spark, root, "*.txt"), "listing")
    late = spark.read.text(transcripts.newest_files(listing, listing.count() - before)).select(F.split("value", r"\|").alias("f"))
    return late.groupBy(F.col("f")[0].alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("f")[1].cast("long")).alias("total"))


@query(
    """SELECT 'versions' AS state, substr(sha256(p_brand), 1, 16) AS hash, count(*) AS files, CAST(max(p_partkey) AS BIGINT) AS highest, CAST(sum(p_size) AS BIGINT) AS bytes FROM part WHERE p_size % 7 <> 0 GROUP BY 2
UNION ALL SELECT CASE WHEN p_size % 2 = 0 THEN 'no-version' ELSE 'no-hash' END, NULL, count(*), NULL, CAST(sum(p_size) AS BIGINT) FROM part WHERE p_size % 7 = 0 GROUP BY 1"""
)
def version_listing(spark, d):
    """A listing of version files <hash>@v<number>; every name of another form is counted by its reason."""
    bad = F.when(F.col("p_size") % 2 == 0, F.lit("/h/0123456789abcdef")).otherwise(F.lit("/h/notes@v2"))
    name = F.concat(F.lit("/h/"), F.substring(F.sha2("p_brand", 256), 1, 16), F.lit("@v"), F.col("p_partkey").cast("string"))
    p = t(spark, d, "part").select(F.when(F.col("p_size") % 7 == 0, bad).otherwise(name).alias("path"), F.col("p_size").cast("long").alias("size"))
    x = transcripts.version_files(p)
    return x.groupBy(F.coalesce("skip", F.lit("versions")).alias("state"), "hash").agg(
        F.count("*").alias("files"), F.max("version").alias("highest"), F.sum("size").alias("bytes")
    )


# --- files as rows --------------------------------------------------------------------------------------------


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS session_id, 'balance' AS category, s_acctbal AS n FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'unreadable', 'files', CAST(count(*) AS DOUBLE) FROM supplier WHERE s_suppkey % 5 = 0 HAVING count(*) > 0"""
)
def json_folder(spark, d):
    """One JSON document per supplier: the numbers of a nested object as rows, and how many documents could not be read."""
    counts = F.struct(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    good = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("session_id"), counts.alias("counts")))
    rows = t(spark, d, "supplier").select(F.col("s_nationkey").alias("folder"), F.when(F.col("s_suppkey") % 5 == 0, "{torn").otherwise(good).alias("value"))
    x = cut(documents.json_files(spark, _documents(rows, "folder", _place(spark, "json")), pattern="*.txt", packed=True), "json")
    bad = x.where("not readable").agg(F.count("*").cast("double").alias("n")).where("n > 0")
    bad = bad.select(F.lit("unreadable").alias("session_id"), F.lit("files").alias("category"), "n")
    return documents.category_counts(x.where("readable"), "$.counts", "session_id").unionByName(bad)


@query(
    """SELECT 'board=b' || CAST(c_nationkey AS VARCHAR) AS board, CAST(c_custkey AS VARCHAR) AS task_id, c_name AS subject, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS status, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS blockers FROM customer WHERE c_custkey % 10 <> 9"""
)
def task_files(spark, d):
    """One JSON document per task in a folder per board; what has no id is no task, wrongly typed fields are null."""
    status = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array("c_mktsegment"))).otherwise("[5]")
    value = F.concat(
        F.lit("{"), F.when(F.col("c_custkey") % 10 != 9, F.concat(F.lit('"id":"'), F.col("c_custkey").cast("string"), F.lit('",'))).otherwise(""),
        F.lit('"subject":"'), "c_name", F.lit('","status":'), F.regexp_replace(status, r"[\[\]]", ""),
        F.when(F.col("c_custkey") % 3 == 0, ',"blockedBy":["x"]').otherwise(""), F.lit("}"),
    )
    rows = t(spark, d, "customer").select(F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("board"), value.alias("value"))
    x = documents.tasks(spark, _documents(rows, "board", _place(spark, "tasks")), pattern="*.txt", packed=True)
    return x.select("board", "task_id", "subject", "status", F.size("blocked_by").alias("blockers"))


@query(
    """SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name END AS description, 'note' AS type, 'See [[Nation ' || CAST(s_nationkey AS VARCHAR) || '|x]] and [[other]].' AS body,
 'Nation ' || CAST(s_nationkey AS VARCHAR) || ',other' AS links FROM supplier"""
)
def markdown_notes(spark, d):
    """One note with front matter per supplier: its fields, body and links."""
    about = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('description: "about '), "s_name", F.lit('"\n'))).otherwise("")
    value = F.concat(
        F.lit("---\nname: "), "s_name", F.lit("\n"), about, F.lit("metadata:\n  type: note\n---\n\nSee [[Nation "), F.col("s_nationkey").cast("string"), F.lit("|x]] and [[other]].\n")
    )
    rows = t(spark, d, "supplier").select(F.col("s_nationkey").alias("folder"), value.alias("value"))
    x = documents.notes(spark, _documents(rows, "folder", _place(spark, "notes")), pattern="*.txt", packed=True)
    return x.select("name", "description", "type", "body", F.array_join("links", ",").alias("links"))


@query("""SELECT 'site=' || CAST(page_id % 7 AS VARCHAR) AS folder, count(*) AS files, CAST(sum(length(html) + 1) AS BIGINT) AS chars, count(*) FILTER (contains(html, '<footer>')) AS with_footer FROM pages GROUP BY 1""")
def whole_scripts(spark, d):
    """Pages as one document each, read whole, with the folder from the path."""
    rows = t(spark, d, "pages").select((F.col("page_id") % 7).alias("site"), F.col("html").alias("value"))
    x = documents.whole_files(spark, _documents(rows, "site", _place(spark, "scripts")), "*.txt", packed=True)
    x = x.withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return x.groupBy("folder").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text").contains("<footer>")).alias("with_footer"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def relational_table(spark, d):
    o = documents.table(spark, f"{d}/orders.parquet")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query(
    """SELECT c_custkey AS id, 'Goal' AS marker, 'serve ' || c_name || chr(10) || 'well' AS body FROM customer UNION ALL SELECT c_custkey, 'Done', c_mktsegment FROM customer WHERE c_custkey % 3 = 0"""
)
def marked_sections(spark, d):
    """Sections by marker lines; of two with one marker the first counts, text before any belongs to none."""
    done = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\n**Done**:\n"), "c_mktsegment")).otherwise("")
    value = F.concat(F.lit("intro\n## Goal\nserve "), "c_name", F.lit("\nwell"), done, F.lit("\n# Goal\nagain"))
    return documents.sections(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), value.alias("text")), ["Goal", "Done"])


@query(
    """SELECT lang AS kind, count(*) AS n, CAST(sum(CASE WHEN lang IN ('de', 'fr') AND doc_id % 2 = 0 THEN 2 * n_chars ELSE n_chars END) AS BIGINT) AS chars FROM documents GROUP BY 1"""
)
def incremental_index(spark, d):
    """A stream of files upserts an index by key: the second batch changes half of the documents of two languages, the others of them stay; it comes twice and counts once."""
    root, where = _place(spark, "arrivals"), _place(spark, "index")
    x = t(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("kind"), F.col("doc_id").cast("string").alias("path"), "n_chars")
    late = x.where("kind in ('de', 'fr') and CAST(path AS BIGINT) % 2 = 0").withColumn("n_chars", 2 * F.col("n_chars"))

    def put(df, i):
        for _ in range(2):
            jobs.upsert(df, i, where, lambda b: b, "files")

    for rows in (x, late):
        rows.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(x.schema).parquet(f"{root}/in")
        start = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        start.foreachBatch(put).start().awaitTermination()
    return sync.read(spark, where, x.schema).groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """SELECT lang AS kind, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 2 ELSE 1 END * n_chars AS size FROM documents WHERE doc_id % 11 <> 0 OR lang = 'de'"""
)
def sync_written(spark, d):
    """A first snapshot written as an index, then the sync of a second one merged into it: removed files go, changed ones are replaced, all others stay where they are."""
    where = _place(spark, "index")
    known, cur = snapshots(t(spark, d, "documents"))
    ch = cut(sync.delta(known, cur, spark.createDataFrame([("de",)], "kind string")), "delta")
    first = known.select("kind", "path", "size")
    sync.merge(first, where, "sync", 0)
    again = F.when(F.col("doc_id") % 7 == 0, F.col("size")).otherwise(F.col("size") * 2)
    parsed = cur.join(ch.where("state in ('new', 'changed')"), ["kind", "path"]).select("kind", "path", again.alias("size"))
    sync.merge(parsed, where, "sync", 1, removed=ch.where("state = 'removed'"))
    return sync.read(spark, where, first.schema)


# --- sessions from records ------------------------------------------------------------------------------------


def _session_corpus(spark, d):
    """conversations as one record file each, in turn order, with titles, settings that change, side turns and torn lines; files lie packed, many in one."""
    c = t(spark, d, "conversations").where("conv_id is not null")
    odd = F.col("conv_id") % 2 == 1
    usage_of = F.when(F.col("role") == "assistant", F.struct(F.length("text").alias("input_tokens"), F.octet_length("text").alias("output_tokens"), F.col("turn").alias("cache_read_input_tokens")))
    message = F.struct(
        F.col("role").alias("role"), F.concat(F.lit("\x1b[1m## Ask "), "conv_id", F.lit(":"), "turn", F.lit("\x1b[0m\nrest")).alias("content"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("m"), (F.col("turn") % 3).cast("string"))).alias("model"), usage_of.alias("usage"),
    )
    record = F.struct(
        F.col("role").alias("type"), message.alias("message"), F.date_format(F.timestamp_seconds(F.col("conv_id") * 86400 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("turn") >= 1, F.concat(F.lit("/work/"), F.col("turn").cast("string"))).alias("cwd"), F.when(odd, F.concat(F.lit("v"), F.col("turn").cast("string"))).alias("version"),
        (F.col("turn") % 5 == 4).alias("isSidechain"),
    )
    line = F.when((F.col("turn") == 3) & (F.col("conv_id") % 4 == 0), F.lit("{torn")).otherwise(F.to_json(record))
    title = F.when(odd & (F.col("turn") <= 1), F.to_json(F.struct(F.lit("ai-title").alias("type"), F.concat(F.lit("Title "), "conv_id", F.lit("."), "turn").alias("aiTitle"))))
    x = c.select("conv_id", "turn", F.posexplode(F.array_compact(F.array(line, title))).alias("k", "value"))
    root = _place(spark, "records")
    path = F.concat(F.lit("/projects/conv="), F.col("conv_id").cast("string"), F.lit("/session.txt"))
    transcripts.pack(x.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "k").select(path.alias("path"), "value"), root)
    return transcripts.records(spark, root, pattern="*.txt", packed=True).withColumn("session_id", F.regexp_extract("project_dir", r"conv=(-?\d+)", 1))


_GOOD = "NOT (turn = 3 AND conv_id % 4 = 0)"


@query(
    f"""WITH c AS (SELECT *, {_GOOD} AS good FROM conversations WHERE conv_id IS NOT NULL)
SELECT CAST(conv_id AS VARCHAR) AS session_id,
 CASE WHEN conv_id % 2 = 1 AND min(turn) <= 1 THEN 'Title ' || conv_id || '.' || max(turn) FILTER (turn <= 1) WHEN count(*) FILTER (good AND role = 'user' AND turn % 5 <> 4) > 0 THEN 'Ask ' || conv_id || ':' || min(turn) FILTER (good AND role = 'user' AND turn % 5 <> 4) ELSE CAST(conv_id AS VARCHAR) END AS title,
 CASE WHEN conv_id % 2 = 1 AND min(turn) <= 1 THEN 'title' WHEN count(*) FILTER (good AND role = 'user' AND turn % 5 <> 4) > 0 THEN 'prompt' ELSE 'id' END AS title_source,
 strftime(TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (conv_id * 86400 + 60 * min(turn) FILTER (good)), '%Y-%m-%d %H:%M:%S') AS first_ts,
 strftime(TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (conv_id * 86400 + 60 * max(turn) FILTER (good)), '%Y-%m-%d %H:%M:%S') AS last_ts,
 '/work/' || min(turn) FILTER (good AND turn >= 1) AS cwd, CASE WHEN conv_id % 2 = 1 THEN 'v' || min(turn) FILTER (good) END AS version,
 count(*) FILTER (good AND role = 'user') AS user_turns, count(*) FILTER (good AND role = 'assistant') AS assistant_turns, count(*) FILTER (good AND role IN ('user', 'assistant') AND turn % 5 = 4) AS sidechain_turns,
 count(*) FILTER (good AND role = 'system') AS system_records, CAST(coalesce(sum(length(text)) FILTER (good AND role = 'assistant'), 0) AS BIGINT) AS input, CAST(coalesce(sum(strlen(text)) FILTER (good AND role = 'assistant'), 0) AS BIGINT) AS output,
 count(*) FILTER (NOT good) AS bad_lines, count(*) + count(*) FILTER (conv_id % 2 = 1 AND turn <= 1) AS lines FROM c GROUP BY conv_id"""
)
def session_summaries(spark, d):
    x = sessions.summaries(_session_corpus(spark, d))
    return x.select(
        "session_id", "title", "title_source", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"), "cwd", "version", "user_turns", "assistant_turns",
        "sidechain_turns", "system_records", "input", "output", "bad_lines", "lines",
    )


@query(
    f"""SELECT CAST(conv_id AS VARCHAR) AS session_id, 'm' || (turn % 3) AS model, CAST(sum(length(text)) AS BIGINT) AS input, CAST(sum(strlen(text)) AS BIGINT) AS output, CAST(sum(turn) AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_creation
FROM conversations WHERE role = 'assistant' AND {_GOOD} AND conv_id IS NOT NULL GROUP BY 1, 2"""
)
def session_tokens_by_model(spark, d):
    return sessions.tokens_by_model(_session_corpus(spark, d))


@query(
    """SELECT event_type, 'run ' || event_type || '.sh' AS label, 'bash /x/run ' || event_type || '.sh --token [redacted] -v' AS shown, count(*) AS n, coalesce(max(value), 0) AS max_ms FROM events GROUP BY event_type""".replace("'run ' || event_type", "event_type").replace("/x/run ' || event_type", "/x/' || event_type")
)
def hook_report(spark, d):
    """Hook health with the label of each command and the command as it may be shown."""
    command = F.concat(F.lit("bash  /x/"), "event_type", F.lit(".sh --token hunter2secret -v"))
    h = t(spark, d, "events").select(command.alias("command"), F.col("user_id").alias("session_id"), F.col("value").alias("duration_ms"))
    return usage.hook_report(h).select(F.regexp_extract("command", "/x/([a-z]+)", 1).alias("event_type"), "label", "shown", "n", "max_ms")


@query("""SELECT count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) % 10) AS names, count(*) AS occurrences FROM events WHERE event_type = 'view'""")
def unparsed_tool_names(spark, d):
    """Names with the tool prefix that name no server are counted, not lost."""
    k = (F.get_json_object("props", "$.k").cast("long") % 10).cast("string")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("mcp____"), k)).otherwise(F.concat(F.lit("mcp__"), "event_type", F.lit("__t_"), k))
    return tools.unparsed_names(t(spark, d, "events").select(name.alias("name")))


# --- scalar rules ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name || ' ' || p_type || '!!' AS plain FROM part""")
def escapes_stripped(spark, d):
    x = F.concat(F.lit("\x1b[1;31m"), "p_name", F.lit("\x1b[0m \x1b]0;title\x07"), "p_type", F.lit("\x1b(!\x1bM!"))
    return t(spark, d, "part").select("p_partkey", X.strip_ansi(x).alias("plain"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE '' END AS title FROM part""")
def title_lines(spark, d):
    k = F.col("p_size") % 3
    x = F.when(k == 0, F.concat(F.lit("\n---\n## > - "), "p_name", F.lit("\nrest"))).when(k == 1, F.concat(F.lit("***\n1. "), "p_type")).otherwise("--\n**\n#")
    return t(spark, d, "part").select("p_partkey", X.title_line(x).alias("title"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_type END AS prose FROM part""")
def prose_kept(spark, d):
    """Envelope elements go with their text; a stray tag goes alone."""
    x = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<note>gone\nall</note>"), "p_name", F.lit("<meta>x</meta>"))).otherwise(F.concat("p_name", F.lit("</note>"), "p_type"))
    return t(spark, d, "part").select("p_partkey", X.prose_only(x, ["note", "meta"]).alias("prose"))


@query("""SELECT p_partkey, substr(CASE WHEN p_size % 2 = 0 THEN 'id-' || p_partkey ELSE repeat(p_name || ' ', 20) END, 1, 140) AS title FROM part""")
def title_fallbacks(spark, d):
    x = F.when(F.col("p_size") % 2 == 0, F.lit("---\n")).otherwise(F.concat(F.repeat(F.concat("p_name", F.lit(" ")), 20), F.lit(".")))
    return t(spark, d, "part").select("p_partkey", X.title_or(x, F.concat(F.lit("id-"), F.col("p_partkey").cast("string"))).alias("title"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/home-' || c_name ELSE 'rel-' || c_name END AS path FROM customer""")
def project_paths(spark, d):
    x = F.concat(F.when(F.col("c_custkey") % 2 == 0, "-home-").otherwise("rel-"), "c_name")
    return t(spark, d, "customer").select("c_custkey", X.project_path(x).alias("path"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '.py' WHEN 1 THEN event_type WHEN 2 THEN 'A=1 ' || event_type || ' x' WHEN 3 THEN event_type || ' | sort' ELSE substr('python3 -c ' || repeat(event_type || ' ', 12), 1, 45) || '...' END AS label FROM events"""
)
def hook_labels(spark, d):
    k, e = F.col("event_id") % 5, F.col("event_type")
    x = (
        F.when(k == 0, F.concat(F.lit("node '/a/b/"), e, F.lit(".py' --x"))).when(k == 1, F.concat(F.lit("/usr/bin/"), e, F.lit(" -a b")))
        .when(k == 2, F.concat(F.lit("A=1   "), e, F.lit("  x"))).when(k == 3, F.concat(e, F.lit(" | sort"))).otherwise(F.concat(F.lit("python3 -c "), F.repeat(F.concat(e, F.lit(" ")), 12)))
    )
    return t(spark, d, "events").select("event_id", X.hook_label(x).alias("label"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, CASE WHEN event_id % 4 <> 0 THEN event_type || '-of-' || user_id ELSE '' END AS slug FROM events"""
)
def file_name_parts(spark, d):
    """Time and slug of note file names; names of another form have neither."""
    good = F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-"), "event_type", F.lit("-of-"), F.col("user_id").cast("string"), F.lit("-abcdef12.md"))
    n = F.when(F.col("event_id") % 4 != 0, good).otherwise(F.concat("event_type", F.lit(".md")))
    return t(spark, d, "events").select("event_id", stamp(X.stamp_of_name(n)).alias("ts"), X.slug_of_name(n).alias("slug"))


@query("""SELECT event_id, event_type IN ('click', 'error') OR event_id % 3 = 0 AS dispatch FROM events""")
def dispatch_tests(spark, d):
    name = F.when(F.col("event_type") == "click", "Task").when(F.col("event_type") == "error", "Agent").otherwise(F.col("event_type"))
    return t(spark, d, "events").select("event_id", X.is_dispatch(name, F.when(F.col("event_id") % 3 == 0, F.lit("reviewer"))).alias("dispatch"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 4 < 2 AS bare, CASE WHEN o_orderkey % 4 < 2 THEN date_trunc('day', o_orderdate) WHEN o_orderkey % 4 = 2 THEN date_trunc('second', o_orderdate) END AS t FROM orders)
SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS a, strftime(CASE WHEN bare THEN t + INTERVAL 1 DAY ELSE t END, '%Y-%m-%d %H:%M:%S') AS z FROM o"""
)
def day_windows(spark, d):
    """A bare date is its whole day, a full time is a moment, anything else is nothing."""
    k = F.col("o_orderkey") % 4
    raw = F.when(k < 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    w = X.entry_window(raw)
    return t(spark, d, "orders").select("o_orderkey", stamp(w["start"]).alias("a"), stamp(w["end"]).alias("z"))


@query("""SELECT c_custkey, CAST(1 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS numbers, round(c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END, 6) AS total FROM customer""")
def numeric_maps(spark, d):
    """The finite numbers of an object and their sum; strings, flags and nulls are none."""
    nation = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit('"'), F.col("c_nationkey").cast("string"), F.lit('"')))
    j = F.concat(F.lit('{"balance":'), F.col("c_acctbal").cast("string"), F.lit(',"nation":'), nation, F.lit(',"flag":true,"none":null}'))
    x = t(spark, d, "customer").select("c_custkey", F.try_variant_get(F.try_parse_json(j), "$", "map<string,variant>").alias("m"))
    m = X.numeric_only(F.col("m"))
    return x.select("c_custkey", F.size(m).alias("numbers"), r6(X.map_total(m)).alias("total"))


@query("""SELECT page_id, CASE WHEN page_id % 6 <> 5 THEN regexp_extract(url, '://([^/?#]*)', 1) END AS host FROM pages""")
def url_hosts(spark, d):
    u = F.when(F.col("page_id") % 6 == 5, F.concat(F.lit("not a url "), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return t(spark, d, "pages").select("page_id", X.url_host(u).alias("host"))


@query("""SELECT p_partkey, p_size % 3 <> 2 AS is_code FROM part""")
def edit_suffixes(spark, d):
    end = F.when(F.col("p_size") % 3 == 0, ".RS").when(F.col("p_size") % 3 == 1, ".go").otherwise(".rs.txt")
    return t(spark, d, "part").select("p_partkey", X.has_suffix(F.concat(F.lit("/Src/"), "p_name", end), [".rs", ".go"]).alias("is_code"))


# --- texts with known answers ---------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CAST(ix AS INTEGER) AS ix, sentence FROM (SELECT p_partkey AS doc_id, unnest([0, 1, 2, 3, 4]) AS ix,
 unnest(['About ' || p_name, 'Part no. ' || p_partkey || ' weighs 3.5 kg, e.g. in ' || p_type || '.', 'It is "new."', 'Is it big?', 'Yes... it is made by ' || p_brand || '!']) AS sentence FROM part)"""
)
def sentences_of_parts(spark, d):
    """Sentences of a markdown text about each part: abbreviations, numbers, quotes and dots inside words end none."""
    x = F.concat(
        F.lit("# About "), "p_name", F.lit("\n\n> Part no. "), F.col("p_partkey").cast("string"), F.lit(" weighs **3.5** kg, e.g. in "), "p_type",
        F.lit('. It is "new." Is it `big`? Yes... it is made by '), "p_brand", F.lit("!\n\n```\nlet x = 1. No.\n```\n| a | b |\n"),
    )
    return text.sentence_table(t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), x.alias("text")))


_WORDS = {
    "the": 1, "part": 1, "is": 1, "made": 1, "of": 1, "readability": 5, "people": 2, "idea": 3, "science": 2, "going": 2, "language": 2, "nation": 2, "table": 2,
    "quiet": 2, "beautiful": 3, "video": 3, "create": 2, "whale": 1, "radio": 3, "recipe": 3,
}
_LEXICON = sorted(_WORDS)


@query(
    f"""WITH lex(k, s) AS (VALUES {", ".join(f"({i}, {_WORDS[w]})" for i, w in enumerate(_LEXICON))}),
w AS (SELECT p_partkey AS doc_id, a.s + b.s + c.s + 4 * {_WORDS["table"]} AS s FROM part JOIN lex a ON a.k = p_size % {len(_LEXICON)} JOIN lex b ON b.k = p_partkey % {len(_LEXICON)} JOIN lex c ON c.k = (p_partkey + p_size) % {len(_LEXICON)})
SELECT doc_id, CAST(2 AS BIGINT) AS sentences, CAST(7 AS BIGINT) AS words, CAST(s AS BIGINT) AS syllables, floor((0.39 * 3.5 + 11.8 * (s / 7) - 15.59) * 100 + 0.5) / 100 AS grade FROM w"""
)
def readability_of_parts(spark, d):
    """Grades of texts over a closed vocabulary; code words don't count."""
    lex = F.array(*map(F.lit, _LEXICON))
    pick = lambda k: F.get(lex, (k % len(_LEXICON)).cast("int"))
    x = F.concat_ws(" ", F.lit("Table"), pick(F.col("p_size")), pick(F.col("p_partkey")), F.lit("table. Table src/main.rs"), pick(F.col("p_partkey") + F.col("p_size")), F.lit("table x_y!"))
    return text.readability(text.sentence_table(t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), x.alias("text"))))


@query(
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'login http://u' || o_custkey || ':[redacted]@h/x?apiKey=[redacted]&page=2 done' WHEN 1 THEN 'Authorization: Bearer [redacted]' WHEN 2 THEN 'password = "[redacted]", count=' || o_custkey
 WHEN 3 THEN 'run [redacted] with ${PROJECT_ROOT}' WHEN 4 THEN '{"token":"[redacted]","x":' || o_custkey || '}' ELSE 'plain words about the key of ' || o_custkey END AS text,
 CASE o_orderkey % 6 WHEN 0 THEN 2 WHEN 5 THEN 0 ELSE 1 END AS n_redacted FROM orders"""
)
def redacted_lines(spark, d):
    """Log lines with secrets of known places."""
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    x = (
        F.when(k == 0, F.concat(F.lit("login http://u"), c, F.lit(":pw"), c, F.lit("@h/x?apiKey=k"), c, F.lit("&page=2 done")))
        .when(k == 1, F.concat(F.lit("Authorization: Bearer a"), c)).when(k == 2, F.concat(F.lit('password = "p'), c, F.lit('", count='), c))
        .when(k == 3, F.lit("run ${API_TOKEN:-x} with ${PROJECT_ROOT}")).when(k == 4, F.concat(F.lit('{"token":"t'), c, F.lit('","x":'), c, F.lit("}")))
        .otherwise(F.concat(F.lit("plain words about the key of "), c))
    )
    return text.redact(t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), x.alias("text")))


_RANK_ROUNDS = 5
_SQL_RANKS = "".join(
    f""", r{k + 1} AS (SELECT n.doc_id, n.ix, 0.15 / n.n + 0.85 * coalesce(g.s, 0) AS r FROM nodes n LEFT JOIN
 (SELECT e.doc_id, e.j, sum(e.p * r{k}.r) AS s FROM e JOIN r{k} ON e.doc_id = r{k}.doc_id AND e.i = r{k}.ix GROUP BY 1, 2) g ON g.doc_id = n.doc_id AND g.j = n.ix)"""
    for k in range(_RANK_ROUNDS)
)


def _trail(spark, d):
    """Each user's events as a text: a sentence of few words for each event."""
    e = t(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = e.select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).cast("int").alias("ix"), F.concat_ws(" ", "event_type", F.concat(F.lit("hour"), F.hour("ts").cast("string"))).alias("sentence"))
    return cut(x, "trail")


@query(
    """WITH s AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS ix, event_type AS a, 'hour' || hour(ts) AS b FROM events),
tm AS (SELECT doc_id, ix, a AS term FROM s UNION ALL SELECT doc_id, ix, b FROM s), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), df AS (SELECT doc_id, term, count(*) AS df FROM tm GROUP BY 1, 2),
v0 AS (SELECT tm.doc_id, ix, tm.term, ln((1 + n) / (1 + df)) + 1 AS w FROM tm JOIN df ON df.doc_id = tm.doc_id AND df.term = tm.term JOIN n ON n.doc_id = tm.doc_id),
v AS (SELECT doc_id, ix, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, ix)) AS w FROM v0),
e0 AS (SELECT a.doc_id, a.ix AS i, b.ix AS j, sum(a.w * b.w) AS w FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.ix <> b.ix GROUP BY 1, 2, 3),
e AS (SELECT doc_id, i, j, w / sum(w) OVER (PARTITION BY doc_id, i) AS p FROM e0), nodes AS (SELECT s.doc_id, ix, n FROM s JOIN n ON n.doc_id = s.doc_id), r0 AS (SELECT doc_id, ix, 1.0 / n AS r FROM nodes)"""
    + _SQL_RANKS
    + f" SELECT doc_id, ix, round(r, 6) AS rank FROM r{_RANK_ROUNDS}"
)
def event_ranks(spark, d):
    """Five rounds of ranking over each user's events."""
    s = _trail(spark, d)
    return text.rank_sentences(s, text.tf_idf(s), epsilon=0.0, rounds=_RANK_ROUNDS).withColumn("rank", r6("rank"))


@query(
    """WITH e AS (SELECT user_id AS g, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'open' WHEN 'purchase' THEN 'resolution' END AS kind FROM events WHERE event_type IN ('error', 'purchase')),
o AS (SELECT g, seq, ts, row_number() OVER (PARTITION BY g ORDER BY ts, seq) AS k FROM e WHERE kind = 'open'),
f AS (SELECT g, list({'ts': ts, 'seq': seq} ORDER BY ts, seq) AS fs FROM e WHERE kind = 'resolution' GROUP BY g)"""
    # Sequential: the k-th item takes the first resolution after it that no earlier item took.
    + """, w AS (SELECT o.g, o.k, o.seq, list_filter(coalesce(fs, []), lambda x: (x.ts > o.ts OR x.ts = o.ts AND x.seq > o.seq) AND x.ts <= o.ts + INTERVAL 14 DAYS) AS can FROM o LEFT JOIN f ON f.g = o.g),
m AS (SELECT g, list({'seq': seq, 'can': list_transform(can, lambda x: x.seq)} ORDER BY k) AS items FROM w GROUP BY g),
z AS (SELECT g, list_reduce(list_prepend([CAST(-1 AS BIGINT)], list_transform(items, lambda i: list_concat([i.seq], i.can))), lambda acc, i: list_concat(acc, [i[1], coalesce(list_filter(i[2:], lambda c: NOT list_contains(list_transform(range(3, len(acc) + 1, 2), lambda p: acc[p]), c))[1], -1)])) AS r FROM m)
SELECT g AS user_id, unnest(list_transform(range(2, len(r), 2), lambda p: r[p])) AS seq, nullif(unnest(list_transform(range(3, len(r) + 1, 2), lambda p: r[p])), -1) AS resolved_by FROM z"""
)
def nearest_loops(spark, d):
    """Errors matched one to one with the nearest purchase of the next 14 days, oldest first."""
    e = t(spark, d, "events").where("event_type in ('error', 'purchase')")
    x = e.select(
        "user_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "open").otherwise("resolution").alias("kind"),
        F.lit("").alias("text"), F.lit(None).cast("string").alias("supersedes"),
    )
    return pairing.match_loops(x, "user_id")
