"""Usage, trend and session queries over the given tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.operators import pairing, sessions, tools, trends, usage
from logloom.plans.base import NOW, now, r6, stamp, t

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _usage(spark, d):
    """events as usage rows: the type is the model, value x 100 the output tokens, half of it the input; `view` has no rate."""
    out = F.floor(F.col("value") * 100 + 0.5).cast("long")
    zero = F.lit(0).cast("long")
    return t(spark, d, "events").select(
        "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("model"), F.floor(out / 2).cast("long").alias("input"),
        out.alias("output"), zero.alias("cache_read"), zero.alias("cache_creation"),
    )


_RATES = (("signup", 15.0, 75.0), ("error", 1.0, 5.0), ("click", 3.0, 15.0), ("purchase", 5.0, 25.0))


def _rates(spark, rows=_RATES):
    return spark.createDataFrame(list(rows), "model string, input_per_million double, output_per_million double")


_SQL_USAGE = """
WITH rates(model, ri, ro) AS (VALUES ('signup', 15.0, 75.0), ('error', 1.0, 5.0), ('click', 3.0, 15.0), ('purchase', 5.0, 25.0)),
u AS (SELECT ts, user_id, event_type AS model, CAST(floor(value * 100 + 0.5) AS BIGINT) AS output,
             CAST(floor(floor(value * 100 + 0.5) / 2) AS BIGINT) AS input,
             time_bucket(INTERVAL 5 HOURS, ts, TIMESTAMP '1970-01-01') AS block FROM events)"""


@query(
    _SQL_USAGE
    + """,
pm AS (SELECT block, u.model, sum(input) AS i, sum(output) AS o, count(*) AS n, any_value(ri) AS ri, any_value(ro) AS ro
       FROM u LEFT JOIN rates USING (model) GROUP BY block, u.model),
b AS (SELECT block, sum(i) AS i, sum(o) AS o, sum(n) AS n, string_agg(model, ',' ORDER BY model) AS models,
             CASE WHEN count(*) = count(ri) THEN sum(i * ri / 1e6 + o * ro / 1e6) END AS cost FROM pm GROUP BY block)
SELECT strftime(block, '%Y-%m-%d %H:%M:%S') AS block, CAST(i AS BIGINT) AS input, CAST(o AS BIGINT) AS output, CAST(n AS BIGINT) AS turns,
       models, round(cost, 6) AS cost, (SELECT count(DISTINCT user_id) FROM u WHERE u.block = b.block) AS sessions FROM b"""
)
def usage_blocks(spark, d):
    x = usage.usage_blocks(_usage(spark, d), _rates(spark))
    return x.select(stamp("block").alias("block"), "input", "output", "turns", "models", r6("cost").alias("cost"), "sessions")


@query(
    """
SELECT l_returnflag AS model, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input, CAST(sum(l_linenumber) AS BIGINT) AS output,
       round(CASE l_returnflag WHEN 'A' THEN sum(CAST(l_quantity AS BIGINT)) * 3.0 / 1e6 + sum(l_linenumber) * 15.0 / 1e6
                         WHEN 'R' THEN sum(CAST(l_quantity AS BIGINT)) * 1.0 / 1e6 + sum(l_linenumber) * 5.0 / 1e6 END, 6) AS cost
FROM lineitem GROUP BY l_returnflag"""
)
def usage_totals(spark, d):
    zero = F.lit(0).cast("long")
    u = t(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("long").alias("input"),
        F.col("l_linenumber").cast("long").alias("output"), zero.alias("cache_read"), zero.alias("cache_creation"),
    )
    x = usage.usage_totals(u, _rates(spark, (("A", 3.0, 15.0), ("R", 1.0, 5.0))))
    return x.select("model", "input", "output", r6("cost").alias("cost"))


@query(
    _SQL_USAGE
    + """
SELECT round(sum(i * ri / 1e6 + o * ro / 1e6), 6) AS cost, count(*) - count(ri) AS unpriced_models,
       CAST(coalesce(sum(CASE WHEN ri IS NULL THEN i + o END), 0) AS BIGINT) AS unpriced_tokens
FROM (SELECT u.model, sum(input) AS i, sum(output) AS o, any_value(ri) AS ri, any_value(ro) AS ro FROM u LEFT JOIN rates USING (model) GROUP BY u.model)"""
)
def total_cost(spark, d):
    x = usage.total_cost(_usage(spark, d), _rates(spark))
    return x.select(r6("cost").alias("cost"), "unpriced_models", "unpriced_tokens")


@query(
    """
SELECT m AS model, count(*) AS n, CAST(CASE WHEN m = '<synthetic>' THEN 0.0 WHEN regexp_replace(m, '-[0-9]{8}$', '') = 'F' THEN 2.0 WHEN m = 'O' THEN 4.0 END AS DOUBLE) AS rate_in
FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN '<synthetic>' WHEN o_orderpriority = '2-HIGH' THEN o_orderstatus || '-2024'
                  WHEN o_orderstatus = 'F' THEN 'F-20240101' ELSE o_orderstatus END AS m FROM orders) GROUP BY m"""
)
def rate_lookup(spark, d):
    """Exact id, else without a date suffix; never a prefix; the unbilled model is 0."""
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    m = (
        F.when(prio == "1-URGENT", "<synthetic>").when(prio == "2-HIGH", F.concat(status, F.lit("-2024")))
        .when(status == "F", "F-20240101").otherwise(status)
    )
    n = t(spark, d, "orders").groupBy(m.alias("model")).agg(F.count("*").alias("n"))
    return usage.priced(n, _rates(spark, (("F", 2.0, 8.0), ("O", 4.0, 16.0)))).select("model", "n", "rate_in")


@query(
    """
WITH h AS (SELECT event_type AS command, user_id, CASE WHEN event_id % 5 <> 0 AND event_type <> 'signup' THEN value END AS ms FROM events)
SELECT command, count(*) AS n, count(*) - count(ms) AS missing, coalesce(quantile_disc(ms, 0.5), 0) AS p50, coalesce(quantile_disc(ms, 0.95), 0) AS p95,
       coalesce(max(ms), 0) AS max_ms, round(coalesce(sum(ms), 0), 4) AS total_ms, count(DISTINCT user_id) AS sessions FROM h GROUP BY command"""
)
def hook_health(spark, d):
    ms = F.when((F.col("event_id") % 5 != 0) & (F.col("event_type") != "signup"), F.col("value"))
    h = t(spark, d, "events").select(F.col("event_type").alias("command"), F.col("user_id").alias("session_id"), ms.alias("duration_ms"))
    return usage.hook_health(h).withColumn("total_ms", F.round("total_ms", 4))


def _sessions(spark, d):
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("first_ts"), F.col("o_totalprice").alias("cost"),
        (F.col("o_totalprice") * 10).alias("tokens"), F.col("o_custkey").alias("project"),
    )


@query(
    """SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS cost, round(sum(o_totalprice * 10), 2) AS tokens, count(*) AS sessions
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"""
)
def daily_cost(spark, d):
    x = usage.daily_trend(_sessions(spark, d))
    return x.select("day", F.round("cost", 2).alias("cost"), F.round("tokens", 2).alias("tokens"), "sessions")


@query(
    """SELECT l_returnflag AS model, round(sum(l_extendedprice), 2) AS cost, round(sum(l_quantity), 2) AS tokens, count(*) AS n FROM lineitem GROUP BY 1"""
)
def cost_by_model(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("cost"), F.col("l_quantity").alias("tokens"))
    x = usage.by_key(li, "model", "cost", "tokens")
    return x.select("model", F.round("cost", 2).alias("cost"), F.round("tokens", 2).alias("tokens"), "n")


@query("""SELECT o_custkey AS project, round(sum(o_totalprice), 2) AS cost, count(*) AS n FROM orders GROUP BY 1""")
def cost_by_project(spark, d):
    x = usage.by_key(_sessions(spark, d), "project", "cost")
    return x.select("project", F.round("cost", 2).alias("cost"), "n")


@query(
    """SELECT round(sum(l_extendedprice), 2) AS cost, count(*) AS sessions,
 round(least(1.0, greatest(0.0, avg(CASE WHEN l_discount * 12 BETWEEN 0 AND 1 THEN l_discount * 12 END))), 6) AS hit_rate, (SELECT count(*) FROM events) AS events FROM lineitem"""
)
def headline_summary(spark, d):
    s = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("cost"), (F.col("l_discount") * 12).alias("cache_hit_rate"))
    x = usage.headline(s, t(spark, d, "events").select("event_id"))
    return x.select(F.round("cost", 2).alias("cost"), "sessions", r6("hit_rate").alias("hit_rate"), "events")


@query(
    """SELECT CAST(h AS INTEGER) AS hour, count(event_id) AS n FROM range(24) r(h) LEFT JOIN events ON h = extract(hour FROM ts + INTERVAL 2 HOURS) GROUP BY h"""
)
def prompts_by_hour(spark, d):
    return trends.prompts_by_hour(t(spark, d, "events").select("ts"), "Etc/GMT-2")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""")
def prompts_by_day(spark, d):
    return trends.prompts_by_day(t(spark, d, "events").select("ts"))


@query(
    """SELECT role AS project, count(*) AS n, count(*) FILTER (turn % 3 = 0) AS pastes, CAST(quantile_disc(length(text), 0.5 ORDER BY length(text) DESC) AS BIGINT) AS median_length
FROM (SELECT *, length(text) FROM conversations) GROUP BY role""".replace("quantile_disc(length(text), 0.5 ORDER BY length(text) DESC)", "percentile_disc(0.5) WITHIN GROUP (ORDER BY length(text) DESC)")
)
def prompt_stats(spark, d):
    p = t(spark, d, "conversations").select(
        F.col("role").alias("project"), (F.col("turn") % 3 == 0).alias("had_paste"), F.lit(None).cast("timestamp").alias("ts"),
        F.length("text").cast("long").alias("length"),
    )
    return trends.prompt_stats(p).select("project", "n", "pastes", F.col("median_length").cast("long").alias("median_length"))


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month FROM orders WHERE month(o_orderdate) <> 4),
s AS (SELECT unnest(generate_series(greatest((SELECT min(month) FROM m), (SELECT max(month) FROM m) - INTERVAL 119 MONTHS), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month)
SELECT strftime(s.month, '%Y-%m') AS month, count(m.month) AS n FROM s LEFT JOIN m ON s.month = m.month GROUP BY s.month"""
)
def month_trend(spark, d):
    """Months without rows stay, as zeros."""
    o = t(spark, d, "orders").where("month(o_orderdate) <> 4")
    return trends.month_spine(o, "o_orderdate")


@query(
    """SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 1, 2"""
)
def users_by_sketch(spark, d):
    """Distinct users of each month from sketches of its days, beside the exact count: close if within the stated error."""
    e = t(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), "user_id")
    days = usage.distinct_sketches(e, "user_id", "event_type", "month", "day")
    exact = e.groupBy("event_type", "month").agg(F.countDistinct("user_id").alias("users"))
    x = usage.distinct_over(days, "event_type", "month").join(exact, ["event_type", "month"])
    return x.select("event_type", "month", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= usage.SKETCH_ERROR * F.col("users")).alias("close"))


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month FROM orders), s AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-12-01', INTERVAL 1 MONTH)) AS month)
SELECT strftime(s.month, '%Y-%m') AS month, count(m.month) AS n FROM s LEFT JOIN m ON s.month = m.month GROUP BY s.month
UNION ALL SELECT 'before', count(*) FROM m WHERE month < TIMESTAMP '1996-01-01' HAVING count(*) > 0 UNION ALL SELECT 'after', count(*) FROM m WHERE month > TIMESTAMP '1997-12-01' HAVING count(*) > 0"""
)
def month_trend_window(spark, d):
    """Two years of months; what lies before and after is counted, not lost."""
    return trends.month_spine(t(spark, d, "orders"), "o_orderdate", F.lit("1997-12-15").cast("timestamp"), 24)


@query(
    """WITH r AS (SELECT event_type AS skill, ts, user_id, event_id % 3 = 0 AS del, user_id % 7 AS project FROM events),
m AS (SELECT skill, strftime(ts, '%Y-%m-%d') AS mo, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT skill, mo, n, row_number() OVER (PARTITION BY skill ORDER BY n DESC, mo) AS k FROM m)
SELECT r.skill, count(*) AS n, count(*) FILTER (del) AS delegated, count(*) FILTER (NOT del) AS mainline, count(DISTINCT user_id) AS sessions, count(DISTINCT project) AS projects,
 strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, any_value(strftime(ts, '%Y-%m')) AS busiest_month
FROM r GROUP BY r.skill""".replace("any_value(strftime(ts, '%Y-%m')) AS busiest_month", "(SELECT x.mo FROM (SELECT skill, strftime(ts, '%Y-%m') AS mo, count(*) AS n FROM r r2 WHERE r2.skill = r.skill GROUP BY 1, 2 ORDER BY n DESC, mo LIMIT 1) x) AS busiest_month").replace("m AS (SELECT skill, strftime(ts, '%Y-%m-%d') AS mo, count(*) AS n FROM r GROUP BY 1, 2),\nb AS (SELECT skill, mo, n, row_number() OVER (PARTITION BY skill ORDER BY n DESC, mo) AS k FROM m)\n", "one AS (SELECT 1)\n")
)
def skill_activity(spark, d):
    r = t(spark, d, "events").select(
        F.col("event_type").alias("skill"), "ts", F.col("user_id").alias("session_id"), (F.col("event_id") % 3 == 0).alias("is_delegated"),
        (F.col("user_id") % 7).alias("project"),
    )
    x = trends.skill_activity(r)
    return x.select("skill", "n", "delegated", "mainline", "sessions", "projects", stamp("first_ts").alias("first_ts"), "busiest_month")


@query("""SELECT CAST(hour AS INTEGER) AS hour, n FROM (SELECT extract(hour FROM ts) AS hour, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, hour LIMIT 1""")
def peak_hour(spark, d):
    return trends.peak(t(spark, d, "events").select(F.hour("ts").alias("hour")), "hour")


@query("""SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def share_of_total(spark, d):
    return trends.shares(t(spark, d, "events"), "event_type").withColumn("share", r6("share"))


_AGED = f"""WITH e AS (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'other' END AS status,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 40) END AS resolved FROM orders),
a AS (SELECT *, CAST(floor((epoch_us(coalesce(resolved, TIMESTAMP '{NOW}')) - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS days FROM e)"""


def _aged(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("other")
    fixed = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 40).cast("int")))
    e = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), status.alias("status"), fixed.alias("resolved_ts"))
    return trends.aging(e, now())


@query(
    _AGED
    + """SELECT CASE WHEN days <= 1 THEN 'today' WHEN days <= 7 THEN 'week' WHEN days <= 31 THEN 'month' WHEN days <= 92 THEN 'quarter' ELSE 'stale' END AS band,
 count(*) AS n, max(days) AS oldest FROM a WHERE status = 'open' GROUP BY 1"""
)
def friction_bands(spark, d):
    return _aged(spark, d).where("status = 'open'").groupBy("band").agg(F.count("*").alias("n"), F.max("days").alias("oldest"))


@query(
    _AGED
    + """SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved, max(days) FILTER (status = 'open') AS oldest_days,
 (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY days DESC) FROM a WHERE status = 'resolved') AS median_days_to_close,
 round(count(*) FILTER (status = 'resolved') / count(*) FILTER (status IN ('open', 'resolved')), 6) AS resolution_rate FROM a"""
)
def friction_aging(spark, d):
    return trends.aging_summary(_aged(spark, d)).withColumn("resolution_rate", r6("resolution_rate"))


@query(
    """WITH j AS (SELECT lang, source, CAST(quality AS VARCHAR) AS quality FROM documents JOIN labels USING (doc_id)),
x AS (SELECT 'lang' AS dimension, lang AS value FROM j UNION ALL SELECT 'source', source FROM j UNION ALL SELECT 'quality', quality FROM j)
SELECT dimension, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY dimension), 6) AS share FROM x GROUP BY 1, 2"""
)
def outcome_distributions(spark, d):
    j = t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return trends.outcome_tallies(j, "lang", "source", "quality").withColumn("share", r6("share"))


@query(
    """SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS population, (SELECT count(DISTINCT doc_id) FROM labels) AS judged,
 (SELECT count(DISTINCT l.doc_id) FROM labels l JOIN documents d ON l.doc_id = d.doc_id) AS measured,
 (SELECT count(DISTINCT l.doc_id) FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL) AS judged_unknown"""
)
def judgement_coverage(spark, d):
    return trends.coverage(t(spark, d, "labels"), t(spark, d, "documents"), "doc_id")


@query(
    """WITH s AS (SELECT ts, user_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events)
SELECT count(*) AS samples, count(*) - count(k) AS without_limits, strftime(max(ts) FILTER (k IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS ts, (SELECT k FROM s WHERE k IS NOT NULL ORDER BY ts DESC, user_id DESC LIMIT 1) AS limits FROM s"""
)
def pacing_summary(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    s = t(spark, d, "events").select("ts", F.col("user_id").alias("session_id"), F.when(k % 4 != 0, k).alias("limits"))
    return trends.pacing(s).select("samples", "without_limits", stamp("ts").alias("ts"), "limits")


@query(
    """SELECT source AS bucket, count(*) AS files, CAST(sum(n_chars * 3) AS BIGINT) AS chars, CAST(floor(sum(n_chars * 3) / 4 + 0.5) AS BIGINT) AS tokens,
 count(*) FILTER (n_chars * 3 >= 38000 AND n_chars * 3 < 40000) AS warn, count(*) FILTER (n_chars * 3 >= 40000) AS over, max(n_chars * 3) AS largest,
 (SELECT doc_id FROM documents e WHERE e.source = d.source ORDER BY n_chars DESC, doc_id LIMIT 1) AS largest_name,
 floor(100.0 * max(n_chars * 3) / 40000 * 10 + 0.5) / 10 AS percent_of_ceiling FROM documents d GROUP BY source"""
)
def size_budget(spark, d):
    s = t(spark, d, "documents").select(F.col("source").alias("bucket"), F.col("doc_id").alias("name"), (F.col("n_chars") * 3).alias("chars"))
    return trends.size_budget(s)


@query(
    """SELECT CASE WHEN source IN ('src0', 'src1') THEN 'hot' WHEN source IN ('src2', 'src3') THEN 'warm' ELSE 'other' END AS category,
 CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files, max(doc_id) AS newest FROM documents GROUP BY 1"""
)
def disk_rollup(spark, d):
    cats = spark.createDataFrame([("src0", "hot"), ("src1", "hot"), ("src2", "warm"), ("src3", "warm")], "prefix string, category string")
    f = t(spark, d, "documents").select(F.col("source").alias("prefix"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("ts"))
    return trends.disk_rollup(f, cats)


# --- sessions -------------------------------------------------------------------------------------------------


@query(
    """SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'system') AS system_turns,
 CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(substr(text, 1, 40), turn) AS first_text, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id"""
)
def session_summary(spark, d):
    c = t(spark, d, "conversations")
    n = lambda r: F.count_if(F.col("role") == r)
    return c.groupBy("conv_id").agg(
        n("user").alias("user_turns"), n("assistant").alias("assistant_turns"), n("system").alias("system_turns"),
        F.sum(F.length("text")).alias("chars"), F.min_by(F.substring("text", 1, 40), "turn").alias("first_text"), F.max("turn").alias("last_turn"),
    )


@query(
    """SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS position FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)"""
)
def named_counts(spark, d):
    return sessions.named_counts(t(spark, d, "events"), "user_id", "event_type").withColumn("position", F.col("position").cast("long"))


@query(
    """WITH s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 40)
SELECT count(*) AS sessions, CAST(sum(u) AS BIGINT) AS user_turns, CAST(sum(a) AS BIGINT) AS assistant_turns FROM s"""
)
def newest_session_totals(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns")
    )
    x = c.select(F.col("conv_id").alias("session_id"), "user_turns", "assistant_turns", F.timestamp_seconds("conv_id").alias("first_ts"), F.timestamp_seconds("conv_id").alias("last_ts"))
    return sessions.totals(x, 40).select("sessions", "user_turns", "assistant_turns")


@query(
    """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source AS session_id, doc_id AS path, count(*) FILTER (line LIKE '%.') AS added, count(*) FILTER (line LIKE 'T%') AS removed, count(*) AS edits FROM l GROUP BY 1, 2"""
)
def touched_files(spark, d):
    l = t(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    e = l.select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("path"), F.col("line").endswith(".").cast("int").alias("added"),
        F.col("line").startswith("T").cast("int").alias("removed"), F.lit(None).cast("timestamp").alias("ts"), F.lit(False).alias("user_modified"),
    )
    return sessions.touched_files(e).select("session_id", "path", "added", "removed", "edits")


@query(
    """WITH c AS (SELECT conv_id, turn, floor(turn / 2) - 1 AS parent FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT conv_id, parent FROM c WHERE parent >= 0 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT c.conv_id, count(*) FILTER (k.parent IS NOT NULL) AS branches FROM c LEFT JOIN k ON c.conv_id = k.conv_id AND c.turn = k.parent GROUP BY 1"""
)
def fork_points(spark, d):
    parent = F.floor(F.col("turn") / 2) - 1
    r = t(spark, d, "conversations").where("role in ('user', 'assistant')").select(
        F.col("conv_id").alias("session_id"), F.col("role").alias("type"), F.col("turn").cast("string").alias("uuid"),
        F.when(parent >= 0, parent.cast("string")).alias("parent_uuid"),
    )
    return sessions.forks(r).groupBy(F.col("session_id").alias("conv_id")).agg(F.count_if("is_branch").alias("branches"))


@query("""SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role IN ('user', 'assistant') AND turn % 4 <> 3""")
def mainline_turns(spark, d):
    r = t(spark, d, "conversations").select(F.col("role").alias("type"), F.when(F.col("turn") % 4 == 3, True).alias("is_sidechain"), F.lit(None).cast("boolean").alias("is_meta"), "text")
    return sessions.mainline(r).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT doc_id, substr(text, 1, 60) AS excerpt, length(text) > 60 AS truncated FROM documents""")
def excerpts(spark, d):
    return t(spark, d, "documents").select("doc_id", X.excerpt(F.col("text"), 60).alias("x")).select("doc_id", "x.excerpt", "x.truncated")


@query("""SELECT doc_id FROM documents WHERE lower(text) LIKE '%there%' OR lower(source) LIKE '%there%'""")
def contains_filter(spark, d):
    return t(spark, d, "documents").where(X.contains_any("There", F.col("text"), F.col("source"))).select("doc_id")


@query("""SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_orderstatus = 'O'""")
def enum_filter(spark, d):
    return t(spark, d, "orders").where((F.lower("o_orderpriority") == "1-urgent") & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query(f"""SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAYS GROUP BY 1""")
def window_cutoff(spark, d):
    return t(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-12 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def clamped_page(spark, d):
    return sessions.page(t(spark, d, "orders"), F.desc("o_totalprice"), "o_orderkey", limit=50, offset=100).select("o_orderkey", "o_totalprice")


@query(
    """SELECT c_custkey, CAST(row_number() OVER (ORDER BY CASE WHEN k = '' THEN 1 ELSE 0 END, k DESC, c_custkey) AS BIGINT) AS position
FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS k FROM customer)"""
)
def missing_last_order(spark, d):
    """Empty and null sort last in either direction."""
    k = F.nullif(F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.lit(""))
    x = t(spark, d, "customer").select("c_custkey", k.alias("k"))
    return sessions.numbered(x, F.desc_nulls_last("k"), F.col("c_custkey").asc()).select("c_custkey", "position")


@query("""SELECT 'main' AS site, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 2 UNION ALL SELECT 'delegated', event_type, count(*) FROM events WHERE event_id % 2 = 1 GROUP BY 2""")
def union_with_site(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type")
    a = e.where("event_id % 2 = 0").withColumn("site", F.lit("main"))
    b = e.where("event_id % 2 = 1").withColumn("site", F.lit("delegated"))
    return a.unionByName(b).groupBy("site", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT origin, name FROM (SELECT 'nation' AS origin, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'nation', n_name FROM nation)""")
def origin_names(spark, d):
    n = t(spark, d, "nation").select(F.lit("nation").alias("origin"), F.col("n_name").alias("name"))
    r = t(spark, d, "region").select(F.lit("region").alias("origin"), F.col("r_name").alias("name"))
    return n.unionByName(r).unionByName(n).dropDuplicates(["origin", "name"])


@query("""SELECT DISTINCT c_mktsegment FROM customer""")
def distinct_values(spark, d):
    return t(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


@query("""SELECT c_nationkey AS k, 'only-customers' AS side FROM customer EXCEPT SELECT s_nationkey, 'only-customers' FROM supplier UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)""")
def set_difference(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return c.exceptAll(s).withColumn("side", F.lit("only-customers")).unionByName(c.intersect(s).withColumn("side", F.lit("both")))
