"""Pairing, tool, text, graph, source and streaming queries over the given tables, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.operators import graph, pairing, sessions, text, tools
from logloom.plans.base import now, r6, snapshots, stamp, t
from logloom.shared import cut, scratch_dir
from logloom.sources import documents, sync, transcripts
from logloom.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pairing --------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS k FROM lineitem WHERE l_returnflag <> 'N')
SELECT o_orderkey, l_linenumber AS line, l_returnflag AS flag FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND k = 1"""
)
def dispatch_results(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    r = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), (F.col("l_returnflag") != "N").alias("admissible")
    )
    return pairing.pair_first(o, r, "id", "line", "flag").select(F.col("id").alias("o_orderkey"), "line", "flag")


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS dispatched FROM customer""")
def matched_flag(spark, d):
    known = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return pairing.with_match_flag(t(spark, d, "customer").select("c_custkey"), known, "c_custkey", "dispatched")


@query(
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nation, customers, suppliers, c.k IS NOT NULL AS in_left, s.k IS NOT NULL AS in_right FROM c FULL JOIN s ON c.k = s.k"""
)
def both_sides_kept(spark, d):
    c = t(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return pairing.both_sides(c, s, "nation")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')""")
def never_dispatched(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""SELECT d.doc_id, source, quality, CASE WHEN l.doc_id IS NULL THEN 'unjudged' ELSE 'judged' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def judgements(spark, d):
    l = t(spark, d, "labels").select("doc_id", "quality").withColumn("state", F.lit("judged"))
    x = t(spark, d, "documents").select("doc_id", "source").join(l, "doc_id", "left")
    return x.withColumn("state", F.coalesce("state", F.lit("unjudged")))


@query(
    """WITH s AS (SELECT event_id AS id, ts AS a, ts + INTERVAL 30 MINUTES + INTERVAL 24 HOURS AS z FROM events WHERE event_type = 'error'),
l AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 30 DAYS AS x FROM orders),
p AS (SELECT s_suppkey AS log_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (s_suppkey * 7 % 700) AS ls FROM supplier)
SELECT id, count(log_id) AS n_logs FROM s LEFT JOIN p ON ls + INTERVAL 1 DAY >= a AND ls <= z GROUP BY id""".replace("l AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 30 DAYS AS x FROM orders),\n", "")
)
def overlap_counts(spark, d):
    s = t(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end")
    )
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(s_suppkey * 7 % 700 AS INT))")
    l = t(spark, d, "supplier").select(F.col("s_suppkey").alias("log_id"), at.alias("start"), (at + F.expr("INTERVAL 1 DAY")).alias("end"))
    return pairing.overlap_counts(s, l).select("id", "n_logs")


@query(
    """WITH s AS (SELECT event_id AS id, ts AS a, ts + INTERVAL 30 MINUTES + INTERVAL 24 HOURS AS z FROM events WHERE event_type = 'error'),
p AS (SELECT s_suppkey AS log_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (s_suppkey * 7 % 700) AS ls FROM supplier),
n AS (SELECT id, count(log_id) AS n_logs FROM s LEFT JOIN p ON ls + INTERVAL 1 DAY >= a AND ls <= z GROUP BY id)
SELECT count(*) FILTER (n_logs > 0) AS logged, count(*) FILTER (n_logs = 0) AS unlogged, CAST(sum(n_logs) AS BIGINT) AS overlaps FROM n"""
)
def friction_gap(spark, d):
    n = F.col("n_logs")
    return overlap_counts(spark, d).agg(F.count_if(n > 0).alias("logged"), F.count_if(n == 0).alias("unlogged"), F.sum(n).alias("overlaps"))


@query(
    """SELECT event_id, strftime((SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) > (e.ts, e.event_id) AND p.ts <= e.ts + INTERVAL 2 DAYS), '%Y-%m-%d %H:%M:%S') AS next_ts
FROM events e WHERE event_type = 'error'"""
)
def nearest_following(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), "event_type")
    x = pairing.next_within(e, "user_id", F.col("event_type") == "error", F.col("event_type") == "purchase", "INTERVAL 2 DAYS")
    return x.select(F.col("seq").alias("event_id"), stamp("next_ts").alias("next_ts"))


def _loops(spark, d):
    """Errors are open items and purchases resolutions; each names the day or the number that it is about."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "error", "open").when(F.col("event_type") == "purchase", "resolution")
    sup = F.when((F.col("event_type") == "purchase") & (k.cast("int") % 2 == 0), F.concat(F.lit('the "item '), k, F.lit('" fix')))
    x = t(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.concat(F.lit("item "), k, F.lit(" broke")).alias("text"), sup.alias("supersedes"))
    return x.where("kind is not null")


@query()
def matched_loops(spark, d):
    """Greedy one-to-one matching by reference, then by nearest following within 14 days."""
    return pairing.match_loops(_loops(spark, d), "user_id")


@query(
    """WITH o AS (SELECT CASE WHEN o_orderpriority LIKE '%NOT%' THEN 'none' ELSE o_orderpriority END AS specialist, o_custkey, o_orderdate,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'async_launched' END AS status, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_totalprice AS BIGINT) END AS len FROM orders)
SELECT specialist, count(*) AS n, count(DISTINCT o_custkey) AS sessions, count(*) FILTER (status = 'async_launched') AS background, count(*) FILTER (status = 'completed') AS foreground,
 count(*) FILTER (status IS NULL) AS unknown_mode, percentile_disc(0.5) WITHIN GROUP (ORDER BY len DESC) AS median_prompt, count(*) - count(len) AS missing_prompt, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_ts FROM o GROUP BY 1"""
)
def delegation_by_specialist(spark, d):
    s = F.col("o_orderpriority")
    o = t(spark, d, "orders").select(
        F.when(s.contains("NOT"), "none").otherwise(s).alias("specialist"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "async_launched").alias("status"),
        F.lit(None).cast("boolean").alias("is_async"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").try_cast("decimal(20,0)").cast("long")).alias("prompt_length"),
    )
    x = pairing.by_specialist(o).withColumn("median_prompt", F.col("median_prompt").cast("long"))
    return x.select("specialist", "n", "sessions", "background", "foreground", "unknown_mode", "median_prompt", "missing_prompt", stamp("first_ts").alias("first_ts"))


@query(
    """WITH f AS (SELECT l_orderkey, count(*) AS records, CAST(sum(l_linenumber) AS BIGINT) AS tool_calls, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS tokens,
 substr(min(CAST(l_linenumber + 100 AS VARCHAR) || l_linestatus), 4) AS specialist, count(DISTINCT l_linestatus) > 1 AS mixed, max(l_shipdate) > min(l_shipdate) AS spans FROM lineitem GROUP BY 1)
SELECT specialist, count(*) AS files, CAST(sum(records) AS BIGINT) AS records, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (NOT spans) AS without_span, count(*) FILTER (mixed) AS mixed_files FROM f GROUP BY 1"""
)
def delegated_work(spark, d):
    r = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("tool_calls"), F.struct("l_linenumber", "l_linestatus").alias("seq"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("long")).alias("tokens"), F.col("l_shipdate").alias("ts"), F.col("l_linestatus").alias("specialist"),
    )
    return pairing.delegated_work(r).drop("span_s")


@query("""SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def replays_dropped(spark, d):
    """The table with itself replayed from an older file: the newer copy of each id stays."""
    e = t(spark, d, "events").select("event_id", "event_type")
    both = e.withColumn("mtime", F.lit(2)).unionByName(e.where("event_id % 3 = 0").withColumns({"mtime": F.lit(1), "event_type": F.lit("stale")}))
    x = pairing.drop_replays(both, "event_id", F.desc("mtime"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    """SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 20) AS large, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS without_k,
 count(DISTINCT user_id) AS users, count(*) FILTER (ts IS NULL) AS undated FROM events"""
)
def scan_evidence(spark, d):
    return t(spark, d, "events").agg(
        F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 20).alias("large"),
        F.count_if(F.get_json_object("props", "$.k").isNull()).alias("without_k"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("ts").isNull()).alias("undated"),
    )


@query(
    """WITH c AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, split_part(p_name, ' ', 1) AS bare FROM part),
k AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM part)
SELECT p_partkey, coalesce(a.k, b.k) AS declared_key, CASE WHEN a.k IS NOT NULL THEN 'key' WHEN b.k IS NOT NULL THEN 'bare_key' END AS matched_by FROM c LEFT JOIN k a ON c.key = a.k LEFT JOIN k b ON lower(c.bare) = b.k"""
)
def canonical_key_join(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name")
    head = F.substring_index("p_name", " ", 1)
    used = p.select("p_partkey", X.canonical_key(F.col("p_name")).alias("key"), X.canonical_key(head).alias("bare_key"))
    dec = p.select(X.canonical_key(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(head)).alias("key"))
    return pairing.fallback_join(used, dec).select("p_partkey", "declared_key", "matched_by")


@query(
    """WITH l AS (SELECT p_partkey, p_name || '#' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || '-' || p_partkey END AS bare FROM part),
ln AS (SELECT *, count(*) OVER (PARTITION BY bare) AS n FROM l),
r0 AS (SELECT CASE WHEN p_size % 3 = 0 THEN p_name || '#' || p_partkey ELSE p_type || '#' || p_partkey END AS name, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_brand || '-' || p_partkey END AS bare, p_size FROM part),
r AS (SELECT *, count(*) OVER (PARTITION BY bare) AS n FROM r0)
SELECT ln.p_partkey, coalesce(e.p_size, CASE WHEN ln.n = 1 THEN r.p_size END) AS value FROM ln LEFT JOIN r0 e ON ln.name = e.name LEFT JOIN r ON ln.bare = r.bare AND r.n = 1 AND ln.n = 1"""
)
def unique_bare_name_join(spark, d):
    """Parts under two spellings: full names that agree for a third, bare names of which some are shared by many."""
    p, key = t(spark, d, "part"), F.col("p_partkey").cast("string")
    bare = lambda k: F.when(F.col("p_size") % k == 0, F.col("p_brand")).otherwise(F.concat_ws("-", "p_brand", key)).alias("bare")
    left = p.select("p_partkey", F.concat_ws("#", "p_name", key).alias("name"), bare(2))
    right = p.select(F.concat_ws("#", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")), key).alias("name"), bare(5), F.col("p_size").alias("value"))
    return pairing.unique_fallback_join(left, right, "name", "bare").select("p_partkey", "value")


@query(
    """SELECT s_suppkey FROM supplier WHERE substr(s_name, 1, 14) IN (SELECT substr(s_name, 1, 14) FROM supplier WHERE s_suppkey % 10 = 3)"""
)
def prefix_membership(spark, d):
    s = t(spark, d, "supplier").withColumn("k", F.substring("s_name", 1, 14))
    live = s.where("s_suppkey % 10 = 3").select("k").distinct()
    return s.join(live, "k", "left_semi").select("s_suppkey")


@query(
    """WITH p AS (SELECT DISTINCT url FROM pages), g AS (SELECT page_id, substr(sha256(url), 1, CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 10 END) AS digest FROM pages WHERE page_id % 5 <> 4
 UNION ALL SELECT page_id, 'ffffffffffff' FROM pages WHERE page_id % 5 = 4)
SELECT page_id, CASE WHEN length(digest) < 8 THEN 'too-short' WHEN n = 0 THEN 'no-match' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN length(digest) >= 8 AND n = 1 THEN path END AS path
FROM (SELECT g.page_id, g.digest, (SELECT count(*) FROM p WHERE starts_with(sha256(url), g.digest)) AS n, (SELECT min(url) FROM p WHERE starts_with(sha256(url), g.digest)) AS path FROM g)"""
)
def digest_paths(spark, d):
    p = t(spark, d, "pages").select("page_id", "url")
    w = F.when(F.col("page_id") % 4 == 0, 3).when(F.col("page_id") % 4 == 1, 8).when(F.col("page_id") % 4 == 2, 16).otherwise(10)
    g = p.select("page_id", F.when(F.col("page_id") % 5 == 4, F.lit("ffffffffffff")).otherwise(F.substring(F.sha2("url", 256), F.lit(1), w)).alias("digest"))
    return pairing.resolve_digests(g, p.select(F.col("url").alias("path"))).select("page_id", "status", "path")


@query(
    """WITH l AS (SELECT 'a' AS layer, 1 AS rank, n_regionkey AS k, min(n_name) AS v FROM nation GROUP BY 3 UNION ALL SELECT 'b', 2, r_regionkey, r_name FROM region WHERE r_regionkey < 3)
SELECT k AS key, arg_max(v, rank) AS value, arg_max(layer, rank) AS layer, string_agg(layer, ',' ORDER BY rank) AS set_by FROM l GROUP BY k"""
)
def settings_overlay(spark, d):
    a = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.min("n_name").alias("value")).withColumns({"layer": F.lit("a"), "rank": F.lit(1)})
    b = t(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"), F.lit("b").alias("layer"), F.lit(2).alias("rank"))
    return pairing.overlay(a.unionByName(b))


@query(
    """WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS part, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, CASE WHEN b.k IS NULL THEN 'only-a' WHEN a.k IS NULL THEN 'only-b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k"""
)
def run_set_comparison(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", F.col("l_partkey").alias("part"))
    n = lambda c: li.where(c).groupBy("part").agg(F.count("*").alias("n"))
    return graph.set_comparison(n("l_returnflag = 'A'"), n("l_returnflag <> 'A'"), "part", "n")


@query("""SELECT s_suppkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'nation-' || s_nationkey) AS plugin FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def two_key_coalesce(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("full"))
    x = t(spark, d, "supplier").join(n, "s_nationkey", "left")
    return x.select("s_suppkey", F.coalesce("full", F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"))).alias("plugin"))


# --- tools ----------------------------------------------------------------------------------------------------


@query(
    """SELECT event_type AS server, count(*) FILTER (event_id % 3 <> 0) AS mainline, count(*) FILTER (event_id % 3 = 0) AS delegated, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) % 10) AS tools,
 count(DISTINCT user_id) AS sessions, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM events WHERE event_type <> 'view' GROUP BY 1"""
)
def server_usage(spark, d):
    k = (F.get_json_object("props", "$.k").cast("long") % 10).cast("string")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("mcp____"), k)).otherwise(F.concat(F.lit("mcp__"), "event_type", F.lit("__t_"), k))
    c = t(spark, d, "events").select(name.alias("name"), "ts", F.col("user_id").alias("session_id"), (F.col("event_id") % 3 == 0).alias("is_delegated"))
    x = tools.server_usage(c)
    return x.select("server", "mainline", "delegated", "tools", "sessions", stamp("first_ts").alias("first_ts"))


@query(
    """WITH u AS (SELECT event_type AS s, count(*) AS calls FROM events GROUP BY 1)
SELECT CASE s WHEN 'error' THEN 'error' ELSE s END AS key, CASE WHEN s IN ('click', 'view') THEN 'used' WHEN s = 'error' THEN 'elsewhere' ELSE 'unaccounted' END AS bucket, calls, CAST(CASE WHEN s = 'click' THEN 2 WHEN s IN ('view', 'error') THEN 1 ELSE 0 END AS BIGINT) AS collisions FROM u
UNION ALL SELECT 'idle', 'never-called', 0, 1"""
)
def server_decay(spark, d):
    s = F.when(F.col("event_type") == "error", F.lit("connector_Error")).otherwise(F.col("event_type"))
    u = t(spark, d, "events").groupBy(s.alias("server")).agg(F.count("*").alias("calls"))
    names = spark.createDataFrame([("Click",), ("click",), ("view",), ("error",), ("idle",)], "name string")
    return tools.server_decay(u, names)


@query(
    """SELECT p.probe, count(event_id) AS occurrences, count(DISTINCT user_id) AS sessions, CASE WHEN count(event_id) = 0 THEN 'silent' ELSE 'observed' END AS state
FROM (VALUES ('buy', 'purchase'), ('look', 'view'), ('look', 'click'), ('never', 'refund')) p(probe, match) LEFT JOIN events ON event_type = match GROUP BY 1"""
)
def trigger_coverage(spark, d):
    e = t(spark, d, "events").select(F.lit("tool").alias("kind"), F.col("event_type").alias("name"), F.col("user_id").alias("session_id"), "ts")
    p = spark.createDataFrame([("buy", "tool", "purchase"), ("look", "tool", "view"), ("look", "tool", "click"), ("never", "tool", "refund")], "probe string, kind string, match string")
    return tools.trigger_coverage(e, p).drop("last_ts")


@query("""SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'grep', count(*) FROM events WHERE event_id % 2 = 0""")
def invoked_commands(spark, d):
    """Programs of a shell line made of each event: wrappers, assignments, quotes and pipes are seen through."""
    line = F.concat(F.lit("A=1 sudo /bin/"), "event_type", F.lit(" '&& no'"), F.when(F.col("event_id") % 2 == 0, F.lit(" | grep x")).otherwise(F.lit("")))
    return tools.commands(t(spark, d, "events").select(line.alias("line")), "line").groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, arg_min(p_partkey, (p_size, p_name, p_partkey)) AS p_partkey FROM part GROUP BY 1""".replace("arg_min(p_partkey, (p_size, p_name, p_partkey))", "(SELECT q.p_partkey FROM part q WHERE q.p_brand = part.p_brand ORDER BY p_size, p_name, p_partkey LIMIT 1)"))
def precedence_dedup(spark, d):
    return tools.prefer(t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name"), "p_brand", "p_size", "p_name", "p_partkey").select("p_brand", "p_partkey")


@query(
    """SELECT event_id, 'number' AS kind, CASE WHEN event_type = 'view' THEN 'set (number), not shown' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS shown FROM events"""
)
def allow_listed(spark, d):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    e = t(spark, d, "events").select("event_id", F.col("event_type").alias("key"), v.alias("v"))
    ok = spark.createDataFrame([("signup",), ("error",), ("click",), ("purchase",)], "key string")
    return tools.allow_listed(e, ok).drop("key")


@query(
    """WITH a AS (SELECT l_partkey AS k, max(l_shipdate) AS z, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS m FROM lineitem GROUP BY 1),
n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2023-12-01' END AS u, z, m FROM part LEFT JOIN a ON p_partkey = k),
g AS (SELECT p_partkey, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(CASE WHEN u IS NULL THEN z WHEN z IS NULL THEN u ELSE greatest(u, z) END)) / 86400000000) AS age, m,
 datediff('day', last_day(z), DATE '2024-02-01') AS quiet FROM n)
SELECT p_partkey AS name, CAST(age AS BIGINT) AS age_days, CASE WHEN age IS NULL THEN 'no-evidence' WHEN m = 1 AND quiet > 90 AND age <= 120 THEN 'bursty' WHEN age > 120 THEN 'stale' ELSE 'keep' END AS verdict, CASE WHEN age IS NULL THEN 0 WHEN m = 1 AND quiet > 90 AND age <= 120 THEN 2 WHEN age > 120 THEN 1 ELSE 3 END AS rank FROM g"""
)
def deletion_shortlist(spark, d):
    li = t(spark, d, "lineitem")
    a = li.groupBy(F.col("l_partkey").alias("name")).agg(
        F.max("l_shipdate").cast("timestamp").alias("last_ts"), F.countDistinct(X.month_of(F.col("l_shipdate"))).alias("active_months"), F.max(X.month_of(F.col("l_shipdate"))).alias("busiest_month")
    )
    used = F.when(F.col("p_partkey") % 3 == 0, F.lit("2023-12-01 00:00:00").cast("timestamp"))
    e = t(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("uses"), used.alias("last_used"))
    return tools.deletion_shortlist(e, a, now(), 365).select("name", "age_days", "verdict", "rank")


@query(
    """SELECT o_custkey AS board, count(*) FILTER (o_orderstatus <> 'F') AS open_tasks, count(*) AS tasks, min(o_orderkey) FILTER (o_orderstatus <> 'F') AS next_task FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'F') > 0"""
)
def open_boards(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("board"), F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    live = t(spark, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("session_id"))
    return tools.open_boards(o, live).withColumn("board", F.col("board").cast("long"))


@query(
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 15 MINUTES AS live FROM events GROUP BY 1""".replace("arg_max(event_type, (ts, event_id))", "arg_max(event_type, ts)")
)
def latest_state(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return tools.latest_state(e, "user_id", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("user_id", "state", "live")


@query(
    """WITH s AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'saved' ELSE 'generated' END AS kind, html, len(regexp_extract_all(html, '<li>')) AS calls FROM pages)
SELECT kind, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (calls > 1) AS fan_out FROM s GROUP BY 1"""
)
def script_inventory(spark, d):
    s = t(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "saved").otherwise("generated").alias("kind"), F.col("html").alias("text"))
    return tools.script_inventory(s, "<li>")


@query(
    """SELECT p_partkey, p_name AS declared_name, CASE WHEN p_size % 3 <> 0 THEN p_type END AS description, 'size ' || p_size || ',' || p_brand || CASE WHEN p_size % 4 = 0 THEN ',more' ELSE '' END AS phases,
 CASE WHEN p_size % 2 = 0 THEN 8 ELSE 7 END AS lines, 1 + p_size % 2 AS call_sites, p_size % 2 = 0 AS uses_parallel, false AS uses_pipeline, p_size % 5 = 0 AS uses_worktrees FROM part"""
)
def script_features(spark, d):
    """Scripts about parts: what their source declares."""
    k, size = F.col("p_size"), F.concat(F.lit("size "), F.col("p_size").cast("string"))
    value = F.concat(
        F.lit("export const meta = {\n  name: '"), "p_name", F.lit("',\n"), F.when(k % 3 != 0, F.concat(F.lit('  description: "'), "p_type", F.lit('", '))).otherwise("  nickname: 'no', "),
        F.lit("phases: [{ title: '"), size, F.lit("' }, { title: '"), "p_brand", F.lit("' }],\n};\nphase('"), size, F.lit("'); phase("),
        F.when(k % 4 == 0, F.lit("'more'")).otherwise(F.lit("more")), F.lit(");\nagent(1); reagent(2);"), F.when(k % 2 == 1, F.lit(" agent (2)\n")).otherwise("\nparallel([])\n"),
        F.when(k % 5 == 0, F.lit("isolation: 'worktree'")).otherwise("isolation: worktree"),
    )
    x = tools.script_features(t(spark, d, "part").select("p_partkey", value.alias("text")))
    return x.select("p_partkey", "declared_name", "description", F.array_join("phases", ",").alias("phases"), "lines", "call_sites", "uses_parallel", "uses_pipeline", "uses_worktrees")


@query(
    """WITH g AS (SELECT l_partkey, l_suppkey, l_linenumber, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber) > 1 AS gap FROM lineitem)
SELECT l_partkey AS hash, l_suppkey AS session_id, count(*) AS n, min(l_linenumber) AS first, max(l_linenumber) AS highest, count(*) FILTER (gap) AS gaps FROM g GROUP BY 1, 2"""
)
def version_chains(spark, d):
    v = t(spark, d, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_suppkey").alias("session_id"), F.col("l_linenumber").alias("version"), F.lit(1).alias("size"))
    return tools.version_chains(v).drop("size")


@query("""SELECT l_partkey AS hash, count(DISTINCT l_suppkey) AS sessions, count(*) AS versions, max(l_linenumber) AS highest FROM lineitem GROUP BY 1""")
def file_summary(spark, d):
    return tools.file_summary(version_chains(spark, d).withColumn("size", F.lit(0))).drop("size")


# --- text -----------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_SQL_TERMS = f"""WITH l0 AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS ix, unnest(ls) AS s FROM l0),
w AS (SELECT doc_id, ix, unnest(regexp_extract_all(regexp_replace(lower(s), '[''‘’]', '', 'g'), '[\\pL\\pN]+(?:-[\\pL\\pN]+)*')) AS term FROM l),
tf AS (SELECT doc_id, ix, term, count(*) AS tf FROM w WHERE length(term) > 1 AND term NOT IN ({_STOP}) AND NOT regexp_full_match(term, '\\pN+') GROUP BY 1, 2, 3),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1), df AS (SELECT doc_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS c FROM tf GROUP BY 1, 2)"""


def _lined(spark, d):
    """documents, and the lines of each as its sentences."""
    return t(spark, d, "documents").select("doc_id", "text"), text.line_lists(F.col("text"))


@query(
    _SQL_TERMS
    + """, v AS (SELECT tf.doc_id, ix, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.doc_id = df.doc_id AND tf.term = df.term JOIN n ON n.doc_id = tf.doc_id)
SELECT doc_id, CAST(ix AS INTEGER) AS ix, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, ix)), 6) AS weight FROM v"""
)
def tf_idf_vectors(spark, d):
    return text.tf_idf_texts(*_lined(spark, d)).withColumn("weight", r6("weight"))


@query(
    _SQL_TERMS
    + """, s AS (SELECT df.doc_id, term, c AS count, round(c * (ln((1 + n) / (1 + df)) + 1), 9) AS score FROM df JOIN n ON n.doc_id = df.doc_id)
SELECT doc_id, term, count, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 6"""
)
def keyword_scores(spark, d):
    return text.keywords_texts(*_lined(spark, d)).select("doc_id", "term", "count", r6("score").alias("score"))


@query(
    _SQL_TERMS
    + """, v0 AS (SELECT tf.doc_id, ix, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.doc_id = df.doc_id AND tf.term = df.term JOIN n ON n.doc_id = tf.doc_id),
v AS (SELECT doc_id, ix, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, ix)) AS w FROM v0)
SELECT a.doc_id, CAST(a.ix AS INTEGER) AS i, CAST(b.ix AS INTEGER) AS j, round(sum(a.w * b.w), 6) AS weight FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.ix <> b.ix GROUP BY 1, 2, 3"""
)
def sentence_similarity(spark, d):
    return text.similarity_texts(*_lined(spark, d)).withColumn("weight", r6("weight"))


@query()
def sentence_table(spark, d):
    return text.sentence_table(t(spark, d, "documents").select("doc_id", "text"))


@query()
def sentence_ranks(spark, d):
    return text.rank_texts(t(spark, d, "documents").select("doc_id", "text"))


@query()
def extractive_digest(spark, d):
    return text.digest_texts(t(spark, d, "documents").select("doc_id", "text"))


@query()
def readability_scores(spark, d):
    return text.readability_texts(t(spark, d, "documents").select("doc_id", "text"))


_POSTINGS = """WITH w AS (SELECT doc_id, 'body' AS field, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+')) AS term FROM documents UNION ALL SELECT doc_id, 'title', unnest(regexp_split_to_array(lower(source), '[^\\pL\\pN_]+')) FROM documents),
ix AS (SELECT term, doc_id, field, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2, 3)"""


def _index(spark, d):
    return text.postings(t(spark, d, "documents").select("doc_id", "text", "source"), title="source", body="text")


def _local_index(spark, d):
    return text.postings_texts(t(spark, d, "documents").select("doc_id", "text", "source"), title="source", body="text")


def _queries(spark, d):
    """Every fiftieth document asks with its source and the first two words of its text."""
    x = t(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id", "source", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("w"))
    return x.select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "source", F.array_join(F.slice("w", 1, 2), " ")).alias("query"))


@query(_POSTINGS + "SELECT term, doc_id, field, tf FROM ix")
def search_index(spark, d):
    return _index(spark, d)


_ASKED = """, q AS (SELECT DISTINCT query_id, unnest(list_filter(list_concat(regexp_split_to_array(lower(source), '[^\\pL\\pN_-]+'), list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN_]+'), lambda x: x <> '')[1:2]), lambda x: x <> '')) AS q
 FROM (SELECT doc_id AS query_id, coalesce(source, '') AS source, text FROM documents WHERE doc_id % 50 = 0)), nd AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
h AS (SELECT query_id, q, doc_id, sum(tf * CASE field WHEN 'title' THEN 4.0 ELSE 1.0 END) AS tf FROM ix JOIN q ON starts_with(term, q) GROUP BY 1, 2, 3),
ln AS (SELECT doc_id, sum(tf) AS len FROM ix GROUP BY 1), df AS (SELECT query_id, q, count(*) AS df FROM h GROUP BY 1, 2),
p AS (SELECT h.query_id, h.doc_id, greatest(1e-6, ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (SELECT avg(len) FROM ln))) AS part
 FROM h JOIN df ON h.query_id = df.query_id AND h.q = df.q JOIN ln ON ln.doc_id = h.doc_id)
SELECT p.query_id, doc_id, round(sum(part), 6) AS score FROM p JOIN nd ON nd.query_id = p.query_id GROUP BY 1, 2 HAVING count(*) = any_value(need)"""


@query(_POSTINGS + _ASKED)
def full_text_search(spark, d):
    ix = cut(_local_index(spark, d), "index")
    n = t(spark, d, "documents").count()
    return text.search(ix, n, _queries(spark, d), {"title": 4.0, "body": 1.0})


@query(
    """WITH w AS (SELECT p_partkey AS doc_id, 'title' AS field, unnest(regexp_split_to_array(lower(p_name), '[^\\pL\\pN_]+')) AS term FROM part UNION ALL SELECT p_partkey, 'description', unnest(regexp_split_to_array(lower(p_type), '[^\\pL\\pN_]+')) FROM part),
ix AS (SELECT term, doc_id, field, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2, 3),
q AS (SELECT p_partkey AS query_id, unnest([lower(substr(p_type, 1, 2)) || 'x' || lower(substr(p_type, 4)), lower(split_part(substr(p_name, 1, 4), ' ', 1))]) AS q FROM part WHERE p_partkey % 50 = 0),
m AS (SELECT query_id, q, term, CASE WHEN starts_with(term, q) THEN 0 ELSE levenshtein(term, q) END AS dist FROM q, (SELECT DISTINCT term FROM ix) WHERE starts_with(term, q) OR levenshtein(term, q) <= floor(length(q) * 0.2)),
x AS (SELECT query_id, doc_id, sum(CASE field WHEN 'title' THEN 3.0 ELSE 2.0 END * tf / (1 + dist)) AS score, count(DISTINCT q) AS got FROM ix JOIN m ON ix.term = m.term GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score FROM x WHERE got = 2"""
)
def fuzzy_search(spark, d):
    """Every fiftieth part asks with its type, misspelt in the third letter, and the start of its name."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    ix = cut(text.postings(p, title="p_name", description="p_type"), "index")
    misspelt = F.concat(F.substring("p_type", 1, 2), F.lit("x"), F.expr("substring(p_type, 4)"))
    q = p.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", misspelt, F.split(F.substring("p_name", 1, 4), " ")[0]).alias("query"))
    return text.fuzzy_search(ix, q, {"title": 3.0, "description": 2.0})


_BEST = _POSTINGS + _ASKED.replace("SELECT p.query_id, doc_id, round(sum(part), 6) AS score FROM p", ", s AS (SELECT p.query_id, doc_id, round(sum(part), 6) AS score FROM p") + "), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s)"


def _best(spark, d, k):
    return text.search(cut(_local_index(spark, d), "index"), t(spark, d, "documents").count(), _queries(spark, d), {"title": 4.0, "body": 1.0}, k=k)


@query(_BEST + " SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM t WHERE place <= 50")
def best_hits(spark, d):
    """The 50 best documents of each query, found without scoring all."""
    return _best(spark, d, 50)


@query(
    _BEST
    + """, a AS (SELECT t.query_id, t.doc_id, regexp_split_to_array(text, '\\s+') AS w, (SELECT list(q) FROM q WHERE q.query_id = t.query_id) AS terms FROM t JOIN documents d ON d.doc_id = t.doc_id WHERE place <= 3),
f AS (SELECT *, list_position(list_transform(w, lambda x: len(list_filter(terms, lambda y: starts_with(regexp_replace(lower(x), '^[^\\pL\\pN_]+', ''), y))) > 0), true) AS pos FROM a)
SELECT query_id, doc_id, CASE WHEN pos > 0 THEN array_to_string(w[greatest(1, pos - 7) : greatest(1, pos - 7) + 13], ' ') END AS excerpt FROM f"""
)
def search_excerpts(spark, d):
    """The three best documents of each query, with the text around the first word that the query asks for; null where only the title matched."""
    hits = _best(spark, d, 3).select("query_id", "doc_id")
    return text.excerpts(hits, _queries(spark, d), t(spark, d, "documents").select("doc_id", "text"))


@query("""SELECT lang AS kind, count(*) AS documents, count(DISTINCT source) AS files FROM documents GROUP BY 1""")
def index_stats(spark, d):
    return t(spark, d, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("documents"), F.countDistinct("source").alias("files"))


@query()
def redacted_documents(spark, d):
    return text.redact(t(spark, d, "documents").select("doc_id", "text"))


# --- graphs and diffs -----------------------------------------------------------------------------------------


def _links(spark, d):
    """Pages whose menu links name other pages: a page is named by the first letters of its host."""
    p = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url"), F.col("html"))
    nodes = p.select("id", F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^./]+)", 1).alias("name"))
    links = p.select(F.col("id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1))).alias("target"))
    return nodes, links


_SQL_LINKS = """WITH nodes AS (SELECT page_id AS id, lower(regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^./]+)', 1)) AS name FROM pages), nm AS (SELECT name, max(id) AS to_id FROM nodes GROUP BY 1),
l AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS target FROM pages),
e AS (SELECT source, target, to_id FROM l LEFT JOIN nm ON nm.name = regexp_replace(lower(trim(target, ' ')), '[\\s_]+', '-', 'g') WHERE to_id IS NULL OR to_id <> source)"""


@query(_SQL_LINKS + "SELECT source, target, to_id FROM e")
def resolved_links(spark, d):
    return graph.resolve_links(*_links(spark, d))


@query(
    _SQL_LINKS
    + """, g AS (SELECT DISTINCT source, to_id FROM e WHERE to_id IS NOT NULL), i AS (SELECT to_id AS id, count(*) AS n FROM g GROUP BY 1), o AS (SELECT source AS id, count(*) AS n FROM g GROUP BY 1), b AS (SELECT source AS id, count(*) AS n FROM e WHERE to_id IS NULL GROUP BY 1)
SELECT nodes.id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, coalesce(b.n, 0) AS n_broken, i.n IS NULL AND o.n IS NULL AS orphan, i.n IS NOT NULL AND o.n IS NULL AS leaf
FROM nodes LEFT JOIN i ON i.id = nodes.id LEFT JOIN o ON o.id = nodes.id LEFT JOIN b ON b.id = nodes.id"""
)
def link_graph(spark, d):
    nodes, links = _links(spark, d)
    return graph.graph_statistics(nodes, cut(graph.resolve_links(nodes, links), "links"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS source, l_suppkey * 7 % (SELECT count(*) FROM part) AS to_id FROM lineitem),
r(id, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 4 UNION SELECT e.to_id, r.hop + 1 FROM r JOIN e ON r.id = e.source WHERE r.hop < 5)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY id"""
)
def link_closure(spark, d):
    n = t(spark, d, "part").count()
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_suppkey") * 7 % n).alias("to_id")).distinct()
    roots = t(spark, d, "part").where("p_partkey < 4").select(F.col("p_partkey").alias("id"))
    return graph.closure(roots, e)


_REACH = """WITH nn AS (SELECT count(*) AS n FROM part), e AS (SELECT l_partkey AS source, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber <> 6 THEN l_suppkey * 7 % n + 1 END AS to_id FROM lineitem, nn),
m1 AS (SELECT p_partkey AS root, p_partkey AS source, seq, to_id FROM part JOIN e ON source = p_partkey),
c1 AS (SELECT root, to_id, min(seq) AS fst, count(*) AS links FROM m1 WHERE to_id <> root GROUP BY 1, 2), k1 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY fst) AS place FROM c1),
m2 AS (SELECT k1.root, e.source, e.seq, e.to_id FROM k1 JOIN e ON e.source = k1.to_id WHERE place <= 40),
g2 AS (SELECT root, to_id, min((source, seq)) AS fst, count(*) AS links FROM m2 WHERE to_id IS NOT NULL GROUP BY 1, 2), known AS (SELECT root, to_id FROM k1 WHERE place <= 40 UNION ALL SELECT p_partkey, p_partkey FROM part),
k2 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY fst) + (SELECT count(*) FROM k1 WHERE k1.root = g.root AND place <= 40) AS place FROM g2 g WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.root = g.root AND known.to_id = g.to_id))"""


def _reach(spark, d):
    n = t(spark, d, "part").count()
    to = F.when(F.col("l_linenumber") != 6, F.col("l_suppkey") * 7 % n + 1)
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), to.alias("to_id"))
    return graph.closure_by_root(t(spark, d, "part").select(F.col("p_partkey").alias("id")), e, hops=2, files=40)


@query(
    _REACH
    + """ SELECT p_partkey AS root, p_partkey AS id, 0 AS hop FROM part UNION ALL SELECT root, to_id, 1 FROM k1 WHERE place <= 40 UNION ALL SELECT root, to_id, 2 FROM k2 WHERE place <= 40"""
)
def closure_of_roots(spark, d):
    """What each part reaches in two hops, 40 parts at most, nearest first."""
    return _reach(spark, d)[0]


@query(
    _REACH
    + """, r AS (SELECT root, 'broken' AS reason, count(*) AS n FROM (SELECT root, to_id FROM m1 UNION ALL SELECT root, to_id FROM m2) WHERE to_id IS NULL GROUP BY 1
UNION ALL SELECT root, 'already-counted', count(*) FROM m1 WHERE to_id = root GROUP BY 1
UNION ALL SELECT g2.root, 'already-counted', sum(links) FROM g2 JOIN known ON known.root = g2.root AND known.to_id = g2.to_id GROUP BY 1
UNION ALL SELECT root, 'already-counted', sum(links - 1) FROM (SELECT root, links, place FROM k1 UNION ALL SELECT root, links, place FROM k2) WHERE place <= 40 GROUP BY 1
UNION ALL SELECT root, 'beyond-files', sum(links) FROM (SELECT root, links, place FROM k1 UNION ALL SELECT root, links, place FROM k2) WHERE place > 40 GROUP BY 1
UNION ALL SELECT k2.root, 'beyond-hops', count(*) FROM k2 JOIN e ON e.source = k2.to_id WHERE place <= 40 GROUP BY 1)
SELECT root, reason, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2 HAVING sum(n) > 0"""
)
def closure_skips(spark, d):
    """Links of those parts that were not followed, by reason."""
    return _reach(spark, d)[1]


#: Rows of a table of common subsequence lengths as lists, folded one after another; the last number of the last row is the length.
_LCS = """coalesce(list_reduce(list_prepend(list_transform({b}, lambda y: 0), list_transform({a}, lambda x: list_transform({b}, lambda y: CAST(x = y AS INTEGER)))),
 lambda p, mt: list_transform(range(1, len(p) + 1), lambda j: CAST(list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN mt[k] = 1 THEN (CASE WHEN k > 1 THEN p[k - 1] ELSE 0 END) + 1 ELSE p[k] END)) AS INTEGER)))[-1], 0)"""


def _runs(spark, d):
    e = t(spark, d, "events")
    steps = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), X.step_signature(F.lit("event"), F.col("event_type"), F.array().cast("array<string>")).alias("signature"))
    return steps, e.select(F.col("user_id").alias("a")).distinct().withColumn("b", F.col("a") + 1)


@query(
    f"""WITH r AS (SELECT user_id AS u, list(event_type ORDER BY event_id) AS s FROM events GROUP BY 1),
p AS (SELECT x.u AS a, x.u + 1 AS b, x.s AS sa, coalesce(y.s, []) AS sb FROM r x LEFT JOIN r y ON y.u = x.u + 1),
q AS (SELECT *, CAST(len(sa) AS INTEGER) AS steps_a, CAST(len(sb) AS INTEGER) AS steps_b, CAST({_LCS.format(a="sa", b="sb")} AS INTEGER) AS aligned FROM p)
SELECT a, b, steps_a, steps_b, aligned, CASE WHEN sa <> sb THEN CAST(coalesce(list_min(list_filter(range(0, least(steps_a, steps_b)), lambda i: sa[i + 1] <> sb[i + 1])), least(steps_a, steps_b)) AS INTEGER) END AS first_divergence,
 round(aligned / greatest(steps_a, steps_b), 6) AS similarity, greatest(steps_a, steps_b) < 12 AS short_run, false AS truncated FROM q"""
)
def run_diffs(spark, d):
    return graph.run_diffs(*_runs(spark, d)).withColumn("similarity", r6("similarity"))


@query(
    f"""WITH r AS (SELECT user_id AS u, list(event_type ORDER BY event_id) AS s FROM events GROUP BY 1),
p AS (SELECT x.u AS a, x.s AS sa, coalesce(y.s, []) AS sb FROM r x LEFT JOIN r y ON y.u = x.u + 1), q AS (SELECT a, len(sa) AS na, len(sb) AS nb, {_LCS.format(a="sa", b="sb")} AS k FROM p)
SELECT a, 'both' AS side, CAST(k AS BIGINT) AS n FROM q WHERE k > 0 UNION ALL SELECT a, 'a', na - k FROM q WHERE na > k UNION ALL SELECT a, 'b', nb - k FROM q WHERE nb > k"""
)
def run_steps(spark, d):
    """The aligned steps of each user's events and the next user's, counted by side."""
    return graph.run_steps(*_runs(spark, d)).groupBy("a", "side").agg(F.count("*").alias("n"))


def _versions(spark, d):
    """Documents of one source and length band as versions of one file."""
    x = t(spark, d, "documents").select("source", F.floor(F.col("n_chars") / 200).alias("band"), "doc_id", "text")
    w = Window.partitionBy("source", "band").orderBy("doc_id")
    v = x.withColumn("version", F.row_number().over(w))
    return v.select(F.concat_ws("@", F.coalesce("source", F.lit("-")), F.col("band").cast("string")).alias("chain"), "version", "text")


_VERSIONS = """v AS (SELECT coalesce(source, '-') || '@' || CAST(floor(n_chars / 200) AS BIGINT) AS chain, row_number() OVER (PARTITION BY source, floor(n_chars / 200) ORDER BY doc_id) AS version, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
p AS (SELECT v.chain, v.version, v.version + 1 AS next_version, v.s AS sa, w.s AS sb FROM v JOIN v w ON w.chain = v.chain AND w.version = v.version + 1)"""


@query(
    f"""WITH {_VERSIONS}, q AS (SELECT *, {_LCS.format(a="sa", b="sb")} AS k FROM p)
SELECT chain, CAST(version AS INTEGER) AS version, CAST(next_version AS INTEGER) AS next_version, CAST(len(sb) - k AS INTEGER) AS added, CAST(len(sa) - k AS INTEGER) AS removed, CAST(k AS INTEGER) AS unchanged FROM q"""
)
def version_line_counts(spark, d):
    return graph.version_diffs(_versions(spark, d)).select("chain", "version", "next_version", "added", "removed", "unchanged")


@query()
def version_diffs(spark, d):
    return graph.version_diffs(_versions(spark, d))


@query()
def version_hunks(spark, d):
    """The changed lines of each version with three lines around."""
    return graph.version_hunks(_versions(spark, d))


# --- sources and sync -----------------------------------------------------------------------------------------


def _corpus(spark, d):
    """conversations as a JSON-lines corpus in the shared folder, one file per task and project, with some bad lines."""
    root = f"{scratch_dir(spark)}/logloom/corpus-{uuid.uuid4().hex}"
    c = t(spark, d, "conversations")
    rec = F.to_json(
        F.struct(
            F.col("role").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), F.concat_ws("-", "conv_id", "turn").alias("uuid"),
            F.struct(F.col("role").alias("role"), F.col("text").alias("content"), F.struct(F.length("text").alias("output_tokens")).alias("usage")).alias("message"),
        )
    )
    line = F.when((F.col("turn") == 3) & (F.col("conv_id") % 4 == 0), F.lit("{torn")).otherwise(rec)
    c.select(F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project"), line.alias("value")).write.partitionBy("project").text(f"{root}/projects")
    return root


@query(
    """SELECT coalesce(CASE WHEN turn = 3 AND conv_id % 4 = 0 THEN NULL ELSE role END, 'bad') AS type, count(*) AS n, CAST(sum(CASE WHEN turn = 3 AND conv_id % 4 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS chars FROM conversations GROUP BY 1"""
)
def transcript_round_trip(spark, d):
    r = transcripts.records(spark, _corpus(spark, d), pattern="*.txt")
    chars = F.when(F.col("ok"), F.length(X.content_text("v"))).otherwise(0)
    return r.groupBy(F.coalesce("type", F.lit("bad")).alias("type")).agg(F.count("*").alias("n"), F.sum(chars).cast("long").alias("chars"))


@query("""SELECT role AS type, CAST(sum(length(text)) AS BIGINT) AS output, count(*) AS n FROM conversations WHERE role = 'assistant' AND NOT (turn = 3 AND conv_id % 4 = 0) GROUP BY 1""")
def tokens_from_records(spark, d):
    r = transcripts.records(spark, _corpus(spark, d), pattern="*.txt").where("type = 'assistant'")
    return r.groupBy("type").agg(F.sum(X.usage_tokens("v")["output"]).alias("output"), F.count("*").alias("n"))


@query("""SELECT event_type AS origin, 'k' AS name, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def nested_config_rows(spark, d):
    x = documents.map_rows(t(spark, d, "events").select("event_type", "props"), "props", "props", "event_type")
    return x.groupBy(F.col("event_type").alias("origin"), "name").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("v", "$", "bigint")).alias("total"))


@query(
    """SELECT lang AS kind, CASE WHEN doc_id % 11 = 0 THEN CASE WHEN lang = 'de' THEN 'held' ELSE 'removed' END WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS n FROM documents GROUP BY 1, 2"""
)
def sync_delta(spark, d):
    """Two snapshots of documents as files: what is new, changed, unchanged, removed, or held because its source could not be read."""
    x = t(spark, d, "documents").select(F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("n_chars").alias("size"))
    known = x.where("doc_id % 7 <> 0 OR doc_id % 11 = 0").withColumn("mtime", F.lit(1))
    cur = x.where("doc_id % 11 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1))
    return sync.report(sync.delta(known, cur, spark.createDataFrame([("de",)], "kind string")))


@query("""SELECT lang AS kind, count(*) AS n, CAST(sum(CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 2 ELSE 1 END * n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id % 11 <> 0 OR lang = 'de' GROUP BY 1""")
def sync_applied(spark, d):
    known, cur = snapshots(t(spark, d, "documents"))
    ch = cut(sync.delta(known, cur, spark.createDataFrame([("de",)], "kind string")), "delta")
    again = F.when(F.col("doc_id") % 7 == 0, F.col("size")).otherwise(F.col("size") * 2)
    todo = ch.where("state in ('new', 'changed')").select("kind", "path")
    parsed = cur.join(todo, ["kind", "path"]).select("kind", "path", again.alias("size"))
    docs = sync.apply(known.select("kind", "path", "size"), parsed, ch)
    return docs.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))


# --- streams --------------------------------------------------------------------------------------------------


@query(
    """SELECT strftime(time_bucket(INTERVAL 5 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS block, count(*) AS turns, CAST(sum(floor(value * 100)) AS BIGINT) AS output FROM events GROUP BY 1"""
)
def stream_blocks(spark, d):
    """The streaming form of usage_blocks, drained to its complete result."""
    s = jobs.event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.drain(jobs.blocks(s), "complete").select(stamp("block").alias("block"), "turns", "output")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def stream_without_replays(spark, d):
    s = jobs.event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.drain(jobs.without_replays(twice, "event_id")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, round((SELECT max(x.value) FROM events x WHERE x.user_id = e.user_id AND x.ts = max(e.ts)), 6) AS value, count(*) AS n FROM events e GROUP BY user_id"""
)
def stream_latest(spark, d):
    """The newest value of each user, as the stream ends."""
    s = jobs.event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.drain_latest(jobs.latest_per_key(s, "user_id")).select("key", stamp("ts").alias("ts"), r6("value").alias("value"), "n")


@query(
    """SELECT count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS"""
)
def stream_pairs(spark, d):
    """Errors paired with purchases of the next 12 hours, as a stream-stream join."""
    s = jobs.event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("key", F.col("user_id"))
    a = s.where("event_type = 'error'").select("key", "ts")
    b = s.where("event_type = 'purchase'").select("key", "ts", F.col("value").alias("result"))
    return jobs.drain(jobs.pairs(a, b, limit="12 hours")).where("rts is not null").agg(F.count("*").alias("pairs"))


@query("""SELECT 0 AS undated, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS future, count(*) AS rows FROM events""".replace("0 AS undated", "count(*) FILTER (ts IS NULL) AS undated"))
def late_counters(spark, d):
    return jobs.late_counters(t(spark, d, "events"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


def _dated(spark, d):
    return t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _pushed(spark, rows, **values):
    """rows as a stream, then one row ten years on with the given values, which lets every window and time-out pass."""
    far = F.lit("2034-01-01 00:00:00").cast("timestamp")
    last = spark.range(1).select(*[(far if f.name == "ts" else F.lit(values.get(f.name)).cast(f.dataType)).alias(f.name) for f in rows.schema])
    return jobs.two_batches(spark, rows, last)


@query(
    """WITH r(model, rate) AS (VALUES ('click', 0.5), ('view', 0.25), ('purchase', 2.0), ('error', 1.0)),
s AS (SELECT time_bucket(INTERVAL 5 HOURS, ts, TIMESTAMP '1970-01-01') AS b, user_id, floor(value * 100) * rate AS cost, rate FROM events LEFT JOIN r ON model = event_type)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS block, count(*) AS turns, count(DISTINCT user_id) AS sessions, round(sum(cost), 6) AS cost, count(*) - count(rate) AS unpriced FROM s GROUP BY b"""
)
def stream_block_costs(spark, d):
    """Cost and exact sessions of each block, by a stream that has passed them all."""
    e = _dated(spark, d).select("ts", F.col("user_id").alias("session"), F.col("event_type").alias("model"), F.floor(F.col("value") * 100).cast("double").alias("amount"))
    rates = spark.createDataFrame([("click", 0.5), ("view", 0.25), ("purchase", 2.0), ("error", 1.0)], "model string, rate double")
    x = jobs.drain(jobs.block_costs(_pushed(spark, e), rates)).where("block < '2030-01-01'")
    return x.select(stamp("block").alias("block"), "turns", "sessions", r6("cost").alias("cost"), "unpriced")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n FROM events GROUP BY 1""")
def stream_expired(spark, d):
    """The last row of every key that fell silent."""
    s = _pushed(spark, _dated(spark, d).select("ts", "user_id", "value"), user_id=-1, value=0.0)
    x = jobs.drain_updates(jobs.latest_per_key(s, "user_id")).where("expired")
    return x.select("key", stamp("ts").alias("ts"), "n")


@query(
    """SELECT a.user_id AS key, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n FROM events a WHERE a.event_type = 'error' AND NOT EXISTS
 (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS) GROUP BY 1, 2"""
)
def stream_unmatched(spark, d):
    """Errors without a purchase in the next 12 hours, once no late one can come."""
    e = _dated(spark, d).select("ts", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.col("value").alias("result"))
    side = lambda kind: _pushed(spark, e.where(F.col("kind") == kind), key=-1).select("key", "ts", "result")
    x = jobs.drain(jobs.pairs(side("error").drop("result"), side("purchase"), limit="12 hours"))
    return x.where("rts is null and key >= 0").groupBy("key", stamp("ts").alias("ts")).agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS session_id, strftime(coalesce(max(ts) FILTER (value > 50), max(ts)), '%Y-%m-%d %H:%M:%S') AS ts, count(*) FILTER (value > 50) > 0 AS with_limits, count(*) AS n FROM events GROUP BY 1"""
)
def stream_samples(spark, d):
    s = jobs.event_stream(spark, d).select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") > 50, F.col("value")).alias("limit"))
    x = jobs.drain(jobs.newest_sample(s), "complete")
    return x.select("session_id", stamp("ts").alias("ts"), F.col("limit").isNotNull().alias("with_limits"), "n")


@query(
    """WITH e AS (SELECT CASE WHEN event_type <> 'error' THEN ts END AS ts, CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 0 END AS batch FROM events),
m AS (SELECT max(ts) AS z FROM e WHERE batch = 0 AND ts <= TIMESTAMP '2024-01-25')
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS rows, count(*) - count(ts) AS undated, count(*) FILTER (ts > TIMESTAMP '2024-01-25') AS future,
 count(*) FILTER (batch = 1 AND ts < (SELECT z FROM m) - INTERVAL 1 HOUR) AS late FROM e GROUP BY 1"""
)
def stream_late_rows(spark, d):
    """Clicks and undated errors that come after all else: what is late, undated or in the future is counted by batch."""
    e = _dated(spark, d).select(F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"), F.col("event_type").isin("click", "error").alias("second"))
    s = jobs.two_batches(spark, e.where("not second"), e.where("second"))
    return jobs.count_late(s, "2024-01-25 00:00:00").drop("newest")


# --- more sources ---------------------------------------------------------------------------------------------


@query(
    """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS uuid, role AS type, substr(text, 1, 80) AS excerpt, length(text) > 80 AS truncated, CAST(length(text) AS BIGINT) AS output FROM conversations WHERE NOT (turn = 3 AND conv_id % 4 = 0)"""
)
def session_timeline(spark, d):
    r = transcripts.records(spark, _corpus(spark, d), pattern="*.txt")
    x = sessions.timeline(r, 80)
    return x.select("uuid", "type", "text.excerpt", "text.truncated", F.col("tokens.output").alias("output"))


@query(
    """SELECT CAST(user_id AS VARCHAR) AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date_raw,
 CASE event_type WHEN 'error' THEN 'Error' ELSE 'Purchase' END AS type, 'item ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS text, CASE WHEN event_id % 3 = 0 THEN 'item before' END AS supersedes FROM events WHERE event_type IN ('error', 'purchase')"""
)
def log_entries(spark, d):
    """Each user's errors and purchases as a log text, parsed back into entries."""
    sup = F.when(F.col("event_id") % 3 == 0, F.lit(" | supersedes: item before")).otherwise(F.lit(""))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" | ["), "event_type", F.lit("] | item "), F.get_json_object("props", "$.k"), sup)
    e = t(spark, d, "events").where("event_type in ('error', 'purchase')").select("user_id", F.struct("event_id", line.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    logs = e.groupBy(F.col("user_id").cast("string").alias("log_id")).agg(body.alias("text"))
    return documents.log_entries(logs, ["error", "purchase"]).drop("format")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END AS date_raw,
 CASE event_type WHEN 'error' THEN 'Error' ELSE 'Purchase' END AS type, 'item ' || CAST(json_extract(props, '$.k') AS VARCHAR) || CASE event_id % 3 WHEN 1 THEN ' goes on' ELSE '' END AS text,
 CASE event_id % 3 WHEN 0 THEN 'pipe' WHEN 1 THEN 'section' ELSE 'table' END AS format FROM events WHERE event_type IN ('error', 'purchase')"""
)
def log_entry_forms(spark, d):
    """The same logs in three line forms: lines with bars, sections with continued paragraphs, and table rows."""
    k, day = F.col("event_id") % 3, F.date_format("ts", "yyyy-MM-dd")
    item = F.concat(F.lit("item "), F.get_json_object("props", "$.k"))
    line = (
        F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" | ["), "event_type", F.lit("] | "), item))
        .when(k == 1, F.concat(F.lit("## "), day, F.lit("\n\n["), "event_type", F.lit("] "), item, F.lit("\n  goes on\n")))
        .otherwise(F.concat(F.lit("| "), day, F.lit(" | "), "event_type", F.lit(" | all | "), item, F.lit(" |")))
    )
    e = t(spark, d, "events").where("event_type in ('error', 'purchase')").select("user_id", F.struct("event_id", line.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    logs = e.groupBy(F.col("user_id").cast("string").alias("log_id")).agg(body.alias("text"))
    return documents.log_entries(logs, ["error", "purchase"]).drop("supersedes")


def _json_lines(spark, rows, line):
    path = f"{scratch_dir(spark)}/logloom/lines-{uuid.uuid4().hex}"
    rows.select(F.to_json(line).alias("value")).write.text(path)
    return path


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, text, CAST(length(text) AS BIGINT) AS length, turn % 3 = 0 AS had_paste, strftime(TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * conv_id, '%Y-%m-%d %H:%M:%S') AS ts FROM conversations WHERE role = 'user' AND regexp_matches(text, '[^ ]')"""
)
def prompt_history(spark, d):
    c = t(spark, d, "conversations").where("role = 'user'")
    pasted = F.when(F.col("turn") % 3 == 0, F.create_map(F.lit("1"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    line = F.struct(F.col("text").alias("display"), (F.col("conv_id") * 1000).alias("timestamp"), F.lit("/p").alias("project"), F.col("conv_id").cast("string").alias("sessionId"), pasted.alias("pastedContents"))
    x = transcripts.prompts(spark, _json_lines(spark, c, line))
    return x.select("session_id", "text", F.col("length").cast("long").alias("length"), "had_paste", stamp("ts").alias("ts"))


@query(
    """WITH s AS (SELECT user_id, ts, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_id % 4 <> 1)
SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS samples, count(*) FILTER (k % 2 = 0) AS with_limits, max(k) FILTER (k % 2 = 0) AS most_used FROM s GROUP BY 1"""
)
def pacing_samples(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    window = F.when(k % 2 == 0, F.struct(F.struct(k.alias("used_percentage"), F.lit(1_700_000_000).alias("resets_at")).alias("five_hour")))
    sid = F.when(F.col("event_id") % 4 != 1, F.col("user_id").cast("string"))
    line = F.struct(sid.alias("session_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"), window.alias("rate_limits"))
    x = transcripts.pacing_samples(spark, _json_lines(spark, t(spark, d, "events"), line))
    has = F.col("limits").isNotNull()
    return x.groupBy("session_id").agg(F.count("*").alias("samples"), F.count_if(has).alias("with_limits"), F.max("limits.five_hour.used").alias("most_used"))
