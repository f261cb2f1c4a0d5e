"""Requests and results: replay removal, pairing, delegated work, and joins that keep what finds no partner."""

from __future__ import annotations

import heapq
import itertools
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.operators import ranks
from logloom.operators.ranges import following, overlaps
from logloom.shared import cut


def drop_replays(rows: DataFrame, key: str, *order) -> DataFrame:
    """One row per key (the first in order); rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    one = rows.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return one.unionByName(rows.where(F.col(key).isNull()))


def pair_first(requests: DataFrame, results: DataFrame, key: str, *order) -> DataFrame:
    """Each request with its first admissible result: results(key, admissible, ...) that name an agent, or whose request came earlier, are admissible."""
    first = drop_replays(results.where("admissible").drop("admissible"), key, *order)
    return requests.join(first, key, "left")


def by_specialist(pairs: DataFrame) -> DataFrame:
    """Per specialist of paired dispatches: counts, projects, sessions, span, overrides, launch modes, upper-median prompt length."""
    mode = X.launch_mode(F.col("status"), F.col("is_async"))
    x = pairs.withColumn("mode", mode)
    n = lambda m: F.count_if(F.col("mode") == m)
    out = x.groupBy("specialist").agg(
        F.count("*").alias("n"),
        F.countDistinct("session_id").alias("sessions"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        n("background").alias("background"),
        n("foreground").alias("foreground"),
        n("unknown").alias("unknown_mode"),
        F.count_if(F.col("prompt_length").isNull()).alias("missing_prompt"),
    )
    return ranks.beside(out, "specialist", ranks.at_places(x, "specialist", "prompt_length", median_prompt=ranks.upper_middle()), "median_prompt")


def delegated_work(records: DataFrame) -> DataFrame:
    """Two stages: per file (its first-named specialist, tokens null if none carried any, span only if last > first), then per specialist."""
    per_file = records.groupBy("file").agg(
        F.count("*").alias("records"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("tokens").alias("tokens"),
        F.min("ts").alias("a"),
        F.max("ts").alias("z"),
        F.min_by("specialist", F.when(F.col("specialist").isNotNull(), F.col("seq"))).alias("specialist"),
        (F.countDistinct("specialist") > 1).alias("mixed"),
    )
    span = F.when(F.col("z") > F.col("a"), F.unix_micros(F.col("z").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")))
    return per_file.groupBy("specialist").agg(
        F.count("*").alias("files"),
        F.sum("records").alias("records"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("tokens").alias("tokens"),
        (F.sum(span) / 1e6).alias("span_s"),
        F.count_if(span.isNull()).alias("without_span"),
        F.count_if("mixed").alias("mixed_files"),
    )


def both_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on a null-safe key with flags for the side a row came from."""
    a = left.withColumnRenamed(key, "__a").withColumn("in_left", F.lit(True))
    b = right.withColumnRenamed(key, "__b").withColumn("in_right", F.lit(True))
    x = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rest = [c for c in a.columns + b.columns if c not in ("__a", "__b", "in_left", "in_right")]
    return x.select(F.coalesce("__a", "__b").alias(key), *rest, no("in_left"), no("in_right"))


def with_match_flag(rows: DataFrame, known: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a flag whether their key is among the known ones (both sides can then be counted)."""
    k = known.select(F.col(key).alias("__k")).where("__k is not null").distinct().withColumn(flag, F.lit(True))
    return rows.join(k, F.col(key) == F.col("__k"), "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("__k")


def overlap_counts(intervals: DataFrame, logs: DataFrame, grace: str = "INTERVAL 24 HOURS") -> DataFrame:
    """intervals(id, start, end) with n_logs: how many logs(log_id, start, end) overlap each from its start to its end + grace. No pair is made."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    i = intervals.select("id", micros(F.col("start")).alias("a"), micros(F.col("end") + F.expr(grace)).alias("z"))
    n = overlaps(i, logs.select(micros(F.col("start")).alias("a"), micros(F.col("end")).alias("z")))
    return intervals.join(n.withColumnRenamed("n", "n_logs"), "id", "left").withColumn("n_logs", F.coalesce("n_logs", F.lit(0).cast("long")))


def next_within(rows: DataFrame, group: str, is_open, is_close, limit: str) -> DataFrame:
    """For each opening row the time of the nearest closing row after it within the limit (closers may serve several). A group may span many tasks."""
    x = following(rows, group, ["ts", "seq"], F.when(is_close, F.col("ts")), "next_ts").where(is_open)
    return x.withColumn("next_ts", F.when(F.col("next_ts") <= F.col("ts") + F.expr(limit), F.col("next_ts")))


def _phrases_held(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """(g, item, held): which of their log's quoted phrases the texts of items hold. Phrases of a log count once, however many resolutions quote them."""
    quoted = fixes.select("g", F.explode(X.quoted_phrases(F.col("supersedes"))).alias("q")).distinct().withColumn("k", F.substring("q", 1, 4))
    own = items.select("g", F.col("seq").alias("item"), "text").join(quoted.select("g").distinct(), "g", "left_semi")
    # A phrase has four characters or more: texts meet it by the first four.
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - 3))
    grams = own.select("*", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(4))))).alias("k"))
    met = grams.join(quoted, ["g", "k"]).where(F.col("text").contains(F.col("q")))
    return met.groupBy("g", "item").agg(F.collect_set("q").alias("held"))


class OpenItems:
    """The open items of one log so far, found newest first by what they share with a resolution; taken ones are never looked at twice.

    Two sets that share three words share one of all but two words of either, so a resolution looks up all its words but the two with the most items.
    """

    def __init__(self):
        self.words, self.taken, self.lists = [], [], {}

    def add(self, words, keys) -> int:
        n = len(self.words)
        self.words.append(frozenset(words))
        self.taken.append(False)
        for k in (*self.words[n], *keys):
            self.lists.setdefault(k, []).append(n)
        return n

    def _newest_first(self, key):
        found = self.lists.get(key, [])
        while found and self.taken[found[-1]]:
            found.pop()
        gone = 0
        for n in reversed(found):
            if not self.taken[n]:
                yield n
            else:
                gone += 1
                if 2 * gone > len(found) > 64:  # most of the list is taken: make it anew for the next one
                    self.lists[key] = [m for m in found if not self.taken[m]]
                    gone = -len(found)

    def take(self, words, keys) -> int | None:
        """The newest item not taken that shares a key or three words; it is taken."""
        best = max((n for k in keys for n in itertools.islice(self._newest_first(k), 1)), default=-1)
        words = set(words)
        rare = sorted(words, key=lambda w: len(self.lists.get(w, ())))[: max(0, len(words) - 2)]
        last = -1
        for n in heapq.merge(*map(self._newest_first, rare), reverse=True):
            if n <= best:
                break
            if n != last and len(words & self.words[n]) >= 3:
                best = n
                break
            last = n
        if best < 0:
            return None
        self.taken[best] = True
        return best


def match_loops(entries: DataFrame, group: str, window_days: int = 14) -> DataFrame:
    """One-to-one matching of open items with resolutions inside each log: entries(group, seq, ts, kind, text, supersedes).

    First every resolution that supersedes something, oldest first, takes the latest earlier unmatched item that shares a
    date, a quoted phrase, or three content words. Then every unmatched item, oldest first, takes the nearest following
    unmatched resolution within the window. Both passes stream a log's rows in order, and no pairs are made: the first holds the log's open items
    by what they can be named by, the second the open items of one window.
    """
    import pandas as pd

    x = entries.where(F.col("kind").isin("open", "resolution")).select(
        F.to_json(F.struct(F.col(group).alias("g"))).alias("g"), group, "seq", "ts", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("supersedes", F.lit("")).alias("supersedes")
    )
    items, fixes = x.where("kind = 'open'"), x.where("kind = 'resolution'")
    span, kind = pd.Timedelta(days=window_days), entries.schema["seq"].dataType.simpleString()

    words, dates = X.content_words, X.date_tokens
    none = F.array().cast("array<string>")
    keys = lambda kind_, c: F.transform(c, lambda v: F.concat(F.lit(kind_), v))
    sup = fixes.where("supersedes <> ''")
    held = _phrases_held(items, sup).withColumnRenamed("item", "seq")
    told = F.concat_ws(" ", "text", F.date_format("ts", "yyyy-MM-dd"))
    open_ = items.join(held, ["g", "seq"], "left").select("g", "seq", "ts", F.lit(False).alias("fix"), words(F.col("text")).alias("words"), F.concat(keys("date ", dates(told)), keys("text ", F.coalesce("held", none))).alias("keys"))
    named_ = F.col("supersedes")
    asked = sup.select("g", "seq", "ts", F.lit(True).alias("fix"), words(named_).alias("words"), F.concat(keys("date ", dates(named_)), keys("text ", X.quoted_phrases(named_))).alias("keys"))

    def take(batches):
        log, found, seqs = None, OpenItems(), []
        for pdf in batches:
            out = []
            for g, seq, fix, ws, ks in zip(pdf["g"], pdf["seq"], pdf["fix"], pdf["words"], pdf["keys"]):
                if g != log:
                    log, found, seqs = g, OpenItems(), []
                if not fix:
                    found.add(ws, ks)
                    seqs.append(seq)
                elif (n := found.take(ws, ks)) is not None:
                    out.append((g, seqs[n], seq))
            yield pd.DataFrame(out, columns=["g", "seq", "resolved_by"])

    stream = open_.unionByName(asked).where("ts is not null").repartition("g").sortWithinPartitions("g", "ts", "seq")
    named = cut(stream.select("g", "seq", "fix", "words", "keys").mapInPandas(take, f"g string, seq {kind}, resolved_by {kind}"), "superseded")
    used = named.select("g", "seq").unionByName(named.select("g", F.col("resolved_by").alias("seq")))
    left = x.select("g", "seq", "ts", "kind").join(used, ["g", "seq"], "left_anti").repartition("g").sortWithinPartitions("g", "ts", "seq")

    def follow(batches):
        log, waiting = None, deque()
        for pdf in batches:
            out = []
            for g, seq, ts, k in zip(pdf["g"], pdf["seq"], pdf["ts"], pdf["kind"]):
                if g != log:
                    log, waiting = g, deque()
                if k == "open":
                    waiting.append((seq, ts))
                    continue
                while waiting and ts - waiting[0][1] > span:
                    waiting.popleft()
                if waiting:
                    out.append((g, waiting.popleft()[0], seq))
            yield pd.DataFrame(out, columns=["g", "seq", "resolved_by"])

    nearest = left.mapInPandas(follow, f"g string, seq {kind}, resolved_by {kind}")
    return items.select("g", group, "seq").join(named.unionByName(nearest), ["g", "seq"], "left").select(group, "seq", "resolved_by")


def fallback_join(used: DataFrame, declared: DataFrame) -> DataFrame:
    """used(key, bare_key, ...) with declared(key, ...): by key, else by bare key; matched_by tells which."""
    d = declared.select(F.col("key").alias("__k")).distinct()
    x = used.join(d, F.col("key") == F.col("__k"), "left").withColumnRenamed("__k", "__full")
    x = x.join(d, F.col("bare_key") == F.col("__k"), "left").withColumnRenamed("__k", "__bare")
    by = F.when(F.col("__full").isNotNull(), "key").when(F.col("__bare").isNotNull(), "bare_key")
    return x.withColumn("declared_key", F.coalesce("__full", "__bare")).withColumn("matched_by", by).drop("__full", "__bare")


def unique_fallback_join(left: DataFrame, right: DataFrame, name: str, bare: str) -> DataFrame:
    """left with right's value: by name, else by bare name where that is unique on both sides."""
    only = lambda d: d.withColumn("__n", F.count("*").over(Window.partitionBy(bare)))
    exact = right.select(F.col(name).alias("__name"), F.col("value").alias("__v1"))
    loose = only(right).where("__n = 1").select(F.col(bare).alias("__bare"), F.col("value").alias("__v2"))
    x = only(left).join(exact, F.col(name) == F.col("__name"), "left")
    x = x.join(loose, (F.col(bare) == F.col("__bare")) & (F.col("__n") == 1), "left")
    return x.withColumn("value", F.coalesce("__v1", "__v2")).drop("__name", "__bare", "__v1", "__v2", "__n")


def resolve_digests(digests: DataFrame, paths: DataFrame, least: int = 8) -> DataFrame:
    """Status of truncated path digests: resolved, ambiguous, no-match or too-short. Only the widths in use are cut, and equal digests meet by a join."""
    used = digests.select(F.length("digest").alias("w")).where(F.col("w").between(least, 64)).distinct().collect()  # 64 at most: a digest's length
    widths = F.array(*[F.lit(w) for w in sorted(r.w for r in used)]).cast("array<int>")
    full = paths.select("path", F.sha2("path", 256).alias("full"), F.explode(widths).alias("w"))
    cut = full.select("path", F.expr("substring(full, 1, w)").alias("digest"))
    found = cut.groupBy("digest").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    status = (
        F.when(F.length("digest") < least, "too-short").when(F.coalesce("n", F.lit(0)) == 0, "no-match")
        .when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    )
    x = digests.join(found, "digest", "left").withColumn("status", status)
    return x.withColumn("path", F.when(F.col("status") == "resolved", F.col("path"))).drop("n")


def overlay(layers: DataFrame) -> DataFrame:
    """layers(key, layer, rank, value): the value of the highest layer per key, that layer, and all layers that set it."""
    return layers.groupBy("key").agg(
        F.max_by("value", "rank").alias("value"),
        F.max_by("layer", "rank").alias("layer"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "layer"))), lambda x: x["layer"]), ",").alias(
            "set_by"
        ),
    )
