"""Structured Streaming forms of the windowed and stateful jobs. Each has a batch twin that tests hold it against."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.shared import scratch_dir


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the table it wrote (append) or its last complete result."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/logloom/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    else:
        w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def two_batches(spark: SparkSession, first: DataFrame, second: DataFrame) -> DataFrame:
    """A stream that delivers the rows of first, then those of second (of the same columns), in one batch each, written by as many tasks as they have."""
    root = f"{scratch_dir(spark)}/logloom/arrivals-{uuid.uuid4().hex}"
    first.write.parquet(root)
    n = max(1, len(spark.read.schema(first.schema).parquet(root).inputFiles()))  # the first batch's files; the second has no more
    second.coalesce(n).write.mode("append").parquet(root)
    return spark.readStream.schema(first.schema).option("maxFilesPerTrigger", n).parquet(root)


def blocks(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows and amounts per five-hour block; sessions are counted by block_costs()."""
    x = events.withWatermark("ts", late)
    return x.groupBy(F.window("ts", "5 hours")["start"].alias("block")).agg(
        F.count("*").alias("turns"), F.sum(F.floor(F.col("value") * 100)).cast("long").alias("output")
    )


def block_costs(events: DataFrame, rates: DataFrame, late: str = "1 hour") -> DataFrame:
    """Turns, distinct sessions, cost and unpriced turns per five-hour block of events(ts, session, model, amount), priced by the static rates(model, rate).

    Rows are first added up by block and session, so the second count is one of distinct sessions, and exact. Append mode: a
    block comes out once, when the watermark has passed it.
    """
    x = events.withWatermark("ts", late).join(rates, "model", "left")
    cost = F.col("amount") * F.col("rate")
    by_session = x.groupBy(F.window("ts", "5 hours").alias("w"), "session").agg(
        F.count("*").alias("turns"), F.sum(cost).alias("cost"), F.count_if(F.col("rate").isNull()).alias("unpriced")
    )
    out = by_session.groupBy("w").agg(
        F.sum("turns").alias("turns"), F.count("*").alias("sessions"), F.sum("cost").alias("cost"), F.sum("unpriced").alias("unpriced")
    )
    return out.select(F.col("w.start").alias("block"), "turns", "sessions", "cost", "unpriced")


def without_replays(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def pairs(requests: DataFrame, results: DataFrame, limit: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Each request with the results of its key inside the limit; requests without any come out once the watermark has passed."""
    a = requests.withWatermark("ts", late)
    b = results.select(F.col("key").alias("rkey"), F.col("ts").alias("rts"), F.col("result")).withWatermark("rts", late)
    near = (F.col("key") == F.col("rkey")) & (F.col("rts") >= F.col("ts")) & (F.col("rts") <= F.col("ts") + F.expr(f"INTERVAL {limit}"))
    return a.join(b, near, "left_outer").select("key", "ts", "rts", "result")


_STATE = "ts timestamp, value double, n bigint"
_LATEST = "key string, ts timestamp, value double, n bigint, expired boolean"


class Latest(StatefulProcessor):
    """The newest value of each key as typed state, with one event-time timer per key that is moved when a newer row comes."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        ts, value, n = self.latest.get() if self.latest.exists() else (None, None, 0)
        for f in rows:
            n += len(f)
            top = f.sort_values(["ts", "value"], na_position="first").iloc[-1]
            at, v = top.ts.to_pydatetime(), None if pd.isna(top.value) else float(top.value)
            if ts is None or (at, v is not None, v or 0.0) >= (ts, value is not None, value or 0.0):  # of equal times the largest value
                ts, value = at, v
        self.latest.update((ts, value, n))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        at = int(pd.Timestamp(ts).timestamp() * 1000) + self.silence_ms
        self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "ts": [ts], "value": [value], "n": [n], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.latest.exists():
            ts, value, n = self.latest.get()
            self.latest.clear()
            yield pd.DataFrame({"key": [key[0]], "ts": [ts], "value": [value], "n": [n], "expired": [True]})

    def close(self) -> None:
        pass


def latest_per_key(events: DataFrame, key: str, silence_ms: int = 15 * 60 * 1000) -> DataFrame:
    """(key, ts, value, n, expired): the newest value per key (of equal times the largest) as it changes, and a last row when a key has been silent (event time). State is on RocksDB: see with_rocksdb()."""
    x = events.withWatermark("ts", "1 hour").select(F.col(key).cast("string").alias("key"), "ts", "value")
    return x.groupBy("key").transformWithStateInPandas(Latest(silence_ms), T._parse_datatype_string(_LATEST), "Update", "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams that start inside keep their state on disk, in RocksDB, which typed state and timers need."""
    name, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def drain_updates(stream: DataFrame, where: str | None = None) -> DataFrame:
    """All updates that a stream gives, with the number of the batch they came in. A batch writes its own folder, so one that runs twice counts once; with a folder named, a restart goes on."""
    spark = stream.sparkSession
    base = where or f"{scratch_dir(spark)}/logloom/stream-{uuid.uuid4().hex}"
    with with_rocksdb(spark):
        (
            stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode("update")
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).start().awaitTermination()
        )
    schema = T.StructType([*stream.schema.fields]).add("batch", "long")
    return spark.read.schema(schema).parquet(f"{base}/out")


def drain_latest(stream: DataFrame) -> DataFrame:
    """The newest row per key of latest_per_key(), from all its updates."""
    x = drain_updates(stream).where("not expired")
    return x.groupBy("key").agg(F.max_by(F.struct("ts", "value", "n"), F.struct("n", "batch")).alias("x")).select("key", "x.*")


def newest_sample(samples: DataFrame) -> DataFrame:
    """(session_id, ts, limit, n) as it changes: each session's newest sample that carries limits, or its newest where none does."""
    best = F.max_by(F.struct("ts", "limit"), F.struct(F.col("limit").isNotNull().alias("has"), F.col("ts").alias("at")))
    return samples.groupBy("session_id").agg(best.alias("x"), F.count("*").alias("n")).select("session_id", "x.ts", "x.limit", "n")


def count_late(stream: DataFrame, now, delay: str = "1 hour", where: str | None = None) -> DataFrame:
    """One row per batch of a stream with ts: rows, undated, future, and late ones (older than the newest time of the batches before, less the delay).

    Operators with a watermark drop late rows silently; this counts them beside such a job. Each batch writes a folder of its own, so one that runs twice counts
    once; the newest time so far is read from the batches before, so with a folder named, a restart goes on.
    """
    spark = stream.sparkSession
    base = where or f"{scratch_dir(spark)}/logloom/late-{uuid.uuid4().hex}"
    schema = "rows bigint, undated bigint, future bigint, late bigint, newest timestamp, batch bigint"

    def add(df: DataFrame, i: int) -> None:
        seen = spark.read.schema(schema).parquet(f"{base}/out").where(F.col("batch") < i) if i else spark.createDataFrame([], schema)
        newest = seen.agg(F.max("newest").alias("__newest"))
        past = F.col("ts") > F.lit(now)
        x = df.join(F.broadcast(newest)).agg(  # one row
            F.count("*").alias("rows"), F.count_if(F.col("ts").isNull()).alias("undated"), F.count_if(past).alias("future"),
            F.count_if(F.col("ts") < F.col("__newest") - F.expr(f"INTERVAL {delay}")).alias("late"), F.max(F.when(~past, F.col("ts"))).alias("newest"),
        )
        x.write.mode("overwrite").parquet(f"{base}/out/batch={i}")

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").select("batch", "rows", "undated", "future", "late", "newest")


def upsert(changed: DataFrame, batch: int, where: str, parse, writer: str, **how) -> bool:
    """foreachBatch body of the incremental index: parse(changed) is merged by key under the batch's number, so a batch that comes again changes nothing."""
    from logloom.sources.sync import merge

    return merge(parse(changed), where, writer, batch, **how)


def late_counters(batch: DataFrame, now) -> DataFrame:
    """Undated, future and other rows of a batch: what trends leave out is counted."""
    return batch.agg(
        F.count_if(F.col("ts").isNull()).alias("undated"), F.count_if(F.col("ts") > now).alias("future"), F.count("*").alias("rows")
    )
