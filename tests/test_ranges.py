"""Work over ordered ranges that split keys, and the index that is merged by key, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import pairing, ranges
from logloom.sources import sync
from logloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def brute_next(rows):
    out = {}
    for g, ts, seq, kind in rows:
        if kind == "open":
            later = [(t, s) for h, t, s, k in rows if h == g and k == "close" and (t, s) > (ts, seq) and t <= ts + dt.timedelta(hours=5)]
            out[seq] = min(later)[0] if later else None
    return out


def test_nearest_following_over_split_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), T0 + dt.timedelta(minutes=rng.randrange(3000)), i, rng.choice(["open", "close", "other", "other"])) for i in range(400)]
    rows += [(9, T0 + dt.timedelta(minutes=5), 1000 + i, "close" if i == 77 else "open") for i in range(90)]  # one moment
    df = spark.createDataFrame(rows, "g int, ts timestamp, seq long, kind string").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = pairing.next_within(df, "g", F.col("kind") == "open", F.col("kind") == "close", "INTERVAL 5 HOURS").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.seq: r.next_ts for r in got} == brute_next(rows) and len(got) == sum(r[3] == "open" for r in rows)


def test_one_group_of_200_000_rows(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 1000 == 999).alias("c"))
    got = pairing.next_within(df, "g", ~F.col("c"), F.col("c"), "INTERVAL 1 DAY")
    off = got.where(F.unix_timestamp("next_ts") != F.floor(F.col("seq") / 1000) * 1000 + 999).count()
    assert off == 0 and got.count() == 199_800 and got.where("next_ts is null").count() == 0


def test_overlaps_without_pairs(spark):
    rng = random.Random(2)

    def some(n):
        out = []
        for i in range(n):
            a = rng.randrange(2000)
            out.append((i, a, a + rng.choice([0, 0, 3, 50, 1500, -5])))
        return [*out, (n, None, 5), (n + 1, 5, None)]

    a, b = some(150), some(200)
    x = ranges.overlaps(spark.createDataFrame(a, "id int, a long, z long"), spark.createDataFrame([r[1:] for r in b], "a long, z long"))
    fine = lambda r: r[1] is not None and r[2] is not None and r[1] <= r[2]
    want = {i: sum(fine(o) and o[2] >= s and o[1] <= z for o in b) for i, s, z in filter(fine, a)}
    assert {r.id: r.n for r in x.collect()} == want and max(want.values()) > 20


def test_many_overlaps_make_few_rows(spark):
    x = spark.range(100_000).select(F.col("id"), F.lit(0).cast("long").alias("a"), F.lit(10).cast("long").alias("z"))
    assert ranges.overlaps(x, x.select("a", "z")).agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (100_000, 100_000, 100_000)


SCHEMA = "kind string, path string, v int"


def state(spark, where):
    return sorted(map(tuple, sync.read(spark, where, spark.createDataFrame([], SCHEMA).schema).collect()))


@pytest.fixture
def index(spark, tmp_path):
    where = str(tmp_path / "index")
    rows = [(k, f"p{i}", 1) for k in ("a", "b c", "7") for i in range(10)]
    assert sync.merge(spark.createDataFrame(rows, SCHEMA), where, "files", 0)
    return where, rows


def test_one_changed_row_leaves_the_others(spark, index):
    where, rows = index
    assert sync.merge(spark.createDataFrame([("a", "p3", 9), ("new", "p0", 2)], SCHEMA), where, "files", 1, removed=spark.createDataFrame([("7", "p1"), ("gone", "p")], "kind string, path string"))
    want = sorted([r for r in rows if r[:2] not in (("a", "p3"), ("7", "p1"))] + [("a", "p3", 9), ("new", "p0", 2)])
    assert state(spark, where) == want
    import os

    assert not os.path.isdir(f"{where}/data/version=1/kind=b c")  # an untouched partition is not written again
    sync.merge(spark.createDataFrame([], SCHEMA), where, "files", 2, removed=spark.createDataFrame([("new", "p0")], "kind string, path string"))
    assert state(spark, where) == [r for r in want if r[0] != "new"]
    sync.vacuum(spark, where, keep=1)
    assert state(spark, where) == [r for r in want if r[0] != "new"] and sync.versions(spark, where) == [2]


def test_a_batch_that_comes_again_changes_nothing(spark, index):
    where, rows = index
    put = lambda batch, v, writer="files": jobs.upsert(spark.createDataFrame([("a", "p3", v)], SCHEMA), batch, where, lambda b: b, writer)
    assert put(1, 5) and not put(1, 6) and not put(0, 7)
    assert ("a", "p3", 5) in state(spark, where) and len(state(spark, where)) == len(rows)
    assert put(0, 8, "another") and ("a", "p3", 8) in state(spark, where)
    assert put(2, 9) and not put(0, 8, "another") and ("a", "p3", 9) in state(spark, where)


def test_a_batch_stopped_halfway_runs_again(spark, index, monkeypatch):
    where, rows = index
    real = sync._manifest

    def stop(spark, where, version):
        raise RuntimeError("executor lost")

    change = spark.createDataFrame([("a", "p3", 5), ("b c", "p1", 6)], SCHEMA)
    before = state(spark, where)
    calls = iter([real, real, stop])  # the manifest is read twice, then the data are written
    monkeypatch.setattr(sync, "_manifest", lambda *a: next(calls, stop)(*a))
    monkeypatch.setattr(sync, "cut", lambda df, name: df)
    real_read = spark.createDataFrame

    def broken(data, schema=None, *a, **k):
        if schema == sync._MANIFEST and data:
            raise RuntimeError("driver lost before the manifest")
        return real_read(data, schema, *a, **k)

    monkeypatch.setattr(spark, "createDataFrame", broken)
    with pytest.raises(RuntimeError):
        sync.merge(change, where, "files", 1)
    monkeypatch.undo()
    import os

    assert os.path.isdir(f"{where}/data/version=1") and state(spark, where) == before
    assert sync.merge(change, where, "files", 1)
    assert state(spark, where) == sorted([r for r in rows if r[:2] not in (("a", "p3"), ("b c", "p1"))] + [("a", "p3", 5), ("b c", "p1", 6)])


def test_the_newest_row_of_a_key_counts(spark, index):
    where, rows = index
    sync.merge(spark.createDataFrame([("a", "p3", 5), ("a", "p3", 8), ("a", "p3", 2)], SCHEMA), where, "files", 1, newest="v")
    assert ("a", "p3", 8) in state(spark, where) and len(state(spark, where)) == len(rows)


def test_loops_of_one_log_with_the_same_words(spark):
    rows = []
    for i in range(4000):
        rows.append((1, i, T0 + dt.timedelta(minutes=i), "open" if i < 2000 else "resolution", f"the parser broke badly again number{i:05d}", None if i < 2000 else "parser broke badly again"))
    df = spark.createDataFrame(rows, "log int, seq long, ts timestamp, kind string, text string, supersedes string")
    got = {r.seq: r.resolved_by for r in pairing.match_loops(df, "log").collect()}
    assert got == {i: 3999 - i for i in range(2000)}  # the newest item first


def test_open_items_look_at_few(monkeypatch):
    found = pairing.OpenItems()
    for i in range(5000):
        found.add(["same", "words", "here", f"own{i}"], [])
    looks = 0
    real = pairing.OpenItems._newest_first

    def counted(self, key):
        nonlocal looks
        for n in real(self, key):
            looks += 1
            yield n

    monkeypatch.setattr(pairing.OpenItems, "_newest_first", counted)
    assert [found.take(["same", "words", "here", "other"], []) for _ in range(5000)] == list(reversed(range(5000)))
    assert looks < 20_000 and found.take(["same", "words", "here"], []) is None
