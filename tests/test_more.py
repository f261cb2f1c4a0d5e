"""Joins, searches, diffs and helpers against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import language, secrets
from logloom.operators import graph, pairing, sessions, text
from logloom.shared import running
from logloom.sources import documents, transcripts

SPOKEN = (
    "cat 1 pillar 2 readability 5 make 1 while 1 cheese 1 the 1 table 2 little 2 people 2 syllable 3 whale 1 boat 1 beautiful 3 queue 1 happy 2 well-known 2 "
    "self-documenting 5 idea 3 area 3 sea 1 create 2 repeat 2 reliable 4 giant 2 million 3 radio 3 medium 3 science 2 client 2 diet 2 field 1 friend 1 believe 2 "
    "quiet 2 cruel 2 ruin 2 actual 3 virtuous 3 video 3 leopard 2 nation 2 vision 2 anxious 2 special 2 precious 2 patient 2 being 2 saying 2 arguing 3 during 2 "
    "guess 1 guide 1 language 2 jaguar 2 recipe 3 argue 2 arguable 4 TABLE 2"
).split()


def test_syllables_as_spoken(spark):
    df = spark.createDataFrame(list(zip(SPOKEN[::2], map(int, SPOKEN[1::2]))), "word string, n int")
    assert [tuple(r) for r in df.withColumn("got", language.syllables(F.col("word"))).where("got <> n").collect()] == []


@pytest.mark.parametrize(
    "line,want,n",
    [
        ("Authorization: Bearer abc", "Authorization: Bearer [redacted]", 1), ("bearer abc", "bearer [redacted]", 1), ("$API_TOKEN x", "[redacted] x", 1),
        ("${API_KEY:-hunter2}", "[redacted]", 1), ("${PROJECT_ROOT:-/opt}", "${PROJECT_ROOT:-/opt}", 0), ("password: hunter2, next", "password: [redacted], next", 1),
        ("see http://u:pw@a.b/c?access_token=zz&page=2#f", "see http://u:[redacted]@a.b/c?access_token=[redacted]&page=2#f", 2), ('{"token":"abc","x":1}', '{"token":"[redacted]","x":1}', 1),
        ("Authorization: Basic dXNlcg==", "Authorization: Basic [redacted]", 1), ("The key of it", "The key of it", 0), ("", "", 0), ("a\n\tb ", "a\n\tb ", 0),
    ],
)
def test_redacted_lines(spark, line, want, n):
    r = spark.range(1).select(secrets.redacted(F.lit(line)).alias("x"), secrets.masked(F.lit(want)).alias("again")).first()
    assert (*r.x, r.again) == (want, n, want)


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(500)] + [(None, 500, 4)]
    got = running(spark.createDataFrame(rows, "k int, i long, v int"), [F.col("k").asc_nulls_last(), F.col("i").asc()], "t", before="v").collect()
    total = 0
    for p, r in enumerate(sorted(got, key=lambda r: (r.k is None, r.k or 0, r.i)), 1):
        assert (r["__position"], r.before) == (p, total)
        total += r.v
    assert sessions.numbered(spark.createDataFrame([], "k int"), F.col("k").asc()).collect() == []


def brute_loops(rows, span):
    """The two passes as they are told."""
    taken, used = {}, set()
    items = [r for r in rows if r[2] == "open"]
    fixes = [r for r in rows if r[2] == "resolution"]
    words = lambda t: {w for w in t.lower().replace(".", " ").split() if len(w) >= 5}
    for r in fixes:
        if not r[4]:
            continue
        for f in reversed(items):
            day = f[1].strftime("%Y-%m-%d")
            quote = r[4].split('"')[1] if '"' in r[4] else None
            if f[0] not in taken and f[:2][::-1] < (r[1], r[0]) and (day in r[4] or quote and quote in f[3] or len(words(f[3]) & words(r[4])) >= 3):
                taken[f[0]] = r[0]
                used.add(r[0])
                break
    for f in items:
        if f[0] in taken:
            continue
        for r in fixes:
            if r[0] not in used and (r[1], r[0]) > (f[1], f[0]) and r[1] - f[1] <= span:
                taken[f[0]] = r[0]
                used.add(r[0])
                break
    return {f[0]: taken.get(f[0]) for f in items}


def test_loops_match_the_passes_as_told(spark):
    rng = random.Random(3)
    pool = ["parser", "broken", "export", "window", "button", "loader", "cache9"]
    every, want = [], {}
    for log in (1, 2, None):
        rows, seq = [], 0
        for day in range(120):
            for _ in range(rng.randrange(3)):
                ts, seq = dt.datetime(2024, 1, 1) + dt.timedelta(days=day // 2, hours=rng.randrange(5)), seq + 1
                if rng.random() < 0.5:
                    rows.append((seq, ts, "open", " ".join(rng.sample(pool, 4)), None))
                else:
                    sup = rng.choice([None, None, ts.strftime("%Y-%m-") + "05", " ".join(rng.sample(pool, 4)), f'the "{rng.choice(pool)} {rng.choice(pool)}" one'])
                    rows.append((seq, ts, "resolution", "done", sup))
        rows.sort(key=lambda r: (r[1], r[0]))
        want |= {(log, k): v for k, v in brute_loops(rows, dt.timedelta(days=14)).items()}
        every += [(log, *r) for r in rows]
    df = spark.createDataFrame(every, "log int, seq long, ts timestamp, kind string, text string, supersedes string")
    got = {(r.log, r.seq): r.resolved_by for r in pairing.match_loops(df, "log").collect()}
    assert got == want and len(set(want.values())) > 40


def test_intervals_of_all_lengths_meet(spark):
    rng = random.Random(4)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(500_000))
    some = lambda n: [(i, a, a + dt.timedelta(minutes=rng.choice([0, 5, 2000, 90_000]))) for i in range(n) for a in [at()]]
    a, b = some(80) + [(99, None, None)], some(120)
    got = pairing.overlap_counts(spark.createDataFrame(a, "id int, start timestamp, end timestamp"), spark.createDataFrame(b, "log_id int, start timestamp, end timestamp"))
    day = dt.timedelta(days=1)
    want = {i: sum(le >= s and ls <= e + day for _, ls, le in b) if s else 0 for i, s, e in a}
    assert {r.id: r.n_logs for r in got.collect()} == want


def test_fuzzy_terms_match_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = {word(rng.randrange(1, 16)) for _ in range(300)}
    asked = [(i, word(rng.randrange(1, 16))) for i in range(40)]

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    want = {(i, t, 0 if t.startswith(q) else edits(t, q)) for i, q in asked for t in terms if t.startswith(q) or edits(t, q) <= int(len(q) * 0.2)}
    got = text.fuzzy_terms(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(asked, "query_id int, query string"))
    assert {(r.query_id, r.term, r.distance) for r in got.collect()} == want


def test_excerpts_stand_around_a_term(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five (Sixth) seven eight nine ten"), (2, None)], "doc_id int, text string")
    hits = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.1)], "query_id int, doc_id int, score double")
    q = spark.createDataFrame([(7, "sixt nothing")], "query_id int, query string")
    got = {r.doc_id: r.excerpt for r in text.excerpts(hits, q, docs, tokens=4).collect()}
    assert got == {1: "four five (Sixth) seven", 2: None}


def test_steps_and_hunks_rebuild_both_sides(spark):
    rng = random.Random(6)
    runs = {k: [rng.choice("abcd") for _ in range(rng.randrange(0, 40))] for k in "pqrs"}
    steps = spark.createDataFrame([(k, i, s) for k, v in runs.items() for i, s in enumerate(v)], "run string, seq int, signature string")
    pairs = [("p", "q"), ("r", "s"), ("p", "p"), ("q", "none")]
    got = {}
    for r in graph.run_steps(steps, spark.createDataFrame(pairs, "a string, b string")).collect():
        got.setdefault((r.a, r.b), []).append(r)
    for (a, b), rows in got.items():
        rows.sort(key=lambda r: r.position)
        assert [r.signature for r in rows if r.side != "b"] == runs[a] and [r.signature for r in rows if r.side != "a"] == runs.get(b, [])
        assert sum(r.side == "both" for r in rows) == graph.lcs_length(runs[a], runs.get(b, []))
    texts = []
    for _ in range(6):
        lines = [f"line {k}" for k in range(60)] if not texts else texts[-1].split("\n")
        for _ in range(4):
            k = rng.randrange(len(lines))
            lines[k : k + rng.randrange(2)] = [f"new {rng.randrange(999)}"] * rng.randrange(3)
        texts.append("\n".join(lines))
    v = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)] + [("d", 1, "x"), ("d", 2, None)], "chain string, version int, text string")
    hunks = {}
    for r in graph.version_hunks(v).collect():
        hunks.setdefault((r.chain, r.version), []).append(r)
    counts = {(r.chain, r.version): r for r in graph.version_diffs(v).collect()}
    for key, rows in hunks.items():
        rows.sort(key=lambda r: r.position)
        assert (sum(r.side == "b" for r in rows), sum(r.side == "a" for r in rows), rows[-1].hunk + 1) == (counts[key].added, counts[key].removed, counts[key].hunks)
        for r in rows:
            before, after = (t.split("\n") for t in (texts[key[1]], texts[key[1] + 1])) if key[0] == "c" else (["x"], [""])
            assert (r.side == "b" or before[r.line_a - 1] == r.text) and (r.side == "a" or after[r.line_b - 1] == r.text)
            assert r.side == "both" or any(abs(r.position - p.position) <= 3 for p in rows)


def test_tables_by_jdbc(spark):
    url = "jdbc:derby:memory:logloom;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id int, name string")
    rows.write.format("jdbc").options(url=url, dbtable="things", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = documents.table(
        spark, url=url, dbtable="things", driver="org.apache.derby.jdbc.EmbeddedDriver", partitionColumn="id", lowerBound="0", upperBound="20", numPartitions="3"
    )
    assert sorted(map(tuple, got.collect())) == [(i, f"n{i}") for i in range(20)]


def test_version_file_names(spark):
    rows = [("/a/0123456789abcdef@v12",), ("/a/0123456789abcdef",), ("/a/0123@v1",), ("/a/@v",)]
    got = [(r.hash, r.version, r.skip) for r in transcripts.version_files(spark.createDataFrame(rows, "path string")).collect()]
    assert got == [("0123456789abcdef", 12, None), (None, None, "no-version"), (None, None, "no-hash"), (None, None, "no-version")]
