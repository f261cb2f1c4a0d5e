"""Jobs on small hand-written corpora, and properties: order of input doesn't matter, what is dropped is counted."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import graph, pairing, sessions, text, tools, trends, usage
from logloom.sources import documents, sync, transcripts
from logloom.streaming import jobs

T0 = datetime(2026, 7, 1, 3, 47, 11)


def usage_rows(spark, rows):
    return spark.createDataFrame(
        [(t, s, m, 10, o, 0, 0) for t, s, m, o in rows],
        "ts timestamp, session_id string, model string, input long, output long, cache_read long, cache_creation long",
    )


RATES = [("big", 5.0, 25.0), ("small", 1.0, 5.0)]


def rates(spark):
    return spark.createDataFrame(RATES, "model string, input_per_million double, output_per_million double")


def test_blocks(spark):
    u = usage_rows(spark, [(T0, "a", "big", 20), (T0 + timedelta(minutes=1), "b", "big-20260101", 20), (None, "c", "big", 5)])
    (b,) = usage.usage_blocks(u, rates(spark)).collect()
    assert (b.sessions, b.turns, b.output) == (2, 2, 40) and int(b.block.timestamp()) % 18_000 == 0
    assert b.cost == pytest.approx((20 * 5 + 40 * 25) / 1e6)
    (b,) = usage.usage_blocks(usage_rows(spark, [(T0, "a", "big", 20), (T0, "a", "odd", 1)]), rates(spark)).collect()
    assert b.cost is None


def test_totals_and_lookup(spark):
    u = usage_rows(spark, [(T0, "a", m, 10) for m in ("big", "small-20250101", "small-2025", "big-x", "<synthetic>")])
    got = {r.model: r.cost for r in usage.usage_totals(u, rates(spark)).collect()}
    assert got["small-2025"] is None and got["big-x"] is None and got["<synthetic>"] == 0.0 and got["small-20250101"] > 0
    r = usage.total_cost(u, rates(spark)).first()
    assert (r.unpriced_models, r.unpriced_tokens) == (2, 40)


def test_hooks(spark):
    h = spark.createDataFrame(
        [("x", "s", 400.0), ("x", "s", 500.0), ("x", "t", None), ("y", "s", None)], "command string, session_id string, duration_ms double"
    )
    got = {r.command: r for r in usage.hook_health(h).collect()}
    assert tuple(got["x"])[1:] == (3, 1, 400.0, 500.0, 500.0, 900.0, 2) and tuple(got["y"])[1:6] == (1, 1, 0.0, 0.0, 0.0)


def test_loops(spark):
    rows = [
        ("l", 1, datetime(2024, 1, 5), "open", "the shell parser broke again", None),
        ("l", 2, datetime(2024, 2, 10), "open", "the shell parser broke badly", None),
        ("l", 3, datetime(2024, 2, 20), "resolution", "done", "shell parser broke"),
        ("m", 1, datetime(2024, 1, 1), "open", "one", None),
        ("m", 2, datetime(2024, 1, 5), "resolution", "fix", None),
        ("n", 1, datetime(2024, 1, 1), "open", "one", None),
        ("n", 2, datetime(2024, 3, 5), "resolution", "fix", None),
        ("o", 1, datetime(2024, 1, 1), "open", "one", None),
        ("o", 2, datetime(2024, 1, 2), "open", "two", None),
        ("o", 3, datetime(2024, 1, 3), "resolution", "fix", None),
    ]
    e = spark.createDataFrame(rows, "log string, seq long, ts timestamp, kind string, text string, supersedes string")
    got = {(r.log, r.seq): r.resolved_by for r in pairing.match_loops(e.repartition(3), "log").collect()}
    assert got == {("l", 1): None, ("l", 2): 3, ("m", 1): 2, ("n", 1): None, ("o", 1): 3, ("o", 2): None}


def test_replays_keep_null_ids(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 1)], "id string, mtime int")
    assert sorted(map(str, pairing.drop_replays(df, "id", F.desc("mtime")).collect())) == sorted(
        ["Row(id='a', mtime=2)", "Row(id=None, mtime=1)", "Row(id=None, mtime=1)"]
    )


def test_lcs_matches_a_table():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randrange(9))]
        b = [rng.choice("abc") for _ in range(rng.randrange(9))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        steps = graph.lcs(a, b)
        assert sum(s[0] == "both" for s in steps) == t[-1][-1]
        assert [s[1] for s in steps if s[1] >= 0] == list(range(len(a))) and [s[2] for s in steps if s[2] >= 0] == list(range(len(b)))
        assert all(a[s[1]] == b[s[2]] for s in steps if s[0] == "both")
    assert graph.lcs(["x"], ["y"])[0][0] == "a"


def test_run_and_version_diffs(spark):
    steps = [("a", i, f"s{i}") for i in range(13)] + [("b", i, f"s{i}") for i in range(10)]
    s = spark.createDataFrame(steps, "run string, seq int, signature string")
    p = spark.createDataFrame([("a", "b"), ("b", "zz"), ("y", "z")], "a string, b string")
    got = {r.a: r for r in graph.run_diffs(s, p).collect()}
    assert (got["a"].aligned, got["a"].similarity, got["a"].first_divergence) == (10, 10 / 13, 10)
    assert got["b"].similarity == 0 and got["y"].similarity == 1.0 and got["y"].short_run
    v = spark.createDataFrame([("f", 2, "a\nb\nc"), ("f", 3, "a\nx\nc\nd"), ("f", 7, None), ("g", 1, "only")], "chain string, version int, text string")
    got = {r.version: r for r in graph.version_diffs(v).collect()}
    assert set(got) == {2, 3} and (got[2].added, got[2].removed, got[2].unchanged, got[2].hunks) == (2, 1, 2, 1)
    big = graph.version_diffs(v, cells=1).where("version = 2").first()
    assert big.wholesale and big.unchanged is None


def test_long_runs_and_versions_are_aligned_whole(spark):
    rng = random.Random(6)
    a = [f"s{i}" for i in range(2500)]
    b = [x for x in a if rng.random() < 0.9] + ["end"]
    rows = [("a", i, x) for i, x in enumerate(a)] + [("b", i, x) for i, x in enumerate(b)]
    s = spark.createDataFrame(rows, "run string, seq int, signature string")
    r = graph.run_diffs(s, spark.createDataFrame([("a", "b")], "a string, b string")).first()
    first = next(i for i, x in enumerate(a) if b[i] != x)
    assert (r.steps_a, r.steps_b, r.aligned, r.first_divergence, r.truncated) == (2500, len(b), len(b) - 1, first, False)
    old = [x for i, x in enumerate(a)]
    new = [f"n{i}" if i % 20 == 0 else x for i, x in enumerate(a[:-1])] + ["new end"]  # over 4,000,000 cells
    v = spark.createDataFrame([("f", 1, "\n".join(old)), ("f", 2, "\n".join(new))], "chain string, version int, text string")
    r = graph.version_diffs(v).first()
    assert (r.added, r.removed, r.unchanged, r.hunks, r.wholesale) == (126, 126, 2374, 126, False)


def test_ranks_match_dense_iteration(spark):
    rng = np.random.default_rng(1)
    words = [f"word{c}" for c in "abcdefghijkl"]
    docs = [(d, " ".join(" ".join(rng.choice(words, rng.integers(1, 6))).capitalize() + "." for _ in range(5 + d))) for d in range(5)] + [(7, ""), (8, None), (9, "The. Of. 12. One word."), (10, "Alone.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sents = text.sentence_table(df)
    vectors = text.tf_idf(sents)
    got = {(r.doc_id, r.ix): r.rank for r in text.rank_texts(df).collect()}
    table = {(r.doc_id, r.ix): r.rank for r in text.rank_sentences(sents, vectors).collect()}
    assert set(got) == set(table) == {(r.doc_id, r.ix) for r in sents.collect()} and np.allclose([got[k] for k in table], list(table.values()))
    names = {w: k for k, w in enumerate(words)}
    for doc in range(5):
        n = 5 + doc
        v = np.zeros((n, len(words)))
        for r in vectors.where(F.col("doc_id") == doc).collect():
            v[r.ix, names[r.term]] = r.weight
        m = v @ v.T
        np.fill_diagonal(m, 0)
        out = m.sum(axis=1)
        r = np.full(n, 1 / n)
        for _ in range(120):
            new = 0.15 / n + 0.85 * sum(m[i] / out[i] * r[i] for i in range(n) if out[i] > 1e-12)
            done = np.abs(new - r).max() < 1e-6
            r = new
            if done:
                break
        assert np.allclose([got[doc, i] for i in range(n)], r)


def test_ranks_and_digests_are_of_sentences(spark, tmp_path):
    from logloom.plans import join_queries as q

    parts = ["The cat sat near the old dog.", "A dog barked at the bird.", "The bird watched the cat.", "Rain fell all day.", "The old dog slept."]
    docs = [(1, " ".join(parts)), (2, "One cat.\nOne dog."), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    terms = [[w for w in p.lower().rstrip(".").split() if w not in text.STOPWORDS] for p in parts]
    names = sorted(set(sum(terms, [])))
    tf = np.array([[ws.count(w) for w in names] for ws in terms], float)
    v = tf * (np.log(6 / (1 + (tf > 0).sum(axis=0))) + 1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = v @ v.T
    np.fill_diagonal(m, 0)
    out, r = m.sum(axis=1), np.full(5, 0.2)
    for _ in range(120):
        new = 0.03 + 0.85 * sum(m[i] / out[i] * r[i] for i in range(5) if out[i])
        done = np.abs(new - r).max() < 1e-6
        r = new
        if done:
            break
    got = {(x.doc_id, x.ix): x.rank for x in q.sentence_ranks(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, i) for i in range(5)} | {(2, 0), (2, 1)}
    assert np.allclose([got[1, i] for i in range(5)], r)
    best = sorted(sorted(range(5), key=lambda i: (-round(r[i], 9), i))[:3])
    digest = {x.doc_id: x for x in q.extractive_digest(spark, str(tmp_path)).collect()}
    assert (digest[1].source, digest[1].digest, digest[2].source) == ("ranked", "\n".join(parts[i] for i in best), "verbatim")
    grades = {x.doc_id: x.grade for x in q.readability_scores(spark, str(tmp_path)).collect()}
    assert {i: x.grade for i, x in digest.items()} == grades


def test_digest_and_readability(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The dog sat. The bird sat. The cat and the dog met."), (2, "Short one."), (3, ""), (4, None)], "doc_id long, text string")
    s = text.sentence_table(docs)
    got = {r.doc_id: r for r in text.digest(s, spark.createDataFrame([(2, "My own words.")], "doc_id long, summary string")).collect()}
    assert (got[1].source, got[2].source, got[2].digest) == ("ranked", "summary", "My own words.") and got[1].digest.count("\n") == 2
    r = {x.doc_id: x for x in text.readability(s).collect()}
    assert (r[1].sentences, r[1].words) == (4, 15) and r[1].grade < 5


def test_redaction_job(spark):
    d = spark.createDataFrame([(1, 'x token = "' + "ab" * 20 + '" y'), (2, "clean words only"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in text.redact(d).collect()}
    assert "abab" not in got[1].text and got[1].n_redacted == 1 and got[2].text == "clean words only" and got[3].text is None


def test_link_graph(spark):
    nodes = spark.createDataFrame([(1, "Alpha One"), (2, "beta"), (3, "gamma"), (4, "Beta")], "id int, name string")
    links = spark.createDataFrame([(1, "beta"), (1, "alpha_one"), (1, "none"), (3, "gamma"), (4, "alpha-one")], "source int, target string")
    e = graph.resolve_links(nodes, links)
    got = {r.id: r for r in graph.graph_statistics(nodes, e).collect()}
    assert (got[1].n_in, got[1].n_out, got[1].n_broken) == (1, 1, 1) and got[3].orphan and got[2].orphan and not got[4].leaf
    hops = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "source int, to_id int")
    assert {r.id: r.hop for r in graph.closure(spark.createDataFrame([(1,)], "id int"), hops, 3).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_shortlist(spark):
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    e = spark.createDataFrame([("old", 17, datetime(2026, 1, 2)), ("burst", 4, None), ("none", 0, None), ("new", 1, datetime(2026, 6, 30))], "name string, uses int, last_used timestamp")
    a = spark.createDataFrame([("burst", datetime(2026, 3, 20), 1, "2026-03")], "name string, last_ts timestamp, active_months int, busiest_month string")
    got = {r.name: (r.verdict, r.age_days) for r in tools.deletion_shortlist(e, a, now, 365).collect()}
    assert got == {"old": ("stale", 180), "burst": ("bursty", 103), "none": ("no-evidence", None), "new": ("keep", 1)}


def test_month_spine_has_no_gaps(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 5),), (datetime(2024, 4, 5),), (None,)], "ts timestamp")
    assert [(r.month, r.n) for r in trends.month_spine(df, "ts").orderBy("month").collect()] == [("2024-01", 1), ("2024-02", 0), ("2024-03", 0), ("2024-04", 1)]
    assert trends.month_spine(df.limit(0), "ts").collect() == []


# --- sources --------------------------------------------------------------------------------------------------

OWNER = "0123abcd-0000-4000-8000-000000000001"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")

    def put(path, lines):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    say = lambda role, u, parent, **k: {"type": role, "uuid": u, "parentUuid": parent, "timestamp": k.pop("ts", "2026-07-01T10:00:00Z"), **k}
    usage_ = {"input_tokens": 10, "output_tokens": 20, "cache_read_input_tokens": "x"}
    put(
        f"projects/-home-p/{OWNER}.jsonl",
        [
            say("user", "u1", None, cwd="", message={"role": "user", "content": "# First *prompt*\nmore"}),
            say("user", "u2", "u1", cwd="/home/p", gitBranch="main", message={"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}),
            say("assistant", "a1", "u1", ts="2026-07-01T12:00:00+02:00", message={"model": "big", "usage": usage_, "content": [{"type": "tool_use", "id": "t1", "name": "Edit", "input": {"k": 1}}]}),
            say("user", "u3", "a1", toolUseResult={"filePath": "a.ts", "structuredPatch": [{"lines": [" x", "-old", "+new", " y", " z"], "newLines": 7, "oldLines": 7}], "userModified": True}),
            {"type": "ai-title", "aiTitle": "one"}, {"type": "ai-title", "aiTitle": "two"},
            "", "{torn", "[1]", '{"type": 5}', {"type": "system", "timestamp": None},
        ],
    )
    put(f"projects/-home-p/{OWNER}/subagents/x/agent.jsonl", [say("assistant", "d1", None, isSidechain=True, message={"usage": {"output_tokens": 5}})])
    put("projects/-home-p/not-a-uuid/x.jsonl", [say("user", "z", None)])
    put("history/history.jsonl", [{"display": "hello", "timestamp": 1_700_000_000_000, "project": "/p", "pastedContents": {"1": {}}}, {"display": "  "}, {"display": 5}, "junk"])
    put("pacing/log.jsonl", [{"session_id": "s", "captured_at": "2026-07-01T00:00:00Z", "rate_limits": {"five_hour": {"used_percentage": 5, "resets_at": 1_700_000_000}}}, {"captured_at": 1}, {"session_id": "t"}])
    put("notes/20240102030405-a-note-abcdef.md", ["---", "name: A note", "description: about", "---", "See [[Other]] and [[A note]]"])
    put("meta/m.json", [{"session_id": "s", "tool_counts": {"Read": 3, "Bad": "x"}}])
    put("meta/bad.json", ["{"])
    put("tasks/session-0123abcd/1.json", [{"id": "1", "subject": "do", "status": "pending", "blockedBy": ["2"]}])
    return str(root)


def test_records(spark, corpus):
    r = transcripts.records(spark, f"{corpus}/projects").cache()
    main = r.where(f"session_id = '{OWNER}'")
    assert main.count() == 10 and main.where("ok").count() == 7  # the blank line is no line; three lines are bad
    assert main.where("type = 'assistant'").first().ts == main.where("uuid = 'u1'").first().ts
    s = sessions.summaries(main).first()
    assert (s.title, s.title_source, s.cwd, s.branch, s.project_dir) == ("two", "title", "/home/p", "main", "-home-p")
    assert (s.user_turns, s.assistant_turns, s.input, s.output, s.cache_read, s.bad_lines) == (3, 1, 10, 20, 0, 3)
    assert s.first_prompt == "First *prompt*"
    assert [x.uuid for x in sessions.forks(main).where("is_branch").collect()] == ["u1"]
    e = sessions.edits_of(main).first()
    assert (e.path, e.added, e.removed, e.user_modified) == ("a.ts", 1, 1, True)
    assert sessions.blast_radius(sessions.touched_files(sessions.edits_of(main))).first().edits == 1
    t = {x.uuid: x for x in sessions.timeline(main).collect()}
    assert t["u2"].text.excerpt == "a\n\nb" and t["a1"].tools == ["Edit"] and t["a1"].tokens.output == 20
    b = sessions.blocks_of(main).where("block_type = 'tool_use'").first()
    assert (b.tool_name, b.tool_use_id) == ("Edit", "t1")
    assert r.where("is_delegated").count() == 1
    assert [x.model for x in sessions.tokens_by_model(main).collect()] == ["big"]


def test_listings(spark, corpus):
    assert [x.session_id for x in transcripts.session_files(spark, f"{corpus}/projects").collect()] == [OWNER]
    got = {x.session_id: x.skip for x in transcripts.delegated_files(spark, f"{corpus}/projects").collect()}
    assert got == {"agent": None, "x": "no-owner"}
    assert len(transcripts.newest_files(transcripts.files(spark, corpus), 3)) == 3


def test_other_sources(spark, corpus):
    (p,) = transcripts.prompts(spark, f"{corpus}/history").collect()
    assert (p.text, p.had_paste, p.ts.year) == ("hello", True, 2023)
    s = {x.session_id: x for x in transcripts.pacing_samples(spark, f"{corpus}/pacing").collect()}
    assert set(s) == {"s", "t"} and s["s"].limits.five_hour.used == 5.0 and s["t"].limits is None
    (n,) = documents.notes(spark, f"{corpus}/notes").collect()
    assert (n.name, n.description, n.slug, n.links) == ("A note", "about", "a-note", ["Other", "A note"]) and n.ts == datetime(2024, 1, 2, 3, 4, 5)
    j = documents.json_files(spark, f"{corpus}/meta")
    assert j.where("readable").count() == 1 and j.count() == 2
    assert [tuple(x) for x in documents.category_counts(j, "$.tool_counts", "session_id").collect()] == [("s", "Read", 3.0)]
    (t,) = documents.tasks(spark, f"{corpus}/tasks").collect()
    assert (t.board, t.task_id, t.blocked_by) == ("0123abcd", "1", ["2"])


def test_log_forms(spark):
    raw = """2026-01-02T03:04:05Z | [Friction] | pipe one | supersedes: old
2026-01-03 | [resolution] | pipe two
stray line
## 2026-02-01 - heading
[Friction] section text
goes on here

not part of it
| 2026-03-01 | Note | scope | table note |
| date | Type | scope | note |"""
    df = spark.createDataFrame([("l", raw)], "log_id string, text string")
    got = [tuple(r) for r in documents.log_entries(df, ["friction", "resolution", "note"]).orderBy("seq").select("format", "date_raw", "type", "text", "supersedes").collect()]
    assert got == [
        ("pipe", "2026-01-02T03:04:05Z", "Friction", "pipe one", "old"), ("pipe", "2026-01-03", "Resolution", "pipe two", None),
        ("section", "2026-02-01", "Friction", "section text goes on here", None), ("table", "2026-03-01", "Note", "table note", None),
    ]


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n## Shipped\na\nb\n**Learned**\nc\n## Shipped\nlate")], "id int, text string")
    assert sorted(map(tuple, documents.sections(df, ["Shipped", "Learned"]).collect())) == [(1, "Learned", "c"), (1, "Shipped", "a\nb")]


def test_sync_equals_rebuild(spark, tmp_path):
    schema = "kind string, path string, mtime int, size int"
    old = spark.createDataFrame([("a", "1", 1, 1), ("a", "2", 1, 1), ("b", "3", 1, 1), ("a", "5", 1, 1)], schema)
    new = spark.createDataFrame([("a", "1", 1, 1), ("a", "2", 2, 1), ("a", "4", 1, 1)], schema)
    ch = sync.delta(old, new, spark.createDataFrame([("b",)], "kind string"))
    assert {r.path: r.state for r in ch.collect()} == {"1": "unchanged", "2": "changed", "3": "held", "4": "new", "5": "removed"}
    parse = lambda d: d.select("kind", "path", F.concat("path", F.lit("@"), F.col("mtime").cast("string")).alias("body"))
    todo = ch.where("state in ('new', 'changed')").select("kind", "path")
    after = sync.apply(parse(old), parse(new.join(todo, ["kind", "path"])), ch)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, parse(new.unionByName(old.where("path = '3'"))).collect()))
    out = str(tmp_path / "docs")
    sync.write(parse(old), out)
    sync.write(parse(new), out)
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "4"]


# --- streams --------------------------------------------------------------------------------------------------


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=7 * i), i % 3, float(i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    src = str(tmp_path / "events.parquet")
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = {(r.block, r.turns, r.output) for r in jobs.drain(jobs.blocks(stream), "complete").collect()}
    want = df.groupBy(F.window("ts", "5 hours")["start"].alias("b")).agg(F.count("*"), F.sum(F.floor(F.col("value") * 100)))
    assert got == {tuple(r) for r in want.collect()}
    twice = stream.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2))))
    assert jobs.drain(jobs.without_replays(twice, "event_id")).count() == 200
    latest = {r.key: (r.ts, r.n) for r in jobs.drain_latest(jobs.latest_per_key(stream, "user_id")).collect()}
    assert latest == {str(u): (max(r[1] for r in rows if r[2] == u), sum(r[2] == u for r in rows)) for u in range(3)}
