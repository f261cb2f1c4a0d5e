"""Queries on small tables that hold what the smallest given tables lack, against their SQL twins."""

import random

import duckdb
import pytest

import __spark_entry__
from logloom.operators import graph, text, tools


def same_as_sql(spark, folder, name, **tables):
    """The rows of a query over the tables (as DataFrames), which must be those of its twin."""
    c = duckdb.connect()
    for k, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{k}.parquet")
        c.execute(f"create view {k} as select * from '{folder}/{k}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(cols).collect()]
    want = c.execute(f"select {', '.join(cols)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def _documents(spark, n, text="concat('a b', id)"):
    langs = "CASE WHEN id % 3 = 0 THEN 'fr' ELSE 'de' END"
    return spark.range(1, n).selectExpr("id AS doc_id", f"{text} AS text", f"{langs} AS lang", "concat('s', id % 2) AS source", f"CAST(length({text}) AS BIGINT) AS n_chars")


@pytest.mark.parametrize("name", ["sync_applied", "sync_written"])
def test_held_files_keep_the_size_they_were_parsed_with(spark, tmp_path, name):
    assert same_as_sql(spark, tmp_path, name, documents=_documents(spark, 400))


def _reached(edges, roots, hops, files):
    """Brute force of closure_by_root(): ({(root, id, hop)}, {(root, reason): n})."""
    out, why = set(), {}
    for r in roots:
        seen, front = {r}, [r]
        out.add((r, r, 0))
        for hop in range(1, hops + 2):
            met = [to for s in sorted(front) for _, to in sorted((q, to) for f, q, to in edges if f == s)]
            front = []
            for to in met:
                if hop > hops:
                    reason = graph.DEEP
                elif to is None:
                    reason = graph.BROKEN
                elif to in seen:
                    reason = graph.AGAIN
                elif len(seen) > files:
                    reason = graph.FULL
                else:
                    seen.add(to), front.append(to), out.add((r, to, hop))
                    continue
                why[r, reason] = why.get((r, reason), 0) + 1
    return out, why


@pytest.mark.parametrize("hops,files,piece", [(2, 5, 3), (3, 40, 1024), (1, 2, 2)])
def test_closures_by_root_leave_a_row_for_each_root(spark, monkeypatch, hops, files, piece):
    monkeypatch.setattr(graph, "PIECE", piece, raising=False)
    monkeypatch.setattr(graph, "FOLLOWED", 100, raising=False)  # several shares
    rng, widths = random.Random(hops), []
    edges = [(rng.randrange(40), q, None if q % 9 == 0 else rng.randrange(60)) for q in range(900)]
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: widths.append((name, (out := kept(df, name)).count())) or out)
    links = spark.createDataFrame(edges, "source long, seq long, to_id long")
    seen, skips = graph.closure_by_root(spark.createDataFrame([(i,) for i in range(50)], "id long"), links, hops, files)
    want = _reached(edges, range(50), hops, files)
    assert {tuple(r) for r in seen.collect()} == want[0]
    assert {(r.root, r.reason): r.n for r in skips.collect()} == want[1]
    assert all(n <= 50 for name, n in widths if name in ("reach", "reach-met"))


def test_fuzzy_search_scores_classes_once(spark, monkeypatch):
    """60 documents of three texts and 30 queries of two forms, which are scored as six pairs."""
    asked, kept = [], text.fuzzy_terms
    monkeypatch.setattr(text, "fuzzy_terms", lambda index, query: asked.append(query.count()) or kept(index, query))
    docs = spark.range(60).selectExpr("id AS doc_id", "element_at(array('large ring', 'small ring', 'hot bolt'), CAST(id % 3 + 1 AS INT)) AS t")
    query = spark.range(30).selectExpr("id AS query_id", "CASE WHEN id % 2 = 0 THEN 'ring laxge' ELSE 'bo' END AS query")
    got = {tuple(r) for r in text.fuzzy_search(text.postings(docs, body="t"), query, {"body": 2.0}).collect()}
    large = {(q, i, 3.0) for q in range(0, 30, 2) for i in range(0, 60, 3)}
    assert got == large | {(q, i, 2.0) for q in range(1, 30, 2) for i in range(2, 60, 3)}
    assert asked == [2]


LINES = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN '' ELSE concat('red fox ', id % 4, ' runs\n \nred ', id % 3, 'x fox\nblue sky sky\n9\nthe') END"


@pytest.mark.parametrize("name", ["keyword_scores", "sentence_similarity", "tf_idf_vectors"])
def test_vectors_of_texts_are_made_where_they_lie(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(text, "RANKED", 7)
    monkeypatch.setattr(text, "MET", 5, raising=False)
    assert same_as_sql(spark, tmp_path, name, documents=_documents(spark, 60, LINES))
    plan = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_digests_of_texts_are_those_of_their_sentences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "RANKED", 11)
    says = "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 8 = 0 THEN '' ELSE concat('The red fox ran ', id % 4, ' miles. A fox saw red sky. # Nothing.\n\nBlue sky and red fox. ', repeat('We saw a fox. ', CAST(id % 5 AS INT))) END"
    docs = _documents(spark, 50, says)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["extractive_digest"](spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = text.digest(text.sentence_table(docs), ranks=text.rank_texts(docs.select("doc_id", "text")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 30


def test_best_hits_go_by_shares_of_the_queries(spark, monkeypatch):
    """The candidates of all queries never lie in one table, and none stays behind."""
    monkeypatch.setattr(text, "CANDIDATES", 500, raising=False)
    widths, gone, kept = [], [], text.cut
    monkeypatch.setattr(text, "cut", lambda df, name: widths.append((name, (out := kept(df, name)).count())) or out)
    monkeypatch.setattr(text, "drop_cut", lambda df: gone.append(df.count()), raising=False)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('fox ', id % 3, ' sky', id % 7) AS t")
    query = spark.range(20).selectExpr("id AS query_id", "concat('fox sky', id % 7) AS query")
    index = text.postings(docs, body="t")
    got = {(r.query_id, r.place): (r.doc_id, r.score) for r in text.search(index, 200, query, {}, k=3).collect()}
    want = {}
    for r in text.search(index, 200, query, {}).collect():
        want.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    assert got == {(q, i): (d, -s) for q, v in want.items() for i, (s, d) in enumerate(sorted(v)[:3], 1)} and len(got) == 60
    bounded = [n for name, n in widths if name == "search-bounded"]
    assert len(bounded) > 1 and sorted(gone) == sorted(bounded)


def test_version_chains_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(tools, "SORTED", 100, raising=False)
    v = spark.range(1000).selectExpr("id % 50 AS hash", "id % 3 AS session_id", "CAST(id / 7 AS INT) AS version", "1 AS size")
    x = tools.version_chains(v)
    assert x.rdd.getNumPartitions() == 11
    assert x.agg({"n": "sum"}).first()[0] == 1000
