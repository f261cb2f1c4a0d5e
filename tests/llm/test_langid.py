"""Language profiles: n-grams against a plain loop, accuracy on held-out documents, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import langid

SYLLABLES = {"a": "ka no mi ta re so", "b": "str ing tion ed the", "c": "ção ñan ués él", "d": "при вет как дом", "e": "你 好 世 界 文 字"}


def prose(name, rng, n=30):
    parts = SYLLABLES[name].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + rng.choice([".", "!", " 12"])


def plain(text, n=3):
    out, runs, run = {}, [], ""
    for c in text + " ":
        kind = langid._classes()[ord(c)]
        if kind:
            run += chr(kind & 0x7FFFFFFF)
        elif run:
            runs.append(f" {run} ")
            run = ""
    for i, r in enumerate(runs):
        for k in range(len(r) - n + 1):
            g = r[k : k + n]
            out[g] = out.get(g, 0) + 1
    return out


def test_grams_equal_a_loop():
    rng = random.Random(1)
    texts = ["", "Ab c", "1 2", "x", "né  né!", "क्षि a", *(prose(k, rng) for k in SYLLABLES), "a" * 5000, "B"]
    doc, which, count, shape = langid.grams_of(pa.array(texts, pa.large_string()))
    got = [{} for _ in texts]
    for d, w, c in zip(doc.tolist(), which.tolist(), count.tolist()):
        got[d]["".join(map(chr, shape[w]))] = c
    # A blank has no n-gram across it: single letters stand between two blanks.
    assert got == [plain(t) for t in texts]


def test_vectors_bind_and_bundle():
    v = langid.gram_vectors(np.array([[97, 98, 99], [99, 98, 97], [97, 98, 99]], np.uint32), 1024).astype(int)
    one = {c: langid._letters(np.array([ord(c)], np.uint32), 1024)[0].astype(int) for c in "abc"}
    assert (v[0] == np.roll(one["a"], 2) * np.roll(one["b"], 1) * one["c"]).all() and (v[0] == v[2]).all()
    assert abs((v[0] * v[1]).sum()) < 150  # order matters: nearly orthogonal
    texts = pa.array(["abc abd", "", "abc abd"], pa.large_string())
    b = langid.bundles(texts, 1024)
    grams = np.array([[ord(c) for c in g] for g in (" ab", "abc", "bc ", " ab", "abd", "bd ")], np.uint32)
    assert (b[0] == langid.gram_vectors(grams, 1024).astype(int).sum(axis=0)).all() and not b[1].any() and (b[0] == b[2]).all()


def test_both_ways_of_adding_agree(monkeypatch):
    rng = random.Random(2)
    texts = pa.array([prose(rng.choice("abcde"), rng) for _ in range(40)], pa.large_string())
    one = langid.bundles(texts, 256)
    monkeypatch.setattr(langid, "SPARSE", 0)
    monkeypatch.setattr(langid, "GRAMS", 50)
    assert (langid.bundles(texts, 256) == one).all()


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, prose(k := rng.choice("abcde"), rng), k, k) for i in range(400)]
    rows += [(1000, None, "a", None), (1001, "12 !?", "a", None), (1002, prose("b", rng), None, "b"), (1003, "", None, None), (None, prose("c", rng), "c", "c"), (1004, prose("d", rng, 20_000), None, "d"), (1002, prose("b", rng), None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(5)
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[3] for r in rows}
    assert all(r.lang_pred == (want[r.id] or "und") and 0 <= r.score <= 1 for r in got)
    assert sum(r.held_out for r in got) > 60 and all(r.score == 0 for r in got if r.lang_pred == "und")
    again = {(r.id, r.lang_pred, r.score) for r in langid.identify(df.repartition(2)).collect()}
    assert again == {(r.id, r.lang_pred, r.score) for r in got}  # however rows are dealt


def test_nothing_learned(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    got = langid.identify(spark.createDataFrame([(1, "abc", None), (2, None, None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    one = langid.identify(spark.createDataFrame([(1, "abc def", "q"), (3, "xyz", None), (4, "", None)], schema)).collect()
    assert {r.id: r.lang_pred for r in one} == {1: "q", 3: "q", 4: "und"}


def test_documents_of_the_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables here")
    got = langid.op12_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
