"""The pipeline's stages against brute force on the smallest tables, and on odd rows."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from logloom.llm import rules

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def through(spark, docs, place):
    """All stages, each written and read again; the rows after each."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        out.append(docs.collect())
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start = docs.collect()
    clean, unique, cut, mixed, tokens = through(spark, docs, tmp_path)
    led = {r.doc_id: r.fail_bits for r in rules.ledger(docs).collect()}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in start if not led[r.doc_id])
    # One document of each group of near duplicates stays: the smallest id of the component.
    sets = {r.doc_id: shingles(r.text) for r in clean}
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in sorted(sets):
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in unique) == sorted(i for i in sets if find(i) == i)
    # No byte of a repeated 100-byte string is left.
    seen, want = set(), {}
    for r in sorted(unique, key=lambda r: r.doc_id):
        b = r.text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[r.doc_id] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    # Sources come near 150 % of all words by weight, no document more than twice.
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies.values()) <= {1, 2} and {r.doc_id for r in mixed} <= {r.doc_id for r in cut}
    words = {r.doc_id: len(WORD.findall(r.text)) for r in cut}
    taken = sum(words[i] * k for i, k in copies.items())
    sources = {r.source for r in cut}
    assert abs(taken - 1.5 * sum(words.values())) <= len(sources) * max(words.values())
    text = {r.doc_id: r.text for r in cut}
    assert len(tokens) == len(mixed)
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in tokens)
    for rows in (clean, unique, cut, mixed):
        assert list(rows[0].asDict()) == docs.columns


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    some = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    long, twin = some(30_000), some(60)
    rows = [
        (1, some(40), "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "x"), (None, some(50), "en", None, 5, "x"),
        (None, some(50), "en", "b", 5, "x"), (4, long, "en", "b", 9, "x"), (5, twin, "en", "a", 3, None), (5, twin, "en", "a", 3, None), (6, twin, "de", "b", 3, "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    clean, unique, cut, mixed, tokens = through(spark, docs, tmp_path)
    assert sorted(str(r.doc_id) for r in clean) == sorted(map(str, [1, None, None, 4, 5, 5, 6]))
    assert sorted(str(r.doc_id) for r in unique) == sorted(map(str, [1, None, None, 4, 5, 5]))
    assert next(r for r in cut if r.doc_id == 4).text == long
    assert {r.kept for r in tokens} <= {"x", None} and all(r.n_tokens > 0 for r in tokens)


def test_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [len(x) for x in through(spark, docs, tmp_path)] == [0] * 5
