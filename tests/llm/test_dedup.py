"""Near duplicates, vectors and passages against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from logloom.llm import embeddings, minhash, passages
from logloom.llm.suffixes import suffix_array
from logloom.llm.textops import mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, rng, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def mutated(ws, k, rng):
    out = list(ws)
    for i in rng.sample(range(len(ws)), k):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    out = [words(rng.randrange(20, 120), rng) for _ in range(60)]
    base = words(150, rng)
    out += [base] + [mutated(base, rng.randrange(1, 9), rng) for _ in range(40)]  # a star: many copies are only near the base
    for _ in range(15):
        ws = words(80, rng)
        out += [ws, mutated(ws, rng.randrange(0, 6), rng)]
    texts = [" ".join(w) for w in out] + ["", None, "   ", "one", "One", "one two three", "ONE two  three", " ".join(base)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def components(nodes, links):
    par = {n: n for n in nodes}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_match_all_pairs(spark, docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    links = [
        (i, j) for i in sets for j in sets
        if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    want = components(sets, links)
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, component_id string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert {i: got[i].component_id for i in sets} == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in sets)
    kept = minhash.dedup(df, shingle=4)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if want[i] == i)


def test_large_regions_are_dealt_into_blocks_and_go_deeper(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, minhash.near_duplicates(df, shingle=4).collect()))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    assert sorted(map(tuple, minhash.near_duplicates(df, shingle=4).collect())) == whole


def text_groups(seed, groups, copies, length, edits):
    """Texts with independent edits of some templates, and the links among them by all pairs."""
    rng = random.Random(seed)
    texts = [" ".join(mutated(b, rng.randrange(*edits), rng)) for b in [words(length, rng) for _ in range(groups)] for _ in range(copies)]
    rng.shuffle(texts)
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in enumerate(t.split() for t in texts)}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return texts, sets, links


@pytest.mark.parametrize("reach, block, hubs", [(32, 512, 32), (1, 8, 1)])
def test_large_regions_and_clusters_lose_no_link(spark, monkeypatch, reach, block, hubs):
    texts, sets, links = text_groups(11, 3, 60, 150, (1, 5))  # similarities from 0.77 on: many pairs are near 0.8
    similar = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in links]
    assert min(similar) < 0.83
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, value in (("REACH", reach), ("BLOCK", block), ("HUBS", hubs)):
        monkeypatch.setattr(minhash, name, value)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert got == components(sets, links)


def test_neighbours_in_sorted_orders_join_whole_regions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**16, (4, minhash.HASHES), dtype=np.uint16)
    sig = np.repeat(base, 12, axis=0)
    for row in sig:  # a third of the pairs of one template agree in fewer than ESTIMATE hashes
        at = rng.choice(np.arange(4, minhash.HASHES), 24, replace=False)
        row[at] = rng.integers(0, 2**16, 24)
    near = (sig[:, None, :] == sig[None, :, :]).sum(axis=2) >= minhash.ESTIMATE
    links = [(i, j) for i in range(48) for j in range(i) if near[i, j]]
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "rep long, sig binary")
    for reach, block, hubs in ((32, 512, 32), (2, 8, 32)):
        for name, value in (("REACH", reach), ("BLOCK", block), ("HUBS", hubs)):
            monkeypatch.setattr(minhash, name, value)
        found = [tuple(r) for r in minhash._candidate_edges(reps, 48).collect()]
        assert all(near[a, b] for a, b in found) and components(range(48), found) == components(range(48), links)


def test_words_that_cancel_in_power_sums_stay_apart(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, f"x y {a} z u v"), (2, f"x y {b} z u v")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=4).collect()} == {1: 1, 2: 2}


def test_very_long_texts_are_linked(spark):
    rng = random.Random(2)
    long = words(400_000, rng)
    rows = [(1, " ".join(long)), (2, " ".join(mutated(long, 9_000, rng))), (3, " ".join(words(300_000, rng))), (4, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=4).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_of_nothing_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True)]


def vectors(rng):
    out = []
    for label in (0, 1, None):
        for _ in range(30):
            v = rng.normal(size=16)
            out.append((v, label))
            for s in (0.02, 0.08, 0.11):
                out.append((v + rng.normal(size=16) * s * np.linalg.norm(v) / 2, label))
        out.append((out[-1][0], label))  # an equal vector
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(out)]
    n = len(rows)
    return rows + [
        (n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0),
        (n + 5, [1.0] * 8, 0), (n + 6, [float("inf")] * 16, 1), (n + 7, [1e300] * 16, 1), (n + 8, [1.0] * 16, 1),
    ]


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_match_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(np.random.default_rng(3))
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = (x / np.linalg.norm(x), label)
    links = [
        (i, j) for i in good for j in good
        if i < j and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.93
    ]
    want = components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert len(links) > 50 and {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("d", [2, 32, 64, 300])
def test_error_bounds_rule_out_no_link(d):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, d))
    x[400:] = x[:400] + rng.normal(size=(400, d)) * np.linspace(0.05, 0.6, 400)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = embeddings.encode(x)
    maybe = embeddings.may_link(codes, codes, d, 0.93)
    linked = x @ x.T >= 0.93
    assert (linked & ~maybe).sum() == 0 and linked.sum() > 900 and (d < 32 or maybe.mean() < 0.1)


def test_estimates_have_no_bias():
    rng = np.random.default_rng(2)
    d = 48
    x = rng.normal(size=(300, d))
    x[150:] += 1.2 * x[:150]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = []
    for seed in range(30):
        q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
        r = x @ q
        c = np.sign(r) / np.sqrt(d)
        off.append((c[150:] * r[:150]).sum(axis=1) / (c[150:] * r[150:]).sum(axis=1) - (x[150:] * x[:150]).sum(axis=1))
    assert abs(np.mean(off)) < 0.003


def sql_links(rows):
    """The operator's SQL on rows(vec_id, embedding, label)."""
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label VARCHAR)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(c.execute(embeddings.OP2_SQL).fetchall(), key=str)


def test_repeated_ids_are_one_node(spark):
    rng = np.random.default_rng(4)
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (3, [0.0, 1.0], "c"), (4, [0.0, 1.0], "c"), (5, None, "a"), (5, [1.0, 0.01], "a")]
    rows += [(6, [0.3, 1.0], "c"), (7, [1.0, 0.0], "b"), (7, [0.0, 1.0], "c"), (8, [1.0, 0.02], "b")]
    base = rng.normal(size=(6, 8))
    rows += [(100 + int(rng.integers(40)), (base[int(rng.integers(6))] + rng.normal(size=8) * 0.2).tolist(), "mn"[int(rng.integers(2))]) for _ in range(120)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, n_links int, cls int")
    assert sorted(map(tuple, embeddings.near_vectors(df).collect()), key=str) == sql_links(rows)


def test_vectors_of_nothing(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        a = rng.choice(["a", "ab", "abcd", "\0ab"])
        t = ("".join(rng.choice(a) for _ in range(rng.randrange(30))) * rng.randrange(1, 3)).encode()
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute_passages(docs, window=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def passage_docs():
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["été", "the", "of", "noch", "ж", "zz"]) + str(rng.randrange(10**5)) for _ in range(n))
    shared = [text(20) for _ in range(4)]
    out = [text(rng.randrange(0, 60)) for _ in range(40)]
    out += [text(10) + rng.choice(shared) + text(10) for _ in range(40)]
    out += ["a" * 400, "ab" * 300, "a" * 99, "a" * 100, "", None, out[3], out[3], shared[0] * 3, shared[1][:100], "x" * 50 + shared[2][7:107]]
    return list(enumerate(out))


def test_passages_match_brute_force(spark):
    docs = passage_docs()
    want = brute_passages(docs)
    path = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, doc string")
    x = passages.repeats(path.drop("doc")).collect()
    got = {}
    for r in x:
        left, gone, n = passages._kept(r["__text"].encode(), r["__copy"], r["__spans"])
        got[r.doc_id] = (len(r["__text"].encode()), gone, n, hashlib.sha256(left).hexdigest())
    assert got == want
    out = passages.remove_repeats(path)
    assert out.columns == ["doc_id", "text", "doc"]
    assert all(r.doc == "clash" for r in out.collect()) and out.count() == len(docs)


def test_long_texts_are_read_in_overlapping_pieces(spark, monkeypatch):
    docs = passage_docs()
    monkeypatch.setattr(passages, "PIECE", 150)
    monkeypatch.setattr(passages, "SUFFIX_BYTES", 500)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: passages._kept(r["__text"].encode(), r["__copy"], r["__spans"])[1] for r in passages.repeats(df).collect()}
    assert got == {i: w[1] for i, w in brute_passages(docs).items()}


@pytest.mark.parametrize("crowd", [1, 3, 12])
def test_crowded_anchors_part_by_what_stands_beside(spark, monkeypatch, crowd):
    docs = passage_docs()
    monkeypatch.setattr(passages, "CROWD", crowd)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # anchors that run over several batches
    try:
        got = {r.doc_id: passages._kept(r["__text"].encode(), r["__copy"], r["__spans"])[1] for r in passages.repeats(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: w[1] for i, w in brute_passages(docs).items()}


def test_passages_of_nothing_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert passages.remove_repeats(empty).collect() == []
    df = spark.createDataFrame([(None, "q" * 150), (1, "q" * 150), (1, "r" * 150)], "doc_id long, text string")
    got = {(r.doc_id, len(r.text)) for r in passages.remove_repeats(df).collect()}
    # A run of one letter repeats within itself; the row without id comes last and goes as a whole.
    text = " ".join(str(k * k) for k in range(80))
    twice = spark.createDataFrame([(1, text), (1, text), (2, "x " + text), (2, "x " + text)], "doc_id long, text string")
    for parts in (1, 4):
        left = [r.text for r in passages.remove_repeats(twice.repartition(parts)).orderBy("doc_id").collect()]
        assert left == [text, text, "x ", "x "]
    assert (None, 0) in got and (1, 1) in got


def test_scramble_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix64(x))) == len(x)
