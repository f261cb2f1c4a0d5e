"""The trie of conversations against one made of dictionaries, with pieces and ranges of few rows."""

import hashlib
import random
import zlib

import pytest

from logloom.llm import trie

EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt_by_hand(rows):
    text = {}
    for c, turn, role, body in rows:
        if c is not None:
            body = body or ""
            text.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.sha256(body.encode()).hexdigest(), body))
    text = {c: [(r, b) for _, r, _, b in sorted(v)] for c, v in text.items()}
    out = {}
    for c, own in text.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = text.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(k))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), leaves[k], saved[k], digest))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth int, tok string"


def made(rng, n, words, most):
    """Conversations with shared beginnings, whole copies, and ends inside others."""
    rows, seen = [], []
    for c in rng.sample(range(4 * n), n):
        if seen and rng.random() < 0.6:
            base = rng.choice(seen)
            turns = base[: rng.randrange(len(base) + 1)] if rng.random() < 0.7 else list(base)
        else:
            turns = []
        while len(turns) < most and rng.random() < 0.75:
            turns = [*turns, (rng.choice(["user", "assistant"]), rng.choice(words))]
        seen.append(turns)
        rows += [(c, i, r, t, 7, "x") for i, (r, t) in enumerate(turns)] or [(c, 0, "user", "only", 7, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,piece,size,fan", [(1, 3, 7, 2), (2, 64, 10_000, 256), (3, 2, 3, 3), (4, 4, 25, 2)])
def test_equals_dictionaries(spark, monkeypatch, seed, piece, size, fan):
    monkeypatch.setattr(trie, "RANGE", size)
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "SLOT", 2 if piece < 4 else 4096)
    rng = random.Random(seed)
    rows = made(rng, 70, ["a", "bé", "", "cc c"], 14)
    got = trie.trie(*trie.rebuilt(trie.ordered(spark.createDataFrame(rows, SCHEMA))), piece=piece).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rebuilt_by_hand([r[:4] for r in rows]))


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "x"), (0, None, "system", "s"), (0, 1, "user", "x"), (0, 1, None, None), (1, 0, "user", "hi"), (7, 0, "user", "no base"), (7, 1, "user", "b"),
        (None, 0, "user", "lost"), (10, 0, "u", "long " * 300_000), (11, 0, "u", "long " * 300_000), (12, 0, "u", ""), (12, 1, "", ""),
    ]
    got = trie.trie(*trie.rebuilt(trie.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rebuilt_by_hand(rows))


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE", 50)
    long = [(3, i, "user", f"t{i}") for i in range(3000)]
    rows = long + [(8, i, "user", f"t{i}") for i in range(2900)] + [(c, i, "user", "same") for c in range(100, 400) for i in range(3)]
    x = trie.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r, t))
    assert sorted((tuple(r) for r in trie.trie(*trie.whole(x)).collect()), key=str) == brute(want)
    got = sorted((tuple(r) for r in trie.trie(*trie.rebuilt(x)).collect()), key=str)
    assert got == brute(rebuilt_by_hand(rows))


def test_no_conversation(spark):
    x = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(*trie.rebuilt(trie.ordered(x))).collect() == []
