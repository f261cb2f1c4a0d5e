"""Tokens, chats, language model, rules, mixing, URLs and HTML: round trips, brute force, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import bpe, chat, hmm, html, mixing, rules, textops, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- bytes and words ------------------------------------------------------------------------------------------


def test_word_spans_and_hashes():
    texts = ["a  b\tcc", "", " \n", "é\x0bz", "cc"]
    data, off = textops.buffer(pa.array(texts, pa.large_string()))
    starts, ends, of_doc = textops.word_spans(data, off)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(of_doc, of_doc[1:])]
    assert got == [WORD.findall(t) for t in texts]
    h = textops.span_hashes(data, starts, ends)
    assert h[2] == h[-1] and len(set(h)) == len(h) - 1


# --- BPE ------------------------------------------------------------------------------------------------------


def encoder():
    import public_tokenizers as P
    import tiktoken

    c = bpe.Codec(bpe.default_path())
    return c, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def encode_all(c, texts):
    data, off = textops.buffer(pa.array(texts, pa.large_string()))
    return [x for i, j in textops.chunks(off, 500) for x in c.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])]


def test_bpe_equals_the_library():
    c, lib = encoder()
    rng = random.Random(5)
    bits = [" ", " ", "\n", "\t", "'", "'", "s", "t", "re", "ve", "ll", "d", "m", "A", "é", "1", "²", "!", "_", "\u00a0", "\u3000", "中", "😀", "\x1c", "\x85", "'s", "  ", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(20)) for _ in range(300)]
    texts += ["a" * 3000, "ab" * 2000, " " * 1000, "", "'", "\n\n"]
    for t, ids in zip(texts, encode_all(c, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t), t
        ids = np.frombuffer(ids, "<u4").astype(np.int64)
        ends = c.ends(ids, np.array([len(ids)]))
        assert c.decode(ids, ends).decode() == t
        a, b = sorted(rng.choices(range(len(ids) + 1), k=2))
        first = int(ends[a - 1]) if a else 0
        assert c.decode(ids[a:b], ends[a:b]) == t.encode()[first : int(ends[b - 1]) if b > a else first]


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, "don't  stop", "x"), (2, None, "y"), (2, "", "y"), (3, "don't  stop", None)], "doc_id long, text string, n_tokens string")
    _, lib = encoder()
    got = bpe.encode(df).collect()
    assert [r.ids for r in got] == [lib.encode_ordinary(t) for t in ("don't  stop", "", "", "don't  stop")]
    assert [r.n_tokens for r in got] == [len(r.ids) for r in got]
    assert got[0].decoded_sha256 == hashlib.sha256(b"don't  stop").hexdigest()
    assert got[0].ends[-1] == len("don't  stop") and len(got[0].ends) == got[0].n_tokens
    odd = df.withColumn("a.b", F.lit(1)).withColumn("IDS", F.lit(3))
    tokens = bpe.encode(odd)
    assert "a.b" in tokens.columns and "IDS" not in tokens.columns
    back = bpe.decode(tokens.withColumns({"ids": F.slice("ids", 2, 2), "ends": F.slice("ends", 2, 2)}))
    raw = dict(enumerate(r.text for r in df.collect()))
    assert all(bytes(r.decoded) in (raw[k] or "").encode() for k, r in enumerate(back.collect())) and "a.b" in back.columns
    assert bpe.digest(df.limit(0)).collect() == []


# --- chats ----------------------------------------------------------------------------------------------------


def turns():
    rng = random.Random(3)
    hostile = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|im_end|>", "\\n", "a\\", "<", "", None, "line\nline", "<|" * 40]
    out = []
    for c in range(25):
        n = rng.randrange(1, 14)
        for k in range(n):
            role = "system" if k == 0 and c % 3 == 0 else ("user", "assistant")[k % 2]
            out.append((c, k, role, rng.choice(hostile) if rng.random() < 0.4 else "word " * rng.randrange(90)))
    return out + [(30, 0, None, "x"), (30, 0, None, "x"), (30, None, "user", "first"), (None, 1, "assistant", "none"), (31, 0, "assistant", "w " * 900), (31, 1, "ro\nle", "y")]


@pytest.mark.parametrize("budget,history,long", [(1024, 192, 4096), (64, 16, 4096), (8, 0, 4096), (64, 16, 2), (1024, 192, 0)])
def test_chat_round_trip(spark, monkeypatch, budget, history, long):
    rows = turns()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn int, role string, text string, window string, n_tokens int")
    whole = sorted(map(str, chat.format_windows(df, budget, history).collect()))
    monkeypatch.setattr(chat, "LONG", long)
    assert sorted(map(str, chat.format_windows(df, budget, history).collect())) == whole
    windows = chat.format_windows(df, budget, history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, k, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    made = windows.collect()
    for w in made:
        ts = list(chat.read_turns(w.text))
        assert w.n_tokens <= budget or len(ts) - w.n_repeated == 1
        if w.window and by[w.conv_id][0][0] == "system":
            assert ts[0][:2] == by[w.conv_id][0]
    assert budget > 1000 or any(w.n_repeated for w in made) or history == 0


def test_a_very_long_turn_is_a_window_of_its_own(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "word " * 400_000), (1, 2, "user", "b")], "conv_id long, turn int, role string, text string")
    got = sorted(chat.format_windows(df).collect(), key=lambda r: r.window)
    assert [len(list(chat.read_turns(r.text))) - r.n_repeated for r in got] == [1, 1, 1] and chat.read_back(chat.format_windows(df)).first().n_turns == 3


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.format_windows(df)).collect() == []


# --- language model -------------------------------------------------------------------------------------------


def test_forward_is_exact_and_training_adds_up():
    rng = np.random.default_rng(0)
    emit = rng.dirichlet(np.ones(6), hmm.STATES).T.astype(np.float32)
    step = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    start = rng.dirichlet(np.ones(hmm.STATES))
    model = hmm.Model(start, step, emit)
    texts = [rng.integers(0, 6, n) for n in (1, 3, 17, 4)]
    want = []
    for t in texts:
        a = start * emit[t[0]]
        for s in t[1:]:
            a = (a @ step) * emit[s]
        want.append(math.log10(a.sum()))
    assert np.allclose(hmm.log_likelihoods(model, texts), want, atol=1e-4)


def dense_counts(model, texts):
    """Expected counts and log-likelihood, text by text and token by token."""
    starts, steps = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES))
    emit, likelihood, e = np.zeros(model.emit.shape), 0.0, model.emit.astype(float)
    for x in texts:
        n = len(x)
        alpha, c, beta = np.zeros((n, hmm.STATES)), np.zeros(n), np.ones((n, hmm.STATES))
        for t in range(n):
            v = (alpha[t - 1] @ model.step if t else model.start) * e[x[t]]
            c[t] = v.sum()
            alpha[t] = v / c[t]
        for t in range(n - 2, -1, -1):
            beta[t] = model.step @ (e[x[t + 1]] * beta[t + 1]) / c[t + 1]
        gamma = alpha * beta
        starts += gamma[0]
        likelihood += np.log(c).sum()
        np.add.at(emit, x, gamma)
        for t in range(1, n):
            steps += model.step * np.outer(alpha[t - 1], e[x[t]] * beta[t]) / c[t]
    return starts, steps, emit, likelihood


@pytest.mark.parametrize("segment, slab", [(512, 1024), (5, 3), (1, 2)])
def test_baum_welch_matches_a_dense_one_and_never_gets_worse(monkeypatch, segment, slab):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "SLAB", slab)
    rng = np.random.default_rng(1)
    emit = np.zeros((hmm.OWN + hmm.RARE, hmm.STATES), np.float32)
    emit[:12] = rng.dirichlet(np.ones(12), hmm.STATES).T
    model = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit)
    texts = [np.repeat(rng.integers(0, 12, n), rng.integers(1, 4, n)) for n in (1, 3, 17, 40, 2, 9, 25)]
    last = -np.inf
    for _ in range(8):
        got, want = hmm.expected_counts(model, texts), dense_counts(model, texts)
        assert all(np.allclose(x, y, atol=2e-3) for x, y in zip(got, want))
        assert got[3][0] > last - 1e-3  # without smoothing a round never lowers the likelihood
        last = got[3][0]
        model = hmm.improved(*got[:3], smoothing=1e-12)


def test_scores_are_those_of_the_dense_model(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh"[i % 2 :: 2]) * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30))), i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, held_out boolean, row string, score double")
    counts = hmm.count_tokens(df.where("not held_out"), "text")
    vocab = hmm.vocabulary(counts)
    hashed = lambda t: hmm.tokens(*textops.buffer(pa.array([t], pa.large_string())))[0]
    symbols = {r[0]: vocab.look_up(hashed(r[1]))[0] for r in rows}
    model = hmm.first_model(vocab)
    for _ in range(3):
        model = hmm.improved(*dense_counts(model, [symbols[i] for i, _, held in rows if not held])[:3])
    n = dict(zip(vocab.token.tolist(), vocab.n.tolist()))
    got = {r.doc_id: r.score for r in hmm.score(df, rounds=3).collect()}
    for i, t, _ in rows:
        want = dense_counts(model, [symbols[i]])[3] / math.log(10)
        for h, s in zip(hashed(t).tolist(), symbols[i].tolist()):
            if s >= hmm.OWN:  # a shared symbol's token, by its count
                want += math.log10(n.get(h, 0) + 1) - vocab.rare_total[s - hmm.OWN]
        assert got[i] == pytest.approx(want, abs=2e-3), i


def test_rounds_end_when_the_likelihood_stands_still(spark):
    df = spark.createDataFrame([(i, "a b c d " * 5, False) for i in range(20)], "doc_id long, text string, held_out boolean")
    vocab = hmm.vocabulary(hmm.count_tokens(df, "text"))
    seq = hmm.sequences(df, "text", vocab).cache()
    _, history = hmm.train(seq, hmm.first_model(vocab), rounds=30, tolerance=1e-3)
    assert 2 <= len(history) < 30 and history[-1] > history[0]


def test_a_very_long_text_is_scored_whole(spark):
    rows = [(1, " ".join(f"w{k % 50}" for k in range(300_000)), False), (2, "x" * 2_000_000, False), (3, "w1 w2", True)]
    got = {r.doc_id: r for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), rounds=1).collect()}
    assert got[1].n_tokens == 300_001 and got[2].n_tokens == 2 and got[3].n_known == 3 and got[1].score < 0


def test_most_frequent_is_bounded(spark):
    counts = spark.range(1, 200).selectExpr("id AS token", "id * id AS n")
    for most in (0, 1, 50, 198, 199, 1000):
        got = sorted(r.n for r in hmm.most_frequent(counts, most).collect())
        bins = lambda ns: Counter(math.floor(16 * math.log2(n)) for n in ns)
        mine, every = bins(got), bins(k * k for k in range(1, 200))
        assert min(most, 199) - 1 <= len(got) <= most and all(mine[b] == every[b] for b in every if b > min(mine, default=10**9))
    assert hmm.most_frequent(counts, 1000).count() == 199


def test_scores(spark):
    rng = random.Random(2)
    vocab = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    rows = [(i, " ".join(rng.choice(vocab[i % 2]) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "never seen words"), (0, "A1 A1"), (None, "a1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    got = hmm.score(df).collect()
    token = lambda t: WORD.findall((t or "").lower()) + ["\0end"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in token(t))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter(
        (i, held(i), len(token(t)), sum(w in counts for w in token(t)), round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in token(t)), 6))
        for i, t in rows
    )
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    out = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # on texts it never saw
    assert hmm.score(df.limit(0)).collect() == []


# --- rules ----------------------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    ls = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    cover = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text), len(ls) - len(set(ls)), len(cover))


def rule_texts():
    rng = random.Random(6)
    out = ["", None, " \n\x0b ", "one", "a b c d e a b c d e", "x " * 30, "a\na\n\nb\n b", "é😀 # % <\u00a0>", "\n\n"]
    return out + [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)] + ["line of words here\n" * 5]


def test_rules_match_brute_force(spark):
    texts = rule_texts()
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "x", 7)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.ledger(df).collect()}
    for i, t in enumerate(texts):
        m = brute_measures(t)
        assert tuple(got[i][k] for k in rules.MEASURES) == m, t
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        assert bool(got[i].fail_bits & rules.mask("base")) == failed
    kept = rules.quality_filter(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.fail_bits & rules.mask("v1")}
    n = {r.rule: r for r in rules.ablation(rules.ledger(df), "v1").collect()}
    bits = [r.fail_bits for r in got.values()]
    for name, b in rules.BITS.items():
        assert n[name].n_failed == sum(bool(x & b) for x in bits)
        assert n[name].n_failed_alone == sum(x == b for x in bits)
        assert n[name].n_kept_without == sum(x & ~b == 0 for x in bits)
    assert rules.ledger(df.limit(0)).collect() == []


# --- mixing ---------------------------------------------------------------------------------------------------


def filled_up():
    sizes = [("a", 100), ("b", 5), ("c", 700), (None, 60)]
    weights, total = [3, 1, 2, 3], 1.5 * 865
    capped: set = set()
    while True:
        free = [k for k in range(4) if k not in capped]
        left = total - sum(2 * sizes[k][1] for k in capped)
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 2 * sizes[k][1]}
        if not over:
            break
        capped |= over
    want = {sizes[k][0]: (2.0 * sizes[k][1] if k in capped else share[k]) for k in range(4)}
    return sizes, want


def test_mix(spark, monkeypatch):
    sizes, want = filled_up()
    s = spark.createDataFrame([(a, n, 1) for a, n in sizes], "source string, source_size long, n_units long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    monkeypatch.setattr(mixing, "FAN", 8)  # three levels of the tree
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", None]), "w " * rng.randrange(30)) for i in range(700)]
    rows += [(700, "a", None), (701, "a", ""), (None, "b", "x y"), (None, "b", "z"), (5, "b", "dup"), (5, "b", "dup")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, taken int")
    p = mixing.plan(df).collect()
    assert len(p) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in p) == sorted((i or -1, len(WORD.findall(t or ""))) for i, _, t in rows)
    for src in ("a", "b", "é", None):
        mine = [r for r in p if r.source == src]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    again = mixing.plan(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, p))
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in p)
    assert mixing.plan(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []


# --- URLs -----------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        ("http://WWW.Example.NET/en/x?y#z", "www.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/fr", "example.net", "/fr", "net/", "block"),
        ("https://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("a://example.com/de/1#q", "example.com", "/de/1", "example.com/de/", "block"),
        ("a://m.x.org/fr/", "m.x.org", "/fr/", "org/fr/", "allow"),
        ("a://net", "net", "", None, "allow"),
        ("a://x.net?q=/en/", "x.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b.com/x://c.org/fr/", "b.com", "/x://c.org/fr/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(0, 1, 0), (0, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judge(pages.drop("host"), labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(rows))] == [r[1:] for r in rows]
    assert urls.judge(pages.limit(0).drop("host"), labels).collect() == []


def test_reputation_shrinks_and_blocks(spark):
    rows = []
    for h in range(40):
        bad = h % 8 == 0
        rows += [(f"h{h}.d{h % 5}.com", int((bad and k % 20 != 0) or k % 20 == 19)) for k in range(60)]
    rows += [("new.d1.com", None), ("h1.once.com", 1)]
    r = {x.host: x for x in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    limit = urls.RATIO * r["h0.d0.com"].rate
    assert all((r[f"h{h}.d{h % 5}.com"].lower_bound > limit) == (h % 8 == 0) for h in range(40))
    assert r["new.d1.com"].posterior == pytest.approx(r["new.d1.com"].prior)
    assert r["h1.once.com"].prior < r["h1.once.com"].posterior < 0.9 and r["h1.once.com"].lower_bound < limit


def test_bad_hosts_are_blocked_through_their_pages(spark, tmp_path):
    rng = random.Random(6)
    pages, labels = [], []
    for i in range(1500):
        h = i % 30
        host = f"user@h{h}.site{h % 6}.co.uk:8080" if h % 2 else f"H{h}.site{h % 6}.blogs.example."
        pages += [(i, f"http://{host}/p{i}", "clash", 1.0), *([(i, f"http://{host}/p{i}", "clash", 1.0)] if i % 100 == 0 else [])]
        labels.append((i, int(rng.random() > (0.9 if h in (3, 8) else 0.1)), 0))
    pages.append((9999, "x://h3.site3.co.uk/" + "long" * 300_000, None, None))
    pages = spark.createDataFrame(pages, "page_id long, url string, host string, rate double")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge(pages, labels).collect()
    assert len(got) == 1516 and len({r.verdict for r in got if r.page_id == 9999}) == 1
    for r in got:
        if r.page_id != 9999:
            assert r.verdict == ("block" if r.page_id % 30 in (3, 8) else "allow"), r
    (tmp_path / "suffixes").write_text("// a comment\nexample\n*.ck\nblogs.example // more\nco.uk\nuk\n")
    hosts = spark.createDataFrame([("a.b.blogs.example",), ("me@x.y.co.uk:80",), ("co.uk",), ("other",), ("",)], "host string")
    want = {"a.b.blogs.example": ("blogs.example", "b.blogs.example"), "me@x.y.co.uk:80": ("co.uk", "y.co.uk"), "co.uk": ("co.uk", "co.uk"), "other": ("other", "other"), "": ("", "")}
    levels = urls.with_levels(hosts, urls.read_suffixes(spark, str(tmp_path / "suffixes"))).collect()
    assert {r.host: (r.suffix, r.domain) for r in levels} == want


# --- HTML -----------------------------------------------------------------------------------------------------


def test_min_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep: sum(max(0, x) if not k else max(0, -x) for x, k in zip(odds, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html.min_cut(odds, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body><header><p>Site name of the page here.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is cheap today.</div>
<div id="cookie-notice">We use cookies on this site to track you.</div><article><h1>A &lt;title&gt; &amp; more</h1><p><b>Bold start.<br><p>Second
 paragraph&nbsp;with   space &eacute;.</p><ul><li>one<li>two</ul><aside>See also other things.</aside><form>Search <input name=q></form>
<p>Short.</p><div class="comments"><p>I liked this article very much, thanks.</p></div></article><footer>&copy; me</footer>"""


def test_main_text():
    want = "A <title> & more\nBold start.\nSecond paragraph with space é.\none\ntwo\nShort."
    assert html.main_text(PAGE) == want
    assert html.main_text("") == "" and html.main_text("<nav><a href=x>y</a></nav>") == ""
    assert html.main_text("<article><p>Cut off in a tag <a hre") == "Cut off in a tag"
    assert html.main_text("<article><p>x < y and a > b.</p></article>") == "x < y and a > b."


def test_class_names_are_weak_evidence_and_scans_are_linear():
    words = "A long paragraph with many words. " * 5
    page = f'<article class="post"><section class="search results about comments"><p>{words}</section><div class="kommentare"><p>Das mag ich sehr, danke.</div></article>'
    assert html.main_text(page) == words.strip()
    assert html.main_text('<article><div class="x"/><p>In a box.</p></article>') == "In a box."
    assert html.main_text("<article><svg><path/></svg><p>After it.") == "After it."
    for odd in ("<a " * 300_000, "<a \"='" * 200_000, "<!-- " * 200_000, "</p" * 300_000, "<a x='>" * 100_000, "<script>" * 100_000):
        assert html.main_text(odd) == ""
    many = "<article>" + "".join(f"<p>Block {i} of the text.</p><div class=ad>Buy {i} now</div>" for i in range(20_000))
    assert html.main_text(many) == "\n".join(f"Block {i} of the text." for i in range(20_000))
    deep = "<div>" * 50_000 + "<article><p>Deep down.</p></article>"
    assert html.main_text(deep) == "Deep down."


LONG = "This is a paragraph of the text, with some words in it. " * 3
LOST = {
    "a head without its end": f"<html><head><title>t</title><meta x><body><article><h1>Head</h1><p>{LONG}</article>",
    "text after a head": f"<head><title>t</title>{LONG}",
    "one form around all": f"<body><form action=x><div class=nav><a href=y>Home</a></div><main><h1>Head</h1><p>{LONG}</p></main></form></body>",
    "one form, no main": f"<body><form><div><p>{LONG}</p><p>{LONG}</p></div><input></form></body>",
    "names of the body": f'<body class="has-sidebar sidebar"><article><h1>Head</h1><p>{LONG}</p></article></body>',
    "names that deny": f'<body class=x><div class="no-ads"><article><p>{LONG}</p></article></div></body>',
    "a wrapper with a bad name": f'<div id="sidebar"><div class="comments"><article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article></div></div>',
    "a header of the article": f"<header><p>Site name here.</p></header><article><header><h1>Head</h1></header><p>{LONG}</p></article>",
}
REPLIES = {
    "nested articles": "<article><p>Ann wrote</p><p>I liked this very much, thanks a lot.</p></article>" * 3,
    "a neutral list": "<div class=thread>" + "<div class=entry-x><span>Ann, 3 May</span><p>I liked this very much, thanks a lot.</p></div>" * 4 + "</div>",
    "responses": "<section class=responses><ol>" + "<li><div>Bob</div><p>No, it is wrong, as I said before, it is.</p></li>" * 3 + "</ol></section>",
}


@pytest.mark.parametrize("name", list(LOST))
def test_pages_that_were_lost(spark, name):
    df = spark.createDataFrame([(1, LOST[name])], "page_id long, html string")
    text = html.extract(df, weights=html.PRIOR).first().text
    assert LONG.strip() in text and ("Head" in text) == ("<h1>" in LOST[name]) and "Home" not in text and "Site name" not in text


@pytest.mark.parametrize("name", list(REPLIES))
def test_readers_comments_without_a_telling_name(spark, name):
    page = f"<body><article><h1>Head</h1><p>{LONG}</p><h2>Part</h2><ul><li>one point of it<li>two</ul><p>{LONG}</p>{REPLIES[name]}</article></body>"
    text = html.extract(spark.createDataFrame([(1, page)], "page_id long, html string"), weights=html.PRIOR).first().text
    assert text == f"Head\n{LONG.strip()}\nPart\none point of it\ntwo\n{LONG.strip()}"


def test_a_real_form_goes():
    assert html.main_text(f"<article><p>{LONG}</p><form><p>Your name and your address, please.</p><input></form></article>") == LONG.strip()


def reference_main_text(page, weights):
    """The extraction by trying all labellings, on what a plain parser sees: for pages of few blocks without odd markup."""
    from html.parser import HTMLParser

    found = []

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.n, self.new = [], 0, True

        def handle_starttag(self, tag, attrs):
            if tag in ("a", "b"):
                self.link = tag == "a"
                return
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role")).split()
            odds = [max((html.TELLING.get(w, 0.0) for w in re.findall("[a-z]+", x)), key=abs, default=0.0) for x in names]
            self.stack.append((tag, self.n, sum(odds) / len(odds) if odds else 0.0))
            self.n, self.new = self.n + 1, True

        def handle_endtag(self, tag):
            if tag not in ("a", "b"):
                self.stack.pop()
                self.new = True

        def handle_data(self, data):
            if data.strip() and not {"script", "style", "form", "head"} & {x[0] for x in self.stack}:
                if self.new:
                    found.append((list(self.stack), []))
                self.new = False
                found[-1][1].append((data, self.lasttag == "a" and "</a>" not in data))
            elif not self.new:
                found[-1][1].append((data, False))

    Reader().feed(page)
    odds, texts = [], []
    for stack, parts in found:
        text = " ".join("".join(p for p, _ in parts).split())
        x = dict.fromkeys(html.FEATURES, 0.0)
        x |= {"bias": 1.0, "length": min(4.0, len(text) / 60), "sentence": float(text[-1] in ".!?…。:"), "digits": sum(c.isdigit() for c in text) / len(text)}
        x[{"p": "paragraph", "h1": "heading", "li": "item"}.get(stack[-1][0], "other")] = 1.0
        odds.append(sum({t: html.ELEMENTS.get(t, 0.0) for t, _, _ in stack}.values()) + sum(s[2] for s in stack) + sum(w * x[f] for w, f in zip(weights, html.FEATURES)))
        odds[-1] = round(html.GRAIN * odds[-1]) / html.GRAIN
        texts.append(text)
    edges, ids = [], [[s[1] for s in stack] for stack, _ in found]
    for j in range(1, len(found)):
        a, b = ids[j - 1], ids[j]
        same = sum(x == y for x, y in zip(a, b))
        edges.append((j - 1, j, 2 * html.SMOOTH / max(1, len(a) + len(b) - 2 * same)))
        before = [i for i in range(j) if ids[i][-2:-1] == b[-2:-1]]
        if before and before[-1] < j - 1:
            edges.append((before[-1], j, html.SMOOTH))
    unit = lambda v: round(v * html.UNIT)
    cost = lambda keep: sum(unit(max(0, x)) if not k else unit(max(0, -x)) for x, k in zip(odds, keep)) + sum(unit(c) for i, j, c in edges if keep[i] != keep[j])
    best = min(([bool(m >> k & 1) for k in range(len(odds))] for m in range(1 << len(odds))), key=lambda k: (cost(k), sum(k)))
    return "\n".join(t for t, k in zip(texts, best) if k)


def test_extraction_matches_all_labellings():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "7", "dolor"]) for _ in range(n))
    for _ in range(120):
        out = []
        for _ in range(rng.randrange(1, 8)):
            kind = rng.randrange(6)
            if kind == 0:
                out.append(f"<nav><li>{say(2)}</li></nav>")
            elif kind == 1:
                out.append(f'<div class="{rng.choice(["ad", "box", "comments list", "content"])}"><p>{say(rng.randrange(1, 30))}.</p></div>')
            elif kind == 2:
                out.append(f"<footer>{say(5)}</footer>")
            elif kind == 3:
                out.append(f"<h1>{say(3)}</h1>")
            else:
                out.append(f"<p>{say(rng.randrange(1, 40))}{rng.choice(['.', ''])}</p>")
        page = f"<html><body><{rng.choice(['article', 'div'])} id=x>" + "".join(out)
        page += f"</{re.search('<(article|div) id=x', page)[1]}></body></html>"
        assert html.main_text(page) == reference_main_text(page, html.PRIOR), page


def test_fitted_weights_follow_the_labelled_blocks(spark):
    rows = [(i, f"<nav><p>{'menu ' * 12}.</p></nav><article><li>point {i}</li><h1>x y</h1></article>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    w = dict(zip(html.FEATURES, html.fit(df)))
    assert w["paragraph"] < 0.5 and w["item"] > 0 and html.fit(df) == html.fit(df.repartition(3))
    assert html.fit(df.limit(0)) == html.PRIOR and html.fit(df.selectExpr("page_id", "'<p>x</p>' AS html")) == html.PRIOR


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    df = df.withColumn("a.b", F.lit(1)).withColumn("N_chars", F.lit(2))
    got = html.extract(df, weights=html.PRIOR).collect()
    assert html.extract(df).columns == ["page_id", "url", "a.b", "text", "n_chars"]
    assert [(r.page_id, r.url, r.n_chars, len(r.text)) for r in got] == [(1, "u", len(html.main_text(PAGE)), len(html.main_text(PAGE))), (2, None, 0, 0), (2, None, 0, 0)]
    assert html.extract(df.limit(0)).collect() == []
