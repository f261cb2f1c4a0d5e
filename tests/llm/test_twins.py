"""The operators' queries that SQL can express, against DuckDB on the smallest tables; and long texts through the others."""

import glob
import os
import random

import duckdb
import pytest

from logloom.llm import bpe, entry, rules

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.QUERIES[name](spark, DATA)
    cur = c.execute(entry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r) for r in df.select(names).collect()), key=str)
    if name != "op3_url_reputation":
        assert got == want
    for x, y in zip(got, want):  # its posteriors are sums of floats in another order
        assert all(a == b or isinstance(a, float) and abs(a - b) < 2e-6 for a, b in zip(x, y)), (x, y)


def test_very_long_texts_keep_their_measures(spark):
    rng = random.Random(1)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    text = " ".join(ws) + "\n" + "x" * 1_000_000 + "\nsame line\nsame line"
    r = rules.ledger(spark.createDataFrame([(1, text, 7, "clash")], "doc_id long, text string, n_words int, fail_bits string")).first()
    assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (300_005, 1, 0) and r.word_chars == sum(map(len, ws)) + 1_000_000 + 16


def test_texts_above_one_pass_are_encoded_whole(spark):
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(2)
    long = " ".join(rng.choice(["été", "don't", "1234", "naïve", "zz", "\n\n"]) + str(rng.randrange(999)) for _ in range(400_000))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Codec(bpe.default_path()).ranks, special_tokens={})
    df = spark.createDataFrame([(1, long), (2, "short"), (3, "y" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df).collect()}
    assert len(long.encode()) > 3_000_000 and got[1].ids == lib.encode_ordinary(long) and got[1].ends[-1] == len(long.encode())
    assert got[3].ends[-1] == 100_000
