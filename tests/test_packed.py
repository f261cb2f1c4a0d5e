"""Findings of round 3: session files in parts, and corpora that lie packed."""

import pytest

import __spark_entry__
from logloom.shared import scratch_dir
from tests.test_findings import same_as_sql


def _made(spark, kind):
    """Data files that queries have written so far, below folders of one kind."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/logloom")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return set()
    walk, out = fs.listFiles(base, True), set()
    while walk.hasNext():
        p = walk.next().getPath().toString()
        if f"/{kind}-" in p and p.endswith(".txt"):
            out.add(p)
    return out


def test_session_parts_are_one_session(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('line ', id, ' é') AS text", "element_at(array('en', 'de', 'fr'), CAST(id % 3 + 1 AS INT)) AS lang").repartition(6)
    before = _made(spark, "sessions")
    assert same_as_sql(spark, tmp_path, "session_listing", documents=docs)
    assert len(_made(spark, "sessions") - before) > 0
    docs.write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        before = _made(spark, "sessions")
        rows = __spark_entry__.queries()["session_listing"](spark, f"{tmp_path}/more").collect()
        made = _made(spark, "sessions") - before
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.files for r in rows] == [1, 1, 1] and len(made) > 6  # a language is written by several tasks


@pytest.mark.parametrize("name", ["session_tokens_by_model", "session_summaries"])
def test_sessions_lie_packed(spark, tmp_path, name):
    turns = spark.range(600).selectExpr("CAST(id / 3 AS BIGINT) AS conv_id", "CAST(id % 3 + id % 2 * 2 AS INT) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('é\\t', id) AS text")
    before = _made(spark, "records")
    assert same_as_sql(spark, tmp_path, name, conversations=turns)
    assert 0 < len(_made(spark, "records") - before) < 50  # for 200 sessions
