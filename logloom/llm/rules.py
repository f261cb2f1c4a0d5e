"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per text. The ledger stores the measurements and one
integer whose bit k says that rule k failed; a policy is a version with a mask of the
rules that it applies. Changing a policy, or asking what one rule costs, reads the
ledger alone and never the texts again.

Defined results: a null or empty text has no words (all measurements 0) and fails
`few_words`; repeated rows are judged alike, each once; an empty table gives an empty
ledger; an input column whose name is one of the ledger's is replaced; a null doc_id is kept.
Windows are compared through 64-bit hashes of their words inside one text, so two
different windows of one text meet with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.columns import SPACES, text_or_empty, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules in bit order: never renumber, only append. Each is a test over the measurements.
RULES = {
    "few_words": lambda c: c("n_words") < 10,
    "repeated_words": lambda c: 100 * c("n_repeat_words") > 20 * c("n_words"),
    "symbols": lambda c: 10 * c("n_symbols") > c("n_words"),
    "repeated_lines": lambda c: 2 * c("n_dup_lines") > c("n_lines"),
    "short_words": lambda c: c("word_chars") < 2 * c("n_words"),
    "long_words": lambda c: c("word_chars") > 14 * c("n_words"),
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}

#: Policies by version: which rules reject a text.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words from __words: equal windows come together by sorting (hash, position), only in texts that have any."""
    n = F.size("__words")
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    docs = docs.withColumn("__h", hashes)
    pairs = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    docs = docs.withColumn(
        "__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(pairs)).otherwise(empty)
    ).drop("__h", "__words")
    s = F.col("__s")
    met = F.filter(
        F.transform(
            s,
            lambda x, k: F.when(
                F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
                x["i"],
            ),
        ),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(-WINDOW).alias("prev"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        F.sort_array(met),
        start,
        lambda a, p: F.struct(
            p.alias("prev"), (a["total"] + F.least(F.lit(WINDOW), p - a["prev"]).cast("long")).alias("total")
        ),
        lambda a: a["total"],
    )
    return docs.withColumn("n_repeat_words", covered).drop("__s")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements in place of their text."""
    docs = docs.withColumn("__text", text_or_empty(text)).drop(*MEASURES, "n_lines", "fail_bits", text)
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    docs = docs.withColumns(
        {
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "__lines": lines,
            "__words": words(t),
        }
    ).drop("__text")
    docs = docs.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    ).drop("__lines")
    return _repeat_words(docs)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their text, with the measurements and fail_bits."""
    out = measure(docs, text)
    bits: Column = F.lit(0).cast("long")
    for name, test in RULES.items():
        bits = bits.bitwiseOR(F.when(test(F.col), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: texts that fail it, that fail it alone, and that would be kept without it.

    Rows are first counted by fail_bits (at most 2^rules groups), so what follows is tiny at any size.
    """
    m = mask(policy)
    seen = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]]
    )
    x = seen.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    kept = F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0
    return x.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or(F.when(hit, F.col("bits")).otherwise(0)).alias("failed_with_bits"),
    )


def quality_filter(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns.

    The bits pass through a one-row inline(): the optimizer would else push the filter below the measurements, with the
    expressions it is made of written out again at each use.
    """
    own = docs.columns
    led = ledger(docs.withColumn("__whole", F.struct(*[F.col(c) for c in own])), text)
    once = led.select("__whole", F.inline(F.array(F.struct(F.col("fail_bits").alias("__bits")))))
    return once.where(passes(policy, "__bits")).select("__whole.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = ledger(docs)
    return led.select(
        "doc_id",
        *MEASURES,
        (~passes("base")).alias("base_failed"),
        passes("v1").alias("kept"),
        "fail_bits",
    )


_SQL_MEASURES = r"""
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM src),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(0, 5) r(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
led AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 14 * n_words)::INT AS BIGINT) AS fail_bits
  FROM m)"""

OP5_SQL = (
    "WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + _SQL_MEASURES
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM led"""
)
