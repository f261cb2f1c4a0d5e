"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A source's target words over its size give each of its documents the same expected number
of copies. The whole part is taken at once; the fraction becomes mass (fraction x size).
Documents are dealt into small blocks by a hash of their id; inside a block they are paired
one after another, and mass moves between the two, in a random direction with odds that keep
both expectations, until one of them is integral. Total mass never changes, so a block ends
with every document decided but one. The undecided rest of 128 blocks forms a block of the next
level, and so on up a reduction tree to one document for each source: a source's taken words
differ from its target by at most half of one document's size (that document is rounded to the nearest), and no document exceeds twice its size.

Defined results: a null text has size 0 and is taken as 0 words; a null source is a source of its own,
ordered last; rows that share source and doc_id (nulls included) are one unit and get the same copies; an empty
table gives an empty result; clashing column names are replaced. All randomness is a hash of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.columns import text_or_empty, word_count
from logloom.shared import cut, running, sized

#: Documents of a leaf block, and residuals of a block of any later level.
FAN = 128
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = 20240229

_UNIT = "struct<doc_id:bigint,size:double,mass:double>"
_STATE = f"struct<c:{_UNIT},out:array<struct<doc_id:bigint,taken:int>>>"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """sources(source, source_size, ...) with target: water filling over the sources' caps.

    In order of cap / weight the capped sources come first, so running sums find the level at once. Sources may be as many as rows: both orders
    are sorted in ranges.
    """
    total, _ = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.lit(0)).first()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__position") - 1) % len(weights) + 1).cast("int"))
    x = running(sources, [F.col("source").asc_nulls_last()], "mix-ranks").withColumn("__w", w).drop("__position")
    x = x.withColumn("__cap", F.lit(float(most)) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    all_w = x.agg(F.coalesce(F.sum("__w"), F.lit(0.0))).first()[0]
    x = running(x, [F.col("__ratio"), F.col("source").asc_nulls_last()], "mix-caps", __caps="__cap", __used="__w")
    level = (F.lit(float(share) * total) - F.col("__caps")) / (F.lit(all_w) - F.col("__used"))
    x = cut(x.withColumn("__level", level).withColumn("__capped", F.col("__level") >= F.col("__ratio")), "mix-levels")
    found = x.where("not __capped").agg(F.max("__level")).first()[0]
    free = F.least(F.lit(found) * F.col("__w"), F.col("__cap")) if found is not None else F.col("__cap")
    return x.withColumn("target", F.when(F.col("__capped"), F.col("__cap")).otherwise(free)).select(*sources.columns, "target")


def _fold(units: str, level: int) -> str:
    """SQL of the sequential pivotal pass over one block's array of units."""
    give = "least(a.c.size - a.c.mass, u.mass)"  # from u to the carried unit
    take = "least(a.c.mass, u.size - u.mass)"  # from the carried unit to u
    chance = f"(pmod(xxhash64(a.c.doc_id, u.doc_id, {SEED}, {level}), 9007199254740992) / 9007199254740992.0D)"
    gives = f"({chance} * ({give} + {take}) < {take})"
    # After a gift either the carried unit is full or u is empty; after a take either u is full or the carried unit is empty.
    unit = lambda who, mass: f"named_struct('doc_id', {who}.doc_id, 'size', {who}.size, 'mass', {mass})"
    done = lambda who, taken: f"named_struct('doc_id', {who}.doc_id, 'taken', {taken})"
    state = lambda carried, out: f"named_struct('c', {carried}, 'out', array_append(a.out, {out}))"
    full = lambda who: f"CAST({who}.size > 0 AS INT)"
    step = f"""CASE
      WHEN a.c IS NULL THEN named_struct('c', u, 'out', a.out)
      WHEN {gives} THEN CASE
        WHEN a.c.size - a.c.mass <= u.mass THEN {state(unit("u", "u.mass - (a.c.size - a.c.mass)"), done("a.c", full("a.c")))}
        ELSE {state(unit("a.c", "a.c.mass + u.mass"), done("u", "0"))} END
      ELSE CASE
        WHEN u.size - u.mass <= a.c.mass THEN {state(unit("a.c", "a.c.mass - (u.size - u.mass)"), done("u", full("u")))}
        ELSE {state(unit("u", "u.mass + a.c.mass"), done("a.c", "0"))} END
    END"""
    return (
        f"aggregate({units}, CAST(named_struct('c', NULL, 'out', array()) AS {_STATE}), "
        f"(a, u) -> CAST({step} AS {_STATE}))"
    )


def copies(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """(source, doc_id, copies) of every unit of sizes(source, doc_id, size); sources has target and n_units."""
    units = sizes.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    s = sized(sources.withColumnRenamed("source", "__source"), n_sources)
    x = units.join(s, F.col("source").eqNullSafe(F.col("__source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    x = x.withColumn("__rate", rate).withColumn("base", F.floor("__rate").cast("int"))
    mass = F.greatest(F.lit(0.0), (F.col("__rate") - F.col("base"))) * F.col("size")
    blocks = F.ceil(F.col("n_units") / FAN)
    leaf = x.select(
        "source",
        F.pmod(F.xxhash64("doc_id", F.lit(SEED)), blocks).alias("block"),
        F.struct(
            F.xxhash64("doc_id", F.lit(SEED + 1)).alias("order"),
            "doc_id",
            F.col("size").cast("double").alias("size"),
            mass.alias("mass"),
        ).alias("u"),
    )
    base = x.select("source", "doc_id", "base")
    most = sources.agg(F.max(F.ceil(F.col("n_units") / FAN))).first()[0] or 0
    decided, level = [], 0
    while True:
        arrays = leaf.groupBy("source", "block").agg(F.sort_array(F.collect_list("u")).alias("us"))
        plain = "transform(us, x -> named_struct('doc_id', x.doc_id, 'size', x.size, 'mass', x.mass))"
        done = cut(arrays.select("source", "block", F.expr(_fold(plain, level)).alias("s")), f"mix{level}")
        decided.append(done.select("source", F.inline("s.out")))
        if most <= 1:
            break
        leaf = done.select(
            "source",
            F.floor(F.col("block") / FAN).alias("block"),
            F.struct(
                F.xxhash64("s.c.doc_id", F.lit(SEED + 2 + level)).alias("order"), "s.c.doc_id", "s.c.size", "s.c.mass"
            ).alias("u"),
        )
        most, level = -(-most // FAN), level + 1
    nearest = (2 * F.col("s.c.mass") >= F.col("s.c.size")) & (F.col("s.c.size") > 0)
    root = done.select("source", "s.c.doc_id", nearest.cast("int").alias("taken"))
    for d in decided:
        root = root.unionByName(d)
    root = root.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), "taken")
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    return base.join(root, same, "left").select(
        "source", "doc_id", (F.col("base") + F.coalesce("taken", F.lit(0))).alias("copies")
    )


def _sizes(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, int]:
    """The sizes (read from the texts once), and one row per source with its target."""
    sizes = cut(docs.select("source", "doc_id", word_count(text_or_empty(text)).alias("size")), "mix-sizes")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    per = cut(targets(per), "mix-sources")
    return sizes, per, per.count()


def plan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of docs."""
    sizes, sources, n = _sizes(docs, text)
    c = copies(sizes, sources, n).select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), "copies")
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    x = sizes.join(c, same).drop("__s", "__d")
    s = sized(sources.withColumnRenamed("source", "__s").drop("n_units"), n)
    x = x.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return x.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0, 1 or 2 times)."""
    own = docs.columns
    sizes, sources, n = _sizes(docs, text)
    c = cut(copies(sizes, sources, n).where("copies > 0"), "mix-copies")
    c = c.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("copies").alias("__copies"))
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    x = docs.join(sized(c, c.count()), same)
    return x.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*own)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
