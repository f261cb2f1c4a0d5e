"""Incremental sync: only files whose (mtime, size) changed are parsed again, and they are merged into the index by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.shared import cut


def delta(known: DataFrame, current: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """(kind, path, state) of known and current(kind, path, mtime, size): new, changed, unchanged, removed, or held.

    What is missing from a source that could not be read (unreadable(kind)) is held, not removed.
    """
    a = known.select(F.col("kind").alias("k1"), F.col("path").alias("p1"), F.col("mtime").alias("m1"), F.col("size").alias("s1"))
    x = current.join(a, (F.col("kind") == F.col("k1")) & (F.col("path") == F.col("p1")), "full_outer")
    same = (F.col("mtime") == F.col("m1")) & (F.col("size") == F.col("s1"))
    kind, path = F.coalesce("kind", "k1"), F.coalesce("path", "p1")
    state = F.when(F.col("p1").isNull(), "new").when(F.col("path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    out = x.select(kind.alias("kind"), path.alias("path"), state.alias("state"))
    if unreadable is None:
        return out
    bad = unreadable.select(F.col("kind").alias("__k")).distinct()
    out = out.join(bad, F.col("kind") == F.col("__k"), "left")
    held = (F.col("state") == "removed") & F.col("__k").isNotNull()
    return out.withColumn("state", F.when(held, "held").otherwise(F.col("state"))).drop("__k")


def apply(documents: DataFrame, parsed: DataFrame, changes: DataFrame) -> DataFrame:
    """The documents after a sync: rows of removed and changed files go, newly parsed rows come."""
    gone = changes.where("state in ('removed', 'changed')").select("kind", "path")
    return documents.join(gone, ["kind", "path"], "left_anti").unionByName(parsed)


def report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind", "state").agg(F.count("*").alias("n"))


def write(parsed: DataFrame, where: str) -> None:
    """Replace every partition that parsed has rows for by these rows: for snapshots of whole partitions only. Changes to some rows go through merge()."""
    parsed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(where)


# --- the written index ----------------------------------------------------------------------------------------
#
# where/data/version=v/kind=k holds the rows that version v gave partition k; where/manifest/version=v names, for every partition, the version that
# holds it now, and the last batch of every writer. A version counts once its manifest is complete, so readers see all of a batch or nothing.

_MANIFEST = "what string, name string, number long"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, where: str) -> list[int]:
    """The committed versions, oldest first."""
    fs, p = _folder(spark, f"{where}/manifest")
    if not fs.exists(p):
        return []
    found = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
    done = [(n, q) for n, q in found if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n, _ in done)


def _manifest(spark: SparkSession, where: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{where}/manifest/version={version}")


def read(spark: SparkSession, where: str, schema, version: int | None = None) -> DataFrame:
    """The index as of a version (the newest if none is named), with the columns of schema."""
    known = versions(spark, where)
    version = version if version is not None else (known[-1] if known else None)
    if version is None:
        return spark.createDataFrame([], schema)
    parts = _manifest(spark, where, version).where("what = 'part'").select(F.col("name").alias("kind"), F.col("number").alias("version"))
    full = StructType(list(schema.fields)).add("version", "long")
    # The manifest has a row per partition, which the reader lists anyway; it prunes the scan to the partitions' present versions.
    rows = spark.read.schema(full).parquet(f"{where}/data")
    return rows.join(F.broadcast(parts), ["kind", "version"]).select(schema.names)


def merge(changed: DataFrame, where: str, writer: str, batch: int, removed: DataFrame | None = None, keys: tuple[str, ...] = ("kind", "path"), newest: str | None = None) -> bool:
    """Put changed rows in and take removed(keys) out of the index, by key; rows of other keys stay. False if this batch of the writer was merged before.

    Only the partitions (kind, a string) that the batch touches are read and written; all others stay where they are. Of rows of one key in a batch that with the
    largest `newest` counts (else any one); a key that is both removed and changed is changed. A batch that was stopped halfway has no manifest: it runs again from the start.
    """
    spark, schema = changed.sparkSession, changed.schema
    known = versions(spark, where)
    last = known[-1] if known else None
    old = _manifest(spark, where, last)
    seen = old.where((F.col("what") == "writer") & (F.col("name") == writer)).agg(F.max("number")).first()[0]
    if seen is not None and batch <= seen:
        return False
    order = F.desc(newest) if newest else F.lit(0)
    one = changed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")
    one = cut(one, "changed")  # read once; and a union of two shuffles may be planned as one partitioning, whose sides adapt apart
    gone = changed.select(*keys) if removed is None else changed.select(*keys).unionByName(removed.select(*keys))
    kinds = cut(gone.select(F.col("kind").alias("__k")).distinct(), "touched")
    touched = read(spark, where, schema, last).join(F.broadcast(kinds), F.col("kind") == F.col("__k")).drop("__k")  # one row per partition
    version = 0 if last is None else last + 1
    merged = touched.join(gone.distinct(), list(keys), "left_anti").unionByName(one)
    merged.write.mode("overwrite").partitionBy("kind").parquet(f"{where}/data/version={version}")
    wrote = spark.read.schema(schema).parquet(f"{where}/data/version={version}").select("kind").distinct()
    here = F.lit(version).cast("long").alias("number")
    rest = old.join(kinds, (F.col("what") == "part") & (F.col("name") == F.col("__k")), "left_anti").where((F.col("what") == "part") | (F.col("name") != writer))
    mine = spark.createDataFrame([("writer", writer, batch)], _MANIFEST)
    manifest = rest.unionByName(wrote.select(F.lit("part").alias("what"), F.col("kind").alias("name"), here)).unionByName(mine)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{where}/manifest/version={version}")
    return True


def vacuum(spark: SparkSession, where: str, keep: int = 2) -> None:
    """Delete what none of the newest `keep` versions holds; no reader of an older one may be running."""
    known = versions(spark, where)
    used = {int(r.number) for v in known[-keep:] for r in _manifest(spark, where, v).where("what = 'part'").select("number").distinct().collect()}  # version numbers
    fs, p = _folder(spark, f"{where}/data")
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("version=") and int(name.partition("=")[2]) not in used and int(name.partition("=")[2]) <= known[-1]:
            fs.delete(s.getPath(), True)
    for v in known[:-keep]:
        fs.delete(_folder(spark, f"{where}/manifest/version={v}")[1], True)
