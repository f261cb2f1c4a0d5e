"""Session helpers that every job may use: shipping the package, cutting lineage, sized joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted and found to be at most so many.
BROADCAST_ROWS = 200_000
#: And, where rows may be wide, only if the table as written has at most so many bytes.
BROADCAST_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each Spark context."""
    root = Path(__file__).resolve().parent
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(root.parent) in known or getattr(spark.sparkContext, "_logloom_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="logloom-")) / "logloom_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    spark.sparkContext._logloom_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a local one if all runs in one JVM (tests), else the warehouse if it is no local folder.

    An error on a cluster that names no shared folder: each executor would write to its own disk, and reads would miss what the others wrote.
    """
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir", None)
    if not place and not (context.master == "local" or context.master.startswith("local[")):
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/logloom-scratch"
        if place.partition(":")[0] == "file" or "://" not in place:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not place:
        place = getattr(context, "_logloom_scratch", None)
        if not place:
            place = "file://" + tempfile.mkdtemp(prefix="logloom-ckpt-")
            context._logloom_scratch = place
    return place.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and losing an executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logloom_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote, when nothing will read it again."""
    path = getattr(df, "_logloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Tables that are written inside leave no shuffle files behind: for jobs of many steps, each of which ends in cut()."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it was counted to be small and its plan reads few bytes; else as it is, for a shuffled join."""
    if rows > BROADCAST_ROWS:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def table_bytes(df: DataFrame) -> int | None:
    """The size on disk of a table that cut() wrote; None for any other."""
    path = getattr(df, "_logloom_path", None)
    if path is None:
        return None
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def sized_bytes(table: DataFrame) -> DataFrame:
    """A table that cut() wrote with a broadcast hint if its files are small; for rows of any width."""
    size = table_bytes(table)
    return F.broadcast(table) if size is not None and size <= BROADCAST_BYTES else table


def running(rows: DataFrame, order: list, name: str, **sums: str) -> DataFrame:
    """rows with `__position` (from 1) in a total order, and for each of sums (new column = column) the sum over all rows before.

    Ranges of the order are sorted side by side, and each starts where those before it end: one row per range is all that meets in one task.
    """
    part = F.spark_partition_id().alias("__range")
    x = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part), name)
    own = x.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in sums.values()])
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    own = own.select("__range", zero("__n").alias("__a_n"), *[zero(f"__s_{c}").alias(f"__a_{c}") for c in sums.values()])
    inside = Window.partitionBy("__range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(own), "__range")
    new = {"__position": (F.row_number().over(inside) + F.col("__a_n")).cast("long")}
    new |= {k: F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"__a_{c}") for k, c in sums.items()}
    return x.withColumns(new).drop("__range", "__a_n", *[f"__a_{c}" for c in sums.values()])
