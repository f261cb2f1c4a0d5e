"""Whitening of embeddings by a covariance over distinct vectors, weighted by how often each occurs.

Equal vectors are grouped first; the weighted, centred products of the distinct ones are summed across partitions; each distinct vector is
whitened once and joined back to the rows that hold it.

Defined results: rows whose vector is null, holds null or non-finite entries, or an entry whose scaled value has 2^52 or more, go, and so do those of another length than the
most common one (of equally common ones, the shorter). No row left: an empty result. Components without variance (eigenvalue at
most rounding error) can't be scaled to one and are left out, so equal vectors give no rows. A deviation beyond the range of a long is null. Repeated rows and ids all
count and all come back. Further columns do not come along; join them by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.columns import quoted
from logloom.shared import cut

SCALE, SHIFT = 64, 1_000_000
#: A vector that more than one in so many rows hold is joined by broadcast: there are fewer than this many of them.
HOT_SHARE = 1000
#: Entries of one product block, to bound a task's memory.
BLOCK = 1 << 20


@dataclass
class Model:
    """What whitens: n vectors with sums per dimension, and unit components (columns) with their eigenvalues, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None


def quantised(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, x) of the usable rows: x = floor(64 * c) + 1000000 for each entry c, as longs."""
    v = F.col(quoted(vec)).cast("array<double>")
    x = vectors.select(F.col(quoted(id)).alias("id"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(1 << 52)))
    x = x.where(F.col("v").isNotNull() & fine)
    return x.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted column sums as Python integers: in 64 bits where the bound allows it."""
    if not len(x):
        return []
    if int(np.abs(x).max()) * int(w.sum()) < 1 << 63:
        return (x * w[:, None]).sum(axis=0).tolist()
    return [sum(a * b for a, b in zip(col, w.tolist())) for col in x.T.tolist()]


def _sums(distinct: DataFrame) -> list[int]:
    """The exact sum of each dimension over the fit list: summed in tasks, then by position."""

    def step(batches):
        for b in batches:
            s = _exact_sums(_matrix(b.column(0), np.int64), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array(list(map(str, s)), pa.string())], names=["i", "s"])

    part = distinct.select("x", "w").mapInArrow(step, "i int, s string")
    rows = part.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    return [int(r.s) for r in sorted(rows, key=lambda r: r.i)]


def _products(rows: DataFrame, column: str, centre) -> np.ndarray:
    """The weighted sum of outer products of centre(column's block): block by block in tasks, then by entry."""

    def step(batches):
        total = None
        for b in batches:
            width = max(1, len(b.column(0)[0])) if len(b) else 1
            for at in range(0, len(b), max(1, BLOCK // width)):
                part = b.slice(at, max(1, BLOCK // width))
                y = centre(_matrix(part.column(0), None))
                out = (y * part.column(1).to_numpy().astype(np.float64)[:, None]).T @ y
                total = out if total is None else total + out
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    found = rows.select(column, "w").mapInArrow(step, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = int(found.j.max()) + 1 if len(found) else 0
    out = np.zeros((d, d))
    out[found.i, found.j] = out[found.j, found.i] = found.v
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from the exact difference n*x - S where 64 bits hold it."""
    if x.size and n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return (x * n - np.array(sums, np.int64)) / n
    return np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x.tolist()], np.float64).reshape(x.shape)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; null beyond a long."""
    top = max((abs(n * v - s) for lo_hi in (x.min(axis=0), x.max(axis=0)) for v, s in zip(lo_hi.tolist(), sums)), default=0)
    if top * top * max(1, x.shape[1]) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    found = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def distinct_vectors(x: DataFrame, weights: str = "counts") -> DataFrame:
    """(x, h, m, w): the different vectors of the most common length, their hash, their number of rows, and their weight in the fit: that number, or one."""
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = lengths[0].d if lengths else 0
    w = F.col("m") if weights == "counts" else F.lit(1).cast("long")
    found = x.where(F.size("x") == d).groupBy("x").agg(F.count("*").alias("m"))
    return cut(found.select("x", F.xxhash64("x").alias("h"), "m", w.alias("w")), "whitening-distinct")


def fit(distinct: DataFrame, most: int = 32) -> Model | None:
    """The model of distinct_vectors(); None without rows or dimensions. Only sums per dimension and the covariance reach the driver."""
    n = distinct.agg(F.sum("w")).first()[0] or 0
    sums = _sums(distinct) if n else []
    if not sums:
        return None
    v = _products(distinct, "x", lambda x: _centred(x, n, sums)) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    kept = int((e > max(e[0], 0.0) * len(e) * 16 * np.finfo(float).eps).sum())
    e, q = e[: min(most, kept)], q[:, : min(most, kept)]
    top = np.abs(q).argmax(axis=0)
    return Model(n, sums, q * np.sign(q[top, np.arange(len(top))]), e, float(np.trace(v)))


def whiten(vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", most: int = 32, weights: str = "counts") -> tuple[DataFrame, Model | None]:
    """((id, deviation, whitened) with one row per usable row of vectors, the model with the largest error of the whitened covariance)."""
    spark, x = vectors.sparkSession, quantised(vectors, id, vec)
    schema = f"id {dict(x.dtypes)['id']}, deviation long, whitened array<double>"
    distinct = distinct_vectors(x, weights)
    model = fit(distinct, most)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema), model
    n, sums, turn = model.n, model.sums, model.components / np.sqrt(model.eigenvalues)

    def step(batches):
        for b in batches:
            if len(b):
                m = _matrix(b.column(b.schema.get_field_index("x")), np.int64)
                white = (_centred(m, n, sums) @ turn).ravel()
                white = pa.ListArray.from_arrays(pa.array(range(0, white.size + 1, turn.shape[1]), pa.int32()), pa.array(white))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_deviations(m, n, sums), pa.int64()), white], names=[*b.schema.names, "deviation", "whitened"])

    done = cut(distinct.mapInArrow(step, "x array<long>, h long, m long, w long, deviation long, whitened array<double>"), "whitening-done")
    total = done.select("w", F.posexplode("whitened").alias("i", "v")).groupBy("i").agg(F.sum(F.col("w") * F.col("v")).alias("s")).collect()
    mean = np.array([r.s for r in sorted(total, key=lambda r: r.i)]) / n
    error = _products(done, "whitened", lambda y: y - mean) / n - np.eye(len(mean))
    model.identity_error = float(np.abs(error).max())
    # Vectors that many rows hold would crowd a shuffle: fewer than HOT_SHARE of them can exist.
    rows = distinct.agg(F.sum("m")).first()[0]
    hot = F.col("m") * HOT_SHARE > rows
    back = done.select("h", F.col("x").alias("y"), "m", "deviation", "whitened")
    keyed = x.select("id", "x", F.xxhash64("x").alias("h"))
    same = (keyed.h == back.h) & (keyed.x == back.y)
    often = keyed.join(F.broadcast(back.where(hot)), same)
    seldom = keyed.join(F.broadcast(back.where(hot).select("h", "y")), same, "left_anti").join(back.where(~hot), same)
    return often.select("id", "deviation", "whitened").unionAll(seldom.select("id", "deviation", "whitened")), model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component (1 to 32), n, deviation, whitened, explained, identity_error of all usable rows of embeddings."""
    white, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    x = white.select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = [float(e) / model.trace for e in model.eigenvalues] if model else []
    return x.select(
        F.col("id").alias("vec_id"), (F.col("i") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("i")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
