"""Groups of any size as bounded blocks: a group of up to `most` rows is one block; a larger one is dealt into
chunks by a hash, and each pair of chunks is a block. Every two rows of a group meet in some block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, key: str, size: str, row: str, most: int) -> DataFrame:
    """rows with `chunk` and `block` (a hash of key and chunk pair): size is the group's size, row identifies the row in its group."""
    n = F.when(F.col(size) > most, F.ceil(F.col(size) / (most / 2.0)).cast("int")).otherwise(F.lit(1))
    x = rows.withColumn("__n", n).withColumn("chunk", F.pmod(F.xxhash64(row, F.lit(77)), F.col("__n")).cast("int"))
    other = F.transform(
        F.sequence(F.lit(0), F.col("__n") - 1),
        lambda j: F.struct(F.least(F.col("chunk"), j).alias("i"), F.greatest(F.col("chunk"), j).alias("j")),
    )
    x = x.withColumn("__p", F.explode(other))
    return x.withColumn("block", F.xxhash64(key, "__p.i", "__p.j")).drop("__n", "__p")


def groups(batches, key: str):
    """Tables of whole groups from batches that come sorted by key."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        k = t.column(key).to_numpy()
        if not len(k):
            continue
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts) if len(cuts) else ():
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and len(rest):
        yield rest


def by_block(rows: DataFrame, block: str = "block") -> DataFrame:
    return rows.repartition(block).sortWithinPartitions(block)


def stars(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each node to the best linked one of its component, for a symmetric boolean matrix.

    A group's natural hub is then the centre in every block that holds it, and its edges are the same ones.
    """
    m, out = len(ids), []
    left = np.ones(m, bool)
    for i in np.lexsort((ids, -linked.sum(axis=1))):
        if not left[i]:
            continue
        left[i] = False
        front = linked[i] & left
        found = front.copy()
        while front.any():
            left &= ~front
            front = linked[front].any(axis=0) & left
            found |= front
        out += [(int(ids[i]), int(ids[j])) for j in np.flatnonzero(found) if ids[j] != ids[i]]
    return out


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])
