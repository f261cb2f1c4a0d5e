"""Connected components over an edge table, by hooking to smaller neighbours and contracting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.shared import cut, drop_cut


#: When contraction has left at most so many edges, one task finishes.
FEW = 1 << 16


def _finish(edges: DataFrame) -> DataFrame:
    """(label, to) of at most FEW edges(a, b): the smallest label that each can reach, in one task of bounded size."""

    def run(batches):
        pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
        nodes, flat = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), return_inverse=True)
        a, b = flat.reshape(-1, 2).T
        to = np.arange(len(nodes))
        while True:
            least = np.minimum(to[a], to[b])
            new = to.copy()
            for end in (a, b):
                np.minimum.at(new, to[end], least)
            new = np.minimum(new, new[new])
            if (new == to).all() and (to[a] == to[b]).all():
                break
            to = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to])], names=["label", "to"])

    return edges.coalesce(1).mapInArrow(run, "label bigint, to bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node that can be reached.

    Each round every node hooks to its smallest neighbour if that is smaller, follows the hook once more, and takes that label; edges are
    rewritten to labels and those inside a label go, so the edge table shrinks from round to round. A label that
    is itself hooked further stays connected by an edge to where it went. When at most FEW edges are left, one task finishes. All state is in
    tables; only the number of edges left comes to the driver.
    """

    def tidy(e: DataFrame) -> DataFrame:
        x = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return cut(x.distinct(), f"{name}-edges")

    e, labels = tidy(edges), None
    while True:
        if e.count() <= FEW:
            last = _finish(e)
            out = last.withColumn("node", F.col("label")) if labels is None else labels.join(last, "label", "left")
            out = cut(out.select("node", F.coalesce("to", "label").alias("component")), f"{name}-labels")
            drop_cut(e)
            if labels is not None:
                drop_cut(labels)
            return out
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        hook = cut(hook, f"{name}-hooks")
        on = lambda at, to: hook.select(F.col("node").alias(at), F.col("to").alias(to))
        far = cut(hook.join(on("to", "label"), "to").join(on("label", "beyond"), "label").select("node", "label", "beyond"), f"{name}-labels")
        drop_cut(hook)
        if labels is None:
            new = cut(far.select("node", "label"), f"{name}-labels")
        else:
            step = far.select(F.col("node").alias("label"), F.col("label").alias("to"))
            new = cut(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels")
            drop_cut(labels)
        labels = new
        of = lambda c: far.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        moved = e.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        on_way = far.select(F.col("label").alias("a"), F.col("beyond").alias("b"))
        rest = tidy(moved.unionByName(on_way))
        drop_cut(far)
        drop_cut(e)
        e = rest
