"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated by a random orthogonal matrix and kept as its signs; with c = signs / sqrt(d) the stored factor is
f = <c, o>. Then <c, q> / f estimates <o, q> without bias over rotations: c = f o + sqrt(1 - f^2) e with e at right angles to o, and e is random,
so the estimate of a pair of cosine t is off by about sqrt(1 - f^2) / f * sqrt(1 - t^2) / sqrt(d - 1), and never by more than sqrt(d - 1) times that.
The other vector q takes part as BITS bits a component, rounded at random so that its mean is kept; the product of signs and bit planes is a count of common
bits. A pair is recomputed exactly, in double precision, if both estimates of it lie within their confidence bounds (Z deviations, or the
certain bound where that is tighter) of the threshold or above. A link is missed with a chance below 1e-8.

Equal vectors of one label are one class. Labels are compared apart; a label of more than BLOCK classes is dealt into chunks, and pairs of
chunks are blocks (blocks.py), so a hot label spreads over many tasks and every pair meets. First only codes meet (64 bytes for 64 components); the
vectors themselves go to the blocks in which their code has a partner left. A block returns link counts and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without label, link with
nothing; vectors of different lengths are never compared; rows without vec_id link with nothing (component null, kept). Rows that share a vec_id are one
node: n_links counts the different other vec_ids that any of its rows links to, and its rows join their components. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import blocks
from logloom.llm.graph import components
from logloom.shared import cut, sized

THRESHOLD = 0.93
SEED = 7
BLOCK = 2048
BITS = 4
Z = 6.0

_U = np.uint64


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(8)
def _dither(d: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).random(d)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(_U)


def encode(units: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each unit vector: its signs, the BITS planes of its rounded components, and factor, origin and step as doubles."""
    d = units.shape[1]
    r = units @ rotation(d)
    low = r.min(axis=1, keepdims=True)
    step = np.maximum((r.max(axis=1, keepdims=True) - low) / ((1 << BITS) - 1), 1e-12)
    level = np.clip(np.floor((r - low) / step + _dither(d)), 0, (1 << BITS) - 1).astype(np.uint8)
    factor = np.abs(r).sum(axis=1, keepdims=True) / np.sqrt(d)
    planes = [_words((level >> k) & 1 > 0) for k in range(BITS)]
    return np.concatenate([_words(r > 0), *planes, *(x.view(_U) for x in (factor, low, step))], axis=1)


def may_link(a: np.ndarray, b: np.ndarray, d: int, threshold: float) -> np.ndarray:
    """Which pairs (signs of rows of a, planes of rows of b) the estimate's confidence bound does not rule out."""
    w = -(-d // 64)
    signs, planes = a[:, :w], b[:, w : w * (BITS + 1)]
    factor = np.clip(a[:, -3:-2].view(np.float64), 1e-9, 1.0)
    low, step = b[:, -2].view(np.float64), b[:, -1].view(np.float64)
    own, total = np.bitwise_count(signs).sum(axis=1), np.zeros(len(b))
    for k in range(BITS):
        total += np.bitwise_count(planes[:, k * w : (k + 1) * w]).sum(axis=1) * float(1 << k)
    out = np.empty((len(a), len(b)), bool)
    off = np.sqrt(1 - factor * factor) * np.sqrt(1 - threshold * threshold) * min(1.0, Z / np.sqrt(max(1, d - 1)))
    for i in range(0, len(a), 256):
        common = np.zeros((len(a[i : i + 256]), len(b)), np.uint32)
        for k in range(BITS):
            for j in range(w):
                common += np.bitwise_count(signs[i : i + 256, j, None] & planes[None, :, k * w + j]).astype(np.uint32) << k
        # <c, q> = (2 * sum over set bits of q - sum of q) / sqrt(d)
        product = (2 * (low * own[i : i + 256, None] + step * common) - (low * d + step * total)) / np.sqrt(d)
        error = off[i : i + 256] + step * min(Z / 2, np.sqrt(d))
        out[i : i + 256] = product + error >= (threshold - 1e-9) * factor[i : i + 256]
    return out


def _described(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, hash of the components, the vector's bytes and its code; nulls where it can't be linked."""
    names = ["vec_id", "label", "dim", "h1", "h2", "vector", "code"]

    def run(batches):
        for batch in batches:
            ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
            n = len(ids)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            off = lists.offsets.to_numpy()
            flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # nulls become NaN
            good = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            cols = [[None] * n for _ in range(5)]
            for d in np.unique(size[good]).tolist():
                rows = np.flatnonzero(good & (size == d))
                x = flat[off[rows][:, None] + np.arange(d)]
                with np.errstate(all="ignore"):
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # no component above 1: squares don't overflow
                fine = np.isfinite(x).all(axis=1)
                rows, x = rows[fine], x[fine]
                code = encode(x / np.linalg.norm(x, axis=1, keepdims=True))
                for i, v, c in zip(rows.tolist(), x, code):
                    raw = v.tobytes()
                    h1, h2 = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), np.int64).tolist()
                    for col, value in zip(cols, (d, h1, h2, raw, c.tobytes())):
                        col[i] = value
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([ids, labels, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    x = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    return x.mapInArrow(run, "vec_id bigint, label string, dim int, h1 bigint, h2 bigint, vector binary, code binary")


def _sides(chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sides of a block that meet: its two chunks, or all rows twice."""
    first = chunk == chunk.min()
    return (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(chunk)),) * 2


def _open_pairs(codes: np.ndarray, i: np.ndarray, j: np.ndarray, d: int, threshold: float) -> np.ndarray:
    """Which pairs of side i and side j both estimates leave open; never a row with itself."""
    out = may_link(codes[i], codes[j], d, threshold)
    out &= out.T if i is j else may_link(codes[j], codes[i], d, threshold).T
    if i is j:
        np.fill_diagonal(out, False)
    return out


def exact_links(x: np.ndarray, y: np.ndarray, open_: np.ndarray, threshold: float) -> np.ndarray:
    """Which open pairs of unit vectors reach the threshold. A product decides; pairs that it can't tell from the threshold are summed one by one, the same way everywhere."""
    if not open_.any():
        return open_
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    here = open_[np.ix_(rows, cols)]
    cosine = x[rows] @ y[cols].T
    linked = here & (cosine >= threshold)
    p, q = np.nonzero(here & (np.abs(cosine - threshold) < 1e-11))
    linked[p, q] = np.einsum("ij,ij->i", x[rows[p]], y[cols[q]]) >= threshold
    out = np.zeros_like(open_)
    out[np.ix_(rows, cols)] = linked
    return out


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _links(reps: DataFrame, threshold: float) -> DataFrame:
    """kind 0: (class, number of single ids it links to); kind 1: edges between classes; kind 2: links of classes that hold an id of several classes."""
    size = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    x = reps.select("cls", "label", "dim", "code").join(size, ["label", "dim"]).withColumn("__g", F.xxhash64("label", "dim"))
    dealt = blocks.deal(x, "__g", "n", "cls", BLOCK).select("block", "chunk", "cls", "dim", "code")

    def estimate(batches):
        for t in blocks.groups(batches, "block"):
            chunk, cls, d = t.column("chunk").to_numpy(), t.column("cls").to_numpy(), t.column("dim")[0].as_py()
            i, j = _sides(chunk)
            open_ = _open_pairs(_matrix(t.column("code"), _U), i, j, d, threshold)
            some = np.union1d(i[open_.any(axis=1)], j[open_.any(axis=0)])
            arrays = [pa.array(np.full(len(some), t.column("block")[0].as_py(), np.int64)), pa.array(chunk[some]), pa.array(cls[some])]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "chunk", "cls"])

    open_ = cut(blocks.by_block(dealt).mapInArrow(estimate, "block bigint, chunk int, cls bigint"), "open")
    full = open_.join(reps.select("cls", "dim", "code", "vector", "singles", "flagged"), "cls")

    def compare(batches):
        for t in blocks.groups(batches, "block"):
            cls, d, singles, flagged = t.column("cls").to_numpy(), t.column("dim")[0].as_py(), t.column("singles").to_numpy(), t.column("flagged").to_numpy()
            i, j = _sides(t.column("chunk").to_numpy())
            open_ = _open_pairs(_matrix(t.column("code"), _U), i, j, d, threshold)
            v = _matrix(t.column("vector"), np.float64)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            part = exact_links(v[i], v[j], open_, threshold)
            linked = np.zeros((len(cls), len(cls)), bool)
            linked[np.ix_(i, j)] = part
            linked |= linked.T
            some = np.flatnonzero(linked.any(axis=1))
            n = linked[some] @ singles
            edges = np.array(blocks.stars(cls, linked), np.int64).reshape(-1, 2)
            p, q = np.nonzero(linked & flagged[:, None])
            a = np.concatenate([cls[some], edges[:, 0], cls[p]])
            b = np.concatenate([n, edges[:, 1], cls[q]])
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(some), len(edges), len(p)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return blocks.by_block(full).mapInArrow(compare, "kind tinyint, a bigint, b bigint")


def _several(of_id: DataFrame, reps: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ids that stand in several classes add: (cls, more) to the other ids of a class, and (vec_id, links) of their own.

    of_id(vec_id, cls) has these ids alone; such tables are small unless ids are broken.
    """
    own = of_id.select(F.col("cls").alias("a"), F.col("cls").alias("b")).distinct()
    met = cut(found.where("kind = 2").select("a", "b").unionByName(own), "several-links")  # a is flagged
    more = met.join(of_id.withColumnRenamed("cls", "a"), "a").select(F.col("b").alias("cls"), "vec_id").distinct()
    more = more.groupBy("cls").agg(F.count("*").alias("more"))
    theirs = cut(met.join(of_id.withColumnRenamed("cls", "a"), "a").select("vec_id", F.col("b").alias("cls")).distinct(), "several-met")
    singles = theirs.join(reps.select("cls", "singles"), "cls").groupBy("vec_id").agg(F.sum("singles").alias("s"))
    others = theirs.join(of_id.withColumnRenamed("vec_id", "other"), "cls").where("other <> vec_id").select("vec_id", "other").distinct()
    others = others.groupBy("vec_id").agg(F.count("*").alias("o"))
    links = singles.join(others, "vec_id", "left").select("vec_id", (F.col("s") + F.coalesce("o", F.lit(0))).alias("links"))
    return more, links


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding, label)."""
    all_rows = cut(_described(vectors), "vectors")
    key = ["label", "dim", "h1", "h2"]
    ids = all_rows.where("dim is not null").select("vec_id", *key).distinct()
    # Ids of several classes, or of one and of rows that can't be linked.
    places = all_rows.where("vec_id is not null").select("vec_id", *key).distinct()
    several = cut(places.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id", F.lit(True).alias("__m")), "several")
    n_several = several.count()
    if n_several:
        ids = ids.join(sized(several, n_several), "vec_id", "left").withColumn("__m", F.coalesce("__m", F.lit(False)))
    else:
        ids = ids.withColumn("__m", F.lit(False))
    classes = ids.groupBy(*key).agg(
        F.min("vec_id").alias("rep"), F.sum((~F.col("__m")).cast("long")).alias("singles"), F.max("__m").alias("flagged")
    )
    content = all_rows.where("dim is not null").groupBy(*key).agg(F.min("vector").alias("vector"), F.min("code").alias("code"))
    reps = cut(classes.join(content, key).withColumn("cls", F.monotonically_increasing_id()), "classes")
    n_reps = reps.count()
    found = cut(_links(reps, threshold), "vector-links")
    degree = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("degree"))
    rep_of = lambda c: reps.select(F.col("cls").alias(c), F.col("rep").alias(f"r{c}"))
    edges = found.where("kind = 1").select("a", "b").join(rep_of("a"), "a").join(rep_of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    of_class = reps.select(*key, "cls", "rep", "singles").join(degree, "cls", "left")
    links = F.coalesce("degree", F.lit(0)) + F.col("singles") - 1
    if n_several:
        of_id = cut(ids.where("__m").join(reps.select(*key, "cls", "rep"), key).select("vec_id", "cls", "rep"), "several-classes")
        edges = edges.unionByName(of_id.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
        more, theirs = _several(of_id.drop("rep"), reps, found)
        of_class = of_class.join(more, "cls", "left")
        links = links + F.coalesce("more", F.lit(0))
    comp = components(edges, "vector-links")
    of_class = of_class.join(comp, F.col("rep") == F.col("node"), "left").select(
        *key, links.cast("long").alias("links"), F.coalesce("component", "rep").alias("component")
    )
    out = all_rows.select("vec_id", *key).join(sized(cut(of_class, "vector-classes"), 2 * n_reps), key, "left")
    n_links = F.coalesce("links", F.lit(0))
    if n_several:
        # An id of several classes has one number, in all its rows, and one component, also in rows that can't be linked.
        node = comp.select(F.col("node").alias("vec_id"), F.col("component").alias("of_node"))
        out = out.join(theirs.withColumnRenamed("links", "own"), "vec_id", "left").join(node, "vec_id", "left")
        n_links = F.coalesce("own", "links", F.lit(0))
        out = out.withColumn("component", F.coalesce("of_node", "component"))
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        n_links.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: The same rows by comparing all pairs of a label.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (
  SELECT DISTINCT a AS vec_id, a AS r FROM links
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT e.vec_id, (SELECT count(DISTINCT b) FROM links WHERE a = e.vec_id) AS n_links,
       coalesce((SELECT min(r) FROM reach WHERE reach.vec_id = e.vec_id), e.vec_id) AS component_id,
       coalesce((SELECT min(r) FROM reach WHERE reach.vec_id = e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
