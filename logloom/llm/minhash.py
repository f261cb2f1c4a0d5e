"""Near-duplicate texts by an LSH forest over word shingles.

Each text is its set of distinct shingles; texts with equal sets form a class with one representative. A signature of
128 minimum hashes is read as 32 orders: order t sorts the signatures that start at position 4t and go round. Texts that share a prefix of
DEPTH hashes in an order form a region of it. Two sets of similarity 0.8 share no region with a chance of 5e-8. Regions of the same members are looked at
once, in one order. In a sorted region every text meets its REACH neighbours on either side, which are those with the longest common prefixes:
the depth at which a text looks for candidates so adapts to how many stand around it, and a region of up to REACH + 1 texts is compared whole.
Neighbours whose whole signatures agree are candidates (a pair of similarity 0.8 falls below ESTIMATE with a chance of 3e-6).
What neighbours leave open in larger regions is completed (see _complete), so a region's size changes no result.

Candidates join into clusters. A cluster's full shingle sets are compared in chunks of BLOCK / 2 texts, and links between texts of different chunks that
these leave open are completed in the same way. Only links confirmed on full sets count. No task holds a whole group, and what leaves a task are
spanning forests, never all pairs.

Defined results: a null, empty or word-less text has an empty set and links with nothing; a text of fewer words than a
shingle has its whole sequence as its one shingle; repeated rows of one id stay one node; rows without doc_id link with nothing (component null) and are kept;
an empty table gives an empty result; other columns are ignored. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import blocks, textops
from logloom.llm.graph import components
from logloom.shared import cut, sized, sized_bytes

SHINGLE = 5
PERCENT = 80
HASHES = 128
ORDERS = 32
DEPTH = HASHES // ORDERS
#: Hashes of the signature that must agree for a candidate: 0.64.
ESTIMATE = 82
#: Neighbours on either side in a sorted order that a text is compared with.
REACH = 32
BLOCK = 512
#: A component with this share (1 / HUBS) of a group sends a member to be compared with all texts outside such components.
HUBS = 32

_U = np.uint64
_FACTORS = textops.mix64(np.arange(1, HASHES + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
_PLACES = textops.mix64(np.arange(1, 65, dtype=_U) * _U(0x9FB21C651E98DF25)) | _U(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = textops.lower(data)
    starts, ends, of_doc = textops.word_spans(low, off)
    w = textops.span_hashes(low, starts, ends)
    h = np.zeros(max(0, len(w) - size + 1), _U)
    for k in range(size):
        h += w[k : k + len(h)] * _PLACES[k]
    h = textops.mix64(h)
    out = []
    for a, b in zip(of_doc[:-1].tolist(), of_doc[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            short = (w[a:b] * _PLACES[: b - a]).sum(dtype=_U) + _U(b - a)
            out.append(textops.mix64(np.array([short], _U) ^ _U(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, _U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minimum hashes of 16 bits each for every set (zeros for an empty one)."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), HASHES), np.uint16)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    at, i = np.concatenate([[0], np.cumsum(sizes[some])]), 0
    flat = np.concatenate([sets[k] for k in some])
    while i < len(some):  # some thousand shingles at a time stay in the cache
        j = max(i + 1, int(np.searchsorted(at, at[i] + 16384, "right")) - 1)
        x, edge = flat[at[i] : at[j]], at[i:j] - at[i]
        for k in range(HASHES):
            low = np.minimum.reduceat((x * _FACTORS[k]) >> _U(32), edge)
            out[some[i:j], k] = ((low * _U(0x9E3779B97F4A7C15)) >> _U(48)).astype(np.uint16)
        i = j
    return out


def describe(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, two sums that identify the set, and the signature."""

    def run(batches):
        for batch in batches:
            data, off = textops.buffer(textops.column(batch, "__text"))
            n, a, b, sig = [], [], [], []
            for i, j in textops.chunks(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                n += [len(s) for s in sets]
                a += [int(s.sum(dtype=_U)) for s in sets]
                b += [int(textops.mix64(s + _U(0x632BE59BD9B4E019)).sum(dtype=_U)) for s in sets]
                sig += [s.tobytes() for s in signatures(sets)]
            signed = lambda v: pa.array(np.array(v, _U).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), signed(a), signed(b), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig"],
            )

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    return x.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sig binary")


def _regions(reps: DataFrame) -> DataFrame:
    """(t, key, n, rep): the members of each region of at least two, regions with the same members once."""
    prefix = lambda t: F.substring(F.col("__s"), t * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
    keys = F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda t: F.struct(t.alias("t"), F.xxhash64(t, prefix(t)).alias("key")))
    rows = reps.withColumn("__s", F.concat("sig", "sig")).select("rep", F.inline(keys))
    found = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("x")
    )
    once = cut(found.where("n > 1").groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "n"), "regions")
    return rows.join(once, "key").select("t", "key", "n", "rep")


def _neighbour_edges(ordered: DataFrame) -> DataFrame:
    """Edges that join all agreeing neighbours of ordered(key, tail, rep), whose partitions are sorted by key and rotated signature.

    An edge that two shorter ones imply is left out, so a run of copies is a chain.
    """

    def run(batches):
        key, rep, sig, edges = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint16), []
        for batch in batches:
            old = len(key)
            key = np.concatenate([key, batch.column(0).to_numpy()])
            rep = np.concatenate([rep, batch.column(2).to_numpy()])
            sig = np.concatenate([sig, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)])
            agree = np.zeros((REACH + 1, len(key)), bool)
            for d in range(1, min(REACH + 1, len(key))):
                i = np.flatnonzero(key[d:] == key[:-d]) + d
                if not len(i):
                    break
                i = i[(sig[i] == sig[i - d]).sum(axis=1) >= ESTIMATE]
                agree[d, i] = True
                i = i[i >= old]
                for k in range(1, d):
                    i = i[~(agree[k, i] & agree[d - k, i - k])]
                edges.append(np.stack([rep[i], rep[i - d]], axis=1))
            if edges:
                yield blocks.edge_batch(np.concatenate(edges))
                edges = []
            key, rep, sig = key[-REACH:], rep[-REACH:], sig[-REACH:]

    return ordered.select("key", "tail", "rep").mapInArrow(run, "a bigint, b bigint")


def _candidate_edges(reps: DataFrame, n_reps: int) -> DataFrame:
    """Edges that join every two texts of a region of reps(rep, sig) whose signatures agree enough."""
    members = cut(_regions(reps), "members")
    tail = F.substring(F.concat("sig", "sig"), F.col("t") * (2 * DEPTH) + 1, F.lit(2 * HASHES))
    x = members.join(sized(reps, 8 * n_reps), "rep").select("key", "n", "rep", tail.alias("tail"))
    order = ["key", "tail", "rep"]
    small, large = x.where(F.col("n") <= REACH + 1), x.where(F.col("n") > REACH + 1)
    edges = _neighbour_edges(small.repartition("key").sortWithinPartitions(*order))
    wide = members.where(F.col("n") > REACH + 1).select("key", "rep")
    if not wide.take(1):
        return edges
    # A large region is cut by range, wherever the cuts fall; what meets across them is left to _complete.
    edges = edges.unionByName(_neighbour_edges(large.repartitionByRange(*order).sortWithinPartitions(*order)))
    return _complete(wide, reps.withColumnRenamed("sig", "value"), cut(edges, "neighbours"), _signatures_agree, _signature_matrix)


def _signatures_agree(x: list, y: list) -> np.ndarray:
    of = lambda v: np.frombuffer(b"".join(v), np.uint16).reshape(-1, HASHES)
    return (of(x) == of(y)).sum(axis=1) >= ESTIMATE


def _signature_matrix(values: list) -> np.ndarray:
    s = np.frombuffer(b"".join(values), np.uint16).reshape(-1, HASHES)
    return np.stack([(s == r).sum(axis=1) >= ESTIMATE for r in s])


def _complete(wide: DataFrame, values: DataFrame, edges: DataFrame, pairs_agree, matrix) -> DataFrame:
    """edges, and what they lack to join every two texts of a group of wide(key, rep) whose values(rep, value) agree.

    Texts outside a group's larger components meet one member of each of those, for as long as that joins a fourth of them. Then
    all texts outside the largest component meet each other and that component, in blocks. Pairs of one component need no comparison, and
    groups of one component take no part any more.
    """

    def met(batches):
        for batch in batches:
            near = pa.array(pairs_agree(batch.column(4).to_pylist(), batch.column(5).to_pylist()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(near) for k in range(4)], names=["a", "b", "ca", "cb"])

    labels = components(edges, "wide")
    x = wide.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    parts, round_, x = [edges], 0, cut(x, "labelled")
    while True:
        sizes = cut(x.groupBy("key", "component").agg(F.count("*").alias("n"), F.max_by("rep", F.xxhash64("rep", F.lit(round_))).alias("b")), "sizes")
        most = F.max(F.struct("n", "component"))
        groups = cut(sizes.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("k"), most.alias("top")).where("k > 1"), "several")
        n_groups = groups.count()
        if not n_groups:
            break
        groups = sized(groups, n_groups)
        x = x.join(groups.select("key"), "key")
        is_hub = (F.col("n") * HUBS >= F.col("total")) | (F.col("component") == F.col("top.component"))
        hubs = cut(sizes.join(groups, "key").where(is_hub).select("key", F.col("component").alias("cb"), "b"), "hubs")
        n_hubs = hubs.count()
        left = x.join(sized(hubs.select("key", F.col("cb").alias("component")), n_hubs), ["key", "component"], "left_anti")
        pairs = left.join(sized(hubs, n_hubs), "key").select(F.col("rep").alias("a"), "b", F.col("component").alias("ca"), "cb")
        near = values.join(hubs.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi")
        near = cut(near.select(F.col("rep").alias("b"), F.col("value").alias("vb")), "met-values")
        pairs = pairs.distinct().join(values.select(F.col("rep").alias("a"), F.col("value").alias("va")), "a").join(sized_bytes(near), "b")
        new = cut(pairs.select("a", "b", "ca", "cb", "va", "vb").mapInArrow(met, "a bigint, b bigint, ca bigint, cb bigint"), "met")
        n_left, n_new = left.select("rep").distinct().count(), new.select("a").distinct().count()
        parts.append(new.select("a", "b"))
        if n_new:
            merged = components(new.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "merged")
            merged = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
            x = x.join(merged, "component", "left").select("key", "rep", F.coalesce("into", "component").alias("component"))
        x, round_ = cut(x, "labelled"), round_ + 1
        if 4 * n_new < n_left or not n_left:
            parts.append(_across(x, values, matrix))
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _across(x: DataFrame, values: DataFrame, matrix) -> DataFrame:
    """Spanning forests of the agreeing pairs of different components in each group of x(key, rep, component)."""
    sizes = x.groupBy("key", "component").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("top")).where("total > top.n")
    groups = groups.select("key", F.col("top.component").alias("__top"), (F.col("total") - F.col("top.n")).alias("__rest"), F.col("top.n").alias("__most"))
    groups = cut(groups, "across")
    parts = lambda c: F.ceil(F.col(c) / (BLOCK / 2.0)).cast("int")
    y = x.join(sized(groups, groups.count()), "key").withColumn("rest", F.col("component") != F.col("__top"))
    y = y.withColumn("__r", parts("__rest")).withColumn("__m", parts("__most"))
    y = y.withColumn("__c", F.pmod(F.xxhash64("rep", F.lit(78)), F.when(F.col("rest"), F.col("__r")).otherwise(F.col("__m"))).cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    others, c = F.sequence(F.lit(0), F.col("__r") - 1), F.col("__c")
    own = F.transform(others, lambda j: pair(F.least(c, j), F.greatest(c, j)))
    top = F.transform(F.sequence(F.lit(0), F.col("__m") - 1), lambda j: pair(c, F.col("__r") + j))
    met = F.when(F.col("rest"), F.concat(own, top)).otherwise(F.transform(others, lambda j: pair(j, F.col("__r") + c)))
    y = y.join(values, "rep").withColumn("__p", F.explode(met))

    def run(batches):
        edges = []
        for t in blocks.groups(batches, "block"):
            ids, of, rest = (t.column(k).to_numpy() for k in ("rep", "component", "rest"))
            if len(ids) < 2 or not rest.any():
                continue
            linked = matrix(t.column("value").to_pylist()) & (of[:, None] != of[None, :]) & (rest[:, None] | rest[None, :])
            edges += blocks.stars(ids, linked)
            if len(edges) > 50_000:
                yield blocks.edge_batch(edges)
                edges = []
        yield blocks.edge_batch(edges)

    y = y.select(F.xxhash64("key", "__p.i", "__p.j").alias("block"), "rep", "component", "rest", "value")
    return blocks.by_block(y).mapInArrow(run, "a bigint, b bigint")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    if m <= 4:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    keep = np.bincount(col)[col] > 1
    row, col = row[keep], col[keep]
    out, width = np.zeros((m, m), np.float32), 8192
    if len(col):
        col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1])]))
        for c in range(0, int(col[-1]) + 1, width):
            a, b = np.searchsorted(col, [c, c + width])
            x = np.zeros((m, width), np.float32)
            x[row[a:b], col[a:b] - c] = 1
            out += x @ x.T
    return np.rint(out).astype(np.int64)


def _set_tests(percent: int):
    """Whether pairs of sets, and all pairs of a list of sets, are similar enough: for _complete and blocks."""

    def enough(n, m, both):
        return (100 * both >= percent * (n + m - both)) & (both > 0)

    def pairs_agree(x: list, y: list) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for i, (a, b) in enumerate(zip(x, y)):
            n, m = len(a) >> 3, len(b) >> 3
            if 100 * min(n, m) >= percent * max(n, m):
                out[i] = enough(n, m, len(np.intersect1d(np.frombuffer(a, _U), np.frombuffer(b, _U), assume_unique=True)))
        return out

    def matrix(values: list) -> np.ndarray:
        own = [np.frombuffer(b, _U) for b in values]
        n = np.array([len(s) for s in own])
        return enough(n[:, None], n[None, :], common_counts(own))

    return pairs_agree, matrix


def _confirmed_edges(docs: DataFrame, text: str, shingle: int, percent: int, clusters: DataFrame) -> DataFrame:
    """Edges that join all linked texts of each of clusters(node, component), confirmed on full sets."""
    size = clusters.groupBy("component").agg(F.count("*").alias("n"))
    wanted = cut(clusters.join(size, "component").withColumnRenamed("node", "doc_id"), "clusters")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))

    def sets_of(batches):
        for batch in batches:
            data, off = textops.buffer(textops.column(batch, "__text"))
            out = []
            for i, j in textops.chunks(off):
                out += [s.tobytes() for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())],
                names=["rep", "component", "n", "value"],
            )

    def sets(of: DataFrame) -> DataFrame:
        y = x.join(sized(of, of.count()), "doc_id").select("doc_id", "component", "n", "__text")
        return y.mapInArrow(sets_of, "rep bigint, component bigint, n bigint, value binary")

    pairs_agree, matrix = _set_tests(percent)

    def run(batches):
        edges = []
        for t in blocks.groups(batches, "block"):
            if len(t) < 2:
                continue
            edges += blocks.stars(t.column("rep").to_numpy(), matrix(t.column("value").to_pylist()))
            if len(edges) > 50_000:
                yield blocks.edge_batch(edges)
                edges = []
        yield blocks.edge_batch(edges)

    chunks = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / (BLOCK / 2.0))).otherwise(F.lit(1))
    dealt = sets(wanted).withColumn("block", F.xxhash64("component", F.pmod(F.xxhash64("rep", F.lit(77)), chunks)))
    edges = blocks.by_block(dealt.select("block", "rep", "value")).mapInArrow(run, "a bigint, b bigint")
    large = wanted.where(F.col("n") > BLOCK)
    if not large.take(1):
        return edges
    values = cut(sets(large).select("rep", "value"), "large-sets")
    wide = large.select(F.col("component").alias("key"), F.col("doc_id").alias("rep"))
    return _complete(wide, values, cut(edges, "chunk-links"), pairs_agree, matrix)


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest linked doc_id) and kept, for each row of docs."""
    sig = cut(describe(docs, text, shingle), "signatures")
    reps = (
        sig.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    )
    reps = cut(reps, "classes")
    n_reps = reps.count()
    clusters = components(_candidate_edges(reps.select("rep", "sig"), n_reps), "candidates")
    linked = components(_confirmed_edges(docs, text, shingle, percent, clusters), "links")
    of_class = reps.drop("sig").join(linked, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("n_shingles", "set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    key = ["n_shingles", "set_a", "set_b"]
    out = sig.drop("sig").join(sized(cut(of_class, "found"), 2 * n_reps), key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def dedup(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates() keeps."""
    gone = cut(near_duplicates(docs, text, shingle, percent).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(sized(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=4)


#: The same rows by joining all shingles.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT c.a, c.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2) c
  JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.r, d.doc_id) AS component_id, coalesce(least.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id"""
