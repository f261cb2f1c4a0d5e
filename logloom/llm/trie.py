"""The prefix trie of conversations, from sorted order.

Conversations are cut into pieces of 64 turns. Pieces with equal turns before them form a group; the pieces of all groups are sorted in ranges, by turn
digests, and neighbours in a group are joined by an edge as deep as their longest common prefix. Inside a range, union-find takes the edges in
descending depth, and each merge of components makes a branching node. What touches a range's ends is contracted to at most one component per depth
and side; these forests are put side by side, many ranges at a time, and merged by the same union-find until nothing is open. Unary chains are never
stored: a component stands for the nodes between the depth where it ends and the depth where it merges.

Sums over a node's subtree are sums over its members: what a row shares with the row before it in sorted order, and whether it ends a leaf.
Only conversations above one piece need these added up over their later pieces.

Defined results: rows without a conv_id go. Turns are in the order of turn (null first); the same turn twice is ordered by role, then by the text's SHA-256, and repeated rows
are turns of their own. A null role or text is empty. Two turns are equal if role and text are. No conversation: no node, not even a root. `c % 5` has the
sign of c. Extra columns are not read. The hash of the conversations that end at one node is a pass over their ids in one task, streamed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.blocks import by_block, groups
from logloom.llm.columns import quoted
from logloom.shared import cut, sized

#: Turns of a piece; bytes that stand for a turn.
PIECE, WIDTH = 64, 16
#: Turns of a conversation that meet one row of its own figures in a join, pieces that are added up at a time.
SLOT = 4096
#: Pieces of one sorted range, and ranges whose open components are merged at a time.
RANGE, FAN = 8192, 256
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


# --- turns ----------------------------------------------------------------------------------------------------


def ordered(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, tok, bytes): each turn's place in its conversation (from 1), a digest of role and text, and the text's size. Sorted in ranges, so one conversation may span many."""
    body, who = F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), F.coalesce(F.col(quoted(role)).cast("string"), F.lit(""))
    x = conversations.select(
        F.col(quoted(id)).cast("long").alias("c"), F.col(quoted(turn)).alias("turn"), who.alias("role"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"),
    ).where("c is not null")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    x = cut(x.repartitionByRange(F.asc("c"), *order).withColumn("range", F.spark_partition_id()), "trie-turns")
    counts = x.groupBy("c", "range").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.withColumn("ahead", earlier).where("ahead > 0").select("c", "range", "ahead")  # at most one row per range
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("range", "c").orderBy(*order))).join(F.broadcast(ahead), ["c", "range"], "left")
    tok = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "digest"), 256), 1, 2 * WIDTH)
    return x.select("c", (F.col("r") + F.coalesce("ahead", F.lit(0))).alias("pos"), tok.alias("tok"), "bytes")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ordered() turns as they are: (c, d, tok, bytes) with d from 0, and (c, m) with the number of turns."""
    return turns.select("c", (F.col("pos") - 1).alias("d"), "tok", "bytes"), turns.groupBy("c").agg(F.count("*").alias("m"))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """whole() of conversations whose first crc32(c) % heads turns are those of the first conversation of their family (c - c % family)."""
    lengths = turns.groupBy("c").agg(F.count("*").alias("n"))
    convs = lengths.select("c", "n", (F.crc32(F.col("c").cast("string")) % heads).alias("h"), (F.col("c") - F.col("c") % family).alias("b"))
    base = lengths.select(F.col("c").alias("b"), F.col("n").alias("nb"))
    convs = convs.join(base, "b", "left").withColumn("k", F.least("h", F.coalesce("nb", F.lit(0))))
    convs = convs.select("c", "b", "h", "k", "n", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("m"))
    first = turns.where((F.col("pos") < heads) & (F.col("c") % family == 0)).withColumnRenamed("c", "b")
    taken = convs.select("c", "b", "h").join(first, "b").where("pos <= h").select("c", (F.col("pos") - 1).alias("d"), "tok", "bytes")
    slots = convs.where("n > h").select("c", "h", "k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SLOT).cast("int"))).alias("slot"))
    own = turns.withColumn("slot", F.floor((F.col("pos") - 1) / SLOT).cast("int")).join(slots, ["c", "slot"]).where("pos > h")
    return taken.unionByName(own.select("c", (F.col("pos") - 1 - F.col("h") + F.col("k")).alias("d"), "tok", "bytes")), convs.select("c", "m")


# --- pieces ---------------------------------------------------------------------------------------------------


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def _over_pieces(rows: DataFrame, names: dict[str, str], fold, forward: bool) -> DataFrame:
    """rows(c, p, ...) with each of names: fold over a conversation's pieces before this one (forward), or from this one on."""
    x = rows.withColumn("__b", F.floor(F.col("p") / SLOT).cast("long"))
    turn = (lambda c: F.asc(c)) if forward else (lambda c: F.desc(c))
    inner = Window.partitionBy("c", "__b").orderBy(turn("p")).rowsBetween(Window.unboundedPreceding, -1 if forward else 0)
    outer = Window.partitionBy("c").orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("c", "__b").agg(*[fold(c).alias(f"__t_{k}") for k, c in names.items()])
    blocks = blocks.select("c", "__b", *[fold(f"__t_{k}").over(outer).alias(f"__o_{k}") for k in names])
    x = x.join(blocks.where("__b > 0") if forward else blocks, ["c", "__b"], "left")
    both = {"bit_xor": lambda a, b: a.bitwiseXOR(b)}.get(fold.__name__, lambda a, b: a + b)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return x.withColumns({k: both(zero(fold(c).over(inner)), zero(F.col(f"__o_{k}"))) for k, c in names.items()}).drop("__b", *[f"__o_{k}" for k in names])


def pieces(turns: DataFrame, lengths: DataFrame, piece: int = PIECE) -> DataFrame:
    """(p, g1, g2, key, c, last, n1, n2, endkey, sizes): each conversation's pieces. g1 and g2 stand for all turns before the piece, n1 and n2 for
    those up to its end; every conversation ends in a piece that is not full, and endkey stands for the whole of it."""
    end = lengths.select("c", F.col("m").alias("d"), F.lit("").alias("tok"), F.lit(0).cast("long").alias("bytes"))
    x = turns.unionByName(end).withColumn("p", F.floor(F.col("d") / piece).cast("long"))
    x = x.groupBy("c", "p").agg(F.array_sort(F.collect_list(F.struct("d", "tok", "bytes"))).alias("t"))  # at most `piece` turns
    hexed = F.array_join("t.tok", "")
    x = x.select("c", "p", hexed.alias("hexed"), (F.element_at("t", -1)["tok"] == "").alias("last"), F.filter(F.transform("t", lambda e: F.when(e["tok"] != "", e["bytes"])), lambda e: e.isNotNull()).alias("sizes"))
    digest = F.sha2(F.concat(F.col("p").cast("string"), F.lit("/"), "hexed"), 256)
    one, many = x.where("p = 0 and last"), cut(x.where("p > 0 or not last"), "trie-pieces")
    none = F.lit(0).cast("long")
    many = many.withColumns({"d1": F.when(~F.col("last"), _half(digest, 1)), "d2": F.when(~F.col("last"), _half(digest, 16))})
    many = _over_pieces(many, {"g1": "d1", "g2": "d2"}, F.bit_xor, True)
    many = many.withColumns({"n1": F.col("g1").bitwiseXOR(F.col("d1")), "n2": F.col("g2").bitwiseXOR(F.col("d2"))}).drop("d1", "d2")
    one = one.withColumns({"g1": none, "g2": none, "n1": none.cast("long"), "n2": none.cast("long")})
    x = one.unionByName(many)
    whole_digest = F.sha2(F.concat_ws("/", F.col("p").cast("string"), F.col("g1").cast("string"), F.col("g2").cast("string"), "hexed"), 256)
    return x.select("p", "g1", "g2", F.unhex("hexed").alias("key"), "c", "last", "n1", "n2", F.when(F.col("last"), F.substring(whole_digest, 1, 32)).alias("endkey"), "sizes")


def sorted_ranges(x: DataFrame) -> DataFrame:
    """pieces() in sorted ranges: `seg` and `idx` are the range and the place in it. Each range also holds its neighbours' nearest rows (idx -1, and 2^40)."""
    order = ["p", "g1", "g2", "key", "c"]
    x = cut(x, "trie-unsorted")
    n = max(1, -(-x.count() // RANGE))
    at = F.monotonically_increasing_id()
    x = x.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"seg": F.spark_partition_id().cast("long"), "idx": at.bitwiseAND(F.lit((1 << 33) - 1))})
    x = cut(x, "trie-sorted")
    ends = x.groupBy("seg").agg(F.max("idx").alias("top"))  # one row per range
    beside = Window.partitionBy(F.lit(0)).orderBy("seg")
    ends = cut(ends.withColumns({"before": F.lag("seg").over(beside), "after": F.lead("seg").over(beside)}), "trie-ends")
    heads = x.join(F.broadcast(ends.where("before is not null").select("seg", "before", F.lit(0).cast("long").alias("idx"))), ["seg", "idx"])
    tails = x.join(F.broadcast(ends.where("after is not null").select("seg", "after", F.col("top").alias("idx"))), ["seg", "idx"])
    heads = heads.withColumns({"seg": F.col("before"), "idx": F.lit(1 << 40)}).drop("before")
    tails = tails.withColumns({"seg": F.col("after"), "idx": F.lit(-1).cast("long")}).drop("after")
    return x.unionByName(heads).unionByName(tails)


# --- one range ------------------------------------------------------------------------------------------------


def _common(t: pa.Table, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of turns of each row of a sorted table, and for each row but the last the turns it has in common with the next, -1 across groups."""
    keys = t.column("key").combine_chunks().cast(pa.large_binary())
    off = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    size = np.diff(off) // WIDTH
    table = np.zeros((len(keys), piece, WIDTH), np.uint8)
    if off[-1] > off[0]:
        data = np.frombuffer(keys.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, WIDTH)
        row = np.repeat(np.arange(len(keys)), size)
        table[row, np.arange(len(row)) - np.repeat((off[:-1] - off[0]) // WIDTH, size)] = data
    words = table.reshape(len(keys), piece, WIDTH).view(np.uint64)
    same = (words[1:] == words[:-1]).all(axis=2) & (np.arange(piece) < np.minimum(size[1:], size[:-1])[:, None])
    common = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    for name in ("p", "g1", "g2"):
        v = t.column(name).to_numpy()
        common[v[1:] != v[:-1]] = -1
    return size, common


def _shares(t: pa.Table, piece: int):
    """For the rows of a range with its neighbours: (own rows, sizes, gaps before and after each own row, bytes shared with the row before, whether a leaf ends)."""
    idx = t.column("idx").to_numpy()
    size, common = _common(t, piece)
    a, b = int(idx[0] == -1), len(idx) - int(idx[-1] == 1 << 40)
    gaps = np.concatenate([[-1] if a == 0 else [], common[max(0, a - 1) : b], [-1] if b == len(idx) else []]).astype(np.int64)
    own, size = t.slice(a, b - a), size[a:b]
    sizes = own.column("sizes").to_pylist()
    pre = [[0, *np.cumsum(s).tolist()] for s in sizes]
    shared = [x[max(0, g)] for x, g in zip(pre, gaps[:-1].tolist())]
    leaf = own.column("last").to_numpy(zero_copy_only=False).astype(bool) & (gaps[1:] < size)
    return own, size, gaps, pre, shared, leaf.astype(np.int64)


def _later(x: DataFrame, piece: int) -> DataFrame:
    """sorted_ranges() with `more` and `leaves`: bytes shared and leaves ended in this and all later pieces, for conversations above one piece."""
    nothing = F.lit(None).cast("long")
    one = x.where("p = 0 and last").withColumns({"more": nothing, "leaves": nothing})
    many = x.where("p > 0 or not last")

    def step(batches):
        for t in groups(batches, "seg"):
            own, _, _, _, shared, leaf = _shares(t, piece)
            long = (own.column("p").to_numpy() > 0) | ~own.column("last").to_numpy(zero_copy_only=False).astype(bool)
            if long.any():
                at = np.flatnonzero(long)
                yield pa.RecordBatch.from_arrays([*(own.column(k).combine_chunks().take(pa.array(at)) for k in ("c", "p")), pa.array(np.array(shared, np.int64)[at]), pa.array(leaf[at])], names=["c", "p", "shared", "leaf"])

    found = x.repartition("seg").sortWithinPartitions("seg", "idx").mapInArrow(step, "c long, p long, shared long, leaf long")
    found = _over_pieces(cut(found, "trie-shared"), {"more": "shared", "leaves": "leaf"}, F.sum, False)
    return one.unionByName(many.join(found.select("c", "p", "more", "leaves"), ["c", "p"]))


class Item:
    """A component while it grows: members, what they add up to, and what is known of its node at `level`."""

    __slots__ = ("level", "n", "low", "more", "leaves", "kids", "endkey", "place", "pre", "shared", "next", "below", "gap")

    def __init__(self, level, n, low, more, leaves, kids, endkey, place, pre, shared, next, below, gap):
        self.level, self.n, self.low, self.more, self.leaves, self.kids, self.endkey = level, n, low, more, leaves, kids, endkey
        self.place, self.pre, self.shared, self.next, self.below, self.gap = place, pre, shared, next, below, gap


_SCHEMA = pa.schema([
    ("kind", pa.string()), ("seg", pa.int64()), ("idx", pa.int64()), ("p", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
    ("owner", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("more", pa.int64()), ("shared", pa.int64()), ("endkey", pa.string()),
    ("n1", pa.int64()), ("n2", pa.int64()), ("pre", pa.list_(pa.int64())), ("up", pa.int64()), ("ref", pa.int64()), ("gap", pa.int64()), ("right", pa.int64()),
])
_DDL = (
    "kind string, seg long, idx long, p long, g1 long, g2 long, a long, b long, owner long, n long, kids long, leaves long, more long, shared long, "
    "endkey string, n1 long, n2 long, pre array<long>, up long, ref long, gap long, right long"
)


def _solve(items: list[Item], right: int, out: list[dict], new_ref):
    """Union-find over the gaps between items, deepest first: closed components go to out, and what is open at either end is returned, contracted.

    A gap is kept open where it is less than all gaps on one of its sides: components across it may grow beyond the range. Rows of out that wait
    for their parent's owner, and references of earlier rounds, hang below their component until it closes.
    """
    n = len(items)
    gaps = [x.gap for x in items] + [right]
    keep, low = [g < 0 for g in gaps], 1 << 60
    for i in range(n + 1):
        if gaps[i] < low:
            keep[i], low = True, gaps[i]
    low = 1 << 60
    for i in reversed(range(n + 1)):
        if gaps[i] < low:
            keep[i], low = True, gaps[i]

    def row(x: Item, kind: str, a: int) -> dict:
        p, g1, g2 = x.place
        return dict(kind=kind, p=p, g1=g1, g2=g2, a=a, b=x.level, owner=x.low, n=x.n, kids=x.kids, leaves=x.leaves, more=x.more, shared=x.shared, endkey=x.endkey, n1=x.next[0], n2=x.next[1], pre=x.pre)

    def settle(x: Item) -> None:
        for r in x.below:
            r["up"] = x.low

    def close(x: Item, depth: int) -> None:
        """The component's nodes below depth are known; one child of the node at depth is left."""
        if x.level > depth:
            done = row(x, "node", depth)
            settle(x)
            out.append(done)
            x.level, x.kids, x.endkey, x.next, x.below = depth, 1, None, (None, None), [done]

    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in sorted((i for i in range(n + 1) if not keep[i]), key=lambda i: -gaps[i]):
        i, j = find(i - 1), find(i)
        x, y, depth = items[i], items[j], gaps[j]
        close(x, depth)
        close(y, depth)
        x.n, x.low, x.more, x.leaves, x.kids = x.n + y.n, min(x.low, y.low), x.more + y.more, x.leaves + y.leaves, x.kids + y.kids
        if len(x.below) < len(y.below):
            x.below, y.below = y.below, x.below
        x.below += y.below
        top[j] = i
    left = []
    starts = [i for i in range(n) if top[i] == i]
    for i, after in zip(starts, [*starts[1:], n]):
        x, edge = items[i], max(gaps[i], gaps[after])
        if edge < 0:  # a whole group
            close(x, 0)
            settle(x)
            out.append(row(x, "node", -1))
            continue
        close(x, edge)
        ref = new_ref()
        for r in x.below:
            r["ref"] = ref
        out.append(row(x, "item", -1) | {"gap": gaps[i], "right": gaps[after], "ref": ref})
        left.append(x)
    return left


def _emit(out: list[dict], seg: int):
    for k in range(0, len(out), 4096):
        rows = out[k : k + 4096]
        yield pa.RecordBatch.from_pylist([{"seg": seg, "idx": k + i} | r for i, r in enumerate(rows)], schema=_SCHEMA)


def _counter(round_: int, seg: int):
    n = iter(range(1 << 12))
    return lambda: round_ << 52 | seg << 12 | next(n)


def _forest(x: DataFrame, piece: int) -> DataFrame:
    """The closed components of each range, and its open ones."""

    def step(batches):
        for t in groups(batches, "seg"):
            own, size, gaps, pre, shared, leaf = _shares(t, piece)
            if not len(own):
                continue
            seg = own.column("seg")[0].as_py()
            cols = {k: own.column(k).to_pylist() for k in ("p", "g1", "g2", "c", "n1", "n2", "endkey", "more", "leaves")}
            items = []
            for i in range(len(own)):
                more, leaves = cols["more"][i], cols["leaves"][i]
                place = (cols["p"][i], cols["g1"][i], cols["g2"][i])
                items.append(Item(
                    int(size[i]), 1, cols["c"][i], shared[i] if more is None else more, int(leaf[i]) if leaves is None else leaves, 0, cols["endkey"][i], place, pre[i],
                    shared[i], (cols["n1"][i], cols["n2"][i]), [], int(gaps[i]),
                ))
            out: list[dict] = []
            _solve(items, int(gaps[-1]), out, _counter(0, seg))
            yield from _emit(out, seg)

    return x.repartition("seg").sortWithinPartitions("seg", "idx").mapInArrow(step, _DDL)


def _merge(open_items: DataFrame, round_: int) -> DataFrame:
    """Open components of FAN neighbouring ranges, merged: nodes, references to what became of the items ("map"), and what stays open."""
    x = open_items.withColumn("block", F.floor(F.col("seg") / FAN).cast("long"))

    def step(batches):
        for t in groups(batches, "block"):
            rows = t.to_pylist()
            block, out, items = rows[0]["block"], [], []
            for r in rows:
                hook = {"kind": "map", "seg": r["ref"]}
                out.append(hook)
                items.append(Item(r["b"], r["n"], r["owner"], r["more"], r["leaves"], r["kids"], r["endkey"], (r["p"], r["g1"], r["g2"]), r["pre"], r["shared"], (r["n1"], r["n2"]), [hook], r["gap"]))
            _solve(items, rows[-1]["right"], out, _counter(round_, block))
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_pylist([r if r["kind"] == "map" else {"seg": block, "idx": k + i} | r for i, r in enumerate(out[k : k + 4096])], schema=_SCHEMA)

    return x.repartition("block").sortWithinPartitions("block", "seg", "idx").mapInArrow(step, _DDL)


def components(x: DataFrame, piece: int = PIECE) -> DataFrame:
    """All components of the sorted pieces, with the owner of the node above each (`up`; null for roots)."""
    first = cut(_forest(x, piece), "trie-forest")
    tables, round_ = [first], 0
    while (n := tables[-1].where("kind = 'item'").count()) > 0:
        round_ += 1
        tables.append(cut(_merge(tables[-1].where("kind = 'item'"), round_), "trie-merge"))
    known, out = None, None
    for t in reversed(tables):  # the last round's references have owners; each round before asks the one after it
        rows = t.where("kind <> 'item'")
        if known is not None:
            names = known.select(F.col("seg").alias("ref"), F.col("up").alias("owner_above"))
            waiting = rows.where("up is null and ref is not null").join(sized(names, sizes), "ref")
            rows = rows.where("up is not null or ref is null").unionByName(waiting.withColumn("up", F.col("owner_above")).select(rows.columns))
        known, sizes = rows.where("kind = 'map'"), t.where("kind = 'map'").count() if t is not first else 0
        nodes = rows.where("kind = 'node'")
        out = nodes if out is None else out.unionByName(nodes)
    return out


# --- nodes ----------------------------------------------------------------------------------------------------


def end_hashes(x: DataFrame) -> DataFrame:
    """(endkey, ends): the hash of the ids of the conversations that are one sequence, in order; streamed."""

    def step(batches):
        key, h, keys, sums = None, None, [], []

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["endkey", "ends"])
            keys.clear()
            sums.clear()
            return b

        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k == key:
                    h.update(b",%d" % c)
                    continue
                if key is not None:
                    keys.append(key)
                    sums.append(h.hexdigest())
                key, h = k, hashlib.sha256(b"%d" % c)
            if len(keys) >= 4096:
                yield flush()
        if key is not None:
            keys.append(key)
            sums.append(h.hexdigest())
            yield flush()

    return x.where("last").select("endkey", "c").repartition("endkey").sortWithinPartitions("endkey", "c").mapInArrow(step, "endkey string, ends string")


def trie(turns: DataFrame, lengths: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of turns(c, d, tok, bytes), with lengths(c, m): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    x = sorted_ranges(pieces(turns, lengths, piece))
    if x.where("p > 0").limit(1).count():
        x = cut(_later(x, piece), "trie-later")
    else:
        x = x.withColumns({"more": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long")})
    parts = cut(components(x, piece), "trie-components")
    # The node at the end of a full piece gets its children, and the conversations that end there, from the group that goes on behind it.
    roots = parts.where("a = -1 and p > 0").select((F.col("p") - 1).alias("p"), F.col("g1").alias("n1"), F.col("g2").alias("n2"), F.col("kids").alias("k"), F.col("endkey").alias("e"))
    nodes = parts.where("a >= 0 or p = 0")
    short = nodes.where(F.col("b") < piece)
    full = nodes.where(F.col("b") == piece).drop("kids", "endkey").join(roots, ["p", "n1", "n2"])
    nodes = short.unionByName(full.withColumnsRenamed({"k": "kids", "e": "endkey"}))
    own = x.where((F.col("idx") >= 0) & (F.col("idx") < 1 << 40))
    ended = nodes.where("endkey is not null").join(end_hashes(own), "endkey")
    nodes = ended.unionByName(nodes.where("endkey is null").withColumn("ends", F.lit(EMPTY_HASH)))
    d = F.col("d")
    nodes = nodes.withColumn("d", F.explode(F.sequence(F.col("a") + 1, F.col("b"))))
    before = F.when(d > 0, F.get("pre", (d - 1).cast("int"))).otherwise(F.lit(0))
    return nodes.select(
        F.col("owner").alias("conv_id"), (F.col("p") * piece + d).alias("depth"), F.when(d > F.col("a") + 1, F.col("owner")).otherwise(F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(d == F.col("b"), F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("more") - F.col("shared") - (F.col("n") - 1) * before).alias("saved_tokens"), F.when(d == F.col("b"), F.col("ends")).otherwise(EMPTY_HASH).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the rebuilt conversations' trie."""
    return trie(*rebuilt(ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: crc32 bit by bit; nodes are told apart by running hashes of their turns.
OP13_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS v
  FROM (SELECT DISTINCT c FROM t)
), k AS (SELECT c, c - c % 5 AS b, xor(v, 4294967295) % 9 AS h FROM crc),
r AS (
  SELECT k.c, t.pos AS d, t.role, t.text FROM k JOIN t ON t.c = k.b AND t.pos <= k.h
  UNION ALL
  SELECT k.c, t.pos - k.h + least(k.h, coalesce(n.n, 0)), t.role, t.text
  FROM k JOIN t ON t.c = k.c AND t.pos > k.h LEFT JOIN (SELECT c, count(*) AS n FROM t GROUP BY c) n ON n.c = k.b
), x AS (
  SELECT c, 0 AS d, '' AS key, 0 AS bytes FROM k
  UNION ALL
  SELECT c, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d), strlen(text) FROM r
), y AS (SELECT c, d, sha256(key) AS key, lag(sha256(key)) OVER (PARTITION BY c ORDER BY d) AS up, bytes, d = max(d) OVER (PARTITION BY c) AS ends FROM x),
g AS (
  SELECT d, key, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM y GROUP BY d, key
), kids AS (SELECT up AS key, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY up),
first AS (SELECT y.c, y.d, y.key, g.n, g.bytes, g.conv_id = y.c AS owns, kids.n IS NULL AS leaf FROM y JOIN g USING (d, key) LEFT JOIN kids USING (key)),
sums AS (
  SELECT d, key, c, sum(CASE WHEN owns THEN (n - 1) * bytes ELSE 0 END) OVER w AS saved, sum(CASE WHEN owns AND leaf THEN 1 ELSE 0 END) OVER w AS leaves
  FROM first WINDOW w AS (PARTITION BY c ORDER BY d DESC)
), total AS (SELECT d, key, sum(saved)::BIGINT AS saved, sum(leaves)::BIGINT AS leaves FROM sums GROUP BY d, key)
SELECT g.conv_id, g.d::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n AS n_convs, coalesce(kids.n, 0) AS n_children, total.leaves AS n_leaves,
       total.saved AS saved_tokens, g.ends_sha256
FROM g JOIN total USING (d, key) LEFT JOIN kids ON kids.key = g.key LEFT JOIN g u ON u.key = g.up
"""
