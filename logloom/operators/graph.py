"""Link graphs, bounded closures, and the comparison of runs and versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import expr as X
from logloom.operators.ranges import places
from logloom.shared import cut, freed_shuffles


def resolve_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """links(source, target) with to_id: the last node (by id) whose normalised name is the target's; null is broken, self-links go."""
    names = nodes.groupBy(X.link_name(F.col("name")).alias("key")).agg(F.max("id").alias("to_id"))
    x = links.select("source", "target").distinct().withColumn("key", X.link_name(F.col("target")))
    x = x.join(names, "key", "left").drop("key")
    return x.where(F.col("to_id").isNull() | (F.col("to_id") != F.col("source")))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node of nodes(id): links in and out (distinct), broken ones, orphan (none in, none out), leaf (in, but none out)."""
    good = edges.where("to_id is not null").select("source", "to_id").distinct()
    inn = good.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_in"))
    out = good.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    bad = edges.where("to_id is null").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_broken"))
    x = nodes.select("id").join(inn, "id", "left").join(out, "id", "left").join(bad, "id", "left").fillna(0)
    return x.withColumn("orphan", (F.col("n_in") == 0) & (F.col("n_out") == 0)).withColumn(
        "leaf", (F.col("n_in") > 0) & (F.col("n_out") == 0)
    )


def closure(roots: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """(id, hop): what roots(id) reach over edges(source, to_id) within the hops, each with its smallest hop.

    One join and one anti-join per hop; the frontier holds new nodes only.
    """
    seen = cut(roots.select("id").distinct().withColumn("hop", F.lit(0)), "closure")
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(edges, F.col("id") == F.col("source")).select(F.col("to_id").alias("id")).distinct()
        front = cut(new.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "closure")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen


#: Why a link was not followed.
BROKEN, AGAIN, FULL, DEEP = "broken", "already-counted", "beyond-files", "beyond-hops"


#: Targets of a source that go together, and links that are followed at a time: this many, or some times all that there are.
PIECE, FOLLOWED = 1024, 100_000_000
_RANK = 1 << 40


def _targets(links: DataFrame) -> DataFrame:
    """(source, piece, targets): the to_id of each source's links in order of seq, PIECE of them a row; null where broken."""
    x = places(links.select("source", "seq", "to_id"), "source", ["seq", "to_id"])
    x = x.groupBy("source", F.floor(F.col("place") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("place", "to_id"))).alias("x"))
    return cut(x.select("source", "piece", F.col("x.to_id").alias("targets")), "reach-targets")


def closure_by_root(roots: DataFrame, links: DataFrame, hops: int = 5, files: int = 200) -> tuple[DataFrame, DataFrame]:
    """((root, id, hop), (root, reason, n)): what each of roots(id) reaches by links(source, seq, to_id), `files` ids at most beside itself, and why links were not followed.

    Hop by hop, and inside a hop by (source, seq), a new id counts while its root has room. Of the links of what was counted, each is followed or has one
    reason: a null to_id, an id counted before, no room, or no hop left. A source's targets come to a root as an array, are counted there, and leave one
    row per root; a share of the roots goes at a time, so that the links that meet never lie on disk together.
    """
    spark = roots.sparkSession
    one = roots.select(F.col("id").alias("root")).distinct()
    state = cut(one.select("root", F.array("root").alias("seen"), F.array("root").alias("front")), "reach")
    reached = [state.select("root", F.explode("front").alias("id"), F.lit(0).alias("hop"))]
    skips = []
    with freed_shuffles(spark):
        targets = _targets(links)
        n_links, n_sources = targets.agg(F.sum(F.size("targets")), F.countDistinct("source")).first()
        for hop in range(1, hops + 2):
            front = state.select("root", (F.lit(files + 1) - F.size("seen")).alias("room"), F.posexplode(F.array_sort("front")).alias("rank", "id"))
            if hop > hops:
                size = targets.groupBy(F.col("source").alias("id")).agg(F.sum(F.size("targets")).alias("n"))
                deep = front.join(size, "id").groupBy("root").agg(F.sum("n").alias("n"))
                skips.append(cut(deep.select("root", F.lit(DEEP).alias("reason"), "n"), "reach-skipped"))
                break
            n_front = state.agg(F.sum(F.size("front"))).first()[0] or 0
            if not n_front or not n_links:
                break
            meet = n_front * n_links / n_sources
            shares = max(1, round(meet / max(FOLLOWED, 4 * n_links)))
            tasks = 1 + int(meet / shares / 1_000_000)  # arrays are small before they are taken apart, so bytes don't tell
            done = [cut(_followed(state, front, targets, shares, k, tasks), "reach") for k in range(shares)]
            state = done[0]
            for more in done[1:]:
                state = state.unionByName(more)
            for reason in (BROKEN, AGAIN, FULL):
                skips.append(state.select("root", F.lit(reason).alias("reason"), F.col(reason).alias("n")))
            reached.append(state.select("root", F.explode("front").alias("id"), F.lit(hop).alias("hop")))
    seen, out = reached[0], spark.createDataFrame([], one.schema).select("root", F.lit("").alias("reason"), F.lit(0).cast("long").alias("n"))
    for more in reached[1:]:
        seen = seen.unionByName(more)
    for more in skips:
        out = out.unionByName(more)
    return seen, out.groupBy("root", "reason").agg(F.sum("n").cast("long").alias("n")).where("n > 0")


def _followed(state: DataFrame, front: DataFrame, targets: DataFrame, shares: int, k: int, tasks: int) -> DataFrame:
    """The next (root, seen, front) of one share of the roots, with the links of each reason."""
    mine = F.pmod(F.xxhash64("root"), F.lit(shares)) == k
    met = front.where(mine).join(targets.withColumnRenamed("source", "id"), "id")
    met = met.select("root", "room", (F.col("rank") * F.lit(_RANK) + F.col("piece") * PIECE).alias("start"), "targets")
    known = state.where(mine).select("root", F.lit(0).alias("room"), F.lit(None).cast("long").alias("start"), F.col("seen").alias("targets"))
    x = met.unionByName(known).repartition(tasks, "root")  # all that follows is within a root
    x = x.select("root", "room", "start", F.posexplode("targets").alias("at", "to_id"))
    x = x.groupBy("root", "to_id").agg(
        F.max("room").alias("room"), F.min(F.col("start") + F.col("at")).alias("first"), F.count("start").alias("links"), F.count_if(F.col("start").isNull()).alias("known")
    )
    fresh = F.col("to_id").isNotNull() & (F.col("known") == 0)
    x = x.withColumn("fresh", fresh).withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("fresh"), "first")))
    x = x.withColumn("taken", F.col("fresh") & (F.col("place") <= F.col("room")))
    total = lambda c, n="links": F.sum(F.when(c, F.col(n)).otherwise(0))
    return x.groupBy("root").agg(
        F.collect_list(F.when((F.col("known") > 0) | F.col("taken"), F.col("to_id"))).alias("seen"), F.collect_list(F.when(F.col("taken"), F.col("to_id"))).alias("front"),
        total(F.col("to_id").isNull()).alias(BROKEN), (total(F.col("known") > 0) + F.sum(F.when(F.col("taken"), F.col("links") - 1).otherwise(0))).alias(AGAIN),
        total(F.col("fresh") & ~F.col("taken")).alias(FULL),
    )


def set_comparison(a: DataFrame, b: DataFrame, name: str, count: str) -> DataFrame:
    """(name, a, b, side): counts of two runs side by side; side is both, only-a or only-b."""
    x = a.select(F.col(name).alias("__a"), F.col(count).alias("a")).join(
        b.select(F.col(name).alias("__b"), F.col(count).alias("b")), F.col("__a") == F.col("__b"), "full_outer"
    )
    side = F.when(F.col("__b").isNull(), "only-a").when(F.col("__a").isNull(), "only-b").otherwise("both")
    return x.select(
        F.coalesce("__a", "__b").alias(name), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), side.alias("side")
    )


def _equal_ends(a: list, b: list) -> tuple[int, int]:
    """Lengths of the common start and, after it, of the common end."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return lo, hi


def _next_row(y: list):
    """A step (row i + 1, x[i]) -> row i of the table of common subsequence lengths of x[i:] and y[j:]; bit len(y) - 1 - j is the gain from y[j]."""
    m, at, known = len(y), {}, {}
    for j, v in enumerate(y):
        at.setdefault(v, []).append(m - 1 - j)
    full = (1 << m) - 1

    def step(row: int, u) -> int:
        bits = at.get(u)
        if bits is None:
            return row
        mask = known.get(u)
        if mask is None:
            raw = bytearray(m // 8 + 1)
            for k in bits:
                raw[k >> 3] |= 1 << (k & 7)
            mask = int.from_bytes(raw, "little")
            if len(bits) > 64:
                known[u] = mask
        v = full ^ row
        hit = v & mask
        return full ^ (((v + hit) | (v - hit)) & full)

    return step


def lcs(a: list, b: list) -> list[tuple[str, int, int]]:
    """Steps of an alignment by longest common subsequence: ('both' | 'a' | 'b', index in a, index in b); ties prefer a alone.

    Equal ends are cut off first. The table has rows and bits for what both sides hold alone, as other steps never match. A row is kept for about every
    sqrt(rows)-th one, and those between are made again.
    """
    lo, hi = _equal_ends(a, b)
    all_a, all_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    shared = set(all_a).intersection(all_b)
    x, y = [s for s in all_a if s in shared], [s for s in all_b if s in shared]
    n, m, step = len(x), len(y), _next_row(y)
    every = max(1, int(n**0.5))
    saved, row = {n: 0}, 0
    for i in range(n - 1, -1, -1):
        row = step(row, x[i])
        if i % every == 0:
            saved[i] = row
    part: dict[int, int] = {}

    def row_of(i: int) -> int:
        if i in saved:
            return saved[i]
        if i not in part:
            part.clear()
            top = min(n, (i // every + 1) * every)
            r = saved[top]
            for k in range(top - 1, i - 1, -1):
                r = part[k] = step(r, x[k])
        return part[i]

    out = [("both", k, k) for k in range(lo)]
    i = j = at_a = at_b = 0
    here = row_of(0)
    below = row_of(1) if n else 0
    left = here.bit_count()  # of x[i:] and y[j:]
    skip_a = below.bit_count()  # of x[i + 1:] and y[j:]
    while at_a < len(all_a) or at_b < len(all_b):
        own_a, own_b = at_a < len(all_a) and all_a[at_a] not in shared, at_b < len(all_b) and all_b[at_b] not in shared
        if own_a:  # to leave it out costs nothing, and a alone comes first
            out.append(("a", lo + at_a, -1))
            at_a += 1
            continue
        gain = here >> (m - 1 - j) & 1 if j < m and not own_b else 0
        if i < n and j < m and not own_b and x[i] == y[j]:
            kind = "both"
        elif at_b == len(all_b) or i < n and skip_a >= left - gain:
            kind = "a"
        else:
            kind = "b"
        out.append((kind, lo + at_a if kind != "b" else -1, lo + at_b if kind != "a" else -1))
        at_a, at_b = at_a + (kind != "b"), at_b + (kind != "a")
        if kind == "b" and own_b:
            continue
        if kind != "a":
            left, skip_a = left - gain, skip_a - (below >> (m - 1 - j) & 1)
            j += 1
        if kind != "b":
            i += 1
            here, left = below, skip_a
            below = row_of(i + 1) if i < n else 0
            skip_a = (below & ((1 << (m - j)) - 1)).bit_count()
    out += [("both", len(a) - hi + k, len(b) - hi + k) for k in range(hi)]
    return out


def _paired_runs(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sa, sb): the signatures of both runs in order; null for a run without steps."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("seq", "signature"))), lambda s: s["signature"])
    runs = steps.groupBy("run").agg(seq.alias("s"))
    x = pairs.join(runs.select(F.col("run").alias("a"), F.col("s").alias("sa")), "a", "left")
    return x.join(runs.select(F.col("run").alias("b"), F.col("s").alias("sb")), "b", "left").select("a", "b", "sa", "sb")


#: Steps of a side that meet in one tile of an alignment.
TILE = 32_768
_TILE = "i int, j int, bits binary, carry binary, gained long, differs long"


def tile(x: list, y: list, bits: bytes | None, carry: bytes | None) -> tuple[bytes, bytes, int]:
    """One tile of the table of common subsequence lengths: rows x, columns y, the gains along its upper border and the carries along its left one (null for
    none) -> gains along the lower border, carries along the right one, and the number of gains."""
    m, at, known = len(y), {}, {}
    for j, v in enumerate(y):
        at.setdefault(v, []).append(j)
    full = (1 << m) - 1
    v = full ^ int.from_bytes(bits or b"", "little")
    left, right = int.from_bytes(carry or b"", "little"), bytearray(len(x) // 8 + 1)
    for k, u in enumerate(x):
        mask = known.get(u)
        if mask is None:
            raw = bytearray(m // 8 + 1)
            for p in at.get(u, ()):
                raw[p >> 3] |= 1 << (p & 7)
            mask = int.from_bytes(raw, "little")
            if len(at.get(u, ())) > 64:
                known[u] = mask
        hit = v & mask
        total = v + hit + (left >> k & 1 if left else 0)
        if total >> m:
            right[k >> 3] |= 1 << (k & 7)
        v = (total | (v ^ hit)) & full
    gains = full ^ v
    return gains.to_bytes(m // 8 + 1, "little"), bytes(right), gains.bit_count()


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence of two lists that fit one tile."""
    return tile(a, b, None, None)[2] if a and b else 0


def run_diffs(steps: DataFrame, pairs: DataFrame, most: int | None = None, short: int = 12, size: int | None = None) -> DataFrame:
    """Per row of pairs(a, b): the alignment of two runs' steps(run, seq, signature); `most` limits the steps of a side (flagged).

    Both runs are cut into blocks of `size` steps, and every two blocks are a tile. Tiles of one diagonal are computed side by side, and pass on only the bits
    along their borders, in a table; so the length is exact, and a task holds two blocks at a time, however long a run is.
    """
    size = size or TILE
    numbered = places(steps.select("run", "seq", "signature"), "run", ["seq", "signature"])
    lengths = numbered.groupBy("run").agg(F.count("*").alias("n"))
    if most is not None:
        numbered = numbered.where(F.col("place") < most)
    block = F.floor(F.col("place") / size).cast("int")
    blocks = numbered.groupBy("run", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "signature"))), lambda s: s["signature"]).alias("s"))
    blocks = cut(blocks, "run-blocks")  # of `size` steps
    side = lambda k: lengths.select(F.col("run").alias(k), F.col("n").alias(f"all_{k}"))
    x = pairs.select("a", "b").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left").fillna(0, ["all_a", "all_b"])
    kept = lambda c: F.least(F.col(c), F.lit(most)) if most is not None else F.col(c)
    x = x.withColumns({"na": kept("all_a").cast("int"), "nb": kept("all_b").cast("int")})
    x = cut(x.withColumns({"ta": F.ceil(F.col("na") / size).cast("int"), "tb": F.ceil(F.col("nb") / size).cast("int")}), "run-pairs")
    ends = x.where("ta > 0 and tb > 0").agg(F.max(F.col("ta") + F.col("tb"))).first()[0] or 0
    key = {c: pairs.schema[c].dataType.simpleString() for c in ("a", "b")}

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                sa, sb = list(r.sa), list(r.sb)
                bits, carry, n = tile(sa, sb, r.bits, r.carry)
                off = next((k for k, (p, q) in enumerate(zip(sa, sb)) if p != q), None) if r.i == r.j else None
                rows.append((r.a, r.b, r.i, r.j, bits, carry, n, None if off is None else r.i * size + off))
            out = pd.DataFrame(rows, columns=["a", "b", *[c.split()[0] for c in _TILE.split(", ")]])
            yield out.astype({"differs": "Int64"})

    done, waves = None, []
    for d in range(max(0, ends - 1)):
        i = F.explode(F.sequence(F.greatest(F.lit(0), d - F.col("tb") + 1), F.least(F.lit(d), F.col("ta") - 1)))
        t = x.where((F.col("ta") > 0) & (F.col("tb") > 0) & (F.col("ta") + F.col("tb") - 2 >= d)).select("a", "b", i.alias("i")).withColumn("j", d - F.col("i"))
        t = t.join(blocks.select(F.col("run").alias("a"), F.col("block").alias("i"), F.col("s").alias("sa")), ["a", "i"])
        t = t.join(blocks.select(F.col("run").alias("b"), F.col("block").alias("j"), F.col("s").alias("sb")), ["b", "j"])
        if done is None:
            t = t.withColumns({"bits": F.lit(None).cast("binary"), "carry": F.lit(None).cast("binary")})
        else:
            t = t.join(done.select("a", "b", (F.col("i") + 1).alias("i"), "j", "bits"), ["a", "b", "i", "j"], "left")
            t = t.join(done.select("a", "b", "i", (F.col("j") + 1).alias("j"), "carry"), ["a", "b", "i", "j"], "left")
        t = t.select("a", "b", "i", "j", "sa", "sb", "bits", "carry").repartition("a", "b", "i")
        done = cut(t.mapInPandas(run, f"a {key['a']}, b {key['b']}, {_TILE}"), "run-tiles")
        waves.append(done.select("a", "b", "i", "gained", "differs"))
    out = x
    if waves:
        every = waves[0]
        for w in waves[1:]:
            every = every.unionByName(w)
        every = every.join(x.select("a", "b", "ta"), ["a", "b"])
        every = every.groupBy("a", "b").agg(F.sum(F.when(F.col("i") == F.col("ta") - 1, F.col("gained"))).alias("aligned"), F.min("differs").alias("differs"))
        out = x.join(every, ["a", "b"], "left")
    else:
        out = x.withColumns({"aligned": F.lit(0).cast("long"), "differs": F.lit(None).cast("long")})
    shorter, longest = F.least("na", "nb"), F.greatest("na", "nb")
    first = F.coalesce(F.col("differs"), F.when(F.col("na") != F.col("nb"), shorter)).cast("int")
    aligned = F.coalesce("aligned", F.lit(0)).cast("int")
    cut_off = (F.greatest("all_a", "all_b") > most) if most is not None else F.lit(False)
    out = out.select(
        "a", "b", F.col("na").alias("steps_a"), F.col("nb").alias("steps_b"), aligned.alias("aligned"), first.alias("first_divergence"),
        F.when(longest > 0, aligned / longest).otherwise(1.0).alias("similarity"), (longest < short).alias("short_run"), cut_off.alias("truncated"),
    )
    return pairs.join(out, ["a", "b"])


def run_steps(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The aligned steps of each pair of runs in order: (a, b, position, side: both, a or b; index_a, index_b, signature); see lcs()."""
    x, kind = _paired_runs(steps, pairs), pairs.schema["a"].dataType.simpleString()
    names = ["a", "b", "position", "side", "index_a", "index_b", "signature"]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                sa, sb = ([] if s is None else list(s) for s in (r.sa, r.sb))
                rows = [(r.a, r.b, k, side, i, j, sa[i] if i >= 0 else sb[j]) for k, (side, i, j) in enumerate(lcs(sa, sb))]
                out = pd.DataFrame(rows, columns=names)
                yield out.assign(**{c: out[c].where(out[c] >= 0).astype("Int32") for c in ("index_a", "index_b")})

    return x.mapInPandas(run, f"a {kind}, b {kind}, position int, side string, index_a int, index_b int, signature string")


def version_diffs(versions: DataFrame, cells: int | None = None, context: int = 3, hunk_lines: int = 20_000) -> DataFrame:
    """Each version against the next of its chain: versions(chain, version, text) -> added, removed, unchanged, hunks, wholesale, truncated.

    Where a limit of cells is given, pairs above it after their equal ends are cut off count as replaced whole, with unchanged null.
    """
    x = _consecutive(versions)
    kind = versions.schema["chain"].dataType.simpleString()
    schema = (
        f"chain {kind}, version int, next_version int, added int, removed int, unchanged int, hunks int, wholesale boolean, truncated boolean"
    )

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a, b = (r.text or "").split("\n"), (r.next_text or "").split("\n")
                lo, hi = _equal_ends(a, b)
                na, nb = len(a) - lo - hi, len(b) - lo - hi
                if cells is not None and na * nb > cells:
                    rows.append((r.chain, r.version, r.next_version, nb, na, None, 1, True, na + nb > hunk_lines))
                    continue
                steps = lcs(a, b)
                changed = [k for k, s in enumerate(steps) if s[0] != "both"]
                hunks = sum(1 for p, q in zip([-(10**9), *changed], changed) if q - p > 2 * context + 1)
                shown = len(set().union(*(range(max(0, k - context), min(len(steps), k + context + 1)) for k in changed))) if changed else 0
                rows.append(
                    (r.chain, r.version, r.next_version, sum(s[0] == "b" for s in steps), sum(s[0] == "a" for s in steps),
                     sum(s[0] == "both" for s in steps), hunks, False, shown > hunk_lines)
                )
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out.astype({"unchanged": "Int32"})

    return x.mapInPandas(run, schema)


def _consecutive(versions: DataFrame) -> DataFrame:
    """(chain, version, next_version, text, next_text). Only numbers are ordered within a chain; texts then meet by (chain, version)."""
    w = Window.partitionBy("chain").orderBy("version")
    order = versions.select("chain", "version", F.lead("version").over(w).alias("next_version")).where("next_version is not null")
    x = order.join(versions.select("chain", "version", "text"), ["chain", "version"])
    after = versions.select("chain", F.col("version").alias("next_version"), F.col("text").alias("next_text"))
    return x.join(after, ["chain", "next_version"]).select("chain", "version", "next_version", "text", "next_text")


#: Lines that leave a task together.
HUNK_ROWS = 20_000


def version_hunks(versions: DataFrame, context: int = 3) -> DataFrame:
    """The lines of each change from a version to the next of its chain, with `context` equal lines around: (chain, version, next_version, hunk, position,
    side: both, a (removed) or b (added); line_a, line_b from 1, text). Changes whose contexts touch are one hunk; all lines come, whatever their number."""
    kind = versions.schema["chain"].dataType.simpleString()
    names = ["chain", "version", "next_version", "hunk", "position", "side", "line_a", "line_b", "text"]

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        return out.assign(**{c: out[c].where(out[c] > 0).astype("Int32") for c in ("line_a", "line_b")})

    def run(batches):
        rows = []
        for pdf in batches:
            for r in pdf.itertuples():
                a, b = (r.text or "").split("\n"), (r.next_text or "").split("\n")
                steps, hunk, shown = lcs(a, b), -1, -1
                changed = [k for k, s in enumerate(steps) if s[0] != "both"]
                for k in changed:
                    begin = max(0, k - context)
                    hunk += begin > shown or hunk < 0
                    for p in range(max(begin, shown), min(len(steps), k + context + 1)):
                        side, i, j = steps[p]
                        rows.append((r.chain, r.version, r.next_version, hunk, p, side, i + 1, j + 1, a[i] if i >= 0 else b[j]))
                        shown = p + 1
                if len(rows) > HUNK_ROWS:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    return _consecutive(versions).mapInPandas(
        run, f"chain {kind}, version int, next_version int, hunk int, position int, side string, line_a int, line_b int, text string"
    )
