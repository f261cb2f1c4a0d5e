"""Exact removal of repeated passages: each byte covered by a WINDOW-byte string that also starts earlier.

Every window picks an anchor: the GRAM bytes inside it with the smallest hash (the leftmost of equals). Equal windows
pick equal anchors at equal places, so they meet when rows are dealt by anchor. A run of windows with one anchor is one row: its
fragment (the bytes the run covers) as a hash, and where it lies. Fragments with equal hashes have all windows in common, so all but the
earliest repeat; within a batch this is settled before anything shuffles, and a passage that stands in many documents is one row per batch. Anchors
with several different fragments have their fragments' bytes fetched (first places only); suffix arrays of these, built by
Lyndon grouping (suffixes.py), bring equal windows together, and again all but the earliest repeat. Fragments of very common anchors first part by
the bytes beside the anchor, so that no task holds more than CROWD of them.

Documents with the whole text of an earlier one are settled by a hash of the text and take no part in this.
Order of documents: doc_id (null last), then a hash of the text. Rows equal in both are one document. A null text is empty; texts
shorter than a window lose nothing; an empty table gives an empty result; columns named like an output are replaced.
Hashes have 64 bits; fragments that differ are compared byte by byte only where their anchors are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import blocks, textops
from logloom.llm.suffixes import suffix_array
from logloom.shared import cut, sized

WINDOW = 100
GRAM = 24
#: Longer texts are read in pieces that overlap by a window less one byte.
PIECE = 4 << 20
#: Bytes of text whose rows are made and settled together.
PART = 3 << 20
#: Different fragments of one anchor up to which they are compared in one task; beyond, they are told apart by what stands beside the anchor.
CROWD = 20_000
#: Every window has at least so many bytes before or after its anchor.
BESIDE = (WINDOW - GRAM) // 2
#: Bytes of fragments that one suffix array covers, whole anchors at a time.
SUFFIX_BYTES = 1 << 16

_U = np.uint64
#: Factors of the eight-byte parts of a gram. Its hash only chooses anchors: grams that collide cost time and change no result.
_LANE = textops.mix64(np.arange(1, GRAM // 8 + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
_KEY = "doc bigint, cid int"


def anchor_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor hash, fragment hash, first window, number of windows, and the anchor's place in the fragment, of each run over texts (positions in data)."""
    n, span = len(data), WINDOW - GRAM + 1
    if n < WINDOW:
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 3
    eight, m = textops.lanes(data), n - GRAM + 1
    h = eight[:m] * _LANE[0]
    for k in range(1, GRAM // 8):
        h += eight[8 * k : 8 * k + m] * _LANE[k]
    h = textops.mix64(h)
    mask = _U((1 << 24) - 1)
    v = (h & ~mask) | np.arange(len(h), dtype=_U)
    rows = -(-len(v) // span)
    block = np.full(rows * span, np.iinfo(_U).max, _U)
    block[: len(v)] = v
    block = block.reshape(rows, span)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - WINDOW + 1], ahead[span - 1 : span + n - WINDOW])
    size = np.diff(off)
    edge = np.zeros(n + 2, np.int32)
    some = size >= WINDOW
    np.add.at(edge, off[:-1][some], 1)
    np.add.at(edge, off[1:][some] - WINDOW + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[: n - WINDOW + 1]))
    if not len(start):
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 3
    p = (least[start] & mask).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, p = start[first], p[first]
    count = np.diff(np.append(first, len(start)))
    place = (p - lo).astype(_U) * _U(0x9E3779B97F4A7C15) + count.astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    frag = textops.mix64(textops.span_hashes(data, lo, lo + count - 1 + WINDOW, 2 * WINDOW) + place)
    return h[p], frag, lo, count, p - lo


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U, copy=False).view(np.int64))


def _runs(texts: DataFrame) -> DataFrame:
    """Anchor rows of texts(doc, cid, __text); kind 1: known to repeat within its batch."""

    def small(batches):
        """Batches of about PART bytes of text: what a worker holds depends on them."""
        for batch in batches:
            off = textops.buffer(textops.column(batch, "__text"))[1]
            for i, j in textops.chunks(off, PART):
                yield batch.slice(i, j - i)

    def run(batches):
        for batch in small(batches):
            data, off = textops.buffer(textops.column(batch, "__text"))
            parts = []
            for i, j in textops.chunks(off, min(textops.CHUNK, PIECE)):
                whole = int(off[j] - off[i])
                if whole <= PIECE:
                    a, f, lo, c, at = anchor_runs(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    d = np.searchsorted(off[i : j + 1] - off[i], lo, "right") - 1
                    parts.append((a, f, d + i, lo - (off[i : j + 1] - off[i])[d], c, at))
                    continue
                for begin in range(0, whole - WINDOW + 1, PIECE):
                    x = data[off[i] + begin : min(off[j], off[i] + begin + PIECE + WINDOW - 1)]
                    a, f, lo, c, at = anchor_runs(x, np.array([0, len(x)]))
                    parts.append((a, f, np.full(len(a), i), lo + begin, c, at))
            if not parts:
                continue
            a, f, d, lo, c, at = (np.concatenate(x) for x in zip(*parts))
            docs = batch.column(0).to_numpy()
            doc, cid = docs[d], batch.column(1).to_numpy()[d]
            kind = np.zeros(len(a), np.int8)
            order = np.argsort(f, kind="stable")
            same = np.flatnonzero(f[order][1:] == f[order][:-1])
            if len(same):
                near = np.zeros(len(f), bool)
                near[same] = near[same + 1] = True
                k = order[near]
                k = k[np.lexsort((lo[k], cid[k], doc[k], f[k]))]
                new = np.ones(len(k), bool)
                new[1:] = f[k][1:] != f[k][:-1]
                head = k[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                here = (doc[k] == doc[head]) & (cid[k] == cid[head]) & (lo[k] == lo[head])
                again = k[~here]
                kind[again] = 1
                kind[k[here & ~new]] = 9  # the first place once more, from a repeated row: it is no repeat
                a[again] = textops.mix64(f[again] + lo[again].astype(_U) + doc[again].astype(_U))  # any task will do
            if (kind == 9).any():
                a, f, doc, cid, lo, c, at, kind = (x[kind != 9] for x in (a, f, doc, cid, lo, c, at, kind))
            yield pa.RecordBatch.from_arrays(
                [_signed(a), _signed(f), pa.array(doc), pa.array(cid), pa.array(lo.astype(np.int64)),
                 pa.array(c.astype(np.int16)), pa.array(at.astype(np.int16)), pa.array(kind)],
                names=["anchor", "frag", "doc", "cid", "lo", "n", "at", "kind"],
            )

    return texts.mapInArrow(run, f"anchor bigint, frag bigint, {_KEY}, lo bigint, n smallint, at smallint, kind tinyint")


def _settle(runs: DataFrame) -> DataFrame:
    """kind 1: windows that repeat; kind 2: the first places of fragments whose anchor has others as well; kind 3: the same, for an anchor of more than CROWD fragments.

    Rows come sorted by anchor, fragment and place. Of the last anchor in a batch at most CROWD first places are held, so memory is bounded for any group.
    """
    cols = ["anchor", "doc", "cid", "lo", "n", "at", "kind"]

    def table(t, kinds):
        arrays = [pa.array(t[c]) for c in cols[:-1]] + [pa.array(np.asarray(kinds).astype(np.int8))]
        return pa.RecordBatch.from_arrays(arrays, names=cols)

    def pick(t, which):
        return {c: v[which] for c, v in t.items()}

    def run(batches):
        anchor = frag = None  # of the last row
        lead = None  # the place of the last fragment's first row
        held, crowded = None, False  # first places of the last anchor

        def close():
            if held is not None and len(held["anchor"]) > 1:
                yield table(held, np.full(len(held["anchor"]), 2))

        for batch in batches:
            t = {c: batch.column(k).to_numpy() for k, c in enumerate(batch.schema.names)}
            n = len(t["anchor"])
            if not n:
                continue
            new_a, new_f = np.ones(n, bool), np.ones(n, bool)
            new_a[1:] = t["anchor"][1:] != t["anchor"][:-1]
            new_f[1:] = new_a[1:] | (t["frag"][1:] != t["frag"][:-1])
            new_a[0] = anchor is None or t["anchor"][0] != anchor
            new_f[0] = new_a[0] or t["frag"][0] != frag
            anchor, frag = t["anchor"][-1], t["frag"][-1]
            # A row at the place of its fragment's first one comes from a repeated row of one document: it is no repeat.
            at_first = np.maximum.accumulate(np.where(new_f, np.arange(n), -1))
            here = np.ones(n, bool)
            for c in ("doc", "cid", "lo"):
                before = lead[c] if lead is not None else t[c][0]
                here &= t[c] == np.where(at_first < 0, before, t[c][at_first])
            lead = {c: (t[c][at_first[-1]] if at_first[-1] >= 0 else lead[c]) for c in ("doc", "cid", "lo")}
            again = (t["kind"] == 1) | ~(new_f | here)
            if again.any():
                yield table(pick(t, again), np.ones(int(again.sum())))
            first = np.flatnonzero(new_f & ~again)
            which = np.cumsum(new_a)[first]  # 0: still the anchor that the batch before ended with
            for g in (0, int(np.cumsum(new_a)[-1])) if new_a[1:].any() or new_a[0] else (0,):
                if g:  # the anchor before has ended, and so have those between
                    yield from close()
                    held, crowded = None, False
                    middle = first[(which > 0) & (which < g)]
                    if len(middle):
                        of = np.cumsum(new_a)[middle]
                        count = np.bincount(of)[of]
                        some = count > 1
                        if some.any():
                            yield table(pick(t, middle[some]), np.where(count[some] > CROWD, 3, 2))
                mine = pick(t, first[which == g])
                if not len(mine["anchor"]):
                    continue
                if crowded:
                    yield table(mine, np.full(len(mine["anchor"]), 3))
                    continue
                held = mine if held is None else {c: np.concatenate([held[c], v]) for c, v in mine.items()}
                if len(held["anchor"]) > CROWD:
                    yield table(held, np.full(len(held["anchor"]), 3))
                    held, crowded = None, True
        yield from close()

    x = runs.repartition("anchor").sortWithinPartitions("anchor", "frag", "doc", "cid", "lo")
    return x.mapInArrow(run, f"anchor bigint, {_KEY}, lo bigint, n smallint, at smallint, kind tinyint")


def _fetch(texts: DataFrame, places: DataFrame) -> DataFrame:
    """places(anchor, doc, cid, lo, n, at) with their bytes."""
    by_doc = cut(
        places.groupBy("doc", "cid").agg(F.collect_list(F.struct("anchor", "lo", "n", "at")).alias("places")), "places"
    )
    n = by_doc.count()
    few = texts.join(sized(by_doc.select("doc", "cid"), n), ["doc", "cid"], "left_semi")
    x = few.join(by_doc, ["doc", "cid"]).select("doc", "cid", "places", "__text")

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                spots = one.column(2).flatten()
                anchor, lo, n, at = (spots.field(k).to_numpy() for k in range(4))
                raw = one.column(3)[0].as_py().encode()
                frags = [raw[a : a + k + WINDOW - 1] for a, k in zip(lo.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(np.full(len(lo), one.column(0)[0].as_py(), np.int64)),
                     pa.array(np.full(len(lo), one.column(1)[0].as_py(), np.int32)), pa.array(lo), pa.array(n), pa.array(at),
                     pa.array(frags, pa.binary())],
                    names=["anchor", "doc", "cid", "lo", "n", "at", "bytes"],
                )

    return x.mapInArrow(run, f"anchor bigint, {_KEY}, lo bigint, n smallint, at smallint, bytes binary")


def repeated_windows(doc, cid, lo, n, frags) -> list[tuple[int, int, int, int]]:
    """(doc, cid, first, number) of runs of windows that some earlier window of these fragments equals."""
    text = b"\0".join(frags)
    size = np.array([len(f) + 1 for f in frags])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    row = np.repeat(np.arange(len(frags)), size)[: len(text)]
    inside = np.arange(len(text)) - at[row]
    order = np.array(suffix_array(text))
    order = order[inside[order] < n[row[order]]]
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), WINDOW)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 15):
        b = min(len(order), a + (1 << 15))
        same[a:b] = (view[order[a:b]] == view[order[a - 1 : b - 1]]).all(axis=1)
    kind = np.cumsum(~same)
    r, start = row[order], lo[row[order]] + inside[order]
    k = np.lexsort((start, cid[r], doc[r], kind))
    again = k[1:][kind[k][1:] == kind[k][:-1]]
    # A window that lies in two fragments of one document at the same place is one window, not a repeat.
    j = k[:-1][kind[k][1:] == kind[k][:-1]]
    again = again[(doc[r[again]] != doc[r[j]]) | (cid[r[again]] != cid[r[j]]) | (start[again] != start[j])]
    rr, ss = r[again], start[again]
    o = np.lexsort((ss, rr))
    rr, ss = rr[o], ss[o]
    if not len(rr):
        return []
    new = np.ones(len(rr), bool)
    new[1:] = (rr[1:] != rr[:-1]) | (ss[1:] != ss[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(rr)))
    return list(zip(doc[rr[first]].tolist(), cid[rr[first]].tolist(), ss[first].tolist(), count.tolist()))


def _agreement(strings: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with any other: its neighbours in sorted order have it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in zip(order, order[1:]):
        x, y = strings[i], strings[j]
        k = min(len(x), len(y))
        bits = (int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")).bit_length()
        same = k - (bits + 7) // 8
        if same > out[i]:
            out[i] = same
        out[j] = same
    return out


def shared_parts(frags: list[bytes], at: list[int]) -> list[tuple[int, int]]:
    """Where each fragment of one anchor may hold a window of another: equal windows agree to the left and to the right of the anchor."""
    right = _agreement([f[p:] for f, p in zip(frags, at)])
    left = _agreement([f[:p][::-1] for f, p in zip(frags, at)])
    return [(p - a, p + b) for p, a, b in zip(at, left, right)]


def _compare(frags: DataFrame) -> DataFrame:
    """Repeated windows of fragments that share an anchor; only what may repeat goes into the suffix arrays."""

    def out(rows):
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc", "cid", "lo", "n"]
        )

    def run(batches):
        held, size, rows = [], 0, []

        def flush():
            doc, cid, lo, n, parts = zip(*held)
            return repeated_windows(np.array(doc), np.array(cid), np.array(lo), np.array(n), list(parts))

        for t in blocks.groups(batches, "anchor"):
            if len(t) < 2:
                continue
            doc, cid, lo, at, texts = (t.column(c).to_pylist() for c in ("doc", "cid", "lo", "at", "bytes"))
            for d, c, first, f, (a, b) in zip(doc, cid, lo, texts, shared_parts(texts, at)):
                if b - a >= WINDOW:
                    held.append((d, c, first + a, b - a - WINDOW + 1, f[a:b]))
                    size += b - a + 1
            if size >= SUFFIX_BYTES:
                rows += flush()
                held, size = [], 0
            if len(rows) > 20_000:
                yield out(rows)
                rows = []
        if held:
            rows += flush()
        yield out(rows)

    x = frags.repartition("anchor").sortWithinPartitions("anchor")
    return x.mapInArrow(run, f"{_KEY}, lo bigint, n bigint")


def _beside(frags: DataFrame) -> DataFrame:
    """Fragments of crowded anchors under narrower ones: the anchor with the BESIDE bytes before it, and with those after it.

    Equal windows have equal bytes on the side where they reach further, so all places of a window still meet.
    """

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            at_, raw_ = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("at", "bytes"))
            for k, (anchor, at, raw) in enumerate(zip(batch.column(0).to_pylist(), at_, raw_)):
                for side, part in ((b"<", raw[at - BESIDE : at] if at >= BESIDE else b""), (b">", raw[at + GRAM : at + GRAM + BESIDE])):
                    if len(part) == BESIDE:
                        h = hashlib.blake2b(part, digest_size=8, key=side + anchor.to_bytes(8, "little", signed=True)).digest()
                        keys.append(int.from_bytes(h, "little", signed=True))
                        rows.append(k)
            some = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *some.columns[1:]], names=batch.schema.names)

    return frags.mapInArrow(run, frags.schema)


def _compare_crowded(frags: DataFrame) -> DataFrame:
    """Repeated windows of more than CROWD fragments that are equal over GRAM + BESIDE bytes: each window is a row under a 128-bit hash, and all but the earliest repeat.

    The smallest place per hash is a partial aggregate and the join back may be split, so no group meets in one task.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, cid, lo, n, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "cid", "lo", "n", "bytes"))):
                for k in range(n):
                    h = hashlib.blake2b(raw[k : k + WINDOW], digest_size=16).digest()
                    rows.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), doc, cid, lo + k))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h1", "h2", "doc", "cid", "lo"])

    w = cut(frags.mapInArrow(run, f"h1 bigint, h2 bigint, {_KEY}, lo bigint"), "windows")
    place = F.struct("doc", "cid", "lo")
    first = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    x = w.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return x.select("doc", "cid", "lo", F.lit(1).cast("long").alias("n"))


def _spans(windows: DataFrame) -> DataFrame:
    """(doc, cid, spans): the maximal byte runs that repeated windows(doc, cid, lo, n) cover."""
    names = ["doc", "cid", "spans"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        key, spans, rows = None, [], []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.int32()),
                 pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], kind)],
                names=names,
            )

        for batch in batches:
            d, c, lo, n = (batch.column(k).to_pylist() for k in range(4))
            for k, a, b in zip(zip(d, c), lo, (x + y + WINDOW - 1 for x, y in zip(lo, n))):
                if k != key:
                    if key is not None:
                        rows.append((key, spans))
                    key, spans = k, [[a, b]]
                elif a <= spans[-1][1]:
                    if b > spans[-1][1]:
                        spans[-1][1] = b
                else:
                    spans.append([a, b])
            if len(rows) > 5_000:
                yield out()
                rows.clear()
        if key is not None:
            rows.append((key, spans))
        yield out()

    x = windows.repartition("doc", "cid").sortWithinPartitions("doc", "cid", "lo")
    return x.mapInArrow(run, f"{_KEY}, spans array<struct<start:bigint,end:bigint>>")


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __text (never null), __copy (its whole text stands earlier) and __spans (byte runs to remove, or null)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    x = docs.withColumns({"__text": t, "doc": doc, "cid": F.hash(t), "__h": F.xxhash64(t)})
    long_enough = F.octet_length("__text") >= WINDOW
    classes = x.where(long_enough).groupBy("__h", "cid").agg(
        F.min("doc").alias("__first"), F.max("doc").alias("__last")
    )
    classes = cut(classes.where("__first <> __last").select("__h", "cid", "__first"), "classes")
    x = x.join(sized(classes, classes.count()), ["__h", "cid"], "left").drop("__h")
    x = x.withColumn("__copy", F.coalesce(F.col("doc") != F.col("__first"), F.lit(False))).drop("__first")
    texts = x.where(long_enough & ~F.col("__copy")).select("doc", "cid", "__text")
    settled = cut(_settle(_runs(texts)), "settled")
    known = settled.where("kind = 1").select("doc", "cid", "lo", F.col("n").cast("long").alias("n"))
    open_ = settled.where("kind = 2").select("anchor", "doc", "cid", "lo", "n", "at")
    found = known.unionByName(_compare(_fetch(texts, open_)))
    crowded = settled.where("kind = 3").select("anchor", "doc", "cid", "lo", "n", "at")
    if crowded.take(1):
        narrow = cut(_beside(_fetch(texts, crowded)), "narrow")
        full = cut(narrow.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select("anchor"), "full")
        n_full = full.count()
        found = found.unionByName(_compare(narrow.join(sized(full, n_full), "anchor", "left_anti")))
        if n_full:
            found = found.unionByName(_compare_crowded(narrow.join(sized(full, n_full), "anchor", "left_semi")))
    spans = cut(_spans(found), "spans")
    n, total = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = spans.withColumnRenamed("spans", "__spans")
    return x.join(sized(spans, n + total // 4), ["doc", "cid"], "left")


def _kept(raw: bytes, copy: bool, spans) -> tuple[bytes, int, int]:
    """The remaining bytes, how many went, and in how many runs."""
    if copy:
        return b"", len(raw), 1
    if not spans:
        return raw, 0, 0
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    out.append(raw[at:])
    left = b"".join(out)
    return left, len(raw) - len(left), len(spans)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the repeated bytes of their texts removed (a character that a cut breaks goes as a whole); all other columns stay as they are."""
    own = docs.columns
    rest = F.struct(*[F.col(c) for c in own if c != text], F.lit(0).alias("__none")).alias("__row")
    x = repeats(docs.select("doc_id", F.col(text).alias("__in"), rest), "__in").select("__row", "__text", "__copy", "__spans")

    def run(batches):
        for batch in batches:
            texts = []
            for raw, copy, spans in zip(*(batch.column(k) for k in (1, 2, 3))):
                raw, copy, spans = raw.as_py(), copy.as_py(), spans.as_py()
                texts.append(raw if not copy and not spans else _kept(raw.encode(), copy, spans)[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["__row", "__out"])

    kind = x.schema["__row"].dataType.simpleString()
    out = x.mapInArrow(run, f"__row {kind}, __out string")
    return out.select(*[F.col("__out").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in own])


def op8_passage_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = repeats(docs).select("doc_id", "__text", "__copy", "__spans")

    def run(batches):
        for batch in batches:
            out = []
            for i in range(len(batch)):
                raw = batch.column(1)[i].as_py().encode()
                left, gone, n = _kept(raw, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                out.append((len(raw), gone, n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out)) if out else [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return x.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
