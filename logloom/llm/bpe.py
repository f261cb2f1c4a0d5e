"""Byte-level BPE encoding and decoding over ranks in a file.

Pre-tokenisation uses no regular expression. Each code point gets a class from an array;
with one character of look-ahead the classes become symbols of a small automaton, and each
symbol is a function from state to state. Function composition is associative, so the
states before all characters come from a blocked scan: blocks are composed side by side, the block
functions are scanned in the same way, and a last pass applies them. A boundary is a fact of (state, symbol).
The resulting byte slices go to a cache of merged pairs. Each token's end in its text (a byte offset) is kept beside its id: decoding
writes every token's bytes to the place the offsets give, and a token range can be traced to, and decoded as, its part of the text.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows repeat; an empty table
gives an empty result; other columns are kept, whatever their names, but for those named like an output.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import textops
from logloom.llm.columns import others, quoted

#: Tokens that the cache of merged slices may hold; it is emptied when full.
CACHE = 1 << 17
BLOCK = 64

# Code point classes.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE = range(6)
# Symbols: a class, refined by what follows.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_SPACE, S_BLANK, S_RUN = range(8)
# States: what the last character left open. FRESH: the next character starts a token.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, TAIL1, TAIL2 = range(8)

#: White space by the Unicode property, which the pattern's \s means.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state] (a token starts before this character)."""
    nxt, starts = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_QUOTE1: IN_OTHERS, S_QUOTE2: IN_OTHERS}
    for sym in range(8):
        for st in range(8):
            if sym in run:
                joins = st in (run[sym], AFTER_SPACE)
                nxt[sym, st], starts[sym, st] = run[sym], not joins
                if not joins and sym in (S_QUOTE1, S_QUOTE2):  # a contraction, if it starts a token
                    nxt[sym, st] = TAIL1 if sym == S_QUOTE1 else TAIL2
                if sym == S_LETTER and st in (TAIL1, TAIL2):
                    nxt[sym, st], starts[sym, st] = (FRESH if st == TAIL1 else TAIL1), False
            elif sym == S_RUN:
                nxt[sym, st], starts[sym, st] = IN_BLANKS, st != IN_BLANKS
            else:
                nxt[sym, st] = AFTER_SPACE if sym == S_SPACE else FRESH
    return nxt, starts


_NEXT, _STARTS = _automaton()
#: Symbols 8-15 are the same at a text's first character: whatever came before, the state is FRESH.
_NEXT2 = np.concatenate([_NEXT, np.repeat(_NEXT[:, FRESH : FRESH + 1], 8, axis=1)])
_STARTS2 = np.concatenate([_STARTS, np.ones((8, 8), bool)])


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the Unicode general categories."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter(
        (kinds.get(category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1
    )
    out[list(WHITE)] = BLANK
    out[32] = SPACE
    out[39] = QUOTE
    return out


def _symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """cp: code points of many texts; first: which of them start a text."""
    n = len(cp)
    kind = classes()[cp]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    white = (kind == SPACE) | (kind == BLANK)
    follows = np.zeros(n, bool)  # by something that isn't white, in the same text
    follows[:-1] = ~white[1:]
    follows &= ~last
    sym = np.array([S_LETTER, S_NUMBER, S_RUN, S_RUN, S_OTHER, S_OTHER], np.uint8)[kind]
    sym[(kind == SPACE) & follows] = S_SPACE
    sym[(kind == BLANK) & follows] = S_BLANK
    q = np.flatnonzero((kind == QUOTE) & ~last)
    if len(q):
        a = cp[q + 1]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # 's 't 'm 'd
        two_ok = (q + 2 < n) & ~last[np.minimum(q + 1, n - 1)]
        b = cp[np.minimum(q + 2, n - 1)]
        two = two_ok & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))  # 're 've 'll
        sym[q[one]] = S_QUOTE1
        sym[q[two]] = S_QUOTE2
    sym[first] += 8
    return sym


def _compose(functions: np.ndarray) -> np.ndarray:
    """The state before each function, from FRESH: functions is (n, 8), each row a map of states. A blocked associative scan."""
    n = len(functions)
    if n <= BLOCK:
        out, st = np.empty(n, np.uint8), FRESH
        for i in range(n):
            out[i] = st
            st = functions[i, st]
        return out
    rows = -(-n // BLOCK)
    f = np.empty((rows * BLOCK, 8), np.uint8)
    f[:n], f[n:] = functions, np.arange(8, dtype=np.uint8)
    f = f.reshape(rows, BLOCK, 8)
    whole = f[:, 0].copy()
    for j in range(1, BLOCK):
        whole = np.take_along_axis(f[:, j], whole, 1)
    st = _compose(whole)
    out, lanes = np.empty((rows, BLOCK), np.uint8), np.arange(rows)
    for j in range(BLOCK):
        out[:, j] = st
        st = f[lanes, j, st]
    return out.reshape(-1)[:n]


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions in cp where a pre-token starts."""
    n = len(cp)
    sym = _symbols(cp, first)
    rows = -(-n // BLOCK)
    s = np.zeros(rows * BLOCK, np.uint8)
    s[:n] = sym
    s = s.reshape(rows, BLOCK)
    # Composition of each block's functions, all blocks side by side.
    flat = _NEXT2.reshape(-1)
    whole = _NEXT2[s[:, 0]]
    for j in range(1, BLOCK):
        whole = flat[(s[:, j].astype(np.uint8)[:, None] << 3) | whole]
    st = _compose(whole)
    before = np.empty((rows, BLOCK), np.uint8)
    for j in range(BLOCK):
        before[:, j] = st
        st = flat[(s[:, j] << 3) | st]
    return np.flatnonzero(_STARTS2.reshape(-1)[(sym << 3) | before.reshape(-1)[:n]])


class Codec:
    """Ranks of one vocabulary file, with the cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def _merge(self, piece: bytes) -> list[int]:
        """Lowest-rank pairs first, leftmost on ties, with a heap: n log n for long slices too."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts at i
        back = list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not live[i] or end[i] >= n or end[end[i]] != e:
                continue
            j = end[i]
            live[j] = False
            end[i] = e
            if e < n:
                back[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (k := back[i]) >= 0 and (r := ranks.get(piece[k:e])) is not None:
                heapq.heappush(heap, (r, k, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def ids_of(self, piece: bytes) -> bytes:
        """The slice's ids as little-endian unsigned 32-bit integers."""
        r = self.ranks.get(piece)
        ids = [r] if r is not None else self._merge(piece)
        out = np.array(ids, "<u4").tobytes()
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[piece] = out
        return out

    def slices(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of all pre-tokens (the end included), and offsets of each text's among them."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        first = np.zeros(len(data) + 1, bool)
        first[off[:-1]] = True
        starts = at[token_starts(cp, first[: len(data)][lead])]
        return np.append(starts, len(data)), np.searchsorted(starts, off)

    def encode(self, data: np.ndarray, off: np.ndarray):
        """For each text: its ids as bytes."""
        if not len(data):
            yield from (b"" for _ in range(len(off) - 1))
            return
        cuts, of_text = self.slices(data, off)
        raw, at = data.tobytes(), cuts.tolist()
        cache, ids_of = self.cache, self.ids_of
        for i in range(len(off) - 1):
            a, b = int(of_text[i]), int(of_text[i + 1])
            get = cache.get
            yield b"".join([get(p) or ids_of(p) for p in [raw[x:y] for x, y in zip(at[a:b], at[a + 1 : b + 1])]])

    def ends(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where each token ends in its own text, for the ids of many texts and each text's number of them."""
        total = np.cumsum(self.width[ids])
        before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
        return total - np.repeat(before, counts)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of consecutive tokens, each written where its offset puts it; ends may start anywhere in a text."""
        if not len(ids):
            return b""
        width = self.width[ids]
        begin = ends - width
        first = int(begin[0])
        source = np.repeat(self.at[ids] - begin + first, width)
        source += np.arange(int(ends[-1]) - first)
        return self.bytes[source].tobytes()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs without their text, with ids and ends (arrays of int: each token's id, and the byte offset where it ends), n_tokens, and ids_sha256 and decoded_sha256 for audits."""
    return _run(docs, text, path, True)


def digest(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """As encode(), without the arrays."""
    return _run(docs, text, path, False)


_NEW = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "ends")


def _run(docs: DataFrame, text: str, path: str | None, arrays: bool) -> DataFrame:
    keep = others(docs, text, *_NEW)
    ints = T.ArrayType(T.IntegerType())
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("ids", ints), T.StructField("ends", ints)] * arrays
    place = path or default_path()

    def run(batches):
        own = codec(place)
        for batch in batches:
            data, off = textops.buffer(textops.column(batch, "__text"))
            for i, j in textops.chunks(off):  # a result for each part: what a worker holds does not depend on the batch
                raw = list(own.encode(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                count = np.array([len(x) >> 2 for x in raw])
                sha = [hashlib.sha256(x).hexdigest() for x in raw]
                ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
                del raw
                ends = own.ends(ids, count)
                cuts = np.cumsum(count)[:-1]
                back = [hashlib.sha256(own.decode(x, e)).hexdigest() for x, e in zip(np.split(ids, cuts), np.split(ends, cuts))]
                part = batch.slice(i, j - i)
                cols = [part.column(k) for k in range(len(keep))]
                cols += [pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if arrays:
                    at = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                    cols += [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f.name for f in new)])

    x = docs.select(*[F.col(quoted(c)).alias(f"__{k}") for k, c in enumerate(keep)], F.col(quoted(text)).cast("string").alias("__text"))
    return x.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + new))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens(ids, ends, ...) with `decoded`, the bytes of their text: binary, since a range of tokens may cut a character.

    ids and ends may be slices of what encode() gives; null arrays decode to null. A row whose arrays differ in length is an error.
    """
    keep, place = others(tokens, "decoded"), path or default_path()

    def run(batches):
        own = codec(place)
        for batch in batches:
            k = len(keep)
            out = []
            for ids, ends in zip(batch.column(k), batch.column(k + 1)):
                if not ids.is_valid or not ends.is_valid:
                    out.append(None)
                    continue
                if len(ids) != len(ends):
                    raise ValueError("ids and ends differ in length")
                out.append(own.decode(ids.values.to_numpy().astype(np.int64), ends.values.to_numpy().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    x = tokens.select(*[F.col(quoted(c)).alias(f"__{k}") for k, c in enumerate(keep)], F.col("ids").alias("__ids"), F.col("ends").alias("__ends"))
    return x.mapInArrow(run, T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())]))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs)
