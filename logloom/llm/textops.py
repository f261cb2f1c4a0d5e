"""Vectorised text primitives over Arrow string columns: one byte buffer for a whole batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scramble (the SplitMix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of text that one vectorised pass works on, to bound a worker's memory.
CHUNK = 2 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column as large_string without nulls."""
    x = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(x.cast(pa.large_string()), "")


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and n + 1 offsets."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK):
    """Ranges of documents of about `most` bytes together; a longer document stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets of each document's words among them."""
    n = len(data)
    word = ~_SPACE[data]
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[off[:-1]] = True
    last[off[1:]] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | first[:n]))
    ends = np.flatnonzero(word & (~after | last[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; UTF-8 sequences are untouched."""
    return _LOWER[data]


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks that keep the first k of eight bytes.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number (zeros after the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 64) -> np.ndarray:
    """A 64-bit hash of each span's bytes. Eight bytes at a time are scrambled into it, so no sum of powers can cancel; spans above `most` bytes go through BLAKE2."""
    size = ends - starts
    h = size.astype(np.uint64) * _STEP
    eight, live = lanes(data), None
    for k in range(0, most, 8):
        live = np.flatnonzero(size > k) if live is None else live[size[live] > k]
        if not len(live):
            break
        h[live] = mix64((h[live] ^ (eight[starts[live] + k] & _FIRST[np.minimum(size[live] - k, 8)])) + _STEP)
    for i in np.flatnonzero(size > most).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h
