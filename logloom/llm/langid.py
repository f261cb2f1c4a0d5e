"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs, fixed by its code point. An n-gram's vector binds (multiplies) its letters' vectors, each permuted (rotated) by its
place; a document bundles (adds) the vectors of all its n-grams; a language's prototype bundles its documents, each scaled to one length. A document's
language is the prototype with the largest cosine, after what all prototypes share is taken from document and prototypes.

Texts are read as lower-cased runs of letters and their marks, a blank between; n-grams hold at most one blank at either end, so what stands between words says nothing.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text where no language was learned. Documents without a
language, or held out, are not learned from; documents without a letter teach nothing. Ties go to the first language by code point.
With one learned language, all texts with letters get it. Repeated rows count as often as they come. Extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.columns import documents, quoted
from logloom.llm.textops import buffer, chunks, column, mix64
from logloom.shared import cut

#: Signs of a vector, and letters of an n-gram.
SIZE, GRAM = 2048, 3
#: Documents are summed as whole numbers of this unit, so that sums don't depend on how rows are dealt.
UNIT = 1 << 20
#: The largest number of languages: prototypes go to every task.
MOST_LANGUAGES = 10_000
#: n-grams whose vectors are made at a time.
GRAMS = 4096
#: A product of full tables beats adding row by row unless so many entries of a table are zero for each that is not.
SPARSE = 256
#: Bytes of text that one pass works on.
PASS = 1 << 20
UNKNOWN = "und"


@cache
def _classes() -> np.ndarray:
    """For each code point: its lower-case letter (or mark); 0 for all else. Bit 31 is set for marks."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
        elif kind[0] == "M":
            out[i] = i | 1 << 31
    return out


def _letters(code: np.ndarray, size: int) -> np.ndarray:
    """The random signs of each code point, one row each."""
    words = np.arange(size // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = mix64(mix64(code.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))[:, None] ^ words[None, :])
    return (np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little") * 2).astype(np.int8) - 1


def gram_vectors(grams: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The vectors of n-grams (rows of code points, a blank as 32): letters' vectors, rotated by place and multiplied."""
    code, at = np.unique(grams, return_inverse=True)
    letters, at, out = _letters(code, size), at.reshape(grams.shape), None
    for place in range(grams.shape[1]):
        turned = np.roll(letters, grams.shape[1] - 1 - place, axis=1)[at[:, place]]
        out = turned if out is None else out * turned
    return out


def grams_of(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of the n-grams found, by document, and the n-grams' code points: rows of the last are what the second names."""
    data, off = buffer(texts)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = np.repeat(np.arange(len(texts)), np.diff(heads[off]))
    kind = _classes()[code]
    # One blank after each run of letters, and one before each document's first.
    word = kind > 0
    same = np.zeros(len(doc), bool)
    same[1:] = doc[1:] == doc[:-1]
    before = np.zeros(len(doc), bool)
    before[1:] = word[:-1] & same[1:]
    kept = word | before
    kept_code, kept_doc = np.where(word, kind & 0x7FFFFFFF, 32)[kept].astype(np.uint32), doc[kept]
    edge = np.flatnonzero(np.diff(kept_doc, prepend=-1, append=-1)[: len(kept_doc)] != 0) if len(kept_doc) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(kept_doc)) if len(edge) else edge
    open_end = ends[kept_code[ends - 1] != 32] if len(edge) else ends
    places = np.concatenate([edge, open_end])
    owners = np.concatenate([kept_doc[edge], kept_doc[open_end - 1]]) if len(edge) else kept_doc[:0]
    order = np.argsort(places, kind="stable")
    # A closing blank comes before the next document's opening one at the same place.
    order = order[np.lexsort((owners[order], places[order]))]
    seq = np.insert(kept_code, places[order], 32)
    own = np.insert(kept_doc, places[order], owners[order])
    if len(seq) < gram:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, gram), np.uint32),)
    n = len(seq) - gram + 1
    fine = own[:n] == own[gram - 1 :]
    for k in range(1, gram - 1):  # no blank inside
        fine &= seq[k : k + n] != 32
    at = np.flatnonzero(fine)
    alphabet, index = np.unique(seq, return_inverse=True)
    key = np.zeros(len(at), np.int64)
    for k in range(gram):
        key = key * len(alphabet) + index[at + k]
    distinct, which = np.unique(key, return_inverse=True)
    pair, count = np.unique(own[at] * np.int64(max(1, len(distinct))) + which, return_counts=True)
    shape = np.empty((len(distinct), gram), np.uint32)
    rest = distinct.copy()
    for k in reversed(range(gram)):
        shape[:, k] = alphabet[rest % len(alphabet)]
        rest //= len(alphabet)
    return pair // max(1, len(distinct)), pair % max(1, len(distinct)), count, shape


def bundles(texts: pa.Array, size: int = SIZE, gram: int = GRAM) -> np.ndarray:
    """The bundled vector of each text, by blocks of n-grams; zero without a letter."""
    out = np.zeros((len(texts), size), np.float32)
    doc, which, count, shape = grams_of(texts, gram)
    by = np.argsort(which, kind="stable")
    doc, which, count = doc[by], which[by], count[by].astype(np.float32)
    for a in range(0, len(shape), GRAMS):
        lo, hi = np.searchsorted(which, [a, a + GRAMS])
        v = gram_vectors(shape[a : a + GRAMS], size)
        if (hi - lo) * SPARSE >= len(texts) * len(v):  # one product
            table = np.zeros((len(texts), len(v)), np.float32)
            table[doc[lo:hi], which[lo:hi] - a] = count[lo:hi]
            out += table @ v.astype(np.float32)
            continue
        order = lo + np.argsort(doc[lo:hi], kind="stable")
        for k in range(0, len(order), GRAMS):
            o = order[k : k + GRAMS]
            starts = np.flatnonzero(np.diff(doc[o], prepend=-1))
            out[doc[o][starts]] += np.add.reduceat(v[which[o] - a] * count[o][:, None], starts, axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros(x.shape, np.float64), where=size > 0)


@dataclass
class Profiles:
    """The learned languages in order, their prototypes as unit rows, and what they share."""

    languages: list[str]
    prototypes: np.ndarray
    shared: np.ndarray
    gram: int = GRAM

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        x = bundles(texts, self.prototypes.shape[1], self.gram)
        known = x.any(axis=1)
        near = unit(unit(x) - self.shared) @ self.prototypes.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(best)), best], 0.0, 1.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0)


def _parts(batch: pa.RecordBatch, name: str):
    """A batch's texts in ranges of bounded bytes, as (start, texts); one longer text stands alone."""
    texts = column(batch, name)
    _, off = buffer(texts)
    for a, b in chunks(off, PASS):
        for i in range(a, b, 512):
            yield i, texts.slice(i, min(b, i + 512) - i)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE, gram: int = GRAM) -> Profiles | None:
    """Profiles of the documents with a language; None without any. One pass: each task adds up its documents by language."""

    def step(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(b.schema.get_field_index("lang")).to_pylist()
            for at, texts in _parts(b, "text"):
                vectors = np.rint(unit(bundles(texts, size, gram)) * UNIT).astype(np.int64)
                code = np.array(langs[at : at + len(texts)])
                for name in np.unique(code):
                    mine = vectors[code == name]
                    if mine.any():
                        sums[str(name)] = sums.get(str(name), 0) + mine.sum(axis=0)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(range(size), pa.int32()), pa.array(v)], names=["lang", "i", "v"])

    x = docs.select(F.col(quoted(text)).cast("string").alias("text"), F.col(quoted(lang)).cast("string").alias("lang")).where("lang is not null")
    found = x.mapInArrow(step, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v"))
    found = cut(found, "language-sums")
    if (n := found.where("i = 0").limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not n:
        return None
    table = found.toPandas()
    names = sorted(set(table.lang))
    raw = np.zeros((len(names), size))
    raw[table.lang.map({k: i for i, k in enumerate(names)}), table.i] = table.v
    raw = unit(raw)
    shared = raw.mean(axis=0) if len(names) > 1 else np.zeros(size)
    return Profiles(names, unit(raw - shared), shared, gram)


def predict(docs: DataFrame, profiles: Profiles | None, text: str = "text") -> DataFrame:
    """docs(id, held_out, text) as (id, held_out, lang_pred, score)."""

    def step(batches):
        for b in batches:
            langs, scores = [], []
            for _, texts in _parts(b, text):
                names, near = profiles.predict(texts) if profiles else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                langs += names
                scores.append(near)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["id", "held_out", "lang_pred", "score"]
            )

    schema = f"id {dict(docs.dtypes)['id']}, held_out boolean, lang_pred string, score double"
    return docs.select("id", "held_out", F.col(quoted(text)).cast("string").alias(text)).mapInArrow(step, schema)


def held_out(id: Column) -> Column:
    """True for a fourth of the ids, by checksum; null ids are not held out."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of all rows, learned from those that are not held out."""
    x = docs.select(F.col(quoted(id)).alias("id"), held_out(F.col(quoted(id))).alias("held_out"), F.col(quoted(text)).alias("text"), F.col(quoted(lang)).alias("lang"))
    return predict(x, fit(x.where("not held_out")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    return identify(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
