"""A hidden Markov language model: Baum-Welch over all training texts, exact scores by the scaled forward recursion.

Tokens are words of the lower-cased text, then one end. Their counts over all training texts form a distributed table. The emission
alphabet is bounded: the OWN most frequent tokens are symbols of their own, all others share RARE symbols by hash, and
P(token | state) = P(symbol | state) * P(token | symbol), where a shared symbol gives its tokens (count + 1) / (its total + its distinct + 1);
the one left over is for tokens that were never seen. README gives the held-out scores of other bounds.

Each Baum-Welch round runs over every training text as a whole: tasks add up expected counts of starts, steps and emissions, and a
distributed sum by index joins them. A text longer than SEGMENT tokens is cut for the work only: the product of its segments' transition and emission
matrices carries the forward state into each segment and the backward state back into it, so counts are those of the uncut text and memory is bounded.
Rounds end when the log-likelihood a round starts from gains less than TOLERANCE of itself, or after ROUNDS.

The TOP most frequent tokens' counts go to every task (a bounded table); what is not among them is looked up by a join.

Defined results: a null or empty text is one end token; rows without doc_id are training texts; repeated rows count and are scored
each; an empty table gives an empty result; other columns are ignored. Tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import textops
from logloom.shared import cut

STATES = 8
OWN = 1 << 14
RARE = 1 << 10
TOP = 1 << 17
ROUNDS = 6
TOLERANCE = 1e-3
SEGMENT = 512
#: Segments that are worked on side by side.
SLAB = 1024
STICKY = 0.9
SMOOTHING = 0.02
SEED = 11

_U = np.uint64
END = np.array([0x454E44], _U)  # the end token's hash before mixing
_END = textops.mix64(END)[0]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts (each text's words, then its end), and their offsets by text."""
    if len(data):
        low = textops.lower(data)
        starts, ends, of_doc = textops.word_spans(low, off)
        w = textops.span_hashes(low, starts, ends)
    else:
        w, of_doc = np.zeros(0, _U), np.zeros(len(off), np.int64)
    n = len(off) - 1
    out = np.empty(len(w) + n, _U)
    ends = of_doc[1:] + np.arange(n)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = w
    out[ends] = _END
    return out, np.append(0, ends + 1)


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, n) over all texts of docs."""

    def run(batches):
        for batch in batches:
            data, off = textops.buffer(textops.column(batch, "__text"))
            every = [tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])[0] for i, j in textops.chunks(off)]
            t, n = np.unique(np.concatenate(every) if every else np.zeros(0, _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["token", "n"])

    x = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "token bigint, n bigint")
    return x.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of the vocabulary: bounded arrays, and three totals."""

    token: np.ndarray  # sorted hashes of the TOP tokens
    n: np.ndarray  # their counts
    symbol: np.ndarray  # their symbols
    rare_total: np.ndarray  # log10 of each shared symbol's denominator
    total: int
    distinct: int

    def look_up(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, count (0 if not among TOP) and whether it is among TOP, of each token."""
        if not len(self.token):
            return OWN + (t % _U(RARE)).astype(np.int64), np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        at = np.minimum(np.searchsorted(self.token, t), len(self.token) - 1)
        hit = self.token[at] == t
        return (
            np.where(hit, self.symbol[at], OWN + (t % _U(RARE)).astype(np.int64)),
            np.where(hit, self.n[at], 0),
            hit,
        )


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Up to `most` of the most frequent tokens: all above a count that a histogram of some hundred bins gives, and those of the bin at the border whose
    hashes come first, so the number does not jump when the vocabulary grows.

    A sorted limit would send that many rows of each task to the driver; this sends them once.
    """

    def whole_bins(of: DataFrame, bin_of, room: int, falling: bool):
        """The bins that fit, the first that doesn't (or null), and the room left."""
        bins = of.groupBy(bin_of.alias("b")).agg(F.count("*").alias("k")).collect()
        last = None
        for b, k in sorted(map(tuple, bins), reverse=falling):
            if k > room:
                return last, b, room
            last, room = b, room - k
        return last, None, room

    count_bin, hash_bin = F.floor(16 * F.log2("n")), F.pmod(F.xxhash64("token"), F.lit(1024))
    lowest, border, room = whole_bins(counts, count_bin, most, True)
    out = count_bin >= lowest if lowest is not None else F.lit(False)
    if border is not None:
        last, _, _ = whole_bins(counts.where(count_bin == border), hash_bin, room, False)
        if last is not None:
            out = out | (count_bin == border) & (hash_bin <= last)
    return counts.where(out)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, TOP).toPandas().sort_values(["n", "token"], ascending=[False, True])
    token = top["token"].to_numpy(np.int64).view(_U)
    n = top["n"].to_numpy(np.int64)
    symbol = np.where(np.arange(len(n)) < OWN, np.arange(len(n)), OWN + (token % _U(RARE)).astype(np.int64))
    # Shared symbols: totals of all tokens less those of the OWN first.
    bucket = F.col("token").bitwiseAND(F.lit(RARE - 1).cast("long")).cast("int")  # RARE is a power of two
    sums, kinds = np.zeros(RARE), np.zeros(RARE)
    for b, s, k in counts.groupBy(bucket.alias("b")).agg(F.sum("n"), F.count("*")).collect():  # RARE rows
        sums[b], kinds[b] = s, k
    own = (token[:OWN] % _U(RARE)).astype(np.int64)
    np.subtract.at(sums, own, n[:OWN])
    np.subtract.at(kinds, own, 1)
    order = np.argsort(token)
    return Vocabulary(token[order], n[order], symbol[order], np.log10(sums + kinds + 1), int(total), int(distinct))


def sequences(docs: DataFrame, text: str, vocab: Vocabulary) -> DataFrame:
    """Each text as symbols, with the sums that need no join, and its tokens outside TOP with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        v = sent.value
        unit = np.log10(v.total + v.distinct + 1)
        for batch in batches:
            data, off = textops.buffer(textops.column(batch, "__text"))
            sym, n_tokens, n_known, base, given, rare = [], [], [], [], [], []
            for i, j in textops.chunks(off):
                t, at = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                s, n, hit = v.look_up(t)
                here = np.where(hit, np.log10(n + 1.0), 0.0)
                own = hit & (s < OWN)
                within = np.where(own, 0.0, here - v.rare_total[np.maximum(s - OWN, 0)])
                sym += [x.astype("<u2").tobytes() for x in np.split(s, at[1:-1])]
                n_tokens += np.diff(at).tolist()
                n_known += np.add.reduceat(hit, at[:-1]).tolist()
                base += (np.add.reduceat(here, at[:-1]) - unit * np.diff(at)).tolist()
                given += np.add.reduceat(within, at[:-1]).tolist()
                for x, h in zip(np.split(t.view(np.int64), at[1:-1]), np.split(hit, at[1:-1])):
                    k, c = np.unique(x[~h], return_counts=True)
                    rare.append([{"token": a, "k": b} for a, b in zip(k.tolist(), c.tolist())])
            kind = pa.list_(pa.struct([("token", pa.int64()), ("k", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sym, pa.binary()), pa.array(n_tokens, pa.int64()),
                 pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(given, pa.float64()), pa.array(rare, kind)],
                names=["doc_id", "held_out", "symbols", "n_tokens", "n_known", "base", "given", "rare"],
            )

    return (
        docs.select("doc_id", "held_out", F.col(text).cast("string").alias("__text"))
        .mapInArrow(
            run,
            "doc_id bigint, held_out boolean, symbols binary, n_tokens bigint, n_known bigint, base double, given double, "
            "rare array<struct<token:bigint,k:bigint>>",
        )
        .withColumn("row", F.monotonically_increasing_id())
    )


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray  # from state to state
    emit: np.ndarray  # symbol by state


def first_model(vocab: Vocabulary) -> Model:
    """Sticky states around the unigram distribution, told apart by fixed noise."""
    m = OWN + RARE
    unigram = np.bincount(vocab.symbol, weights=vocab.n, minlength=m)[:m] + 1.0
    noise = np.exp(np.random.default_rng(SEED).normal(scale=0.7, size=(m, STATES)))
    emit = unigram[:, None] * noise
    step = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
    np.fill_diagonal(step, STICKY)
    flat = np.full(STATES, 1 / STATES)
    return Model(flat, step, (emit / emit.sum(axis=0)).astype(np.float32))


def _laid_out(segments: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Segments of falling length side by side, (longest, number), and how many are longer than t at each t."""
    length = np.array([len(s) for s in segments])
    sym = np.zeros((int(length[0]), len(segments)), np.int64)
    for k, s in enumerate(segments):
        sym[: len(s), k] = s
    return sym, np.searchsorted(-length, -np.arange(len(sym)), "left").tolist()


def _products(model: Model, segments: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
    """For each segment the product of its steps and emissions, scaled: it takes the state before the segment to the one at its end."""
    sym, live = _laid_out(segments)
    step = model.step.astype(np.float32)
    first = np.where(begins[:, None, None], model.start.astype(np.float32)[None, None, :], step[None])
    out = first * model.emit[sym[0]][:, None, :]
    for t in range(1, len(sym)):
        m = live[t]
        x = (out[:m] @ step) * model.emit[sym[t, :m]][:, None, :]
        out[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    return out / out.sum(axis=(1, 2), keepdims=True)


def _borders(model: Model, segments: list[np.ndarray], text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward state before each segment and the backward state after it, both up to scale; of whole texts they are not used and 1."""
    n = len(segments)
    ahead, behind = np.ones((n, STATES), np.float32), np.ones((n, STATES), np.float32)
    several = np.flatnonzero(np.bincount(text)[text] > 1)
    if not len(several):
        return ahead, behind
    product = np.empty((n, STATES, STATES), np.float32)
    for a in range(0, len(several), SLAB):
        k = several[a : a + SLAB]
        k = k[np.argsort([-len(segments[i]) for i in k], kind="stable")]
        product[k] = _products(model, [segments[i] for i in k], place[k] == 0)
    last = np.zeros(int(text.max()) + 1, np.int64)
    np.maximum.at(last, text, place)
    for p in range(1, int(place.max()) + 1):  # segments of a text follow each other in the list
        k = np.flatnonzero(place == p)
        x = product[k - 1, 0] if p == 1 else np.einsum("ni,nij->nj", ahead[k - 1], product[k - 1])
        ahead[k] = x / x.sum(axis=1, keepdims=True)
    for p in range(int(place.max()) - 1, -1, -1):
        k = np.flatnonzero((place == p) & (last[text] > p))
        x = np.einsum("nij,nj->ni", product[k + 1], behind[k + 1])
        behind[k] = x / x.sum(axis=1, keepdims=True)
    return ahead, behind


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Expected starts, steps and emissions over whole texts by the forward-backward recursions, and the natural log-likelihood."""
    segments, text, place = [], [], []
    for i, x in enumerate(texts):
        for p, a in enumerate(range(0, len(x), SEGMENT)):
            segments.append(x[a : a + SEGMENT])
            text.append(i)
            place.append(p)
    text, place = np.array(text), np.array(place)
    ahead, behind = _borders(model, segments, text, place)
    starts, steps = np.zeros(STATES), np.zeros((STATES, STATES))
    emit, likelihood = np.zeros((OWN + RARE, STATES)), 0.0
    order = np.argsort([-len(s) for s in segments], kind="stable")
    for a in range(0, len(order), SLAB):
        k = order[a : a + SLAB]
        x = _slab_counts(model, [segments[i] for i in k], place[k] == 0, ahead[k], behind[k])
        starts += x[0]
        steps += x[1]
        for state in range(STATES):
            emit[:, state] += np.bincount(x[2], weights=x[3][:, state], minlength=OWN + RARE)
        likelihood += x[4]
    return starts, steps, emit, np.array([likelihood])


def _slab_counts(model: Model, segments: list[np.ndarray], begins: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple:
    """Expected starts and steps, symbols with their state probabilities, and the log-likelihood of segments between known states."""
    sym, live = _laid_out(segments)
    width, n = sym.shape
    step = model.step.astype(np.float32)
    alpha = np.empty((width, n, STATES), np.float32)
    scale = np.ones((width, n), np.float32)
    a = np.where(begins[:, None], model.start.astype(np.float32), ahead @ step)
    for t in range(width):
        m = live[t]
        if t:
            a = alpha[t - 1, :m] @ step
        a = a[:m] * model.emit[sym[t, :m]]
        c = a.sum(axis=1)
        alpha[t, :m] = a / c[:, None]
        scale[t, :m] = c
    end = np.array([len(s) for s in segments]) - 1
    beta = behind / (alpha[end, np.arange(n)] * behind).sum(axis=1, keepdims=True)
    steps = np.zeros((STATES, STATES))
    for t in range(width - 1, -1, -1):
        m = live[t]
        b = model.emit[sym[t, :m]] * beta[:m] / scale[t, :m, None]
        if t:
            steps += model.step * (alpha[t - 1, :m].T @ b)
        else:
            steps += model.step * (ahead[~begins].T @ b[~begins])
        # alpha becomes the posterior in place: position t is done with it.
        alpha[t, :m] *= beta[:m]
        beta[:m] = b @ step.T
    flat = np.concatenate([sym[t, : live[t]] for t in range(width)])
    gamma = np.concatenate([alpha[t, : live[t]] for t in range(width)])
    gamma /= gamma.sum(axis=1, keepdims=True)
    g0 = alpha[0] / alpha[0].sum(axis=1, keepdims=True)
    likelihood = sum(float(np.log(scale[t, : live[t]]).sum(dtype=np.float64)) for t in range(width))
    return g0[begins].sum(axis=0), steps, flat, gamma, likelihood


def improved(starts: np.ndarray, steps: np.ndarray, emit: np.ndarray, smoothing: float = SMOOTHING) -> Model:
    """The model that the expected counts give, with a little mass everywhere."""
    starts, steps, emit = starts + 5 * smoothing, steps + 5 * smoothing, emit + smoothing
    return Model(starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32))


def train(seq: DataFrame, model: Model, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[Model, list[float]]:
    """Baum-Welch rounds over all rows of seq that are not held out; the model, and the log-likelihood that each round started from."""
    spark = seq.sparkSession
    texts = seq.where("not held_out").select("symbols")
    m, history = OWN + RARE, []
    sizes = np.cumsum([STATES, STATES * STATES, m * STATES, 1])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            total = np.zeros(sizes[-1])

            def add(texts):
                total[:] += np.concatenate([y.ravel() for y in expected_counts(sent.value, texts)])

            for batch in batches:
                held, size = [], 0
                for s in batch.column(0).to_pylist():
                    held.append(np.frombuffer(s, "<u2"))
                    size += len(held[-1])
                    if size > 400_000:
                        add(held)
                        held, size = [], 0
                if held:
                    add(held)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["ix", "x"])

        sums = texts.mapInArrow(run, "ix int, x double").groupBy("ix").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(sizes[-1])  # a number of parameters that is fixed
        total[sums["ix"].to_numpy()] = sums["x"].to_numpy()
        starts, steps, emit, likelihood = np.split(total, sizes[:-1])
        history.append(float(likelihood[0]))
        model = improved(starts, steps.reshape(STATES, STATES), emit.reshape(m, STATES))
        sent.unpersist()
        if len(history) > 1 and history[-1] - history[-2] < tolerance * abs(history[-1]):
            break
    return model, history


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 P(symbols) of each whole text: the scaled forward recursion over all texts at once."""
    length = np.array([len(t) for t in texts])
    order = np.argsort(-length, kind="stable")
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    size = length[order]
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.zeros(len(texts))
    step, a = model.step, np.broadcast_to(model.start, (len(texts), STATES))
    m = len(texts)
    for t in range(int(size[0]) if len(size) else 0):
        while m and size[m - 1] <= t:
            m -= 1
        a = a[:m] @ step if t else a[:m]
        a = a * model.emit[flat[at[:m] + t]]
        c = a.sum(axis=1)
        a /= c[:, None]
        out[:m] += np.log10(c)
    back = np.empty(len(texts))
    back[order] = out
    return back


def score(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, counts, base_score and score of each row of docs(doc_id, held_out, text); learns from rows that are not held out."""
    counts = cut(count_tokens(docs.where("not held_out"), text), "tokens")
    vocab = vocabulary(counts)
    seq = cut(sequences(docs, text, vocab), "sequences")
    model, _ = train(seq, first_model(vocab), rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(s, "<u2") for s in batch.column(1).to_pylist()]
            x = log_likelihoods(sent.value, texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x)], names=["row", "model"])

    scored = cut(seq.select("row", "symbols").mapInArrow(run, "row bigint, model double"), "scored")
    rare = seq.select("row", F.inline("rare")).join(counts, "token", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("known"),
    )
    x = seq.drop("symbols", "rare").join(scored, "row").join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return x.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + F.col("given") + logs).alias("score"),
    )


def op4_hmm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs.withColumn("held_out", held))
