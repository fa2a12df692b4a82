"""Hidden Markov language model over whole texts.

Hidden states emit symbols: each of the most frequent training tokens is a symbol of its
own, all others share hashed symbols, and a token's probability within a shared symbol
comes from its count in the whole training corpus. Baum-Welch statistics are made by
partition and summed by Spark; the scaled forward recursion gives a text's exact likelihood.

Counts of all distinct tokens stay in a table. Only the most frequent ones (at most
HOT_WORDS, a fixed bound) go to the workers, which leaves the few rare tokens of each
text to a join on the token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare_workers

STATES = 8
OWN_SYMBOLS = 4096
SHARED_SYMBOLS = 2048
HOT_WORDS = 1 << 19
ROUNDS = 2                               # of Baum-Welch, each over all training texts
BATCH_TOKENS = 200_000
SEGMENT = 50_000                         # positions of one text held at once
END = b"\n"                              # no word has white space in it


def hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of each token. Two of V tokens share one with a chance of V^2 / 2^65."""
    if not tokens:
        return np.zeros(0, np.uint64)
    values = np.empty(len(tokens), object)
    values[:] = tokens
    return pd.util.hash_array(values, categorize=False)


END_HASH = int(hashes([END])[0])


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each ended by the end token, and the token counts."""
    flat, counts = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        own.append(END)
        flat += own
        counts[i] = len(own)
    return hashes(flat), counts


@dataclass
class Vocabulary:
    """What workers know of the counts. All arrays are bounded by HOT_WORDS or the symbols."""
    hot: np.ndarray           # hashes, ascending
    hot_log: np.ndarray       # log10(count + 1)
    own: np.ndarray           # hashes of the tokens with a symbol of their own, ascending
    shared_log: np.ndarray    # log10(tokens + distinct + 1) of each shared symbol
    total: int                # tokens of the training texts
    distinct: int

    @property
    def symbols(self) -> int:
        return len(self.own) + SHARED_SYMBOLS

    def symbol(self, h: np.ndarray) -> np.ndarray:
        """Own symbols come first, then the shared ones."""
        shared = len(self.own) + (h % np.uint64(SHARED_SYMBOLS)).astype(np.int64)
        at = _find(self.own, h)
        return np.where(at >= 0, at, shared)


def _find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each value in an ascending array, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return np.where(known[at] == h, at, -1)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c): the number of each token in all texts."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, c = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return h[first], np.add.reduceat(c, first)

        def rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for b in batches:
            h, c = np.unique(tokens_of(b.column(0).to_pylist())[0], return_counts=True)
            held, size = held + [(h, c)], size + len(h)
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 750_000:
                    yield rows(*held[0])
                    held, size = [], 0
        if size:
            yield rows(*merged())

    return texts.select("text").mapInArrow(tally, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of the counts. ``counts`` should be materialised."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    by_size = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("n")).collect()}
    k, room = 64, HOT_WORDS                       # at most 64 rows: one for each power of two
    while k > 0 and room >= by_size.get(k - 1, 0):
        k, room = k - 1, room - by_size.get(k - 1, 0)
    hot = counts.where(F.col("c") >= 2.0 ** k).toPandas()
    h, c = hot["h"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    own = np.lexsort((h, -c))[:OWN_SYMBOLS]
    if len(h) and END_HASH in h and int(np.searchsorted(h, END_HASH)) not in own:
        own = np.r_[own[:-1], np.searchsorted(h, END_HASH)]
    # Shared symbols hold what is left of their tokens when the own ones are taken out.
    tokens, words = np.zeros(SHARED_SYMBOLS), np.zeros(SHARED_SYMBOLS)
    unsigned = F.pmod("h", F.lit(SHARED_SYMBOLS))  # the modulus is a power of two, so the sign is no matter
    for r in counts.groupBy(unsigned.alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r["s"]], words[r["s"]] = r["c"], r["n"]
    at = (h[own] % np.uint64(SHARED_SYMBOLS)).astype(np.int64)
    np.subtract.at(tokens, at, c[own])
    np.subtract.at(words, at, 1)
    return Vocabulary(h, np.log10(c + 1.0), np.sort(h[own]), np.log10(tokens + words + 1), total[0] or 0, total[1])


class Model:
    """Start, transition and emission probabilities of the hidden states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit   # K, K x K, symbols x K

    @classmethod
    def first(cls, symbols: int, states: int = STATES, seed: int = 7) -> Model:
        """A start that breaks the symmetry of the states, the same at each call."""
        rng = np.random.default_rng(seed)
        emit = np.exp(rng.normal(0, 0.7, (symbols, states)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of(cls, stats: np.ndarray, states: int = STATES) -> Model:
        """From summed statistics: one row of starts, ``states`` of moves, then the symbols."""
        start, move, emit = stats[0] + 1, stats[1:states + 1] + 1, stats[states + 1:]
        # Each state's emissions lean a little to the symbols' overall shares, so none is 0.
        overall = emit.sum(1, keepdims=True) + 0.5
        emit = emit + 50 * overall / overall.sum()
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Packed:
    """Sequences side by side in time: the tokens of step t of all that are longer than t."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        lengths = counts[self.order]
        starts = (np.cumsum(counts) - counts)[self.order]
        self.rank = np.repeat(np.arange(len(counts)), lengths)
        within = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        by_time = np.argsort(within, kind="stable")
        self.rank = self.rank[by_time]
        self.symbols = symbols[(np.repeat(starts, lengths) + within)[by_time]]
        self.active = np.bincount(within, minlength=lengths[0]) if len(lengths) else np.zeros(0, np.int64)
        self.at = np.cumsum(self.active) - self.active


def forward(model: Model, p: Packed, first: np.ndarray | None = None, keep: np.ndarray | None = None,
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale of every token, the emissions, and the last step's scaled state probabilities.
    ``first``: state probabilities before the first token, if it continues a text. ``keep``
    receives all scaled state probabilities."""
    emissions = model.emit[p.symbols]
    scale = np.empty(len(p.symbols))
    a = np.zeros((0, len(model.start)))
    for t, (n, at) in enumerate(zip(p.active.tolist(), p.at.tolist())):
        if t:
            a = (a[:n] @ model.move) * emissions[at:at + n]
        else:
            a = (model.start if first is None else first @ model.move) * emissions[at:at + n]
        s = a.sum(1)
        a /= s[:, None]
        scale[at:at + n] = s
        if keep is not None:
            keep[at:at + n] = a
    return scale, emissions, a


def log_likelihood(model: Model, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 likelihood of each symbol sequence; a long one goes by segments that hand on
    the state probabilities, so the recursion is exact at any length."""
    out = np.zeros(len(counts))
    ends = np.cumsum(counts)
    short = np.flatnonzero(counts <= SEGMENT)
    if len(short):
        p = Packed(np.concatenate([symbols[ends[i] - counts[i]:ends[i]] for i in short]), counts[short])
        scale, _, _ = forward(model, p)
        by_rank = np.bincount(p.rank, weights=np.log10(scale), minlength=len(short))
        out[short[p.order]] = by_rank
    for i in np.flatnonzero(counts > SEGMENT):
        state = None
        for lo in range(ends[i] - counts[i], ends[i], SEGMENT):
            part = symbols[lo:min(lo + SEGMENT, ends[i])]
            scale, _, a = forward(model, Packed(part, np.array([len(part)])), state)
            state = a[0]
            out[i] += np.log10(scale).sum()
    return out


def _add(model: Model, p: Packed, into: np.ndarray, first: np.ndarray | None, after: np.ndarray) -> np.ndarray:
    """Add the expected moves and emissions of packed sequences, and their starts unless they continue a text
    (``first``). ``after``: what follows the last step (empty at a text's end); returns the same for the
    step before the first."""
    states = len(model.start)
    alpha = np.empty((len(p.symbols), states))
    scale, emissions, _ = forward(model, p, first, keep=alpha)
    emissions /= scale[:, None]
    active, at = p.active.tolist(), p.at.tolist()
    for t in range(len(active) - 1, -1, -1):
        n, lo = active[t], at[t]
        beta = np.ones((n, states))
        m = len(after)
        if m:
            into[1:states + 1] += model.move * (alpha[lo:lo + m].T @ after)
            beta[:m] = after @ model.move.T
        after = emissions[lo:lo + n] * beta        # beta of this step, times its emissions
        alpha[lo:lo + n] *= beta                   # now the posterior of the states
    if active and first is None:
        into[0] += alpha[:active[0]].sum(0)
    for k in range(states):
        into[states + 1:, k] += np.bincount(p.symbols, weights=alpha[:, k], minlength=len(into) - states - 1)
    return after


def statistics(model: Model, symbols: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
    """Add the expected starts, moves and emissions of the sequences. A very long one goes by segments:
    forward once, keeping the state probabilities between them, then backward with what follows
    each segment handed on, so its expectations are those of the whole."""
    none, ends = np.zeros((0, len(model.start))), np.cumsum(counts)
    short = np.flatnonzero(counts <= SEGMENT)
    if len(short):
        _add(model, Packed(np.concatenate([symbols[ends[i] - counts[i]:ends[i]] for i in short]), counts[short]), into, None, none)
    for i in np.flatnonzero(counts > SEGMENT):
        parts = [symbols[lo:min(lo + SEGMENT, ends[i])] for lo in range(ends[i] - counts[i], ends[i], SEGMENT)]
        before = [None]
        for part in parts[:-1]:
            before.append(forward(model, Packed(part, np.array([len(part)])), before[-1])[2][0])
        after = none
        for part, first in zip(reversed(parts), reversed(before)):
            after = _add(model, Packed(part, np.array([len(part)])), into, first, after)


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_TOKENS tokens at five characters each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= 5 * BATCH_TOKENS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def baum_welch(texts: DataFrame, vocab: Vocabulary, model: Model) -> Model:
    """One round over all texts: statistics by partition, summed by Spark by row."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vocab, model))
    states = len(model.start)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        into, seen = np.zeros((1 + states + vocab.symbols, states)), False
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in _chunks(texts):
                h, counts = tokens_of(texts[lo:hi])
                statistics(model, vocab.symbol(h), counts, into)
                seen = True
        if seen:
            at = np.flatnonzero(into.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at)] + [pa.array(into[at, k]) for k in range(states)],
                                             names=["row"] + [f"s{k}" for k in range(states)])

    schema = "row int, " + ", ".join(f"s{k} double" for k in range(states))
    sums = (texts.select("text").mapInArrow(expect, schema).groupBy("row")
            .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).toPandas())
    stats = np.zeros((1 + states + vocab.symbols, states))
    stats[sums["row"].to_numpy(np.int64)] = sums.drop(columns="row").to_numpy()
    return Model.of(stats, states)


def train(texts: DataFrame) -> tuple[DataFrame, Vocabulary, Model]:
    """Token counts, vocabulary and model of all rows of (text); counts and every round take all of them."""
    prepare_workers(texts.sparkSession)
    texts = texts.select("text")
    counts = materialise(count_tokens(texts), "hmm-counts")
    vocab = vocabulary(counts)
    model = Model.first(vocab.symbols)
    for _ in range(ROUNDS):
        model = baum_welch(texts, vocab, model)
    return counts, vocab, model


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    base_score is the log10 probability under add-one counts, score that of the model.
    A null or empty text is the end token alone. Each row is scored for itself, so null and
    repeated ids change nothing; an empty table gives no rows. Without training texts no
    token is known and both scores come from the unseen token's share.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast((vocab, model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        key = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                h, n = tokens_of(texts[lo:hi])
                doc = np.repeat(np.arange(hi - lo), n)
                add = lambda w, d=doc, m=hi - lo: np.bincount(d, weights=w, minlength=m)
                symbols, at = vocab.symbol(h), _find(vocab.hot, h)
                hot, is_shared = at >= 0, symbols >= len(vocab.own)
                logs = np.where(hot, vocab.hot_log[at] if len(vocab.hot) else 0, 0)
                within = np.where(is_shared, logs - vocab.shared_log[np.maximum(symbols - len(vocab.own), 0)], 0)
                rare, rare_n = np.unique(np.stack([doc[~hot].astype(np.uint64), h[~hot]], 1), axis=0, return_counts=True) \
                    if not hot.all() else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
                cuts = np.searchsorted(rare[:, 0], np.arange(hi - lo + 1).astype(np.uint64))
                hmm = log_likelihood(model, symbols, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(key + np.arange(hi - lo)), ids.slice(lo, hi - lo), pa.array(n),
                    pa.array(add(hot).astype(np.int64)), pa.array(add(logs)), pa.array(hmm + add(within)),
                    pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(rare[:, 1].copy().view(np.int64))),
                    pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(rare_n.astype(np.int64)))],
                    names=["key", "doc_id", "n_tokens", "n_hot", "hot_log", "part", "rare", "rare_n"])
                key += hi - lo

    per_doc = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        measure, "key long, doc_id long, n_tokens long, n_hot long, hot_log double, part double, "
                 "rare array<long>, rare_n array<long>"), "hmm-docs")
    # Tokens beyond the hot ones: a few for each text, joined on their hash.
    rare = (per_doc.select("key", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
            .select("key", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("n")))
    found = (rare.join(counts, "h").groupBy("key")
             .agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unit = float(np.log10(vocab.total + vocab.distinct + 1))
    return per_doc.join(found, "key", "left").select(
        "doc_id", "n_tokens", (F.col("n_hot") + zero("n_rare")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("hot_log") + zero("rare_log") - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("part") + zero("rare_log")).alias("score"))
