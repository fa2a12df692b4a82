"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, prepare_workers

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MAX_LANGS = 4096          # more distinct labels than this aren't languages
SMOOTHING = 0.01
# The model is fit on about so many labelled rows a language, chosen by a hash of the text.
TRAIN_ROWS = 5000
UNKNOWN = "und"
MIN_SCORE = 0.5
_SLICE = 1 << 20          # positions scored at once, whatever the length of a text
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between spaces, and where each begins."""
    padded = [f" {t.lower()}  " for t in texts]
    starts = np.cumsum([0] + [len(p) for p in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return codes, starts


def _buckets(codes: np.ndarray, starts: np.ndarray, n: int, lo: int, hi: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram at each position lo..hi; ``buckets`` itself where the n-gram
    would reach beyond its text."""
    h = np.zeros(hi - lo, np.uint64)
    for k in range(n):
        part = codes[lo + k:hi + k]
        h[:len(part)] = h[:len(part)] * np.uint64(0x100000001B3) + part + np.uint64(n)
    out = ((h * _MIX) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
    for k in range(1, n):
        over = starts[1:] - k
        over = over[(over >= lo) & (over < hi)]
        out[over - lo] = buckets
    return out


def _slices(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(codes), _SLICE):
        yield lo, min(lo + _SLICE, len(codes))


def count_ngrams(texts: list[str], buckets: int) -> np.ndarray:
    codes, starts = _codes(texts)
    out = np.zeros(buckets, np.int64)
    for lo, hi in _slices(codes):
        for n in ORDERS:
            out += np.bincount(_buckets(codes, starts, n, lo, hi, buckets), minlength=buckets + 1)[:buckets]
    return out


def log_likelihood(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``matrix`` (buckets + 1 x languages, the last row zero) over each text's n-grams."""
    codes, starts = _codes(texts)
    out = np.zeros((len(texts), matrix.shape[1]))
    for lo, hi in _slices(codes):
        first = np.searchsorted(starts, lo, "right") - 1
        last = np.searchsorted(starts, hi, "left")
        cuts = np.maximum(starts[first:last], lo) - lo
        for n in ORDERS:
            rows = matrix[_buckets(codes, starts, n, lo, hi, len(matrix) - 1)]
            out[first:last] += np.add.reduceat(rows, cuts, axis=0, dtype=np.float64)
    return out


class Model:
    """Languages (ascending), log prior, and the log-probability matrix."""

    def __init__(self, langs: list[str], prior: np.ndarray, counts: np.ndarray):
        """``counts``: languages x buckets."""
        self.langs, self.prior = langs, prior
        p = counts + SMOOTHING
        logs = np.log(p / p.sum(1, keepdims=True))
        self.matrix = np.vstack([logs.T, np.zeros((1, len(langs)))]).astype(np.float32)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and its posterior probability; ``und`` and 0 for a null text, one
        without a letter, or when nothing was learned."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        told = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))]
        if told and self.langs:
            z = log_likelihood([texts[i] for i in told], self.matrix) + self.prior
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k, q in zip(told, p.argmax(1), p.max(1)):
                langs[i], scores[i] = self.langs[k], float(q)
        return langs, scores


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on (text, lang). Labels that are null and texts that are null are left out.

    Priors count all labelled rows; n-grams come from about ``train_rows`` distinct texts a language
    (all, if it has fewer, and one at least), whole texts, however often each is repeated. Tasks count by language and bucket, Spark sums,
    and the sums (languages x BUCKETS at most) make the matrix. The number of buckets halves
    while languages x buckets exceeds 16 M, so the matrix stays under 64 MB.
    """
    spark = labelled.sparkSession
    prepare_workers(spark)
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} distinct values of lang")
    langs, buckets = sorted(sizes), BUCKETS
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, buckets)))
    while buckets * len(langs) > 1 << 24 and buckets > 1 << 10:
        buckets //= 2
    place = {x: i for i, x in enumerate(langs)}
    # Distinct texts of a language are thinned by their hash; the one with the smallest always stays.
    h = F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 62))
    texts = rows.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    limit = F.lit(-1).cast("long")
    for r in texts.collect():
        own = max(r["least"], int(min(1.0, train_rows / r["n"]) * (1 << 62)))
        limit = F.when(F.col("lang") == r["lang"], own).otherwise(limit)
    chosen = rows.withColumn("h", h).where(F.col("h") <= limit).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                got = count_ngrams(texts.tolist(), buckets)
                counts[lang] = counts[lang] + got if lang in counts else got
        for lang, got in counts.items():
            at = got.nonzero()[0]
            yield pd.DataFrame({"lang": place[lang], "bucket": at, "n": got[at]})

    sums = (chosen.select("lang", "text").mapInPandas(tally, "lang int, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((len(langs), buckets))
    counts[sums["lang"].to_numpy(np.int64), sums["bucket"].to_numpy(np.int64)] = sums["n"]
    prior = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
    return Model(langs, prior, counts)


def predict(docs: DataFrame, model: Model, carry: bool = False, keep: Column | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text, in numpy batches against the
    broadcast matrix. Only the text is read by the model. With ``carry`` the whole row comes
    along in ``__threadlens_row``. Null and repeated ids change nothing; an empty table
    gives no rows."""
    spark = docs.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        values, langs, scores = texts.tolist(), [], []
        at = 0
        while at < len(values):       # so many texts at once that their code points stay small
            end, size = at, 0
            while end < len(values) and (end == at or size < _SLICE):
                size += len(values[end] or "")
                end += 1
            a, b = shared.value.predict(values[at:end])
            langs, scores, at = langs + a, scores + b, end
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)] if carry else []
    return docs.select(*own, "doc_id", guess(F.col("text")).alias("p")).select(
        *([ROW] if carry else []), "doc_id", "p.lang_pred", "p.score")


def known_language(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with a probability of at least ``min_score``."""
    told = predict(docs, model, carry=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return told.select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns])
