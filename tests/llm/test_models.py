"""Language ID and the hidden Markov model: definitions, held-out accuracy, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from helpers import empty_documents, lower_az, odd_documents, words
from pyspark.sql import functions as F

from threadlens.llm import hmm, langid, queries
from threadlens.llm.common import remainder

SF = "/root/testdata/sf0.01"


def test_langid_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    held = got.join(docs, "doc_id").where("held_out and length(text) > 40")
    n, right = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert got.count() == docs.count() and n > 100 and right / n > 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_langid_sums_the_matrix_exactly():
    texts = ["abc", "a", "zz top " * 300, "ü"]
    counts = np.random.default_rng(1).integers(0, 50, (3, langid.BUCKETS)).astype(float)
    m = langid.Model(["x", "y", "z"], np.log([0.2, 0.3, 0.5]), counts)
    got = langid.log_likelihood(texts, m.matrix)
    for i, t in enumerate(texts):
        alone = sum((m.matrix[:-1] * langid.count_ngrams([t], langid.BUCKETS)[:, None]).astype(float))
        assert got[i] == pytest.approx(alone, rel=1e-5)
        chars = len(t.lower()) + 3
        assert langid.count_ngrams([t], langid.BUCKETS).sum() == chars + (chars - 1) + (chars - 2)


def test_langid_slices_change_nothing(monkeypatch):
    texts = ["one two three", "four", "fünf sechs sieben acht neun zehn", "x"]
    counts = np.random.default_rng(2).integers(0, 50, (2, langid.BUCKETS)).astype(float)
    m = langid.Model(["x", "y"], np.zeros(2), counts)
    whole = langid.log_likelihood(texts, m.matrix)
    monkeypatch.setattr(langid, "_SLICE", 7)
    assert langid.log_likelihood(texts, m.matrix) == pytest.approx(whole)


def test_langid_odd_rows(spark):
    docs = odd_documents(spark)
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    undefined = sum(not any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    assert sum(r["lang_pred"] == "und" for r in got) == undefined
    assert set(r["lang_pred"] for r in got) <= {"und", "en", "de", "fr", "es"}
    assert langid.known_language(docs, model).columns == docs.columns
    nothing = langid.train(empty_documents(spark))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty_documents(spark), model).count() == 0


def tokens(text):
    return words(lower_az(text)) + ["\n"]


def test_hmm_base_and_held_out_gain(spark):
    got = {r["doc_id"]: r for r in queries.op8_hmm_scores(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", remainder(F.col("doc_id"), 7, 2).alias("held")).collect()
    count = Counter(t for r in rows if not r["held"] for t in tokens(r["text"]))
    total, distinct = sum(count.values()), len(count)
    model = base = 0.0
    for r in rows:
        g, ts = got[r["doc_id"]], tokens(r["text"])
        want = sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in ts)
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (
            r["held"], len(ts), sum(t in count for t in ts), total)
        assert g["base_score"] == pytest.approx(want, rel=1e-9)
        if r["held"]:
            model, base = model + g["score"], base + g["base_score"]
    assert len(got) == len(rows) and model > base


def test_forward_is_the_sum_over_all_paths(monkeypatch):
    m = hmm.Model.first(5, states=3)
    m.move = m.move / m.move.sum(1, keepdims=True)
    symbols, counts = np.array([0, 3, 1, 4, 2, 2, 0]), np.array([4, 1, 2])

    def brute(seq):
        p = m.start * m.emit[seq[0]]
        for s in seq[1:]:
            p = sum(p[i] * m.move[i] for i in range(3)) * m.emit[s]
        return math.log10(p.sum())

    want = [brute([0, 3, 1, 4]), brute([2]), brute([2, 0])]
    assert hmm.log_likelihood(m, symbols, counts) == pytest.approx(want)
    monkeypatch.setattr(hmm, "SEGMENT", 3)
    assert hmm.log_likelihood(m, symbols, counts) == pytest.approx(want)


def test_statistics_are_posteriors_and_raise_likelihood():
    m = hmm.Model.first(6, states=2)
    m.move = m.move / m.move.sum(1, keepdims=True)
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 9, 40)
    symbols = rng.integers(0, 3, counts.sum()) + 3 * np.repeat(rng.integers(0, 2, 40), counts)
    before = hmm.log_likelihood(m, symbols, counts).sum()
    into = np.zeros((1 + 2 + 6, 2))
    hmm.statistics(m, symbols, counts, into)
    assert into[0].sum() == pytest.approx(40)
    assert into[1:3].sum() == pytest.approx(counts.sum() - 40)
    assert into[3:].sum(1) == pytest.approx(np.bincount(symbols, minlength=6))
    plain = hmm.Model(into[0] / into[0].sum(), into[1:3] / into[1:3].sum(1, keepdims=True), into[3:] / into[3:].sum(0))
    assert hmm.log_likelihood(plain, symbols, counts).sum() > before


def test_hmm_is_a_distribution(spark):
    """Over all one-word texts of a tiny vocabulary plus the unseen, probability adds up to one at most."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "b c", "a"])], "doc_id long, text string")
    counts, vocab, model = hmm.train(docs)
    assert (vocab.total, vocab.distinct) == (9, 4)
    one = model.emit.sum(0)
    assert one == pytest.approx(np.ones(len(model.start)))


def test_hmm_odd_rows(spark):
    docs = odd_documents(spark)
    got = hmm.score(docs, *hmm.train(docs)).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(tokens(r["text"])) for r in docs.collect())
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    trained = hmm.train(empty_documents(spark))
    unseen = hmm.score(docs, *trained).collect()
    assert len(unseen) == len(got) and {(r["n_known"], r["train_tokens"]) for r in unseen} == {(0, 0)}
    assert hmm.score(empty_documents(spark), *trained).count() == 0


def test_statistics_of_cut_texts_are_those_of_the_whole(monkeypatch):
    m = hmm.Model.first(5, states=3)
    m.move = np.random.default_rng(1).random((3, 3))
    m.move = m.move / m.move.sum(1, keepdims=True)
    rng = np.random.default_rng(2)
    counts = np.array([30, 2, 11, 1, 10])
    symbols = rng.integers(0, 5, counts.sum())
    whole, cut = np.zeros((9, 3)), np.zeros((9, 3))
    hmm.statistics(m, symbols, counts, whole)
    monkeypatch.setattr(hmm, "SEGMENT", 10)
    hmm.statistics(m, symbols, counts, cut)
    assert cut == pytest.approx(whole) and cut[1:4].sum() == pytest.approx(counts.sum() - 5)


def test_a_language_of_copies_is_learned(spark):
    rows = [("el gato se sienta en la casa y mira por la ventana", "es")] * 3000
    rows += [(f"the cat number {i} sits in the house and looks out of the window", "en") for i in range(400)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), train_rows=50)
    assert model.predict([rows[0][0], rows[-1][0]])[0] == ["es", "en"]


def test_every_round_learns_from_all_texts(spark, monkeypatch):
    from threadlens.llm import hmm
    texts = spark.createDataFrame([(f"w{i % 7} w{i % 3} w{i}",) for i in range(40)], "text string")
    taken, whole = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda t, vocab, model: taken.append(t.count()) or whole(t, vocab, model))
    hmm.train(texts)
    assert taken == [40] * hmm.ROUNDS and hmm.ROUNDS > 1
