"""Quality rules, mixing and the shard table against plain Python."""

from collections import Counter

import pytest
from helpers import empty_documents, odd_documents, words
from pyspark.sql import functions as F

from threadlens.llm import mixing, quality, sharding

SF = "/root/testdata/sf0.001"


def repeat_words(ws):
    grams = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    seen, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            inside |= set(range(i, i + 8))
    return len(inside)


def base(text):
    ws, lines, seen, dup = words(text), (text or "").split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    r = repeat_words(ws)
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, r,
            len(ws) < 20 or 100 * r > 30 * len(ws))


@pytest.mark.parametrize("which", ["table", "odd"])
def test_quality_base_counts(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "table" else odd_documents(spark)
    got = Counter(tuple(r) for r in quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())


def test_quality_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed")
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.98
    assert n.get((0, False), 0) / (n.get((0, True), 0) + n.get((0, False), 0)) > 0.8


def test_quality_estimate_orders_votes():
    clean, one, many = (1, 2, 2), (1, 0, 2), (1, 0, 0)
    share, table = quality.estimate([(clean, 900), (one, 30), (many, 70)])
    p = [quality.posterior(share, table, v) for v in (clean, one, many)]
    assert p[0] > p[1] > p[2] and p[0] > 0.5 > p[2]


def test_quality_empty_and_columns(spark):
    assert quality.judge(empty_documents(spark)).count() == 0
    docs = odd_documents(spark)
    assert quality.good_documents(docs).columns == docs.columns


def water(sizes, weights):
    total, stop = 1.5 * sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(2 * s for s, x in zip(sizes, stop) if x)
        share = sum(w for w, x in zip(weights, stop) if not x)
        t = [2.0 * s if x else left * w / share for s, w, x in zip(sizes, weights, stop)]
        new = [x or v > 2 * s for s, v, x in zip(sizes, t, stop)]
        if new == stop:
            return t
        stop = new


def test_mix_targets_and_takes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == docs.count()
    names = sorted({r["source"] for r in got})
    size = {n: sum(r["size"] for r in got if r["source"] == n) for n in names}
    want = water([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for n, t in zip(names, want):
        own = [r for r in got if r["source"] == n]
        assert all(r["target"] == pytest.approx(t) and r["source_size"] == size[n] for r in own)
        assert abs(sum(r["taken"] for r in own) - t) <= max(r["size"] for r in own)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mix_is_nested_in_the_budget(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = []
    for share in (0.3, 0.6, 0.9):
        monkeypatch.setattr(mixing, "TOTAL_SHARE", share)
        taken.append({r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()})
    assert all(a[k] <= b[k] for a, b in zip(taken, taken[1:]) for k in a)


def test_mix_odd_rows(spark):
    docs = odd_documents(spark)
    got = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words(r["text"])) for r in docs.collect())
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty_documents(spark)).count() == 0


def plain_table(names, size):
    at = [sharding._hash(n, "offset") % size for n in names]
    skip = [sharding._hash(n, "skip") % (size - 1) + 1 for n in names]
    order = [[(a + k * s) % size for k in range(size)] for a, s in zip(at, skip)]
    held, turn = {}, 0
    while len(held) < size:
        i = turn % len(names)
        held[next(x for x in order[i] if x not in held)] = i
        turn += 1
    return [held[k] for k in range(size)]


def test_shard_table_is_fair_and_stable():
    names = [f"n{i}" for i in range(7)]
    assert sharding.fill_table(names, 101) == plain_table(names, 101)
    before = sharding.fill_table(names, 10_007)
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    after = sharding.fill_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after) if b is not None and a != 6)
    assert moved < 0.1 * 10_007
    weighted = Counter(sharding.fill_table(["a", "b"], 10_007, [3, 1]))
    assert weighted[0] / weighted[1] == pytest.approx(3, rel=0.01)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


def test_place(spark):
    docs = odd_documents(spark)
    names = [f"n{i}" for i in range(5)]
    got = sharding.place(docs, ["doc_id"], names, 101)
    assert got.count() == docs.count()
    table = sharding.fill_table(names, 101)
    rows = got.collect()
    assert all(r["shard"] == names[table[r["slot"]]] for r in rows)
    assert len({r["slot"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.place(empty_documents(spark), ["doc_id"], names, 101).count() == 0
    hot = spark.range(5000).select(F.lit(1).alias("k"), "id")
    assert sharding.place(hot, ["k"], names, 101).select("slot").distinct().count() == 1
    assert sharding.place(hot, ["k"], names, 101, split=64).select("shard").distinct().count() == 5


def test_empty_texts_are_taken_no_more_than_twice(spark):
    rows = [(i, "" if i % 3 else "some words of a text", "abc"[i % 2]) for i in range(200)] + [(900, "w " * 4000, "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["copies"] for r in got} <= {0, 1, 2} and any(r["copies"] == 2 for r in got)
