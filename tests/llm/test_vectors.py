"""Lattice links and vector codes against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.llm import codes, lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


def floats(v):
    return [float(np.float32(x)) for x in v]


# --- links ------------------------------------------------------------------

def brute_links(rows):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    component = np.array(ids)
    while True:
        new = np.minimum(component, [component[own].min() if own.any() else c for own, c in zip(linked, component)])
        if (new == component).all():
            return {i: (int(n), int(c), bool(c == i)) for i, n, c in zip(ids, linked.sum(1), component)}
        component = new


def links(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.link(df).collect()}


def near(rng, base, cosine):
    z = rng.normal(size=base.shape)
    z -= (z @ base) * base
    return cosine * base + np.sqrt(1 - cosine ** 2) * z / np.linalg.norm(z)


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = list(rng.normal(size=(200, 64)))
    for size in (3, 10, 60):
        for _ in range(4):
            base = rng.normal(size=64)
            base /= np.linalg.norm(base)
            vectors += [base, *(near(rng, base, c) * rng.uniform(0.1, 9) for c in rng.uniform(0.85, 0.999, size))]
    vectors += vectors[200:230]     # exact copies
    rows = list(enumerate(map(floats, (vectors[i] for i in rng.permutation(len(vectors))))))
    assert links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute_links(rows)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    rows = [(i, floats(base + rng.normal(size=32) * 0.25)) for i in range(120)]
    assert links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute_links(rows)


def test_links_of_odd_rows(spark):
    a, b = [1.0] * 64, [1.0] * 63 + [1.5]
    rows = [(3, a, 1), (3, a, 1), (5, b, None), (1, None, 2), (2, [], 2), (4, [None] * 64, 0), (6, [0.0] * 64, 0),
            (7, [float("nan")] * 64, 0), (8, [float("inf")] + [0.0] * 63, 0), (9, [1.0] * 8, 0), (None, a, 0), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.selectExpr("*", *[f"'x' as `{c}`" for c in ("node", "cell", "component", "unit", "n", "least", "home", "copies")])
    got = sorted(map(tuple, lattice.link(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 4, 6, 7, 8, 9)] + [(None, 0, None, True)] * 2
    assert got == sorted([(3, 1, 3, True)] * 2 + [(5, 1, 3, False)] + alone, key=str)
    assert links(spark.createDataFrame([], SCHEMA)) == {}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=8, max_size=8))
def test_decoded_points_are_nearest(x):
    x = np.array([x])
    p = lattice.decode(x)[0]
    doubled = np.rint(2 * p).astype(int)
    assert (doubled % 2 == doubled[0] % 2).all() and doubled.sum() % 4 == 0
    own = ((x[0] - p) ** 2).sum()
    assert all(own <= ((x[0] - p - v) ** 2).sum() + 1e-9 for v in lattice.SHORTEST)


def test_shortest_vectors():
    assert len(np.unique(lattice.SHORTEST, axis=0)) == 240 and np.allclose((lattice.SHORTEST ** 2).sum(1), 2)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([near(rng, v, 0.9) for v in a])
    tables = lattice.Tables(64)
    x, y = tables.cells(a), tables.cells(b)
    met = ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).any(1)
    signs = np.array([bin(int(m) ^ int(n)).count("1") for m, n in
                      zip(tables.sketch(a).view(np.uint64), tables.sketch(b).view(np.uint64))])
    assert (met & (signs <= lattice.MOST_UNEQUAL)).mean() > 0.99


# --- codes ------------------------------------------------------------------

def brute_codes(rows):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in kept], float) * 256).astype(int)
    width, chosen, error, flat = x.shape[1] // 16, [], np.zeros(len(x), int), []
    for p in range(16):
        points = x[:, p * width:(p + 1) * width]
        book = points[:64].copy()
        for round_ in range(3):
            apart = ((points[:, None] - book[None]) ** 2).sum(2)
            nearest = apart.argmin(1)
            for e in range(len(book)) if round_ < 2 else ():
                if (nearest == e).any():
                    book[e] = points[nearest == e].sum(0) // (nearest == e).sum()
        chosen.append(nearest)
        error += apart.min(1)
        flat += book.ravel().tolist()
    sha = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    by_label = defaultdict(int)
    for r, e in zip(kept, error):
        by_label[r[2]] += int(e)
    return sorted(((r[0], "".join(f"{e:02x}" for e in c), int(e), by_label[r[2]], sha)
                   for r, c, e in zip(kept, np.stack(chosen, 1), error)), key=str)


@pytest.mark.parametrize("n, spread", [(30, 1), (900, 3), (300, 100)])
def test_codes_match_brute_force(spark, n, spread):
    rng = np.random.default_rng(n)
    vectors = [floats(v) for v in rng.integers(-3 * spread, 3 * spread, (n, 32)) / 256 + rng.choice([0, 0.001], (n, 32))]
    rows = [(int(i), v, int(rng.integers(0, 4)) if rng.random() < 0.8 else None) for i, v in zip(rng.permutation(n), vectors)]
    rows += [rows[0], rows[0], (None, vectors[1], 2), (-4, None, 1), (-3, [None] * 32, 1), (-2, [float("nan")] * 32, 1),
             (-1, [float("-inf")] * 32, 1), (-5, [], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id as code", "label as error", "1 as count", "2 as label_key")
    assert sorted(map(tuple, codes.compress(df).collect()), key=str) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    other = [(1, [1.0] * 10, 1), (2, [1.0] * 16, 1), (3, [1.0] * 32, 1), (4, [3e38] * 16, 1)]
    assert {r["vec_id"] for r in codes.compress(spark.createDataFrame(other, SCHEMA)).collect()} == {2, 4}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(1, 40), st.integers(0, 2 ** 30))
def test_trees_hold_every_point_in_balls(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread, (n, width))
    book = rng.integers(-spread, spread, (min(n, 64), width))
    tree = codes.tree_arrays(points)
    own = points[tree["order"]]
    assert sorted(tree["order"].tolist()) == list(range(n))
    for lo, hi, centre, radius, total in zip(*(tree[k] for k in ("lo", "hi", "centre", "radius", "sum"))):
        assert (own[lo:hi].sum(0) == total).all() and (codes._distance(own[lo:hi], centre) <= radius + 1e-6).all()
    want = ((own[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (codes.assign(tree, own, book) == want).all()
    counts, sums = codes.entry_sums(tree, own, book)
    assert (counts == np.bincount(want, minlength=len(book))).all()
    assert all((sums[e] == own[want == e].sum(0)).all() for e in range(len(book)))


def test_whole_balls_are_owned():
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.integers(-5, 5, (100, 4)) + c for c in rng.integers(-400, 400, (10, 4))])
    tree = codes.tree_arrays(points)
    own = points[tree["order"]]
    whole = sum(int(tree["hi"][at] - tree["lo"][at]) for at, entry, _ in codes.owned(tree, own, points[::100]) if entry is not None)
    assert whole > 900


def test_join_counted_keeps_every_row(spark):
    from threadlens.llm.common import join_counted
    big = spark.range(4000).select("id", F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    small = big.groupBy("k").count().withColumn("twice", F.col("k") * 2)
    assert {tuple(r) for r in join_counted(big, small, "k", 4000).select("id", "k", "twice").collect()} == {
        (i, 0 if i < 3000 else i, 0 if i < 3000 else 2 * i) for i in range(4000)}
