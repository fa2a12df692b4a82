"""Golden micro-tables and property tests (brute force on small inputs)."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


# ----------------------------------------------------------------- histogram
def _np_hist(x, nb, k):
    x = np.asarray(x, dtype=float)
    q1, q3 = np.percentile(x, 25), np.percentile(x, 75)
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    main = x[(x >= lo) & (x <= hi)]
    edges = np.linspace(main.min(), main.max(), nb + 1)
    counts, _ = np.histogram(main, bins=edges)
    return list(counts), int((x < lo).sum()), int((x > hi).sum())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_histogram_matches_numpy(spark, seed):
    from threadlens.operators.engagement import score_histogram
    rnd = random.Random(seed)
    vals = [round(rnd.lognormvariate(2, 1.2), 2) for _ in range(500)] + [0.0, 0.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in vals], "score double")
    out = score_histogram(df, "score", 26, 1.5).collect()
    main = [r.n for r in sorted((r for r in out if r.part == "main"), key=lambda r: r.bin)]
    lower = [r.n for r in out if r.part == "lower"][0]
    upper = [r.n for r in out if r.part == "upper"][0]
    assert (main, lower, upper) == _np_hist(vals, 26, 1.5)
    assert sum(main) + lower + upper == len(vals)


def test_histogram_single_value_goes_to_last_bin(spark):
    from threadlens.operators.engagement import score_histogram
    df = spark.createDataFrame([(5.0,)] * 7, "score double")
    out = {(r.part, r.bin): r.n for r in score_histogram(df, "score", 10, 1.5).collect()}
    assert out[("main", 9)] == 7 and sum(v for (p, b), v in out.items() if p == "main") == 7


# ----------------------------------------------------------------- quantiles
def test_exact_quantiles_match_numpy(spark):
    from threadlens.operators.quantiles import exact_quantiles
    rnd = random.Random(7)
    rows = [(g, float(rnd.choice([rnd.random() * 100, 5.0, 5.0]))) for g in range(5) for _ in range(300)]
    rows += [(9, 3.0)]  # one-row group
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.05, 0.25, 0.5, 0.75]
    got = {r.g: [r.q0, r.q1, r.q2, r.q3] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, grp in pdf.groupby("g"):
        assert np.allclose(got[g], np.percentile(grp.v.values, [5, 25, 50, 75]), rtol=0, atol=1e-9)


def test_value_at_rank(spark):
    from threadlens.operators.quantiles import value_at_rank
    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    s = sorted(vals)
    for r in range(len(vals)):
        assert value_at_rank(df, "x", r) == s[r]


# ------------------------------------------------------------- pair counting
def _naive_pairs(up, n):
    from collections import Counter, defaultdict
    by = defaultdict(set)
    for u, p in up:
        by[p].add(u)
    c = Counter()
    for users in by.values():
        us = sorted(users)
        for i in range(len(us)):
            for j in range(i + 1, len(us)):
                c[(us[i], us[j])] += 1
    return {k: v for k, v in c.items() if v >= n}


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_tiled_pairs_equal_naive_self_join(spark, chunk):
    from threadlens.operators.graph import shared_thread_pairs
    rnd = random.Random(11)
    up = {(f"u{rnd.randrange(40)}", rnd.randrange(12)) for _ in range(300)}
    up |= {(f"u{i}", 99) for i in range(35)}  # one hot thread
    df = spark.createDataFrame(sorted(up), "username string, post_id int")
    for n in (1, 2, 4):
        got = {(r.user1, r.user2): r.shared_interactions
               for r in shared_thread_pairs(df, n, chunk_users=chunk).collect()}
        assert got == _naive_pairs(up, n)


# ------------------------------------------------------------------- Louvain
def test_louvain_recovers_two_cliques(spark):
    from threadlens.operators.louvain import louvain, modularity
    rows = [(f"a{i}", f"a{j}", 1.0) for i in range(5) for j in range(i + 1, 5)]
    rows += [(f"b{i}", f"b{j}", 1.0) for i in range(5) for j in range(i + 1, 5)]
    rows += [("a4", "b0", 1.0)]
    e = spark.createDataFrame(rows, "user1 string, user2 string, weight double")
    m = {r.node: r.community for r in louvain(e).collect()}
    assert len({m[f"a{i}"] for i in range(5)}) == 1
    assert len({m[f"b{i}"] for i in range(5)}) == 1
    assert m["a0"] != m["b0"]
    q = modularity(e, louvain(e)).first()["modularity"]
    assert abs(q - 0.4523809523809) < 1e-9


def test_louvain_goes_on_for_rises_that_are_small_in_a_heavy_graph(spark):
    """A path of light edges gains one node a round, each time about 1e-5 of the total
    weight; the other group settles at once and keeps its communities meanwhile."""
    from threadlens.operators.louvain import louvain
    rows = [(1, "h0", "h1", 1e5), *[(1, f"p{i}", f"p{i + 1}", 1.0) for i in range(3)], (2, "h0", "h1", 1.0)]
    e = spark.createDataFrame(rows, "g int, user1 string, user2 string, weight double").coalesce(1)
    got = {(r.g, r.node): r.community for r in louvain(e, group="g").collect()}
    assert got == {**{(1, f"p{i}"): 0 for i in range(4)}, (1, "h0"): 1, (1, "h1"): 1, (2, "h0"): 0, (2, "h1"): 0}


# --------------------------------------------------------------------- votes
def test_five_detectors_vote_on_one_table(spark):
    from threadlens.operators.ml import detector_flags, ensemble_vote
    rnd = random.Random(5)
    days = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *[float(rnd.randrange(5, 9)) for _ in range(3)])
            for i in range(300)]
    days[100] = (days[100][0], 90.0, 5.0, 70.0)
    f = spark.createDataFrame(days, "day timestamp_ntz, a double, b double, c double").coalesce(1)
    flags = detector_flags(f.withColumn("n", F.expr("a + b + c")), "day", "n", ["a", "b", "c"])
    seen = [{r.day for r in t.where(F.col(c) == 1).select("day").collect()} for t, c in flags]
    assert len(seen) == 5 and all(seen) and sum(days[100][0] in s for s in seen) >= 4
    got = {r.day: r.votes for r in ensemble_vote(flags, ["day"]).collect()}
    assert got == {d: sum(d in s for s in seen) for d in set().union(*seen)}
    assert set(got) > seen[0]    # days that only the others see


def test_votes_are_summed_over_any_flag_tables(spark):
    from threadlens.operators.ml import ensemble_vote
    tables = [spark.createDataFrame(r, "k int, f int") for r in ([(1, 1), (2, 0)], [(1, 1), (3, None)], [(3, 1), (2, 0)])]
    votes = lambda m: {r.k: r.votes for r in ensemble_vote([(t, "f") for t in tables], ["k"], m).collect()}
    assert votes(1) == {1: 2, 3: 1} and votes(2) == {1: 2}


# ------------------------------------------------------------------ extrema
def _find_peaks(x):
    """Reference rule: plateau-aware local maxima (middle index, floor)."""
    peaks, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return peaks


def test_local_extrema_match_reference_rule(spark):
    from threadlens.operators.timeseries import local_extrema
    rnd = random.Random(3)
    x = [rnd.choice([0, 1, 2, 2, 3]) for _ in range(200)]
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=i), v) for i, v in enumerate(x)], "day timestamp_ntz, n int")
    out = sorted(local_extrema(df, "day", "n").collect(), key=lambda r: r.day)
    peaks = [i for i, r in enumerate(out) if r.is_peak == 1]
    troughs = [i for i, r in enumerate(out) if r.is_peak == -1]
    assert peaks == _find_peaks(x)
    assert troughs == _find_peaks([-v for v in x])


# --------------------------------------------------------------- calendar
def test_week_and_month_labels_match_pandas(spark):
    from threadlens.functions.timebuckets import bucket
    ts = [dt.datetime(2024, 1, 7, 23, 0), dt.datetime(2024, 1, 8, 0, 0), dt.datetime(2024, 1, 31, 23, 59),
          dt.datetime(2024, 2, 29, 12), dt.datetime(2023, 12, 31, 0, 0, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    got = df.select("ts", bucket("ts", "W").alias("w"), bucket("ts", "M").alias("m")).collect()
    s = pd.Series(1, index=pd.DatetimeIndex(ts))
    for r in got:
        wk = s[s.index == r.ts].resample("W").size().index[0]
        mo = s[s.index == r.ts].resample("ME").size().index[0]
        assert r.w == wk.to_pydatetime() and r.m == mo.to_pydatetime()


# --------------------------------------------------------------- sentiment
def test_sentiment_properties(spark):
    from threadlens.functions.sentiment import with_compound
    rows = [(1, "this is good"), (2, "this is not good"), (3, "this is very good"), (4, "bad"),
            (5, "nothing here"), (6, "good but bad"), (7, "GOOD!!!"), (8, None)]
    df = with_compound(spark.createDataFrame(rows, "id int, t string"), "t")
    s = {r.id: r.compound for r in df.collect()}
    assert all(-1 <= v <= 1 for v in s.values())
    assert s[1] > 0 and s[2] < 0 and s[3] > s[1] and s[4] < 0 and s[5] == 0 and s[8] == 0
    assert s[6] < 0   # the clause after "but" weighs more
    assert s[7] > s[1]


# ----------------------------------------------------------- near duplicates
def test_near_duplicates_equal_brute_force(spark):
    from threadlens.operators.text import clean_tokens, near_duplicates
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        base = rnd.sample(words, 20)
        docs.append((i, " ".join(base)))
        if i % 4 == 0:
            docs.append((100 + i, " ".join(base[:-1] + ["zz"])))  # near copy
        if i % 10 == 0:
            docs.append((200 + i, " ".join(base)))                # exact copy
    df = spark.createDataFrame(docs, "id int, text string")
    rows = near_duplicates(df, "id", "text", threshold=0.8).collect()
    rep = {}
    for r in rows:
        if r.kind == "copy":
            rep[r.id_b] = r.id_a
    groups = {}
    for i in {r.id for r in df.select("id").collect()}:
        groups.setdefault(rep.get(i, i), []).append(i)
    got = set()
    for members in groups.values():
        got |= {(min(a, b), max(a, b)) for a in members for b in members if a < b}
    for r in rows:
        if r.kind == "near":
            for a in groups[r.id_a]:
                for b in groups[r.id_b]:
                    got.add((min(a, b), max(a, b)))
    toks = {r.id: set(r.t) for r in df.select("id", clean_tokens("text").alias("t")).collect()}
    want = set()
    ids = sorted(toks)
    for a in ids:
        for b in ids:
            if a < b and len(toks[a] & toks[b]) / len(toks[a] | toks[b]) >= 0.8:
                want.add((a, b))
    assert got == want


# --------------------------------------------------------------- dedup etc.
def test_keep_first_nulls_group_together(spark):
    from threadlens.operators.engagement import keep_first
    rows = [(3, "a", "x", 1, None, "comment"), (1, "a", "x", 1, None, "comment"),
            (2, None, "x", 1, None, "post"), (5, None, "x", 1, None, "post")]
    df = spark.createDataFrame(rows, "id int, username string, subreddit string, post_id int, "
                                     "created_utc timestamp, interaction_type string")
    assert sorted(r.id for r in keep_first(df).collect()) == [1, 2]


def test_running_mean_matches_pandas(spark):
    from threadlens.operators.timeseries import chunked_running
    rnd = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(3), base + dt.timedelta(seconds=rnd.randrange(20000)), float(rnd.randrange(10)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "cid int, k int, ts timestamp_ntz, v double")
    got = {r.cid: (r.run_n, r.run_mean) for r in chunked_running(df, "k", "ts", "v", "cid", 600).collect()}
    pdf = pd.DataFrame(rows, columns=["cid", "k", "ts", "v"]).sort_values(["k", "ts", "cid"])
    pdf["n"] = pdf.groupby("k").cumcount() + 1
    pdf["m"] = pdf.groupby("k").v.cumsum() / pdf.n
    for r in pdf.itertuples():
        assert got[r.cid][0] == r.n and math.isclose(got[r.cid][1], r.m, abs_tol=1e-6)


def test_range_guard():
    from threadlens.functions.predicates import check_range
    with pytest.raises(ValueError):
        check_range("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        check_range("2024-01-01", "2024-03-01", max_days=30)
    check_range("2024-01-01", "2024-01-30", max_days=30)


def test_extrema_with_distance_greedy(spark):
    from threadlens.operators.timeseries import extrema_with_distance, local_extrema
    x = [0, 5, 0, 3, 0, 4, 0, 0, 6, 0, 1, 0, 2, 0]
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=i), v) for i, v in enumerate(x)],
                               "day timestamp_ntz, n int")
    m = local_extrema(df, "day", "n")
    out = sorted(extrema_with_distance(m, "day", "n", (), 4).collect(), key=lambda r: r.day)
    peaks = [i for i, r in enumerate(out) if r.is_peak_distance == 1]
    # highest first: 8 (6), then 1 (5), 5 (4) is within 4 of 8 → dropped, 3 within 4 of 1, 12 kept
    assert peaks == [1, 8, 12]


def test_closeness_on_path_graph(spark):
    from threadlens.operators.graph import closeness_sampled
    rows = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)]
    e = spark.createDataFrame(rows, "user1 string, user2 string, weight int")
    got = {r.username: r.closeness for r in closeness_sampled(e, 4).collect()}
    # path a-b-c-d: closeness(a) = 3/6, closeness(b) = 3/4
    assert abs(got["a"] - 0.5) < 1e-9 and abs(got["b"] - 0.75) < 1e-9


def _brute_betweenness(adj):
    from collections import deque
    bc = {v: 0.0 for v in adj}
    for s in adj:
        dist, sigma, order, preds = {s: 0}, {s: 1.0}, [], {v: [] for v in adj}
        q = deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    sigma[w] = 0.0
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = {v: 0.0 for v in adj}
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    return bc


def test_betweenness_exact_when_all_sources(spark):
    from threadlens.operators.graph import betweenness_sampled
    rnd = random.Random(2)
    names = [f"n{i}" for i in range(12)]
    es = {tuple(sorted(rnd.sample(names, 2))) for _ in range(25)}
    e = spark.createDataFrame([(a, b, 1) for a, b in es], "user1 string, user2 string, weight int")
    adj = {}
    for a, b in es:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    want = _brute_betweenness(adj)
    got = {r.username: r.betweenness for r in betweenness_sampled(e, 100).collect()}
    for v in adj:
        assert abs(got[v] - want[v]) < 1e-6


def test_connected_components(spark):
    from threadlens.operators.graph import connected_components
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("d", "c")], "a string, b string")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_knn_distance_equals_brute_force(spark):
    from threadlens.operators.ml import knn_distance
    rnd = np.random.default_rng(4)
    pts = rnd.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id int, v array<double>")
    got = {r.id: r.knn3_distance for r in knn_distance(df, "id", "v", k=3, block=16).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, 2]
    for i in range(60):
        assert abs(got[i] - want[i]) < 1e-5


def test_near_duplicates_low_threshold_is_exact(spark):
    """Prefix filtering is exact at any threshold (checked at 0.3, where LSH
    candidate sets would be loose)."""
    from threadlens.operators.text import clean_tokens, near_duplicates
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rnd.sample(words, rnd.randrange(3, 12)))) for i in range(50)]
    df = spark.createDataFrame(docs, "id int, text string")
    rows = near_duplicates(df, "id", "text", threshold=0.3).collect()
    toks = {r.id: set(r.t) for r in df.select("id", clean_tokens("text").alias("t")).collect()}
    rep = {r.id_b: r.id_a for r in rows if r.kind == "copy"}
    groups = {}
    for i in toks:
        groups.setdefault(rep.get(i, i), []).append(i)
    got = set()
    for m in groups.values():
        got |= {(a, b) for a in m for b in m if a < b}
    for r in rows:
        if r.kind == "near":
            got |= {(min(x, y), max(x, y)) for x in groups[r.id_a] for y in groups[r.id_b]}
    want = {(a, b) for a in toks for b in toks
            if a < b and len(toks[a] & toks[b]) / len(toks[a] | toks[b]) >= 0.3}
    assert got == want


def test_value_at_rank_keeps_the_type(spark):
    from threadlens.operators.quantiles import value_at_rank
    big = spark.createDataFrame([(2 ** 53 + i,) for i in range(5)], "x long")
    assert value_at_rank(big, "x", 1) == 2 ** 53 + 1
    names = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "x string")
    assert [value_at_rank(names, "x", i) for i in range(4)] == ["a", "b", "c", None]


def test_quantiles_of_a_skewed_group(spark):
    from threadlens.operators.quantiles import exact_quantiles
    v = np.random.default_rng(3).pareto(0.5, 4000)
    df = spark.createDataFrame([(None, float(x)) for x in v] + [("b", 1.0), ("b", None), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, ["g"], "v", [0.5], ["q"]).collect()}
    assert got[None][0] == 4000 and math.isclose(got[None][1], np.percentile(v, 50), rel_tol=1e-12)
    assert got["b"] == (1, 1.0) and "c" not in got


def test_long_chain_is_one_component(spark):
    from threadlens.operators.graph import connected_components
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(131)] + [("z", "z")], "a string, b string")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert set(got.values()) == {"n000", "z"} and len(got) == 133


@pytest.mark.parametrize("span,chunk", [(7, 512), (60, 64), (60, 7)])
def test_ema_is_the_full_recurrence(spark, span, chunk):
    from threadlens.operators.timeseries import ema
    rnd = np.random.default_rng(1)
    rows = [(k, i, float(x)) for k in ("a", "b") for i, x in enumerate(rnd.uniform(0, 1000, 300))]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {(r.k, r.i): r[f"ema_{span}_x"] for r in ema(df, "i", "x", span, ["k"], chunk).collect()}
    for k, g in pd.DataFrame(rows, columns=["k", "i", "x"]).groupby("k"):
        for i, want in zip(g.i, g.x.ewm(span=span).mean()):
            assert math.isclose(got[k, i], want, abs_tol=2e-6)


def test_ema_without_key_and_with_nulls(spark):
    from threadlens.operators.timeseries import ema
    xs = [None, 1.0, None, 4.0, 2.0]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    got = [r.ema_3_x for r in ema(df, "i", "x", 3, chunk=2).orderBy("i").collect()]
    want = pd.Series(xs).ewm(span=3, ignore_na=True).mean()
    assert got[0] is None and np.allclose(got[1:], want[1:], atol=1e-6)


def test_auc_without_key(spark):
    from threadlens.operators.timeseries import auc_labels, auc_segments, local_extrema
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base + dt.timedelta(days=i), float(v)) for i, v in enumerate([0, 5, 1, 9, 2, 3, 0, 4, 1])],
                               "day timestamp_ntz, n double")
    segs = auc_segments(local_extrema(df, "day", "n"), "day", "n")
    areas = {r.seg: r.auc for r in segs.collect()}
    assert areas[1] == 3.0 and areas[2] == 5.0
    got = {(r.day - base).days: (r.auc_spike, r.auc_drop) for r in auc_labels(df, segs, "day", 4.0, 4.0).collect()}
    assert got[0] == (0.0, 0.0) and got[2] == (5.0, 3.0) and len(got) == 9


def test_reply_tree_deep_chain_orphans_and_cycles(spark):
    from threadlens.sources.ingest import reply_tree
    rows = [("m0", None)] + [(f"m{i}", f"m{i - 1}") for i in range(1, 151)]
    rows += [("o1", "gone"), ("o2", "o1"), ("c1", "c2"), ("c2", "c1"), ("c3", "c1"), ("r", None)]
    got = {r.msg_id: (r.root_id, r.depth) for r in reply_tree(
        spark, spark.createDataFrame(rows, "msg_id string, parent_msg_id string")).collect()}
    assert got == {f"m{i}": ("m0", i) for i in range(151)} | {"r": ("r", 0)}


def test_flatten_nested_three_levels(spark):
    from threadlens.sources.ingest import flatten_nested
    leaf = "struct<id:string,author:string,body:string,created_utc:double,score:long>"
    mid = f"struct<id:string,author:string,body:string,created_utc:double,score:long,replies:array<{leaf}>>"
    df = spark.createDataFrame(
        [("a", "u", "x", 1.0, 1, [("b", "v", "y", 2.0, 2, [("c", "w", "z", 3.0, 3)]), ("d", "v", "y", 2.0, 2, None)]),
         ("e", "u", "x", 1.0, 1, None)],
        f"id string, author string, body string, created_utc double, score long, replies array<{mid}>")
    assert {(r.id, r.parent_id) for r in flatten_nested(df).collect()} == {
        ("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", None)}


def test_assign_ids_are_consecutive(spark):
    from threadlens.sources.ingest import assign_ids
    rnd = random.Random(3)
    df = spark.createDataFrame([(rnd.random(), i) for i in range(500)], "x double, k int").repartition(7)
    got = [r.id for r in assign_ids(df, ["x", "k"]).orderBy("x").collect()]
    assert got == list(range(1, 501))


def test_pairs_ignore_null_users_and_drop_bots(spark):
    from threadlens.operators.graph import find_user_pairs
    from threadlens.sources.roles import Forum
    t = dt.datetime(2024, 1, 2)
    posts = spark.createDataFrame([("p1", "s", "a", t, 1), ("p2", "s", None, t, 1)],
                                  "post_id string, subreddit string, author string, created_utc timestamp_ntz, score int")
    rows = [("p1", "b"), ("p1", None), ("p1", "AutoModerator"), ("p2", "c"), ("p2", "None"), ("p2", "b")]
    comments = spark.createDataFrame([(p, a, t, 1) for p, a in rows],
                                     "post_id string, author string, created_utc timestamp_ntz, score int")
    f = Forum(posts, comments)
    pairs = lambda clean: {(r.user1, r.user2) for r in find_user_pairs(
        f, "2024-01-01", "2024-01-03", None, 1, clean_authors=clean).collect()}
    assert pairs(True) == {("a", "b"), ("b", "c")}
    assert pairs(False) == {("a", "b"), ("b", "c"), ("AutoModerator", "a"), ("AutoModerator", "b"),
                            ("None", "b"), ("None", "c")}


def test_sentiment_contractions_and_capitals(spark):
    from threadlens.functions.sentiment import compound, tokens, with_compound
    texts = ["this is good", "this isn't good", "don't like it", "this is GOOD", "THIS IS GOOD", "caf\u00e9 n'est \u00e9t\u00e9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.compound for r in with_compound(df, "t").orderBy("i").collect()]
    assert got[1] < 0 < got[0] and got[2] < 0 and got[3] > got[0] == got[4] and got[5] == 0
    assert [r[0] for r in df.orderBy("i").select(compound("t")).collect()] == got
    assert df.filter("i = 5").select(tokens("t")).first()[0] == ["caf\u00e9", "nest", "\u00e9t\u00e9"]


def test_clusters_are_the_same_after_load(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from threadlens.operators.ml import assign_clusters, cluster_posts
    rnd = np.random.default_rng(5)
    rows = [(i, float(rnd.normal(i % 3 * 9)), float(rnd.normal() * 100)) for i in range(90)]
    df = spark.createDataFrame(rows, "post_id int, score double, f double")
    res, model = cluster_posts(df, k=3)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = assign_clusters(df.filter("post_id % 2 = 1"), PipelineModel.load(str(tmp_path / "m")))
    want = {r.post_id: r.cluster for r in res.collect()}
    assert all(want[r.post_id] == r.cluster for r in again.collect()) and again.count() == 45


def test_isolation_forest_keeps_small_groups(spark):
    from threadlens.operators.ml import isolation_forest
    rnd = np.random.default_rng(6)
    rows = [(i, "big", *map(float, rnd.normal(size=3))) for i in range(200)] + [(900, "big", 50.0, 50.0, 50.0)]
    rows += [(1000 + i, "tiny", 0.0, 1.0, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, g string, a double, b double, c double")
    got = {r.id: r for r in isolation_forest(df, "id", ["a", "b", "c"], n_trees=20, sample=32, group="g",
                                             contamination=0.02).collect()}
    assert len(got) == len(rows) and got[900].is_anomaly == 1
    assert all(got[1000 + i].is_anomaly == 0 and got[1000 + i].anomaly_score is None for i in range(5))


def test_knn_with_too_few_neighbours(spark):
    from threadlens.operators.ml import knn_distance
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "id int, v array<double>")
    assert all(r.knn5_distance is None for r in knn_distance(df, "id", "v", k=5).collect())


def test_replayed_batches_change_nothing(spark, tmp_path):
    from threadlens.streaming import jobs as S
    out = str(tmp_path / "out")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    for epoch in (0, 0, 1):
        S._batch_sink(out)(b, epoch)
    assert spark.read.parquet(out).count() == 2
    assert S.path_exists(spark, out) and not S.path_exists(spark, out + "-none")


def test_knn_index_leaves_most_pairs_out(spark):
    """Clustered points: equal to brute force with a fraction of its distances."""
    from threadlens.operators.knn import nearest
    rnd = np.random.default_rng(11)
    pts = np.concatenate([rnd.normal(size=(150, 3)) + c for c in rnd.uniform(-100, 100, (20, 3))])
    pts = np.concatenate([pts, np.repeat(pts[:1], 40, axis=0), [[500.0, 0.0, 0.0]]])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id int, v array<double>")
    got = {r.id: r for r in nearest(df, "id", "v", k=4, block=64, pivots=40).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    assert all(np.allclose(got[i].distances, want[i]) for i in range(len(pts)))
    assert sum(r.compared for r in got.values()) < len(pts) ** 2 / 4


def test_knn_measures_candidates_only_and_in_pieces(spark, monkeypatch):
    """Bounds are made for a block's mean against all blocks and for its rows against the blocks near it only;
    vectors leave a task in pieces, and the result is that of brute force."""
    import numpy as np
    from threadlens.operators import knn
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    index = knn.Directory(x[:20].copy(), [(i, i % 20, 0.01 * i, 0.01 * i + 0.02) for i in range(60)])
    cell, block = np.arange(5) % 20, np.arange(5)
    some = np.array([3, 17, 40])
    assert np.array_equal(index.bounds(x[:5], cell, block)[:, some], index.bounds(x[:5], cell, block, some))
    monkeypatch.setattr(knn, "_OUT", 100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {r.id: r.distances for r in knn.nearest(df, "id", "v", k=3, block=32, pivots=8).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = np.sort(d, axis=1)[:, 1:4]
    assert len(got) == 3000 and all(np.allclose(got[i], want[i]) for i in range(3000))


def test_knn_of_unusable_vectors(spark):
    from threadlens.operators.knn import knn_distance
    inf = float("inf")
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [inf, 1.0]), (7, []), (8, [1.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = sorted(((r[0], r[1]) for r in knn_distance(df, "id", "v", k=2).collect()), key=str)
    assert got == sorted([(1, 5.0), (2, round(18 ** 0.5, 6)), (2, round(18 ** 0.5, 6)), (None, round(18 ** 0.5, 6))]
                         + [(i, None) for i in (3, 4, 5, 6, 7, 8)], key=str)
    assert [r[1] for r in knn_distance(df.where("id = 3"), "id", "v").collect()] == [None]
    assert knn_distance(df.where("id = 99"), "id", "v").collect() == []


def _undirected(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def _is_connected(nodes, near):
    nodes, seen = set(nodes), set()
    todo = [next(iter(nodes))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += (near.get(x, set()) & nodes) - seen
    return seen == nodes


def _modularity(edges, community):
    m2, k, inner = 0.0, {}, 0.0
    for a, b, w in edges:
        m2 += 2 * w
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inner += 2 * w * (community[a] == community[b])
    tot = {}
    for x, s in k.items():
        tot[community[x]] = tot.get(community[x], 0) + s
    return inner / m2 - sum((t / m2) ** 2 for t in tot.values())


def test_refined_communities_are_connected_and_no_worse(spark):
    from threadlens.operators.louvain import louvain
    rnd = random.Random(21)
    edges, name = {}, lambda g, i: f"{g}-{i:02d}"
    for g in range(3):                      # clusters chained by single edges, and a hub
        for i in range(6):
            for j in rnd.sample(range(i), min(i, 2)):
                edges[name(g, j), name(g, i)] = rnd.choice([1, 2, 5])
        edges[name(g, 0), name((g + 1) % 3, 5)] = 1
        edges["hub", name(g, 3)] = 1
    rows = [(a, b, float(w)) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "user1 string, user2 string, weight double")
    plain = {r.node: r.community for r in louvain(df).collect()}
    fine = {r.node: r.community for r in louvain(df, refine=True).collect()}
    near = _undirected(edges)
    for c in set(fine.values()):
        assert _is_connected([n for n in fine if fine[n] == c], near)
    assert set(plain) == set(fine) == set(near)
    assert _modularity(rows, fine) >= _modularity(rows, plain) - 1e-9
    sizes = {c: sum(v == c for v in fine.values()) for c in fine.values()}
    assert sorted(sizes) == list(range(len(sizes))) and [sizes[c] for c in sorted(sizes)] == sorted(sizes.values(), reverse=True)


def test_disconnected_communities_are_cut(spark):
    from threadlens.operators.louvain import G, _connected
    adj = spark.createDataFrame([(0, a, b, 1.0) for x, y in (("a", "b"), ("c", "d"), ("b", "e")) for a, b in ((x, y), (y, x))],
                                f"{G} int, i string, j string, a double")
    comm = spark.createDataFrame([(0, n, "x") for n in "abcd"] + [(0, "e", "y")], f"{G} int, i string, c string")
    parts = {}
    for r in _connected(adj, comm).collect():
        parts.setdefault(r.c, set()).add(r.i)
    assert sorted(map(sorted, parts.values())) == [["a", "b"], ["c", "d"], ["e"]]


def test_sub_communities_stay_in_their_cluster(spark):
    from threadlens.operators.louvain import sub_communities
    clique = lambda names: [(a, b, 1.0) for i, a in enumerate(names) for b in names[:i]]
    rows = clique("abcd") + clique("efgh") + [("a", "e", 1.0)] + clique("mnop") + [("m", "x", 1.0), ("a", "m", 1.0)]
    member = [(n, 0) for n in "abcdefgh"] + [(n, 1) for n in "mnop"] + [("x", 2)]
    got = sub_communities(spark.createDataFrame(rows, "user1 string, user2 string, weight double"),
                          spark.createDataFrame(member, "node string, community int"))
    parts = {}
    for r in got.collect():
        parts.setdefault((r.cluster, r.community), set()).add(r.node)
    assert {k: "".join(sorted(v)) for k, v in parts.items()} == {(0, 0): "abcd", (0, 1): "efgh", (1, 0): "mnop", (2, 0): "x"}


def test_elimination_keeps_what_scores(spark):
    from threadlens.operators.ml import elimination_by_score, vectors
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        y = rnd.randrange(2)
        rows.append((i, [rnd.gauss(0, 1), 4.0 * y + rnd.gauss(0, 0.5), rnd.gauss(0, 1), rnd.gauss(0, 1)], y))
    df = vectors(spark.createDataFrame(rows, "id int, v array<double>, y int"), "v")
    run = lambda: elimination_by_score(df, "features", "y", "id", folds=2, step=0.5, n_trees=5).collect()
    got = run()
    assert [r.n_features for r in got] == [4, 2, 1] and sum(r.chosen for r in got) == 1 and got == run()
    chosen = next(r for r in got if r.chosen)
    assert 1 in chosen.features and chosen.f1 == max(r.f1 for r in got) > 0.95


def test_candidate_pairs_are_not_shuffled(spark):
    """Pairs are counted where a tile's users meet: between the tiles' exchange and the count there is no other."""
    from collections import Counter
    from itertools import combinations

    from threadlens.operators.graph import shared_thread_pairs
    rnd = random.Random(11)
    rows = sorted({(f"u{rnd.randrange(60)}", rnd.randrange(25), k) for _ in range(2500) for k in (0, 1)})
    up = spark.createDataFrame(rows, "username string, post_id long, k int")
    for keys in ([], ["k"]):
        one = up if keys else up.where("k = 0").drop("k")
        crowd = {}
        for u, p, k in rows:
            if keys or k == 0:
                crowd.setdefault((k, p), []).append(u)
        want = Counter((k if keys else 0, *pair) for (k, _), us in crowd.items() for pair in combinations(sorted(us), 2))
        df = shared_thread_pairs(one, 3, chunk_users=8, keys=keys)
        got = {(r.k if keys else 0, r.user1, r.user2): r.shared_interactions for r in df.collect()}
        assert got == {p: n for p, n in want.items() if n >= 3} and got
        plan = df._jdf.queryExecution().sparkPlan().toString()
        last = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in ln
                and "u#" in ln and "v#" in ln]
        assert not last and "collect_list" in plan


def test_degrees_take_one_pass(spark):
    from threadlens.operators.graph import degree_centrality
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 3), ("b", "c", 1), ("a", "d", 4)], "user1 string, user2 string, weight long")
    got = {r.username: (r.degree, r.weighted_degree, r.degree_centrality) for r in degree_centrality(edges).collect()}
    assert got == {"a": (3, 9, 1.0), "b": (2, 3, 0.666667), "c": (2, 4, 0.666667), "d": (1, 4, 0.333333)}


def test_searches_from_sources_make_the_edges_once(spark):
    from pyspark.sql import functions as F

    from threadlens.operators.graph import betweenness_sampled, closeness_sampled
    made = spark.sparkContext.accumulator(0)

    def mark(x):
        made.add(1)
        return x
    path = [(f"n{i}", f"n{i + 1}") for i in range(5)]
    for search in (closeness_sampled, betweenness_sampled):
        before = made.value
        e = spark.createDataFrame(path, "user1 string, user2 string").withColumn("user1", F.udf(mark)("user1"))
        assert search(e, 3).count() == (3 if search is closeness_sampled else 6)
        assert made.value - before == len(path)
