"""Steps that must stay small where pairs of users, or texts, are very many."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F


def _crowd(rnd, users, threads, rows):
    return sorted({(f"u{rnd.randrange(users)}", f"t{rnd.randrange(threads)}") for _ in range(rows)})


def _met(rows, least):
    by = defaultdict(set)
    for u, p in rows:
        by[p].add(u)
    c = Counter(pair for us in by.values() for pair in combinations(sorted(us), 2))
    return {p: n for p, n in c.items() if n >= least}


@pytest.mark.parametrize("chunk", [8, 2048])
def test_dense_crowds_are_counted_by_matrices(spark, chunk):
    """Few threads of very many users make no row a candidate."""
    from threadlens.operators.graph import shared_thread_pairs
    rnd = random.Random(5)
    rows = _crowd(rnd, 90, 12, 900)
    rows += [(f"u{rnd.randrange(90)}", f"small{i // 3}") for i in range(90)]
    weeks = {k: sorted({(u, p) for u, p in rows if hash((u, p, k)) % 4}) for k in (1, 2)}
    up = spark.createDataFrame([(u, p, k) for k, x in weeks.items() for u, p in x] + [(None, "t1", 1), ("u1", "t1", None)],
                               "username string, post_id string, k int")
    df = shared_thread_pairs(up, 3, chunk_users=chunk, keys=["k"])
    got = {(r.k, r.user1, r.user2): r.shared_interactions for r in df.collect()}
    assert got == {(k, *p): n for k, x in weeks.items() for p, n in _met(x, 3).items()} and got
    one = shared_thread_pairs(up.where("k = 1").drop("k"), 2, chunk_users=chunk)
    assert {(r.user1, r.user2): r.shared_interactions for r in one.collect()} == _met(weeks[1], 2)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "explode(two" not in plan


def test_sparse_threads_are_listed():
    """Both ways of counting a tile agree, whatever the size of its threads."""
    import numpy as np

    from threadlens.operators.crowd import _listed, _product
    rnd = np.random.default_rng(3)
    at, of = [rnd.integers(0, n, 400) for n in (30, 20)], [rnd.integers(0, 50, 400) for _ in range(2)]
    held = [np.bincount(x, minlength=50) for x in of]
    want = np.zeros((30, 20), np.int32)
    for u, t in zip(at[0], of[0]):
        np.add.at(want[u], at[1][of[1] == t], 1)
    for way in ("product", "listed"):
        c = np.zeros_like(want)
        threads = np.flatnonzero(held[0] * held[1])
        _product(c, at, of, threads) if way == "product" else _listed(c, at, of, held, threads)
        assert (c == want).all()


def test_pairs_stay_where_they_are_to_meet_few_users(spark):
    """The users' side is written, so its size is known before the pairs are shuffled."""
    from threadlens.operators import graph as G
    edges = spark.range(2_000_000).select(F.col("id").cast("string").alias("user1"), F.lit("5").alias("user2"), F.lit(3).alias("weight"))
    wide = spark.range(3_000_000).select((F.col("id") % 7).cast("string").alias("username"), F.col("id").cast("string").alias("x"),
                                         F.lit(1.0).alias("s"))
    members = wide.groupBy("username").agg(F.max("x").alias("cluster"))
    totals = wide.groupBy("username").agg(F.sum("s").alias("total_score"))
    kept = G.weighted_graph(edges.withColumnRenamed("weight", "shared_interactions"), totals, 2.0)[1]
    for df in (G.edge_table(edges, members, "cluster"), G.community_table(edges, members, "cluster"), kept):
        joins = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines() if "user1" in ln and "Join" in ln]
        assert joins and all("Broadcast" in ln for ln in joins)


def test_modularity_passes_over_the_edges_once(spark):
    from threadlens.operators.louvain import modularity
    made = spark.sparkContext.accumulator(0)

    def mark(x):
        made.add(1)
        return x
    es = [("a", "b", 2), ("b", "c", 1), ("c", "d", 4), ("a", "d", 1), ("d", "e", 2), (None, "a", 1)]
    e = spark.createDataFrame(es, "user1 string, user2 string, weight int").withColumn(
        "user1", F.udf(mark).asNondeterministic()("user1"))
    member = [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("d", 3), ("x", None)]       # e in none, d in two
    m = spark.createDataFrame(member, "node string, community int")
    got = modularity(e, m).first().modularity
    m2 = 2.0 * sum(w for a, b, w in es if a)
    deg = Counter()
    for a, b, w in es:
        if a:
            deg[a] += w
            deg[b] += w
    want = 0.0
    for c in (1, 2, 3):
        mine = [n for n, k in member if k == c]
        inner = sum(2 * w for a, b, w in es if a in mine and b in mine)
        want += inner / m2 - (sum(deg[n] for n in mine) / m2) ** 2
    assert abs(got - want) < 1e-9
    assert made.value == len(es)


def test_searches_meet_an_edge_once_for_all_sources(spark, monkeypatch):
    """Rows of a level's join are edges, not edges times sources; many sources take several rows a node."""
    from threadlens.operators import graph as G
    rnd = random.Random(8)
    names = [f"n{i}" for i in range(40)]
    es = sorted({tuple(sorted(rnd.sample(names, 2))) for _ in range(260)}) + [("x", "y")]
    e = spark.createDataFrame(es, "user1 string, user2 string")
    near = defaultdict(set)
    for a, b in es:
        near[a].add(b)
        near[b].add(a)
    met, kept = [], G._around

    def around(und, held):
        out = kept(und, held)
        node = held.select("node").distinct()
        met.append(und.join(node, und["a"] == node["node"]).count())
        assert out.count() <= len(near) * 40
        return out
    monkeypatch.setattr(G, "_around", around)
    for limit in (G.SENT_NODES, 0):
        monkeypatch.setattr(G, "SENT_NODES", limit)
        got = {r.username: (r.reached, r.total_dist) for r in G.closeness_sampled(e, 40).collect()}
        assert len(got) == 40
        for s, (reached, total) in got.items():
            dist, at = {s: 0}, [s]
            for v in at:
                for w in sorted(near[v] - dist.keys()):
                    dist[w] = dist[v] + 1
                    at.append(w)
            assert (reached, total) == (len(dist), sum(dist.values()))
    assert met and max(met) <= 2 * len(es)


@pytest.mark.parametrize("most", [1024, 5])
def test_ngrams_of_a_user_are_counted_as_numbers(spark, monkeypatch, most):
    """Users whose texts fit make no row an n-gram; ties go to the smallest n-gram as text, over texts none is made."""
    from threadlens.operators import text as T
    monkeypatch.setattr(T, "TASK_TEXTS", most)
    rnd = random.Random(4)
    words = ["a", "ab", "b", "é", "zz", "中", "c", "ba"]
    rows = [(rnd.choice(["u", "v", "w", None]), " ".join(rnd.choices(words, k=rnd.randrange(9)))) for _ in range(40)]
    rows += [("one", "x"), ("none", ""), ("null", None), ("tie", "b a"), ("tie", "a b")]
    out = T.repeated_ngrams(spark.createDataFrame(rows, "who string, t string"), "t", "who", 4)
    if most == 1024:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "FlatMapGroupsInArrow" in plan
    want = set()
    for who in {u for u, _ in rows}:
        texts = [t.split() for u, t in rows if u == who and t]
        for n in range(1, 5):
            c = Counter(" ".join(t[i:i + n]) for t in texts for i in range(len(t) - n + 1))
            if c:
                top = min(c, key=lambda g: (-c[g], g.encode()))
                again = sum(v for v in c.values() if v > 1)
                want.add((who, n, sum(c.values()), len(c), top, c[top], int(again / sum(c.values()) * 1e6 + 0.5) / 1e6))
    assert set(map(tuple, out.collect())) == want


@pytest.mark.parametrize("t", [0.8, 0.3])
def test_near_duplicates_move_few_sets(spark, monkeypatch, t):
    """Sets that share one rare word are no candidates; all near-duplicates are found, whatever the order of tokens."""
    from threadlens.operators import text as T
    monkeypatch.setattr(T, "SLOTS", 8)            # slots that many tokens share: any order will do
    rnd = random.Random(6)
    words = ["w" + "".join(rnd.choices("abcdefgh", k=3)) for _ in range(300)]
    sets = {i: set(rnd.sample(words, rnd.randrange(1, 30))) for i in range(120)}
    for i in range(120, 170):
        near = set(sets[i - 100])
        near ^= set(rnd.sample(words, rnd.randrange(0, 4)))
        sets[i] = near or {"alone"}
    for i in range(170, 230):
        sets[i] = {"rare", *(f"x{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}{'q' * (i - 169)}" for k in range(20))}
    kept, moved = T._prefixes, []

    def prefixes(s, id_col, threshold):
        assert s.columns == [id_col, "words"]
        out = kept(s, id_col, threshold)
        moved.append(out)
        return out
    monkeypatch.setattr(T, "_prefixes", prefixes)
    df = spark.createDataFrame([(i, " ".join(rnd.sample(sorted(s), len(s)))) for i, s in sets.items()], "id long, t string")
    got = {(r.id_a, r.id_b) for r in T.near_duplicates(df, "id", "t", t).where("kind = 'near'").collect()}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}
    texts = defaultdict(list)
    for (i, s), r in zip(sets.items(), df.collect()):
        texts[r.t].append(i)
    alike = {i for x in texts.values() for i in sorted(x)[1:]}
    assert got == {p for p in want if not alike & set(p)} and got and moved


def test_texts_move_packed(spark):
    """What moves to a user's task is a fraction of the texts."""
    from threadlens.operators import text as T
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(400)]
    rows = [(f"u{i % 7}", " ".join(rnd.choices(words, k=600))) for i in range(60)] + [("u1", None), ("empty", "12 34"), (None, "a b")]
    df = spark.createDataFrame(rows, "who string, t string")
    seen = T._packed(df.select("who", T.clean_tokens("t").alias("w")), "who", F.array_distinct("w"), F.size("w"))
    assert seen.agg(F.sum(F.length("packed"))).first()[0] < 0.6 * sum(len(t or "") for _, t in rows)
    got = {(r.who, r.n_tokens, r.n_distinct) for r in T.keyword_repetition(df, "t", "who").collect()}
    by = defaultdict(list)
    for who, t in rows:
        by[who] += [w for w in (t or "").split() if w.isalpha()]
    assert got == {(who, len(x), len(set(x))) for who, x in by.items() if x}


def test_small_graphs_of_many_take_one_task_each(spark, monkeypatch):
    """Graphs that fit in a task come out as by rounds over all of them, beside those that don't."""
    from threadlens.operators import louvain as L
    rnd = random.Random(12)
    rows = []
    for g, (n, m) in {"a": (24, 60), "b": (40, 70), "c": (12, 50), "d": (30, 45), "e": (2, 1)}.items():
        rows += [(g, f"n{u}", f"n{v}", float(rnd.randrange(1, 4))) for u, v in sorted({tuple(rnd.sample(range(n), 2)) for _ in range(m)})]
    rows += [("a", "n1", "n1", 2.0), ("a", "n1", None, 1.0), (None, "x", "y", 1.0)]
    df = spark.createDataFrame(rows, "g string, user1 string, user2 string, w double")
    found = []
    for most in (1_000_000, 95):
        monkeypatch.setattr(L, "TASK_ENTRIES", most)
        found.append({(r.g, r.node): r.community for r in L.louvain(df, w="w", group="g").collect()})
    assert found[0] == found[1] and {g for g, _ in found[0]} == set("abcde")
