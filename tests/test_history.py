"""As-of joins, stored sketches, n-grams and closeness against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, deque

START = dt.datetime(2024, 1, 1)


def test_latest_before_matches_a_scan(spark):
    from threadlens.operators.asof import latest_before
    rnd = random.Random(2)
    at = lambda m: None if m is None else START + dt.timedelta(minutes=m)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", None])
    points = [(i, key(), at(rnd.choice([None, *range(60)]))) for i in range(300)]
    facts = [(i, key(), at(rnd.choice([None, *range(60)])), rnd.choice([0, 1, None])) for i in range(80)]
    got = latest_before(spark.createDataFrame(points, "id long, k string, t timestamp_ntz"),
                        spark.createDataFrame(facts, "fid long, k string, t timestamp_ntz, label int"),
                        "k", "t", ["label"], "fid")
    want = {}
    for i, k, t in points:
        seen = [(ft, fid, label) for fid, fk, ft, label in facts if fk == k and ft is not None and t is not None and ft <= t]
        want[i] = max(seen)[2] if seen else None
    assert {r.id: r.label for r in got.collect()} == want
    none = spark.createDataFrame([], "fid long, k string, t timestamp_ntz, label int")
    assert {r.label for r in latest_before(spark.createDataFrame(points, "id long, k string, t timestamp_ntz"),
                                           none, "k", "t", ["label"], "fid").collect()} == {None}


def test_months_from_daily_sketches(spark, tmp_path):
    from threadlens.operators.sketches import daily_sketches, rolled_up
    rnd = random.Random(9)
    rows = [(START + dt.timedelta(hours=rnd.randrange(24 * 28)), rnd.choice("ab"), f"u{int(rnd.paretovariate(0.6)) % 9000}")
            for _ in range(40_000)] + [(START, "a", None)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, c string, u string")
    daily_sketches(events, "ts", "c", "u").write.parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    got = {(r.c, r.all_communities): (r.n, r.approx_users) for r in rolled_up(stored, "ME", "c").collect()}
    for c in "ab":
        users = {u for _, k, u in rows if k == c and u}
        assert got[c, 0][0] == sum(k == c for _, k, _ in rows) and abs(got[c, 0][1] / len(users) - 1) < 0.05
    assert abs(got[None, 1][1] / len({u for _, _, u in rows if u}) - 1) < 0.05 and got[None, 1][0] == len(rows)


def test_closeness_of_all_nodes(spark):
    from threadlens.operators.sketches import closeness_all
    rnd = random.Random(4)
    edges = {(f"n{i:03d}", f"n{rnd.randrange(i):03d}") for i in range(1, 90)} | {("x", "y")}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r.username: (r.reached, r.closeness) for r in closeness_all(spark.createDataFrame(list(edges), "user1 string, user2 string")).collect()}
    assert set(got) == set(near)
    for a in near:
        dist, todo = {a: 0}, deque([a])
        while todo:
            x = todo.popleft()
            for y in near[x] - dist.keys():
                dist[y] = dist[x] + 1
                todo.append(y)
        r = len(dist) - 1
        want = r / sum(dist.values()) * r / (len(near) - 1)
        assert abs(got[a][0] - r) <= 0.05 * r and abs(got[a][1] - want) <= 0.1 * want


def test_repeated_ngrams(spark):
    from threadlens.operators.text import repeated_ngrams
    rows = [("u", "buy now cheap buy now"), ("u", "buy now"), ("u", None), ("u", ""), (None, "one two"), ("v", "single")]
    got = {(r.user, r.n): (r.n_grams, r.n_distinct, r.top_gram, r.top_count, r.repeated_share)
           for r in repeated_ngrams(spark.createDataFrame(rows, "user string, t string"), "t", "user").collect()}
    texts = [t.split() for u, t in rows if u == "u" and t]
    for n in (1, 2, 3):
        c = Counter(" ".join(t[i:i + n]) for t in texts for i in range(len(t) - n + 1))
        top = min(c, key=lambda g: (-c[g], g))
        again = sum(v for v in c.values() if v > 1)
        assert got["u", n] == (sum(c.values()), len(c), top, c[top], round(again / sum(c.values()), 6))
    assert got["v", 1][:2] == (1, 1) and ("v", 2) not in got and (None, 2) in got


def test_clusters_are_born_merge_split_and_die(spark):
    from threadlens.operators.graph import cluster_events
    week = lambda i: START + dt.timedelta(days=7 * i)
    groups = [(0, "a", "pqr"), (0, "b", "xyz"), (0, "c", "k"), (1, "ab", "pqrxyz"), (1, "new", "mn"),
              (2, "left", "pqr"), (2, "right", "xyz"), (2, "new", "mno")]
    rows = [(week(w), c, who) for w, c, people in groups for who in people] + [(week(1), "new", None), (week(1), "new", "m")]
    got = {((r.window - START).days // 7, r.cluster): (r.n, r.came, r.went)
           for r in cluster_events(spark.createDataFrame(rows, "window timestamp_ntz, cluster string, author string"), "window", 7, 0.5).collect()}
    assert got == {(0, "a"): (3, None, "goes on"), (0, "b"): (3, None, "goes on"), (0, "c"): (1, None, "death"),
                   (1, "ab"): (6, "merge", "split"), (1, "new"): (2, "birth", "goes on"),
                   (2, "left"): (3, "goes on", None), (2, "right"): (3, "goes on", None), (2, "new"): (3, "goes on", None)}


def test_closeness_moves_a_sketch_once_to_a_block(spark, monkeypatch):
    from threadlens.operators import sketches
    made = {}

    def kept(df, name="table"):
        from threadlens.session import written
        made[name] = written(df, name)
        return made[name]
    monkeypatch.setattr(sketches, "written", kept)
    n, key = 150, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    e = spark.range(n).selectExpr("id as a").crossJoin(spark.range(n).selectExpr("id as b")).where("a < b")
    e = e.selectExpr("concat('n', a) as user1", "concat('n', b) as user2")
    got = sketches.closeness_all(e.unionByName(e.limit(10))).collect()
    assert len(got) == n and {(r.reached, r.closeness) for r in got} == {(n - 1, 1.0)}
    blocks = spark.sparkContext.defaultParallelism
    assert made["closeness-near"].count() <= n * blocks and made["closeness-united"].count() == n
    assert spark.conf.get(key) == before


def test_tokens_and_ngrams_are_counted_in_the_task_of_their_user(spark, monkeypatch):
    from threadlens.operators import text as T
    rows = [("a", "one two one two"), ("a", "two One"), ("b", None), (None, "one two three"), (None, "one"), ("c", "x x x x")] + [
        ("d", f"word{i % 3} and more") for i in range(9)]
    df = spark.createDataFrame(rows, "who string, body string")
    found = []
    for most in (100, 1):
        monkeypatch.setattr(T, "TASK_TEXTS", most)
        for f in (T.keyword_repetition, T.repeated_ngrams):
            out = f(df, "body", "who")
            if most == 100:
                assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
            found.append(sorted(map(tuple, out.collect()), key=str))
    assert found[:2] == found[2:]
    assert [r for r in found[0] if r[0] in ("a", None)] == [("a", 6, 2, 0.666667), (None, 4, 3, 0.25)]
    assert ("a", 2, 4, 2, "one two", 2, 1.0) in found[1] and ("c", 3, 2, 1, "x x x", 2, 1.0) in found[1]


def test_rows_are_dealt_over_tasks_before_their_texts_join(spark, tmp_path):
    from threadlens.sources.roles import attach_text
    spark.createDataFrame([(i, f"text {i}") for i in range(7)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.range(100).coalesce(1).selectExpr("if(id = 50, null, id) as id", "'x' as body")
    out = attach_text(spark, str(tmp_path), rows, "id", "body")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.id, r.body) for r in out.collect()} == {(None, None)} | {(i, f"text {i % 7}") for i in range(100) if i != 50}


def test_texts_are_dealt_over_tasks_before_a_lexicon_table_scores_them(spark, monkeypatch):
    from threadlens import session
    from threadlens.functions.sentiment import LEXICON, with_compound, with_compound_table
    parts, write = {}, session.written

    def kept(df, name="table"):
        parts[name] = df.rdd.getNumPartitions()
        return write(df, name)
    monkeypatch.setattr(session, "written", kept)
    texts = ["a very good day", "not bad but GREAT!", "so sad", None, "plain words"]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(40)], "id long, t string").coalesce(1)
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, val double")
    got = {r.id: r.compound for r in with_compound_table(df, "id", "t", lexicon).collect()}
    assert parts["tokens"] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got == {r.id: r.compound for r in with_compound(df, "t").collect()}
