"""Registered engagement queries (A1, A7, A8, A12, C1, C5, C6, D1–D30, F*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.numeric import r6
from threadlens.functions.predicates import date_range, in_communities, optional_eq
from threadlens.functions.timebuckets import bucket
from threadlens.operators import engagement as E
from threadlens.operators import graph as G
from threadlens.plans.catalog import (EV_COMMUNITIES, EV_CTES, EV_END, EV_START, FLAG_CTES,
                                      ORD_COMMUNITIES, ORD_CTES, ORD_END, ORD_START, register, sql)
from threadlens.sources.roles import flagged_interactions, forum_from_events, forum_from_orders

ORD_IN = "(" + ", ".join(f"'{c}'" for c in ORD_COMMUNITIES) + ")"
EV_IN = "(" + ", ".join(f"'{c}'" for c in EV_COMMUNITIES) + ")"
ORD_RANGE = f"BETWEEN TIMESTAMP '{ORD_START}' AND TIMESTAMP '{ORD_END}'"
EV_RANGE = f"BETWEEN TIMESTAMP '{EV_START}' AND TIMESTAMP '{EV_END}'"

ORD_POSTS_SQL = f"SELECT * FROM posts WHERE created_utc {ORD_RANGE} AND subreddit IN {ORD_IN}"
ORD_COMMENTS_SQL = f"""SELECT c.post_id, c.created_utc, p.subreddit, c.score
    FROM comments c JOIN posts p ON c.post_id = p.post_id
    WHERE c.created_utc {ORD_RANGE} AND p.subreddit IN {ORD_IN}"""


def _ord(spark, sf_dir):
    return forum_from_orders(spark, sf_dir)


def _ev(spark, sf_dir):
    return forum_from_events(spark, sf_dir)


# ---------------------------------------------------------------- A1, C1, D16
@register("a1_posts_scan", sql(ORD_CTES, body=f"""
SELECT post_id, created_utc, subreddit, score FROM ({ORD_POSTS_SQL})"""))
def a1_posts_scan(spark, sf_dir):
    return E.load_posts(_ord(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)


@register("c1_comments_join", sql(ORD_CTES, body=ORD_COMMENTS_SQL))
def c1_comments_join(spark, sf_dir):
    return E.load_comments(_ord(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)


@register("d16_overview_counts", sql(ORD_CTES, body=f"""
, p AS ({ORD_POSTS_SQL}), c AS ({ORD_COMMENTS_SQL}),
cc AS (SELECT c2.author FROM comments c2 JOIN posts p2 ON c2.post_id = p2.post_id
       WHERE c2.created_utc {ORD_RANGE} AND p2.subreddit IN {ORD_IN})
SELECT (SELECT count(*) FROM p) AS n_posts, (SELECT count(*) FROM c) AS n_comments,
       (SELECT count(DISTINCT author) FROM (SELECT author FROM p UNION ALL SELECT author FROM cc)) AS n_users,
       (SELECT count(DISTINCT subreddit) FROM p) AS n_communities"""))
def d16_overview_counts(spark, sf_dir):
    f = _ord(spark, sf_dir)
    p = E.load_posts(f, ORD_START, ORD_END, ORD_COMMUNITIES, cols=("post_id", "subreddit", "author"))
    c = E.load_comments(f, ORD_START, ORD_END, ORD_COMMUNITIES, extra=("author",))
    # one pass over tagged rows instead of joining one-row aggregates
    rows = (p.select(F.lit(1).alias("is_post"), "subreddit", "author")
            .unionByName(c.select(F.lit(0).alias("is_post"), F.lit(None).cast("string").alias("subreddit"),
                                  "author")))
    return rows.agg(F.sum("is_post").cast("bigint").alias("n_posts"),
                    F.sum(1 - F.col("is_post")).cast("bigint").alias("n_comments"),
                    F.countDistinct("author").alias("n_users"),
                    F.countDistinct("subreddit").alias("n_communities"))


# ------------------------------------------------------------ D12–D15 histogram
def _hist_sql(src: str, col: str, nb: int = 26, k: float = 1.5) -> str:
    return f"""
, x AS (SELECT CAST({col} AS DOUBLE) AS x FROM ({src}) WHERE {col} IS NOT NULL),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(*) AS total FROM x),
b AS (SELECT q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi, total FROM q),
m AS (SELECT x.x, row_number() OVER () AS rid FROM x, b WHERE x.x >= b.lo AND x.x <= b.hi),
mm AS (SELECT min(x) AS mn, max(x) AS mx, (max(x) - min(x)) / {nb} AS step FROM m),
edges AS (SELECT i, CASE WHEN i >= {nb} THEN mx ELSE CAST(i AS DOUBLE) * step + mn END AS e
          FROM range(0, {nb + 1}) t(i), mm),
binned AS (SELECT m.rid, max(edges.i) AS bin FROM m JOIN edges ON edges.i < {nb} AND edges.e <= m.x
           GROUP BY m.rid),
cnt AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin),
mainr AS (SELECT 'main' AS part, CAST(e0.i AS INTEGER) AS bin, e0.e AS bin_start, e1.e AS bin_end,
                 0.5 * (e0.e + e1.e) AS bin_center, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
          FROM edges e0 JOIN edges e1 ON e1.i = e0.i + 1 LEFT JOIN cnt ON cnt.bin = e0.i
          WHERE e0.i < {nb}),
outr AS (SELECT 'lower' AS part, CAST(NULL AS INTEGER) AS bin, CAST(NULL AS DOUBLE) AS bin_start,
                CAST(NULL AS DOUBLE) AS bin_end, CAST(NULL AS DOUBLE) AS bin_center,
                CAST((SELECT count(*) FROM x, b WHERE x.x < b.lo) AS BIGINT) AS n
         UNION ALL
         SELECT 'upper', NULL, NULL, NULL, NULL,
                CAST((SELECT count(*) FROM x, b WHERE x.x > b.hi) AS BIGINT))
SELECT part, bin, bin_start, bin_end, bin_center, n, (floor((floor((n / (SELECT total FROM q)) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) AS share,
       (floor((floor((n / (SELECT total FROM q) * 100) * 1e9 + 0.5) / 1e9) * 1e3 + 0.5) / 1e3) AS pct
FROM (SELECT * FROM mainr UNION ALL SELECT * FROM outr)"""


@register("d14_post_score_histogram", sql(ORD_CTES, body=_hist_sql(ORD_POSTS_SQL, "score")))
def d14_post_score_histogram(spark, sf_dir):
    p = E.load_posts(_ord(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)
    return E.score_histogram(p, "score", 26, 1.5)


@register("d14_comment_score_histogram", sql(ORD_CTES, body=_hist_sql(ORD_COMMENTS_SQL, "score", 26, 1.5)))
def d14_comment_score_histogram(spark, sf_dir):
    c = E.load_comments(_ord(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)
    return E.score_histogram(c, "score", 26, 1.5)


@register("d12_histogram_wide_iqr", sql(ORD_CTES, body=_hist_sql(ORD_COMMENTS_SQL, "score", 10, 3.0)))
def d12_histogram_wide_iqr(spark, sf_dir):
    c = E.load_comments(_ord(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)
    return E.score_histogram(c, "score", 10, 3.0)


# -------------------------------------------------------- C5, D10, D11, K1, G3
_PCT_SQL = f"""
, p AS (SELECT post_id, created_utc AS post_time, score, subreddit FROM ({ORD_POSTS_SQL})),
c AS ({ORD_COMMENTS_SQL}),
e AS (SELECT c.post_id, date_diff('microsecond', p.post_time, c.created_utc) / 1e6 AS elapsed
      FROM c JOIN p ON c.post_id = p.post_id),
pct AS (SELECT post_id, quantile_cont(elapsed, 0.05) AS p5_elapsed, quantile_cont(elapsed, 0.25) AS p25_elapsed,
               quantile_cont(elapsed, 0.5) AS p50_elapsed, quantile_cont(elapsed, 0.75) AS p75_elapsed
        FROM e GROUP BY post_id)"""


@register("d10_comment_percentiles", sql(ORD_CTES, body=_PCT_SQL + """
SELECT pct.post_id, p.score, p5_elapsed, p25_elapsed, p50_elapsed, p75_elapsed
FROM pct JOIN p ON pct.post_id = p.post_id"""))
def d10_comment_percentiles(spark, sf_dir):
    f = _ord(spark, sf_dir)
    posts = E.load_posts(f, ORD_START, ORD_END, ORD_COMMUNITIES)
    return E.comment_percentiles(posts, E.load_comments(f, ORD_START, ORD_END, ORD_COMMUNITIES))


_ONEHOT = ", ".join(f"CASE WHEN p.subreddit = '{c}' THEN 1 ELSE 0 END AS \"{c}\"" for c in ORD_COMMUNITIES)


@register("k1_percentile_features", sql(ORD_CTES, body=_PCT_SQL + f"""
, j AS (SELECT pct.*, p.score, p.subreddit FROM pct JOIN p ON pct.post_id = p.post_id),
mx AS (SELECT max(p5_elapsed) a, max(p25_elapsed) b, max(p50_elapsed) c, max(p75_elapsed) d, max(score) s FROM j)
SELECT j.post_id, CASE WHEN mx.s = 0 THEN NULL ELSE (floor((floor((j.score / mx.s) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) END AS score,
       CASE WHEN mx.a = 0 THEN NULL ELSE (floor((floor((p5_elapsed / mx.a) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) END AS p5_elapsed,
       CASE WHEN mx.b = 0 THEN NULL ELSE (floor((floor((p25_elapsed / mx.b) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) END AS p25_elapsed,
       CASE WHEN mx.c = 0 THEN NULL ELSE (floor((floor((p50_elapsed / mx.c) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) END AS p50_elapsed,
       CASE WHEN mx.d = 0 THEN NULL ELSE (floor((floor((p75_elapsed / mx.d) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) END AS p75_elapsed,
       {_ONEHOT.replace('p.subreddit', 'j.subreddit')}
FROM j, mx"""))
def k1_percentile_features(spark, sf_dir):
    f = E.percentile_features(_ord(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)
    return f.select(*[r6(c).alias(c) if c in (*E.PCT_COLS, "score") else c for c in f.columns])


# ------------------------------------------------------------- D1–D3, B13, F1
_TOTALS_SQL = f"""
, acts AS (SELECT author, score, created_utc, post_id FROM posts
           UNION ALL SELECT author, score, created_utc, post_id FROM comments),
tot AS (SELECT author AS username, count(*) AS total_interactions, sum(score) AS total_score FROM acts
        WHERE created_utc {EV_RANGE} AND post_id IN (SELECT post_id FROM posts WHERE subreddit IN {EV_IN})
        GROUP BY author)"""


@register("d3_user_totals", sql(EV_CTES, body=_TOTALS_SQL + "\nSELECT * FROM tot"))
def d3_user_totals(spark, sf_dir):
    return G.user_totals(_ev(spark, sf_dir), EV_START, EV_END, EV_COMMUNITIES)


@register("f1_users_by_score", sql(EV_CTES, body=_TOTALS_SQL + """
SELECT username, total_score FROM tot WHERE total_score >= 500 ORDER BY total_score DESC, username"""))
def f1_users_by_score(spark, sf_dir):
    t = G.user_totals(_ev(spark, sf_dir), EV_START, EV_END, EV_COMMUNITIES)
    return (t.filter(F.col("total_score") >= 500).select("username", "total_score")
            .orderBy(F.desc("total_score"), "username"))


# --------------------------------------------------------------- D6, D5, C6
_FLAG_COLS = ["id", "username", "interaction_type", "subreddit", "post_id", "parent_id",
              "created_utc", "score"]


def _flagged(spark, sf_dir):
    return flagged_interactions(spark, sf_dir).select(*_FLAG_COLS)


_DEDUP_SQL = """
, dedup AS (SELECT * FROM flagged WHERE id IN (
    SELECT min(id) FROM flagged GROUP BY username, subreddit, post_id, created_utc, interaction_type))"""


@register("d6_dedup_interactions", sql(EV_CTES, FLAG_CTES, body=_DEDUP_SQL + "\nSELECT * FROM dedup"))
def d6_dedup_interactions(spark, sf_dir):
    return E.keep_first(_flagged(spark, sf_dir))


@register("d5_interactions_by_community", sql(EV_CTES, FLAG_CTES, body=_DEDUP_SQL + f"""
SELECT subreddit, count(*) AS interaction_count FROM dedup
WHERE created_utc {EV_RANGE} AND subreddit IS NOT NULL GROUP BY subreddit"""))
def d5_interactions_by_community(spark, sf_dir):
    d = E.keep_first(_flagged(spark, sf_dir)).filter(date_range("created_utc", EV_START, EV_END))
    return E.value_counts(d, "subreddit", "interaction_count")


@register("b4_optional_community", sql(EV_CTES, FLAG_CTES, body=_DEDUP_SQL + f"""
SELECT username, subreddit, post_id, interaction_type, created_utc FROM dedup
WHERE created_utc {EV_RANGE} AND subreddit = 'purchase'"""))
def b4_optional_community(spark, sf_dir):
    d = E.keep_first(_flagged(spark, sf_dir)).filter(date_range("created_utc", EV_START, EV_END))
    return optional_eq(d, "subreddit", "purchase").select(
        "username", "subreddit", "post_id", "interaction_type", "created_utc")


@register("c6_post_details", sql(EV_CTES, FLAG_CTES, body=_DEDUP_SQL + f"""
SELECT post_id, author, created_utc, score FROM posts
WHERE post_id IN (SELECT post_id FROM dedup WHERE created_utc {EV_RANGE} AND subreddit = 'view')"""))
def c6_post_details(spark, sf_dir):
    d = E.keep_first(_flagged(spark, sf_dir)).filter(date_range("created_utc", EV_START, EV_END))
    ids = optional_eq(d, "subreddit", "view").select("post_id").distinct()
    return (_ev(spark, sf_dir).posts.join(ids, "post_id", "left_semi")
            .select("post_id", "author", "created_utc", "score"))


# -------------------------------------------------------------- A7, A8, A12
LIMIT = 1000
LOOKBACK = (("day", 1), ("week", 7), ("month", 30), ("year", 365))


def _new_listing(f):
    p = f.posts.select("post_id", "subreddit", "created_utc", "score")
    return E.top_per_group(p, ["subreddit"], [F.desc("created_utc"), F.asc("post_id")], LIMIT)


def _top_listing(f):
    p = f.posts.select("post_id", "subreddit", "created_utc", "score")
    asof = p.agg(F.max("created_utc")).first()[0]
    parts = []
    for name, days in LOOKBACK:
        recent = p.filter(F.col("created_utc") >= F.lit(asof) - F.make_dt_interval(days=F.lit(days)))
        parts.append(E.top_per_group(recent, ["subreddit"], [F.desc("score"), F.asc("post_id")], LIMIT)
                     .withColumn("timeframe", F.lit(name)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register("a7_new_listing", sql(ORD_CTES, body=f"""
SELECT post_id, subreddit, created_utc, score, rank FROM (
  SELECT post_id, subreddit, created_utc, score,
         row_number() OVER (PARTITION BY subreddit ORDER BY created_utc DESC, post_id) AS rank FROM posts)
WHERE rank <= {LIMIT}"""))
def a7_new_listing(spark, sf_dir):
    return _new_listing(_ord(spark, sf_dir))


_TOP_SQL = "\nUNION ALL\n".join(f"""
SELECT post_id, subreddit, created_utc, score, rank, '{name}' AS timeframe FROM (
  SELECT post_id, subreddit, created_utc, score,
         row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, post_id) AS rank
  FROM posts WHERE created_utc >= (SELECT max(created_utc) FROM posts) - INTERVAL {days} DAY)
WHERE rank <= {LIMIT}""" for name, days in LOOKBACK)


@register("a8_top_listing", sql(ORD_CTES, body=_TOP_SQL))
def a8_top_listing(spark, sf_dir):
    return _top_listing(_ord(spark, sf_dir))


@register("a12_listing_merge", sql(ORD_CTES, body=f"""
, l AS (SELECT post_id, subreddit, created_utc, score FROM (
  SELECT post_id, subreddit, created_utc, score,
         row_number() OVER (PARTITION BY subreddit ORDER BY created_utc DESC, post_id) AS rank FROM posts)
WHERE rank <= {LIMIT}
UNION ALL SELECT post_id, subreddit, created_utc, score FROM ({_TOP_SQL}))
SELECT DISTINCT post_id, subreddit, created_utc, score FROM l"""))
def a12_listing_merge(spark, sf_dir):
    f = _ord(spark, sf_dir)
    cols = ["post_id", "subreddit", "created_utc", "score"]
    return (_new_listing(f).select(*cols).unionByName(_top_listing(f).select(*cols))
            .dropDuplicates(["post_id"]))


# ---------------------------------------------------------- D17–D19, C8, E*
_EV_P = f"SELECT * FROM posts WHERE subreddit IN {EV_IN}"
_EV_C = f"""SELECT c.* FROM comments c JOIN posts p ON c.post_id = p.post_id WHERE p.subreddit IN {EV_IN}"""

DAILY_SQL = f"""
, fp AS ({_EV_P}), fc AS ({_EV_C}),
dp AS (SELECT date_trunc('day', created_utc) AS day, count(*) AS total_posts, sum(score) AS total_score_posts,
              (floor((floor((avg(score)) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) AS avg_score_post FROM fp GROUP BY 1),
dc AS (SELECT date_trunc('day', created_utc) AS day, count(*) AS total_comments,
              sum(score) AS total_score_comments, (floor((floor((avg(score)) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) AS avg_score_comment FROM fc GROUP BY 1),
acts AS (SELECT author AS u, date_trunc('day', created_utc) AS day FROM fp
         UNION ALL SELECT author, date_trunc('day', created_utc) FROM fc),
act AS (SELECT day, count(DISTINCT u) AS active_users FROM acts WHERE u IS NOT NULL GROUP BY day),
nw AS (SELECT day, count(*) AS new_users FROM (SELECT u, min(day) AS day FROM acts WHERE u IS NOT NULL GROUP BY u)
       GROUP BY day),
days AS (SELECT day FROM dp UNION SELECT day FROM dc),
spine AS (SELECT CAST(g AS TIMESTAMP) AS day FROM (SELECT min(day) a, max(day) b FROM days),
          generate_series(a, b, INTERVAL 1 DAY) t(g)),
daily AS (
SELECT spine.day,
       CAST(coalesce(total_posts, 0) AS BIGINT) AS total_posts, coalesce(total_score_posts, 0) AS total_score_posts,
       coalesce(avg_score_post, 0) AS avg_score_post,
       CAST(coalesce(total_comments, 0) AS BIGINT) AS total_comments,
       coalesce(total_score_comments, 0) AS total_score_comments, coalesce(avg_score_comment, 0) AS avg_score_comment,
       CAST(coalesce(active_users, 0) AS BIGINT) AS active_users, CAST(coalesce(new_users, 0) AS BIGINT) AS new_users,
       CAST(coalesce(active_users, 0) - coalesce(new_users, 0) AS BIGINT) AS returning_users
FROM spine LEFT JOIN dp ON dp.day = spine.day LEFT JOIN dc ON dc.day = spine.day
     LEFT JOIN act ON act.day = spine.day LEFT JOIN nw ON nw.day = spine.day)"""


def ev_daily(spark, sf_dir):
    f = _ev(spark, sf_dir)
    p = in_communities(f.posts, "subreddit", EV_COMMUNITIES)
    c = f.comments.join(p.select("post_id"), "post_id", "left_semi")
    return E.daily_engagement(p, c)


@register("d17_daily_engagement", sql(EV_CTES, body=DAILY_SQL + "\nSELECT * FROM daily"))
def d17_daily_engagement(spark, sf_dir):
    return ev_daily(spark, sf_dir)


@register("d22_gini_entropy", sql(EV_CTES, body="""
, pu AS (SELECT date_trunc('day', created_utc) AS day, author, count(*) AS x FROM comments GROUP BY 1, 2),
r AS (SELECT day, x, row_number() OVER (PARTITION BY day ORDER BY x, author) AS i FROM pu)
SELECT day, count(*) AS contributors,
       (floor((floor((2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) AS gini,
       (floor((floor((-sum((x / s) * ln(x / s))) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) AS entropy
FROM (SELECT r.*, sum(x) OVER (PARTITION BY day) AS s FROM r) GROUP BY day"""))
def d22_gini_entropy(spark, sf_dir):
    return E.gini_entropy_by_day(_ev(spark, sf_dir).comments, "author")


@register("d30_period_totals", sql(EV_CTES, body=f"""
, a AS (SELECT subreddit, created_utc FROM posts
        UNION ALL SELECT p.subreddit, c.created_utc FROM comments c JOIN posts p ON c.post_id = p.post_id),
x AS (SELECT subreddit, time_bucket(INTERVAL '1 hour', created_utc) AS hour,
             time_bucket(INTERVAL '1 day', created_utc) AS day,
             CAST(CAST(created_utc AS DATE) + CAST((7 - isodow(created_utc)) % 7 AS INTEGER) AS TIMESTAMP) AS week,
             CAST(last_day(CAST(created_utc AS DATE)) AS TIMESTAMP) AS month FROM a)
SELECT CASE WHEN grouping(hour) = 0 THEN 'hour' WHEN grouping(day) = 0 THEN 'day'
            WHEN grouping(week) = 0 THEN 'week' ELSE 'month' END AS period,
       coalesce(hour, day, week, month) AS bucket, subreddit AS community,
       CAST(grouping(subreddit) AS INTEGER) AS all_communities, count(*) AS n
FROM x GROUP BY GROUPING SETS ((hour, subreddit), (day, subreddit), (week, subreddit), (month, subreddit),
                               (hour), (day), (week), (month))"""))
def d30_period_totals(spark, sf_dir):
    f = _ev(spark, sf_dir)
    c = f.comments.join(f.posts.select("post_id", "subreddit"), "post_id")
    acts = f.posts.select("subreddit", "created_utc").unionByName(c.select("subreddit", "created_utc"))
    return E.period_totals(acts, "subreddit")


# ----------------------------------------------------------------- F2, D25, G4
_TOPU_SQL = """
, tu AS (SELECT author, count(*) AS n FROM posts GROUP BY author ORDER BY n DESC, author LIMIT 100)"""


@register("f2_top_users", sql(ORD_CTES, body=_TOPU_SQL + "\nSELECT author, n FROM tu"))
def f2_top_users(spark, sf_dir):
    p = _ord(spark, sf_dir).posts
    return E.top_n(p.groupBy("author").agg(F.count(F.lit(1)).alias("n")), "n", 100, "author")


@register("d25_top_user_daily_posts", sql(ORD_CTES, body=_TOPU_SQL + """
, d AS (SELECT date_trunc('day', created_utc) AS day, count(*) AS top_user_posts
        FROM posts WHERE author IN (SELECT author FROM tu) GROUP BY 1),
spine AS (SELECT CAST(g AS TIMESTAMP) AS day FROM (SELECT min(day) a, max(day) b FROM d),
          generate_series(a, b, INTERVAL 1 DAY) t(g))
SELECT spine.day, CAST(coalesce(top_user_posts, 0) AS BIGINT) AS top_user_posts
FROM spine LEFT JOIN d ON d.day = spine.day"""))
def d25_top_user_daily_posts(spark, sf_dir):
    p = _ord(spark, sf_dir).posts
    top = E.top_n(p.groupBy("author").agg(F.count(F.lit(1)).alias("n")), "n", 100, "author")
    d = (p.join(top.select("author"), "author", "left_semi")
         .groupBy(F.window("created_utc", "1 day").start.alias("day"))
         .agg(F.count(F.lit(1)).alias("top_user_posts")))
    rng = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    n = (rng["b"] - rng["a"]).days + 1
    spine = spark.range(n).select(
        (F.lit(rng["a"]).cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("day"))
    return spine.join(d, "day", "left").select("day", F.coalesce("top_user_posts", F.lit(0)).alias("top_user_posts"))


@register("g4_set_overlap", sql(EV_CTES, body="""
, a AS (SELECT DISTINCT author FROM comments WHERE src_type = 'click'),
b AS (SELECT DISTINCT author FROM comments WHERE src_type = 'view')
SELECT (SELECT count(*) FROM a JOIN b USING (author)) AS n_both,
       (SELECT count(*) FROM (SELECT author FROM a UNION SELECT author FROM b)) AS n_either,
       (SELECT count(*) FROM a JOIN b USING (author)) * 1.0
         / (SELECT count(*) FROM (SELECT author FROM a UNION SELECT author FROM b)) AS jaccard"""))  # noqa
def g4_set_overlap(spark, sf_dir):
    c = _ev(spark, sf_dir).comments
    a = c.filter(F.col("src_type") == "click").select("author").distinct().withColumn("in_a", F.lit(1))
    b = c.filter(F.col("src_type") == "view").select("author").distinct().withColumn("in_b", F.lit(1))
    j = a.join(b, "author", "full_outer")
    return j.agg(F.sum(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1).otherwise(0))
                 .cast("bigint").alias("n_both"),
                 F.count(F.lit(1)).alias("n_either")).withColumn(
        "jaccard", F.col("n_both") / F.col("n_either"))


# ------------------------------------------------- D16, D18, D30 from stored sketches
@register("d30_approx_users", sql(EV_CTES, body="""
, a AS (SELECT subreddit, author, created_utc FROM posts
        UNION ALL SELECT p.subreddit, c.author, c.created_utc FROM comments c JOIN posts p ON c.post_id = p.post_id),
x AS (SELECT 'W' AS period, subreddit, author,
             CAST(CAST(created_utc AS DATE) + CAST((7 - isodow(created_utc)) % 7 AS INTEGER) AS TIMESTAMP) AS bucket FROM a
      UNION ALL SELECT 'D', subreddit, author, time_bucket(INTERVAL '1 day', created_utc) FROM a)
SELECT period, bucket, subreddit, CAST(grouping(subreddit) AS INTEGER) AS all_communities, count(*) AS n,
       count(DISTINCT author) AS approx_users
FROM x GROUP BY GROUPING SETS ((period, bucket, subreddit), (period, bucket))"""))
def d30_approx_users(spark, sf_dir):
    """Days and weeks from the same stored daily sketches (few users each, so the sketches count exactly)."""
    from threadlens.operators.sketches import daily_sketches, rolled_up
    from threadlens.session import written
    f = _ev(spark, sf_dir)
    c = f.comments.join(f.posts.select("post_id", "subreddit"), "post_id")
    acts = f.posts.select("subreddit", "author", "created_utc").unionByName(c.select("subreddit", "author", "created_utc"))
    stored = written(daily_sketches(acts, "created_utc", "subreddit", "author"), "daily-sketches")
    return rolled_up(stored, "D", "subreddit").withColumn("period", F.lit("D")).unionByName(
        rolled_up(stored, "W", "subreddit").withColumn("period", F.lit("W")))
