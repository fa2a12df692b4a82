"""Engagement totals, distributions and per-thread response times
(inventory A1, C1, C5, D5–D30, F1–F6, G1–G4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.functions.numeric import r3, r6
from threadlens.functions.predicates import date_range, in_communities
from threadlens.operators.quantiles import exact_quantiles, ranked_values
from threadlens.session import written
from threadlens.sources.roles import Forum


# --------------------------------------------------------------------------- loads
def load_posts(forum: Forum, start, end, communities=None, empty: str = "none",
               cols: Sequence[str] = ("post_id", "created_utc", "subreddit", "score")) -> DataFrame:
    """Posts in [start, end] of the selected communities."""
    p = forum.posts.filter(date_range("created_utc", start, end))
    return in_communities(p, "subreddit", communities, empty=empty).select(*cols)


def load_comments(forum: Forum, start, end, communities=None, empty: str = "none",
                  extra: Sequence[str] = ()) -> DataFrame:
    """Comments in [start, end] joined to their post for the community
    (post date not filtered; orphans dropped)."""
    parents = in_communities(forum.posts.select("post_id", "subreddit"), "subreddit",
                             communities, empty=empty)
    c = forum.comments.filter(date_range("created_utc", start, end))
    return c.join(parents, "post_id", "inner").select(
        "post_id", "created_utc", "subreddit", "score", *extra)


# --------------------------------------------------------------------- histogram
def score_histogram(df: DataFrame, col: str = "score", num_bins: int = 26,
                    iqr_mult: float = 1.5) -> DataFrame:
    """IQR outlier split and a fixed-width histogram of the rest.

    Rows: part ('lower' | 'main' | 'upper'), bin (0..num_bins-1 for main,
    NULL otherwise), bin_start, bin_end, bin_center, n, share (n / all rows),
    pct (share·100 rounded to 3 places). Bin edges are ``linspace(min, max,
    num_bins + 1)`` of the main part; a value falls in [edge_i, edge_i+1), the
    last bin is closed — as ``np.histogram`` with explicit edges. The edge array
    is rebuilt with the same float operations and the index corrected against
    it, so float edges cannot move a value by one bin.
    """
    # Everything follows from the distinct values with their counts and ranks.
    x = written(ranked_values(df.select(F.col(col).cast("double").alias("x")), [], "x"), "histogram")
    x = x.withColumnRenamed("_v", "x")
    total = x.agg(F.sum("_m")).first()[0] or 0
    if total == 0:
        return x.sparkSession.createDataFrame(
            [], "part string, bin int, bin_start double, bin_end double, bin_center double, "
                "n bigint, share double, pct double")

    def quantile(p):
        pos = p * (total - 1)
        r0, r1 = int(pos), min(int(pos) + 1, total - 1)
        held = lambda r: F.max(F.when((F.col("_first") <= r) & (F.lit(r) < F.col("_first") + F.col("_m")), F.col("x")))
        return held(r0), held(r1), pos - r0

    (a1, b1, f1), (a3, b3, f3) = quantile(0.25), quantile(0.75)
    v = x.agg(a1.alias("a1"), b1.alias("b1"), a3.alias("a3"), b3.alias("b3")).first()
    q1, q3 = v["a1"] + (v["b1"] - v["a1"]) * f1, v["a3"] + (v["b3"] - v["a3"]) * f3
    iqr = q3 - q1
    lo_b, hi_b = q1 - iqr_mult * iqr, q3 + iqr_mult * iqr
    main = x.filter((F.col("x") >= lo_b) & (F.col("x") <= hi_b))
    mm = main.agg(F.min("x").alias("mn"), F.max("x").alias("mx")).first()
    mn, mx = mm["mn"], mm["mx"]
    step = (mx - mn) / num_bins

    def edge(i):  # numpy linspace: i*step + start, last edge = stop
        return F.when(i >= num_bins, F.lit(mx)).otherwise(i.cast("double") * F.lit(step) + F.lit(mn))

    if mx == mn:
        idx = F.lit(num_bins - 1)
    else:
        raw = F.least(F.floor((F.col("x") - F.lit(mn)) / F.lit(mx - mn) * F.lit(num_bins)),
                      F.lit(num_bins - 1)).cast("int")
        idx = raw
    binned = main.withColumn("bin", idx)
    if mx != mn:
        b = F.col("bin")
        binned = binned.withColumn("bin", F.when(F.col("x") < edge(b), b - 1).otherwise(b))
        b = F.col("bin")
        binned = binned.withColumn("bin", F.when((F.col("x") >= edge(b + 1)) & (b < num_bins - 1),
                                                 b + 1).otherwise(b))
    counts = binned.groupBy("bin").agg(F.sum("_m").alias("n"))
    spark = x.sparkSession
    spine = spark.range(num_bins).select(F.col("id").cast("int").alias("bin"))
    i = F.col("bin")
    main_rows = (spine.join(counts, "bin", "left")
                 .select(F.lit("main").alias("part"), "bin",
                         edge(i).alias("bin_start"), edge(i + 1).alias("bin_end"),
                         F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    main_rows = main_rows.withColumn("bin_center", F.lit(0.5) * (F.col("bin_start") + F.col("bin_end")))
    outl = x.agg(F.sum(F.when(F.col("x") < lo_b, F.col("_m")).otherwise(0)).cast("bigint").alias("lower"),
                 F.sum(F.when(F.col("x") > hi_b, F.col("_m")).otherwise(0)).cast("bigint").alias("upper"))
    out_rows = outl.select(F.explode(F.array(
        F.struct(F.lit("lower").alias("part"), F.col("lower").alias("n")),
        F.struct(F.lit("upper").alias("part"), F.col("upper").alias("n")))).alias("o")).select(
        "o.part", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("bin_start"),
        F.lit(None).cast("double").alias("bin_end"), F.lit(None).cast("double").alias("bin_center"),
        "o.n")
    allr = main_rows.unionByName(out_rows)
    return allr.select("part", "bin", "bin_start", "bin_end", "bin_center", "n",
                       r6(F.col("n") / F.lit(float(total))).alias("share"),
                       r3(F.col("n") / F.lit(float(total)) * 100).alias("pct"))


# ------------------------------------------------------------ response times
PCTS = (5, 25, 50, 75)
PCT_COLS = [f"p{p}_elapsed" for p in PCTS]


def elapsed_seconds(later: str, earlier: str):
    """Seconds from ``earlier`` to ``later`` (no time-zone conversion)."""
    return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later)) / F.lit(1e6)


def comment_percentiles(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Per post with comments: score and the 5/25/50/75th percentile
    of seconds from post to comment (linear interpolation, exact)."""
    p = posts.select("post_id", F.col("created_utc").alias("post_time"), "score").dropDuplicates(["post_id"])
    e = comments.select("post_id", "created_utc").join(p.select("post_id", "post_time"), "post_id")
    e = e.withColumn("elapsed", elapsed_seconds("created_utc", "post_time"))
    q = exact_quantiles(e, ["post_id"], "elapsed", [p / 100 for p in PCTS], PCT_COLS)
    return q.join(p.select("post_id", "score"), "post_id").select("post_id", "score", *PCT_COLS)


def max_scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Divide each column by its max (one scalar aggregate; NULL when the
    max is 0 or missing, as ``try_divide``)."""
    row = df.agg(*[F.max(c).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        m = row[c]
        out = out.withColumn(c, F.lit(None).cast("double") if not m else F.col(c) / F.lit(float(m)))
    return out


def one_hot(df: DataFrame, col: str, values: Sequence[str], drop: bool = True) -> DataFrame:
    """K1: one 0/1 column per value (explicit value list → no extra pass)."""
    out = df
    for v in values:
        out = out.withColumn(v, (F.col(col) == F.lit(v)).cast("int"))
    return out.drop(col) if drop else out


def percentile_features(forum: Forum, start, end, communities) -> DataFrame:
    """The clustering input of the explorer: percentiles and score, max-scaled,
    plus one-hot community columns (G3: one row per post)."""
    posts = load_posts(forum, start, end, communities, cols=("post_id", "created_utc", "subreddit", "score"))
    comments = load_comments(forum, start, end, communities)
    pct = comment_percentiles(posts, comments)
    pct = max_scaled(pct, PCT_COLS + ["score"])
    max_cols = 1000   # one column per community, as the reference: bounded explicitly
    comms = sorted(r[0] for r in posts.select("subreddit").distinct().limit(max_cols + 1).collect())
    if len(comms) > max_cols:
        raise ValueError(f"more than {max_cols} communities: use a sparse encoding (StringIndexer + OneHotEncoder)")
    pct = pct.join(posts.select("post_id", "subreddit").dropDuplicates(["post_id"]), "post_id")
    return one_hot(pct, "subreddit", comms)


# ------------------------------------------------------------------ dedup etc.
DEDUP_KEYS = ("username", "subreddit", "post_id", "created_utc", "interaction_type")


def keep_first(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, order: str = "id") -> DataFrame:
    """Keep the row with the smallest ``order`` per key group (NULL keys
    group together). One aggregation — ``min`` over a struct led by ``order`` —
    so duplicates collapse map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    agg = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return agg.select(*[F.col(f"_r.{c}") if c not in keys else F.col(c) for c in [order] + list(keys) + rest]
                      ).select(*df.columns)


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Non-NULL value counts, most frequent first (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), col))


def top_n(df: DataFrame, order_col: str, n: int, tie: str) -> DataFrame:
    """first n rows by ``order_col`` desc, ``tie`` asc (global top-k:
    ``TakeOrderedAndProject`` keeps n rows per task before the final merge)."""
    return df.orderBy(F.desc(order_col), F.asc(tie)).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int,
                  rank_name: str = "rank") -> DataFrame:
    """First n rows per group. The ``row_number() <= n`` filter becomes a
    partial WindowGroupLimit before the shuffle, so a hot group sends at most n
    rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= n)


# ------------------------------------------------------------ daily features
def daily_engagement(posts: DataFrame, comments: DataFrame, user_col: str = "author") -> DataFrame:
    """D17 + C8 + D18/D19: one row per day from the first to the last active
    day; NULL → 0. Columns: day, total_posts, total_score_posts,
    avg_score_post, total_comments, total_score_comments, avg_score_comment,
    active_users, new_users, returning_users."""
    dp = posts.groupBy(F.window("created_utc", "1 day").start.alias("day")).agg(
        F.count(F.lit(1)).alias("total_posts"), F.sum("score").alias("total_score_posts"),
        r6(F.avg("score")).alias("avg_score_post"))
    dc = comments.groupBy(F.window("created_utc", "1 day").start.alias("day")).agg(
        F.count(F.lit(1)).alias("total_comments"), F.sum("score").alias("total_score_comments"),
        r6(F.avg("score")).alias("avg_score_comment"))
    acts = (posts.select(F.col(user_col).alias("u"), "created_utc")
            .unionByName(comments.select(F.col(user_col).alias("u"), "created_utc"))
            .filter(F.col("u").isNotNull())
            .withColumn("day", F.window("created_utc", "1 day").start))
    active = acts.groupBy("day").agg(F.countDistinct("u").alias("active_users"))
    first = acts.groupBy("u").agg(F.min("day").alias("day")).groupBy("day").agg(
        F.count(F.lit(1)).alias("new_users"))
    days = dp.select("day").unionByName(dc.select("day")).distinct()
    rng = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    spark = posts.sparkSession
    if rng["a"] is None:
        spine = days
    else:
        n = (rng["b"] - rng["a"]).days + 1
        spine = spark.range(n).select(
            (F.lit(rng["a"]).cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int")))
            .alias("day"))
    out = (spine.join(dp, "day", "left").join(dc, "day", "left").join(active, "day", "left")
           .join(first, "day", "left").fillna(0))
    return out.withColumn("returning_users", F.col("active_users") - F.col("new_users"))


def gini_entropy_by_day(acts: DataFrame, user_col: str = "author") -> DataFrame:
    """Inequality of contributions per day.

    gini = 2·Σ i·x_(i) / (n·Σx) − (n+1)/n over ascending per-user counts (the
    standard sign), entropy = −Σ p ln p = ln S − Σ x ln x / S. Ties do not change
    Σ i·x_(i), so users are grouped by their count value first: the window runs
    over distinct count values of one day, never over all users of a day.
    """
    per_user = (acts.withColumn("day", F.window("created_utc", "1 day").start)
                .groupBy("day", user_col).agg(F.count(F.lit(1)).alias("x")))
    by_val = per_user.groupBy("day", "x").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("day").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    by_val = by_val.withColumn("below", F.coalesce(F.sum("m").over(w), F.lit(0)))
    # positions below+1 .. below+m, all with value x
    by_val = by_val.withColumn(
        "ix", F.col("x") * (F.col("m") * F.col("below") + F.col("m") * (F.col("m") + 1) / 2))
    agg = by_val.groupBy("day").agg(
        F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("s"), F.sum("ix").alias("six"),
        F.sum(F.col("m") * F.col("x") * F.log(F.col("x"))).alias("sxlx"))
    return agg.select(
        "day", F.col("n").alias("contributors"),
        r6(F.lit(2.0) * F.col("six") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"),
        r6(F.log(F.col("s")) - F.col("sxlx") / F.col("s")).alias("entropy"))


def user_activity(forum_posts: DataFrame, forum_comments: DataFrame) -> DataFrame:
    """Unified activity rows (author, post_id, created_utc, score, kind)."""
    return (forum_posts.select("author", "post_id", "created_utc", "score", F.lit("post").alias("kind"))
            .unionByName(forum_comments.select("author", "post_id", "created_utc", "score",
                                               F.lit("comment").alias("kind"))))


def period_totals(acts: DataFrame, community_col: str = "subreddit") -> DataFrame:
    """Counts per (period kind, bucket, community) for hour/day/week/month in
    one pass with subtotals over communities (grouping sets)."""
    from threadlens.functions.timebuckets import bucket
    x = acts.select(community_col, bucket("created_utc", "1h").alias("hour"),
                    bucket("created_utc", "1D").alias("day"),
                    bucket("created_utc", "W").alias("week"),
                    bucket("created_utc", "M").alias("month"))
    c = community_col
    sets = [["hour", c], ["day", c], ["week", c], ["month", c], ["hour"], ["day"], ["week"], ["month"]]
    g = x.groupingSets([[F.col(n) for n in s] for s in sets], "hour", "day", "week", "month", c)
    agg = g.agg(F.count(F.lit(1)).alias("n"), F.grouping("hour").alias("_gh"),
                F.grouping("day").alias("_gd"), F.grouping("week").alias("_gw"),
                F.grouping(c).alias("all_communities"))
    period = (F.when(F.col("_gh") == 0, "hour").when(F.col("_gd") == 0, "day")
              .when(F.col("_gw") == 0, "week").otherwise("month"))
    return agg.select(period.alias("period"),
                      F.coalesce("hour", "day", "week", "month").alias("bucket"),
                      F.col(c).alias("community"), F.col("all_communities").cast("int"), "n")
