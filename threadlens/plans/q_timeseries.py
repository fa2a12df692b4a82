"""Registered time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.numeric import sql_r6
from threadlens.functions.sentiment import sentiment_sql, with_compound
from threadlens.operators import timeseries as TS
from threadlens.plans.catalog import EV_CTES, ORD_CTES, TEXT_CTES, register, sql
from threadlens.sources.roles import forum_from_events, forum_from_orders, forum_with_text

# ------------------------------------------------------------ shared series
_SERIES_SQL = """
, cs AS (SELECT p.subreddit, date_trunc('day', c.created_utc) AS day
         FROM comments c JOIN posts p ON c.post_id = p.post_id),
cnt AS (SELECT subreddit, day, count(*) AS n FROM cs GROUP BY 1, 2),
rng AS (SELECT subreddit, min(day) AS a, max(day) AS b FROM cnt GROUP BY 1),
sp AS (SELECT subreddit, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM rng),
series AS (SELECT sp.subreddit, sp.day, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
           FROM sp LEFT JOIN cnt ON cnt.subreddit = sp.subreddit AND cnt.day = sp.day)"""


def ord_series(spark, sf_dir):
    """Daily comment counts per community, zero-filled per community."""
    f = forum_from_orders(spark, sf_dir)
    c = f.comments.join(f.posts.select("post_id", "subreddit"), "post_id")
    return (TS.keyed_zero_filled_counts(c, "subreddit", "created_utc", "1D", "n")
            .withColumnRenamed("bucket", "day"))


BY = ["subreddit"]


@register("e3_e5_rolling", sql(ORD_CTES, body=_SERIES_SQL + f"""
SELECT subreddit, day, n,
       CASE WHEN count(n) OVER w = 7 THEN {sql_r6('avg(n) OVER w')} END AS ma_7_n,
       CASE WHEN count(n) OVER w = 7 THEN {sql_r6('stddev_samp(n) OVER w')} END AS std_7_n
FROM series WINDOW w AS (PARTITION BY subreddit ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def e3_e5_rolling(spark, sf_dir):
    return TS.rolling(ord_series(spark, sf_dir), "day", ["n"], 7, BY)


@register("e4_ema", sql(ORD_CTES, body=_SERIES_SQL + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY day) AS rn FROM series)
SELECT a.subreddit, a.day, a.n,
       {sql_r6('sum(b.n * pow(0.75, a.rn - b.rn)) / sum(pow(0.75, a.rn - b.rn))')} AS ema_7_n
FROM r a JOIN r b ON b.subreddit = a.subreddit AND b.rn <= a.rn
GROUP BY a.subreddit, a.day, a.n"""))
def e4_ema(spark, sf_dir):
    return TS.ema(ord_series(spark, sf_dir), "day", "n", 7, BY)


@register("e6_e8_diffs", sql(ORD_CTES, body=_SERIES_SQL + """
, v AS (SELECT *, n - lag(n) OVER w AS velocity_n, lag(n, 1) OVER w AS lag1_n, lag(n, 7) OVER w AS lag7_n
        FROM series WINDOW w AS (PARTITION BY subreddit ORDER BY day))
SELECT subreddit, day, n, velocity_n,
       velocity_n - lag(velocity_n) OVER (PARTITION BY subreddit ORDER BY day) AS acceleration_n, lag1_n, lag7_n
FROM v"""))
def e6_e8_diffs(spark, sf_dir):
    return TS.diffs(ord_series(spark, sf_dir), "day", "n", BY)


@register("e9_autocorrelation", sql(ORD_CTES, body=_SERIES_SQL + f"""
, l AS (SELECT subreddit, n, lag(n, 7) OVER (PARTITION BY subreddit ORDER BY day) AS lg FROM series)
SELECT subreddit, {sql_r6('corr(n, lg)')} AS autocorr_7 FROM l WHERE lg IS NOT NULL GROUP BY subreddit"""))
def e9_autocorrelation(spark, sf_dir):
    return TS.autocorrelation(ord_series(spark, sf_dir), "day", "n", 7, BY)


_EXTREMA_SQL = _SERIES_SQL + """
, x AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY day) - 1 AS i FROM series),
x2 AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY subreddit ORDER BY day) IS NOT DISTINCT FROM n
                      THEN 0 ELSE 1 END AS chg FROM x),
x3 AS (SELECT *, sum(chg) OVER (PARTITION BY subreddit ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM x2),
runs AS (SELECT subreddit, run, min(i) AS s, max(i) AS e, any_value(n) AS v FROM x3 GROUP BY 1, 2),
r2 AS (SELECT *, lag(v) OVER (PARTITION BY subreddit ORDER BY run) AS pv,
              lead(v) OVER (PARTITION BY subreddit ORDER BY run) AS nv FROM runs),
marks AS (SELECT subreddit, CAST(floor((s + e) / 2) AS BIGINT) AS i,
                 CASE WHEN pv < v AND nv < v THEN 1 WHEN pv > v AND nv > v THEN -1 ELSE 0 END AS kind FROM r2),
m AS (SELECT x.subreddit, x.day, x.n, CAST(coalesce(mk.kind, 0) AS INTEGER) AS is_peak,
             CAST(coalesce(mk.kind, 0) = -1 AS INTEGER) AS is_trough
      FROM x LEFT JOIN marks mk ON mk.subreddit = x.subreddit AND mk.i = x.i AND mk.kind <> 0)"""


@register("e10_local_extrema", sql(ORD_CTES, body=_EXTREMA_SQL + "\nSELECT * FROM m"))
def e10_local_extrema(spark, sf_dir):
    return TS.local_extrema(ord_series(spark, sf_dir), "day", "n", BY).select(
        "subreddit", "day", "n", "is_peak", "is_trough")


_AUC_SQL = _EXTREMA_SQL + f"""
, ax AS (SELECT *, sum(CASE WHEN is_peak <> 0 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY subreddit ORDER BY day ROWS UNBOUNDED PRECEDING) AS seg,
                lead(n) OVER w AS nx, lead(day) OVER w AS nt
         FROM m WINDOW w AS (PARTITION BY subreddit ORDER BY day)),
ax2 AS (SELECT *, (n + nx) / 2 * date_diff('second', day, nt) / 86400.0 AS trap FROM ax),
ne AS (SELECT subreddit, sum(CASE WHEN is_peak <> 0 THEN 1 ELSE 0 END) AS ne FROM m GROUP BY 1),
sg AS (SELECT subreddit, seg, min(day) AS start, sum(trap) AS auc FROM ax2 WHERE seg >= 1 GROUP BY 1, 2),
segs AS (SELECT s.subreddit, s.seg, s.start, s2.start AS "end", {sql_r6('s.auc')} AS auc
         FROM sg s JOIN ne ON ne.subreddit = s.subreddit
         JOIN sg s2 ON s2.subreddit = s.subreddit AND s2.seg = s.seg + 1 WHERE s.seg < ne.ne)"""


@register("e12_auc_segments", sql(ORD_CTES, body=_AUC_SQL + "\nSELECT * FROM segs"))
def e12_auc_segments(spark, sf_dir):
    m = TS.local_extrema(ord_series(spark, sf_dir), "day", "n", BY)
    return TS.auc_segments(m, "day", "n", BY)


AUC_HI, AUC_LO = 25.0, 10.0


@register("e13_auc_labels", sql(ORD_CTES, body=_AUC_SQL + f"""
, j AS (SELECT m.subreddit, m.day, s.seg, s.auc FROM m JOIN segs s
        ON s.subreddit = m.subreddit AND m.day >= s.start AND m.day <= s."end"),
spk AS (SELECT subreddit, day, max(CASE WHEN auc > {AUC_HI} THEN seg END) AS sseg,
              max(CASE WHEN auc < {AUC_LO} THEN seg END) AS dseg FROM j GROUP BY 1, 2)
SELECT m.subreddit, m.day, m.n, coalesce(a1.auc, 0.0) AS auc_spike, coalesce(a2.auc, 0.0) AS auc_drop
FROM m LEFT JOIN spk ON spk.subreddit = m.subreddit AND spk.day = m.day
LEFT JOIN segs a1 ON a1.subreddit = m.subreddit AND a1.seg = spk.sseg
LEFT JOIN segs a2 ON a2.subreddit = m.subreddit AND a2.seg = spk.dseg"""))
def e13_auc_labels(spark, sf_dir):
    from threadlens.session import cut_lineage
    s = cut_lineage(ord_series(spark, sf_dir))   # read by three branches
    m = TS.local_extrema(s, "day", "n", BY)
    segs = TS.auc_segments(m, "day", "n", BY)
    return TS.auc_labels(s, segs, "day", AUC_HI, AUC_LO, BY).select(
        "subreddit", "day", "n", "auc_spike", "auc_drop")


@register("e14_zscore", sql(ORD_CTES, body=_SERIES_SQL + f"""
, st AS (SELECT subreddit, avg(n) AS mu, stddev_samp(n) AS sd FROM series GROUP BY 1)
SELECT s.subreddit, s.day, s.n,
       {sql_r6('abs(s.n - st.mu) / CASE WHEN st.sd <> 0 THEN st.sd END')} AS z_n,
       CAST(coalesce(abs(s.n - st.mu) / CASE WHEN st.sd <> 0 THEN st.sd END > 2.0, false) AS INTEGER) AS is_anomaly
FROM series s JOIN st ON st.subreddit = s.subreddit"""))
def e14_zscore(spark, sf_dir):
    return TS.zscore_flags(ord_series(spark, sf_dir), "n", 2.0, BY)


@register("e17_burst_days", sql(ORD_CTES, body=_SERIES_SQL + """
SELECT subreddit, day, n,
       CASE WHEN count(n) OVER w = 7 AND n > avg(n) OVER w + 2.0 * stddev_samp(n) OVER w THEN 1 ELSE 0 END AS is_burst
FROM series WINDOW w AS (PARTITION BY subreddit ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""))
def e17_burst_days(spark, sf_dir):
    return TS.burst_flags(ord_series(spark, sf_dir), "day", "n", 2.0, 7, BY)


# ------------------------------------------------------- event-level (events)
def _ev(spark, sf_dir):
    return forum_from_events(spark, sf_dir)


@register("e15_calendar_features", sql(EV_CTES, body="""
SELECT comment_id, created_utc, dayofweek(created_utc) + 1 AS day_of_week, hour(created_utc) AS hour,
       CAST(dayofweek(created_utc) IN (0, 6) AS INTEGER) AS is_weekend, month(created_utc) AS month,
       quarter(created_utc) AS quarter, CAST(floor((month(created_utc) % 12) / 3) + 1 AS INTEGER) AS season
FROM comments"""))
def e15_calendar_features(spark, sf_dir):
    return TS.calendar_features(_ev(spark, sf_dir).comments.select("comment_id", "created_utc"), "created_utc")


@register("e18_mean_gap", sql(EV_CTES, body=f"""
SELECT author, count(*) AS n,
       {sql_r6("date_diff('microsecond', min(created_utc), max(created_utc)) / 1e6 / (count(*) - 1)")}
         AS mean_gap_seconds
FROM comments GROUP BY author HAVING count(*) >= 2"""))
def e18_mean_gap(spark, sf_dir):
    from threadlens.functions.numeric import r6
    c = _ev(spark, sf_dir).comments
    g = c.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min("created_utc").alias("a"),
                                F.max("created_utc").alias("b")).filter(F.col("n") >= 2)
    # the mean of consecutive gaps telescopes to (last − first)/(n − 1): no per-user ordering
    return g.select("author", "n", r6(F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / F.lit(1e6)
                                      / (F.col("n") - 1)).alias("mean_gap_seconds"))


@register("e19_e20_response_times", sql(EV_CTES, body=f"""
, e AS (SELECT c.post_id, date_diff('microsecond', p.created_utc, c.created_utc) / 1e6 AS elapsed
        FROM comments c JOIN posts p ON c.post_id = p.post_id)
SELECT post_id, count(*) AS n_comments, {sql_r6('avg(elapsed)')} AS mean_response_seconds,
       {sql_r6('avg(CASE WHEN elapsed <= 3600 THEN 1.0 ELSE 0.0 END)')} AS early_share
FROM e GROUP BY post_id"""))
def e19_e20_response_times(spark, sf_dir):
    from threadlens.functions.numeric import r6
    from threadlens.operators.engagement import elapsed_seconds
    f = _ev(spark, sf_dir)
    e = f.comments.select("post_id", "created_utc").join(
        f.posts.select("post_id", F.col("created_utc").alias("post_time")), "post_id")
    e = e.withColumn("elapsed", elapsed_seconds("created_utc", "post_time"))
    return e.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("n_comments"), r6(F.avg("elapsed")).alias("mean_response_seconds"),
        r6(F.avg(F.when(F.col("elapsed") <= 3600, 1.0).otherwise(0.0))).alias("early_share"))


@register("e21_running_mean", sql(EV_CTES, body=f"""
SELECT comment_id, post_id,
       count(*) OVER w AS run_n, {sql_r6('avg(score) OVER w')} AS run_mean
FROM comments WINDOW w AS (PARTITION BY post_id ORDER BY created_utc, comment_id ROWS UNBOUNDED PRECEDING)"""))
def e21_running_mean(spark, sf_dir):
    c = _ev(spark, sf_dir).comments.select("comment_id", "post_id", "created_utc", "score")
    return TS.chunked_running(c, "post_id", "created_utc", "score", "comment_id").select(
        "comment_id", "post_id", "run_n", "run_mean")


@register("e22_score_shift", sql(EV_CTES, body=f"""
, t AS (SELECT post_id, score, ntile(3) OVER (PARTITION BY post_id ORDER BY created_utc, comment_id) AS third
        FROM comments),
a AS (SELECT post_id, avg(CASE WHEN third = 1 THEN score END) AS f, avg(CASE WHEN third = 3 THEN score END) AS l
      FROM t GROUP BY post_id)
SELECT post_id, {sql_r6('f')} AS first_third_mean, {sql_r6('l')} AS last_third_mean,
       {sql_r6('l - f')} AS shift,
       CAST(sign(f - 50.0) <> sign(l - 50.0) AS INTEGER) AS crosses_midpoint
FROM a"""))
def e22_score_shift(spark, sf_dir):
    from threadlens.functions.numeric import r6
    c = _ev(spark, sf_dir).comments.select("comment_id", "post_id", "created_utc", "score")
    r = TS.chunked_running(c, "post_id", "created_utc", "score", "comment_id")
    n = c.groupBy("post_id").agg(F.count(F.lit(1)).alias("N"))
    r = r.join(n, "post_id")
    base, rem = F.floor(F.col("N") / 3), F.col("N") % 3
    big = rem * (base + 1)
    third = F.when(F.col("run_n") <= big, F.floor((F.col("run_n") - 1) / (base + 1)) + 1).otherwise(
        rem + F.floor((F.col("run_n") - big - 1) / base) + 1)
    a = r.withColumn("third", third).groupBy("post_id").agg(
        F.avg(F.when(F.col("third") == 1, F.col("score"))).alias("f"),
        F.avg(F.when(F.col("third") == 3, F.col("score"))).alias("l"))
    return a.select("post_id", r6("f").alias("first_third_mean"), r6("l").alias("last_third_mean"),
                    r6(F.col("l") - F.col("f")).alias("shift"),
                    (F.signum(F.col("f") - 50.0) != F.signum(F.col("l") - 50.0)).cast("int")
                    .alias("crosses_midpoint"))


@register("e23_behaviour_timeline", sql(EV_CTES, body="""
, d AS (SELECT author, date_trunc('day', created_utc) AS day, count(*) AS n FROM comments GROUP BY 1, 2)
SELECT author, day, n, n - lag(n) OVER (PARTITION BY author ORDER BY day) AS change FROM d"""))
def e23_behaviour_timeline(spark, sf_dir):
    from pyspark.sql import Window
    d = TS.bucket_counts(_ev(spark, sf_dir).comments, "created_utc", "1D", "author").withColumnRenamed(
        "bucket", "day")
    w = Window.partitionBy("author").orderBy("day")
    return d.withColumn("change", F.col("n") - F.lag("n").over(w))


@register("e24_max_actions_60s", sql(EV_CTES, body="""
, t AS (SELECT author, epoch_us(created_utc) AS t FROM comments)
SELECT author, max(c) AS max_actions_per_window FROM (
  SELECT author, count(*) OVER (PARTITION BY author ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS c
  FROM t) GROUP BY author"""))
def e24_max_actions_60s(spark, sf_dir):
    return TS.max_in_lookback(_ev(spark, sf_dir).comments, "author", "created_utc", 60)


@register("e25_decayed_weights", sql(EV_CTES, body=f"""
, m AS (SELECT max(created_utc) AS asof FROM comments)
SELECT author, {sql_r6("sum(score * pow(0.5, date_diff('microsecond', created_utc, m.asof) / 1e6 / 86400.0 / 7.0))")}
         AS decayed_score
FROM comments, m GROUP BY author"""))
def e25_decayed_weights(spark, sf_dir):
    from threadlens.functions.numeric import r6
    c = _ev(spark, sf_dir).comments
    asof = c.agg(F.max("created_utc")).first()[0]
    age = (F.timestamp_diff("MICROSECOND", F.col("created_utc"), F.lit(asof).cast("timestamp_ntz"))
           / F.lit(1e6) / F.lit(86400.0))
    return c.groupBy("author").agg(
        r6(F.sum(F.col("score") * F.pow(F.lit(0.5), age / F.lit(7.0)))).alias("decayed_score"))


@register("e26_sessions", sql(EV_CTES, body="""
, g AS (SELECT author, created_utc,
               CASE WHEN created_utc - lag(created_utc) OVER (PARTITION BY author ORDER BY created_utc)
                         < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM comments),
s AS (SELECT *, sum(st) OVER (PARTITION BY author ORDER BY created_utc ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT author, min(created_utc) AS session_start, max(created_utc) AS session_end, count(*) AS n
FROM s GROUP BY author, sid"""))
def e26_sessions(spark, sf_dir):
    return TS.sessions(_ev(spark, sf_dir).comments, "author", "created_utc", 30, "comment_id")


@register("e27_equal_count_windows", sql(EV_CTES, body="""
, r AS (SELECT post_id, created_utc,
               floor((row_number() OVER (PARTITION BY post_id ORDER BY created_utc, comment_id) - 1) / 25) AS window_id
        FROM comments)
SELECT post_id, CAST(window_id AS BIGINT) AS window_id, count(*) AS n_events,
       min(created_utc) AS window_start, max(created_utc) AS window_end
FROM r GROUP BY post_id, window_id"""))
def e27_equal_count_windows(spark, sf_dir):
    c = _ev(spark, sf_dir).comments
    return TS.equal_count_windows(c, "post_id", "created_utc", 25, "comment_id")


@register("e2_sliding_counts", sql(EV_CTES, body="""
, w AS (SELECT src_type, time_bucket(INTERVAL 15 MINUTE, created_utc) - INTERVAL (k * 15) MINUTE AS window_start
        FROM comments, range(0, 4) t(k))
SELECT src_type, window_start, count(*) AS n FROM w GROUP BY 1, 2"""))
def e2_sliding_counts(spark, sf_dir):
    c = _ev(spark, sf_dir).comments
    return (c.groupBy("src_type", F.window("created_utc", "1 hour", "15 minutes").start.alias("window_start"))
            .agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------- D7, D8, E1
@register("d7_hourly_zero_filled", sql(EV_CTES, body="""
, c AS (SELECT time_bucket(INTERVAL 1 HOUR, created_utc) AS bucket, count(*) AS n FROM comments GROUP BY 1),
sp AS (SELECT CAST(g AS TIMESTAMP) AS bucket FROM (SELECT min(bucket) a, max(bucket) b FROM c),
       generate_series(a, b, INTERVAL 1 HOUR) t(g))
SELECT sp.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM sp LEFT JOIN c ON c.bucket = sp.bucket"""))
def d7_hourly_zero_filled(spark, sf_dir):
    return TS.zero_filled_counts(_ev(spark, sf_dir).comments, "created_utc", "1h")


@register("d7_post_comment_series", sql(EV_CTES, body="""
, c AS (SELECT post_id, time_bucket(INTERVAL 1 HOUR, created_utc) AS bucket, count(*) AS n FROM comments GROUP BY 1, 2),
r AS (SELECT post_id, min(bucket) a, max(bucket) b FROM c GROUP BY 1),
sp AS (SELECT post_id, CAST(unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS TIMESTAMP) AS bucket FROM r)
SELECT sp.post_id, sp.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM sp LEFT JOIN c ON c.post_id = sp.post_id AND c.bucket = sp.bucket"""))
def d7_post_comment_series(spark, sf_dir):
    return TS.keyed_zero_filled_counts(_ev(spark, sf_dir).comments, "post_id", "created_utc", "1h")


@register("d7_weekly_zero_filled", sql(ORD_CTES, body="""
, c AS (SELECT CAST(CAST(created_utc AS DATE) + CAST((7 - isodow(created_utc)) % 7 AS INTEGER) AS TIMESTAMP) AS bucket,
               count(*) AS n FROM posts GROUP BY 1),
sp AS (SELECT CAST(g AS TIMESTAMP) AS bucket FROM (SELECT min(bucket) a, max(bucket) b FROM c),
       generate_series(a, b, INTERVAL 7 DAY) t(g))
SELECT sp.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM sp LEFT JOIN c ON c.bucket = sp.bucket"""))
def d7_weekly_zero_filled(spark, sf_dir):
    return TS.zero_filled_counts(forum_from_orders(spark, sf_dir).posts, "created_utc", "W")


@register("d7_monthly_zero_filled", sql(ORD_CTES, body="""
, c AS (SELECT CAST(last_day(CAST(created_utc AS DATE)) AS TIMESTAMP) AS bucket, count(*) AS n FROM posts GROUP BY 1),
r AS (SELECT min(bucket) a, max(bucket) b FROM c),
sp AS (SELECT CAST(last_day(CAST(a AS DATE) + to_months(CAST(i AS INTEGER))) AS TIMESTAMP) AS bucket
       FROM r, range(0, (year(b) - year(a)) * 12 + month(b) - month(a) + 1) t(i))
SELECT sp.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM sp LEFT JOIN c ON c.bucket = sp.bucket"""))
def d7_monthly_zero_filled(spark, sf_dir):
    return TS.zero_filled_counts(forum_from_orders(spark, sf_dir).posts, "created_utc", "M")


@register("d8_week_community_counts", sql(ORD_CTES, body="""
SELECT CAST(CAST(created_utc AS DATE) + CAST((7 - isodow(created_utc)) % 7 AS INTEGER) AS TIMESTAMP) AS bucket,
       subreddit, count(*) AS n FROM posts GROUP BY 1, 2"""))
def d8_week_community_counts(spark, sf_dir):
    return TS.bucket_counts(forum_from_orders(spark, sf_dir).posts, "created_utc", "W", "subreddit")


@register("e1_five_minute_counts", sql(EV_CTES, body="""
SELECT time_bucket(INTERVAL 5 MINUTE, created_utc) AS bucket, src_type, count(*) AS n FROM comments GROUP BY 1, 2"""))
def e1_five_minute_counts(spark, sf_dir):
    return TS.bucket_counts(_ev(spark, sf_dir).comments, "created_utc", "5min", "src_type")


@register("e11_extrema_with_distance")
def e11_extrema_with_distance(spark, sf_dir):
    m = TS.local_extrema(ord_series(spark, sf_dir), "day", "n", BY)
    return TS.extrema_with_distance(m, "day", "n", BY, 7).select("subreddit", "day", "n", "is_peak",
                                                                 "is_peak_distance")


@register("e22_sentiment_thirds", sql(EV_CTES, TEXT_CTES, body=", " + sentiment_sql(
    "SELECT comment_id, body FROM comments_t", "comment_id", "body") + f"""
, t AS (SELECT c.post_id, s.compound, ntile(3) OVER (PARTITION BY c.post_id ORDER BY c.created_utc, c.comment_id) AS third
        FROM comments c JOIN sent s ON s.comment_id = c.comment_id),
a AS (SELECT post_id, avg(CASE WHEN third = 1 THEN compound END) AS f, avg(CASE WHEN third = 3 THEN compound END) AS l
      FROM t GROUP BY post_id)
SELECT post_id, {sql_r6('f')} AS first_third_mean, {sql_r6('l')} AS last_third_mean, {sql_r6('l - f')} AS shift,
       CAST(sign(f) <> sign(l) AS INTEGER) AS crosses_middle FROM a"""))
def e22_sentiment_thirds(spark, sf_dir):
    from threadlens.plans.q_text import scored_comments
    c = scored_comments(spark, sf_dir).select("comment_id", "post_id", "created_utc", "compound")
    return TS.shift_between_thirds(c, "post_id", "created_utc", "compound", "comment_id")


@register("e17_sentiment_bursts", sql(EV_CTES, TEXT_CTES, body=", " + sentiment_sql(
    "SELECT comment_id, body FROM comments_t", "comment_id", "body") + f"""
, d AS (SELECT c.src_type, date_trunc('day', c.created_utc) AS day, {sql_r6('avg(abs(s.compound))')} AS strength
        FROM comments c JOIN sent s ON s.comment_id = c.comment_id GROUP BY 1, 2)
SELECT src_type, CAST(day AS TIMESTAMP) AS day, strength,
       CASE WHEN count(strength) OVER w = 7 AND strength > avg(strength) OVER w + 1.0 * stddev_samp(strength) OVER w
            THEN 1 ELSE 0 END AS is_burst
FROM d WINDOW w AS (PARTITION BY src_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""))
def e17_sentiment_bursts(spark, sf_dir):
    """Days on which the strength of a community's sentiment stands out from the seven before."""
    from threadlens.functions.numeric import r6
    c = with_compound(forum_with_text(spark, sf_dir).comments, "body")
    d = c.groupBy("src_type", F.date_trunc("day", "created_utc").cast("timestamp_ntz").alias("day")).agg(
        r6(F.avg(F.abs("compound"))).alias("strength"))
    return TS.burst_flags(d, "day", "strength", 1.0, 7, ["src_type"])
