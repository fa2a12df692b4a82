"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.numeric import sql_r6
from threadlens.functions.sentiment import sentiment_sql, with_compound
from threadlens.operators import reports as R
from threadlens.operators import timeseries as TS
from threadlens.operators.engagement import load_posts, top_n
from threadlens.plans.catalog import (EV_CTES, ORD_COMMUNITIES, ORD_CTES, ORD_END, ORD_START, TEXT_CTES,
                                      register, sql)
from threadlens.plans.q_engagement import ORD_POSTS_SQL
from threadlens.sources.roles import forum_from_events, forum_from_orders, forum_with_text

_S = sentiment_sql("SELECT comment_id, body FROM comments_t", "comment_id", "body")

_TIMELINE_SQL = f"""
, x AS (SELECT date_trunc('day', c.created_utc) AS day, s.compound FROM comments c JOIN sent s
        ON s.comment_id = c.comment_id),
g AS (SELECT day, count(*) AS volume, avg(compound) AS a FROM x GROUP BY 1),
sp AS (SELECT CAST(t AS TIMESTAMP) AS day FROM (SELECT min(day) lo, max(day) hi FROM g),
       generate_series(lo, hi, INTERVAL 1 DAY) u(t)),
tl0 AS (SELECT sp.day, CAST(coalesce(g.volume, 0) AS BIGINT) AS volume,
               {sql_r6('coalesce(g.a, 0.0)')} AS avg_sentiment FROM sp LEFT JOIN g ON g.day = sp.day),
tl AS (SELECT *, CASE WHEN count(volume) OVER w = 7 AND volume > avg(volume) OVER w + 2.0 * stddev_samp(volume) OVER w
                      THEN 1 ELSE 0 END AS is_spike
       FROM tl0 WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"""


def _timeline(spark, sf_dir):
    c = with_compound(forum_with_text(spark, sf_dir).comments, "body")
    return R.daily_timeline(c)


@register("n4_daily_timeline", sql(EV_CTES, TEXT_CTES, body=", " + _S + _TIMELINE_SQL + "\nSELECT * FROM tl"))
def n4_daily_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


_SWARM_SQL = f"""
, cells AS (SELECT post_id, time_bucket(INTERVAL 1 HOUR, created_utc) AS hour, count(*) AS n_comments,
                   count(DISTINCT author) AS n_users FROM comments GROUP BY 1, 2),
r AS (SELECT post_id, min(hour) a, max(hour) b FROM cells GROUP BY 1),
sp AS (SELECT post_id, CAST(unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour FROM r),
ser AS (SELECT sp.post_id, coalesce(c.n_comments, 0) AS n FROM sp LEFT JOIN cells c
        ON c.post_id = sp.post_id AND c.hour = sp.hour),
st AS (SELECT post_id, avg(n) AS mu, stddev_samp(n) AS sd FROM ser GROUP BY 1)
SELECT c.hour, c.post_id, c.n_comments, c.n_users, {sql_r6('c.n_comments / c.n_users')} AS comments_per_user,
       {sql_r6('st.mu')} AS baseline_mean, {sql_r6('st.sd')} AS baseline_std
FROM cells c JOIN st ON st.post_id = c.post_id
WHERE c.n_comments > st.mu + 3.0 * st.sd AND c.n_users >= 3"""


@register("n3_swarm_alerts", sql(EV_CTES, body=_SWARM_SQL))
def n3_swarm_alerts(spark, sf_dir):
    return R.swarm_alerts(forum_from_events(spark, sf_dir).comments, 3, 3.0)


@register("n2_insight_rows", sql(EV_CTES, TEXT_CTES, body=", " + _S + _TIMELINE_SQL + """
, pe AS (SELECT p.post_id, count(c.post_id) AS n FROM posts p LEFT JOIN comments c ON c.post_id = p.post_id GROUP BY 1),
tp AS (SELECT post_id FROM (SELECT *, row_number() OVER (ORDER BY n DESC, post_id) AS r FROM pe)
       WHERE r <= CAST(ceil(0.3 * (SELECT count(*) FROM pe)) AS BIGINT)),
ov AS (SELECT author, count(DISTINCT post_id) AS top_posts FROM comments WHERE post_id IN (SELECT post_id FROM tp)
       GROUP BY author HAVING count(DISTINCT post_id) >= 20)
SELECT 'user overlap spike in top posts' AS rule, author AS entity, CAST(NULL AS TIMESTAMP) AS bucket,
       CAST(top_posts AS DOUBLE) AS value, 20.0 AS threshold FROM ov
UNION ALL
SELECT 'volume spike or negative sentiment day', 'all', day, avg_sentiment, -0.05 FROM tl
WHERE is_spike = 1 OR avg_sentiment <= -0.05"""))
def n2_insight_rows(spark, sf_dir):
    from threadlens.operators.graph import top_fraction_posts
    f = forum_from_events(spark, sf_dir)
    c = f.comments.join(top_fraction_posts(f, 0.3).select("post_id"), "post_id", "left_semi")
    ov = c.groupBy("author").agg(F.countDistinct("post_id").alias("top_posts")).filter(F.col("top_posts") >= 20)
    return R.insight_rows(ov, _timeline(spark, sf_dir), 20)


@register("n5_post_table", sql(ORD_CTES, body=f"""
SELECT post_id, author, score, created_utc, subreddit, CAST(NULL AS VARCHAR) AS title FROM ({ORD_POSTS_SQL})"""))
def n5_post_table(spark, sf_dir):
    f = forum_from_orders(spark, sf_dir)
    return load_posts(f, ORD_START, ORD_END, ORD_COMMUNITIES,
                      cols=("post_id", "author", "score", "created_utc", "subreddit", "title"))


@register("b14_single_thread_series", sql(EV_CTES, body="""
, top AS (SELECT post_id FROM comments GROUP BY post_id ORDER BY count(*) DESC, post_id LIMIT 1),
c AS (SELECT time_bucket(INTERVAL 1 MINUTE, created_utc) AS bucket, count(*) AS n FROM comments
      WHERE post_id = (SELECT post_id FROM top) GROUP BY 1),
sp AS (SELECT CAST(g AS TIMESTAMP) AS bucket FROM (SELECT min(bucket) a, max(bucket) b FROM c),
       generate_series(a, b, INTERVAL 1 MINUTE) t(g))
SELECT sp.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM sp LEFT JOIN c ON c.bucket = sp.bucket"""))
def b14_single_thread_series(spark, sf_dir):
    c = forum_from_events(spark, sf_dir).comments
    top = top_n(c.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")), "n", 1, "post_id").first()["post_id"]
    return TS.zero_filled_counts(c.filter(F.col("post_id") == F.lit(top)), "created_utc", "1min")
