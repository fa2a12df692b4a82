"""Registered ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.predicates import content
from threadlens.operators.engagement import daily_engagement, keep_first
from threadlens.plans.catalog import EV_CTES, FLAG_CTES, ORD_CTES, REPLY_CTES, TEXT_CTES, register, sql
from threadlens.session import scratch_path
from threadlens.sources import ingest as I
from threadlens.sources.lists import DATA_DIR, community_list, flagged_users
from threadlens.sources.roles import (flagged_interactions, forum_from_events, forum_from_orders,
                                      forum_with_text, read_table, replies)

def epoch_col():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _raw_posts(spark, sf_dir):
    """API-shaped post records from events (epoch seconds, deleted authors on errors)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("subreddit"),
                    F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("author"),
                    F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("selftext"),
                    F.lit(None).cast("string").alias("url"),
                    (F.timestamp_diff("MICROSECOND", epoch_col(), F.col("ts")) / F.lit(1e6)).alias("created_utc"),
                    F.col("value").alias("score"), F.lit(0).alias("num_comments"),
                    F.get_json_object("props", "$.k").alias("link_flair_text"))


@register("a5_post_record_mapping", """
SELECT CAST(event_id AS VARCHAR) AS post_id, event_type AS subreddit,
       coalesce(CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END, 'None') AS author,
       CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS self_text, CAST(NULL AS VARCHAR) AS url,
       make_timestamp(CAST(round(epoch_us(ts) / 1e6 * 1e6) AS BIGINT)) AS created_utc,
       CAST(trunc(value) AS BIGINT) AS score, CAST(0 AS BIGINT) AS num_comments,
       json_extract_string(props, '$.k') AS flair
FROM events""")
def a5_post_record_mapping(spark, sf_dir):
    raw = _raw_posts(spark, sf_dir)
    out = I.map_posts(raw.withColumn("created_utc", F.round(F.col("created_utc") * 1e6) / 1e6))
    return out


@register("a6_reply_tree", sql(REPLY_CTES, body="""
, tree AS (SELECT 1)
SELECT * FROM (WITH RECURSIVE t(msg_id, root_id, depth) AS (
  SELECT msg_id, msg_id, 0 FROM replies WHERE parent_msg_id IS NULL
  UNION ALL
  SELECT r.msg_id, t.root_id, t.depth + 1 FROM replies r JOIN t ON r.parent_msg_id = t.msg_id)
SELECT msg_id, root_id, depth FROM t)"""))
def a6_reply_tree(spark, sf_dir):
    return I.reply_tree(spark, replies(spark, sf_dir))


_A9_BATCH = """
, tgt AS (SELECT comment_id FROM comments WHERE created_utc < TIMESTAMP '2024-01-15'),
batch AS (SELECT comment_id, score, 0 AS arrival FROM comments WHERE created_utc >= TIMESTAMP '2024-01-10'
          UNION ALL
          SELECT comment_id, score + 1, 1 FROM comments WHERE created_utc >= TIMESTAMP '2024-01-10'),
firsts AS (SELECT comment_id, arg_min(score, arrival) AS score, min(arrival) AS arrival FROM batch GROUP BY comment_id)"""


@register("a9_insert_if_absent", sql(EV_CTES, body=_A9_BATCH + """
SELECT * FROM firsts WHERE comment_id NOT IN (SELECT comment_id FROM tgt)"""))
def a9_insert_if_absent(spark, sf_dir):
    c = forum_from_events(spark, sf_dir).comments
    tgt = c.filter(F.col("created_utc") < F.lit("2024-01-15").cast("timestamp_ntz")).select("comment_id")
    b = c.filter(F.col("created_utc") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    batch = (b.select("comment_id", "score", F.lit(0).alias("arrival"))
             .unionByName(b.select("comment_id", (F.col("score") + 1).alias("score"), F.lit(1).alias("arrival"))))
    return I.insert_if_absent(tgt, batch, ["comment_id"], ["arrival"])


_JSON = DATA_DIR


@register("a10_unified_user_activity", sql(EV_CTES, TEXT_CTES, body=f"""
, users AS (SELECT unnest(manual) AS username FROM read_json_auto('{_JSON}/flagged_users.json')),
comms AS (SELECT unnest(subreddits) AS community FROM read_json_auto('{_JSON}/target_subreddits.json'))
SELECT author AS username, 'post' AS interaction_type, subreddit, created_utc,
       md5(coalesce(title, '') || ' ' || '') AS content_md5, post_id, CAST(NULL AS VARCHAR) AS parent_id, score
FROM posts_t WHERE author IN (SELECT username FROM users) AND subreddit IN (SELECT community FROM comms)
UNION ALL
SELECT c.author, 'comment', p.subreddit, c.created_utc, md5(coalesce(c.body, '')), c.post_id, c.parent_id, c.score
FROM comments_t c JOIN posts p ON p.post_id = c.post_id
WHERE c.author IN (SELECT username FROM users) AND p.subreddit IN (SELECT community FROM comms)"""))
def a10_unified_user_activity(spark, sf_dir):
    f = forum_with_text(spark, sf_dir)
    users = flagged_users(spark).filter(F.col("tier") == "manual").select("username")
    comms = community_list(spark).withColumnRenamed("community", "subreddit")
    p = (f.posts.join(users.withColumnRenamed("username", "author"), "author", "left_semi")
         .join(comms, "subreddit", "left_semi")
         .select(F.col("author").alias("username"), F.lit("post").alias("interaction_type"), "subreddit",
                 "created_utc", F.md5(content("title", "self_text")).alias("content_md5"), "post_id",
                 F.lit(None).cast("string").alias("parent_id"), "score"))
    c = (f.comments.join(users.withColumnRenamed("username", "author"), "author", "left_semi")
         .join(f.posts.select("post_id", "subreddit").join(comms, "subreddit", "left_semi"), "post_id")
         .select(F.col("author").alias("username"), F.lit("comment").alias("interaction_type"), "subreddit",
                 "created_utc", F.md5(F.coalesce("body", F.lit(""))).alias("content_md5"), "post_id",
                 "parent_id", "score"))
    return p.unionByName(c)


@register("a13_assign_ids", sql(EV_CTES, FLAG_CTES, body="""
, d AS (SELECT * FROM flagged WHERE id IN (
    SELECT min(id) FROM flagged GROUP BY username, subreddit, post_id, created_utc, interaction_type))
SELECT row_number() OVER (ORDER BY created_utc, username, post_id, interaction_type) AS id,
       username, interaction_type, subreddit, post_id, created_utc
FROM d"""))
def a13_assign_ids(spark, sf_dir):
    cols = ["id", "username", "interaction_type", "subreddit", "post_id", "parent_id", "created_utc", "score"]
    d = keep_first(flagged_interactions(spark, sf_dir).select(*cols)).drop("id")
    out = I.assign_ids(d.select("username", "interaction_type", "subreddit", "post_id", "created_utc"),
                       ["created_utc", "username", "post_id", "interaction_type"])
    return out


@register("a14_csv_roundtrip", sql(ORD_CTES, body="""
SELECT subreddit, count(*) AS n_posts, sum(score) AS total_score FROM posts GROUP BY subreddit"""))
def a14_csv_roundtrip(spark, sf_dir):
    p = forum_from_orders(spark, sf_dir).posts
    t = p.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("score").alias("total_score"))
    path = scratch_path(spark, "csv-export")
    I.write_csv(t, path)
    return I.read_csv(spark, path, "subreddit string, n_posts bigint, total_score double")


@register("a2_community_filter", sql(ORD_CTES, body=f"""
, comms AS (SELECT unnest(subreddits) AS community FROM read_json_auto('{_JSON}/target_subreddits.json'))
SELECT subreddit, count(*) AS n_posts FROM posts WHERE subreddit IN (SELECT community FROM comms) GROUP BY 1"""))
def a2_community_filter(spark, sf_dir):
    from threadlens.functions.predicates import in_communities
    p = forum_from_orders(spark, sf_dir).posts
    return (in_communities(p, "subreddit", community_list(spark)).groupBy("subreddit")
            .agg(F.count(F.lit(1)).alias("n_posts")))


@register("h9_id_normalise", sql(EV_CTES, body="""
SELECT comment_id, regexp_replace('t3_' || CAST(post_id AS VARCHAR), '^t[0-9]_', '') AS link_id,
       CASE WHEN substr('t3_' || CAST(post_id AS VARCHAR), 1, 3) = 't3_' THEN 'post' END AS parent_kind
FROM comments"""))
def h9_id_normalise(spark, sf_dir):
    c = forum_from_events(spark, sf_dir).comments.withColumn(
        "_full", F.concat(F.lit("t3_"), F.col("post_id").cast("string")))
    return c.select("comment_id", I.normalize_id("_full").alias("link_id"), I.id_kind("_full").alias("parent_kind"))


@register("d19_new_returning_users", sql(EV_CTES, body="""
, acts AS (SELECT author AS u, date_trunc('day', created_utc) AS day FROM posts
           UNION ALL SELECT author, date_trunc('day', created_utc) FROM comments),
a AS (SELECT day, count(DISTINCT u) AS active_users FROM acts GROUP BY day),
n AS (SELECT day, count(*) AS new_users FROM (SELECT u, min(day) AS day FROM acts GROUP BY u) GROUP BY day)
SELECT a.day, a.active_users, CAST(coalesce(n.new_users, 0) AS BIGINT) AS new_users,
       CAST(a.active_users - coalesce(n.new_users, 0) AS BIGINT) AS returning_users
FROM a LEFT JOIN n ON n.day = a.day"""))
def d19_new_returning_users(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    d = daily_engagement(f.posts, f.comments)
    return d.filter(F.col("active_users") > 0).select("day", "active_users", "new_users", "returning_users")


@register("a15_event_days", sql(ORD_CTES, body="""
, days AS (SELECT date_trunc('day', created_utc) AS day, count(*) AS n FROM posts GROUP BY 1),
cal AS (SELECT DISTINCT CAST(created_utc AS DATE) AS date FROM posts WHERE day(created_utc) IN (1, 15))
SELECT CAST(d.day AS TIMESTAMP) AS day, d.n, CAST(c.date IS NOT NULL AS INTEGER) AS is_event
FROM days d LEFT JOIN cal c ON c.date = CAST(d.day AS DATE)"""))
def a15_event_days(spark, sf_dir):
    """A calendar of paydays is written as CSV, read as an external source and flagged on the days."""
    p = forum_from_orders(spark, sf_dir).posts
    path = scratch_path(spark, "calendar")
    dates = p.select(F.to_date("created_utc").alias("date")).where("day(date) in (1, 15)").distinct()
    I.write_csv(dates.withColumn("name", F.lit("payday")).unionByName(
        dates.where("month(date) = 1").withColumn("name", F.lit("January"))), path)
    days = p.groupBy(F.date_trunc("day", "created_utc").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return I.flag_event_days(days, I.external_events(spark, path))
