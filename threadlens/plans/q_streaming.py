"""Registered streaming queries (A4, A11, L1–L8): each lands the events table as
JSON files, runs the stream to completion (``availableNow``) and returns the
sink table; the oracle is the batch SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.numeric import r6, sql_r6
from threadlens.plans.catalog import EV_CTES, register, sql
from threadlens.session import scratch_path
from threadlens.sources.roles import forum_from_events, read_table, thread_key
from threadlens.streaming import jobs as S

SCHEMA = "event_id long, ts string, user_id long, event_type string, value double, k long"
ARRIVALS = 3                # times at which ordered events land, a restart of the stream each
ROWS_PER_FILE = 250_000
COUNTS = "window_start timestamp, event_type string, n long"
FIRST_SEEN = "user_id long, first_seen timestamp"


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value",
                                                      thread_key().alias("k"))


def _files(rows: int) -> int:
    return max(6, -(-rows // ROWS_PER_FILE))


def _land(spark, sf_dir, with_dups=False):
    """The events as JSON files in no order."""
    e = _events(spark, sf_dir)
    if with_dups:  # the same records collected twice (identical rows)
        e = e.unionByName(e.filter(F.col("event_type") == "click"))
    path = scratch_path(spark, "landing")
    S.land_json(e, path, _files(e.count()))
    return path


def _stream(spark, landing, max_files=2):
    return S.read_landing(spark, landing, SCHEMA, "ts", max_files=max_files)


def _in_arrivals(spark, sf_dir, run):
    """Lands the events in spans of time, one after the other, and calls ``run(stream)`` after each:
    the query is started anew and goes on from its checkpoint."""
    e = _events(spark, sf_dir)
    first, last, rows = e.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    land = scratch_path(spark, "landing")
    for i in range(ARRIVALS):
        lo, hi = (first + (last - first) * j / ARRIVALS for j in (i, i + 1))
        part = e.filter((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) if i < ARRIVALS - 1 else F.lit(True)))
        S.land_json(part, f"{land}/{i}", _files(rows // ARRIVALS))
        run(_stream(spark, f"{land}/*", None))


def _ntz(df, cols):
    return S.to_ntz(df, cols)


@register("l1_stream_insert_if_absent", """
SELECT DISTINCT event_id, ts, user_id, event_type, value FROM events""")
def l1_stream_insert_if_absent(spark, sf_dir):
    land = _land(spark, sf_dir, with_dups=True)
    target = scratch_path(spark, "l1-target")
    S.stream_insert_if_absent(_stream(spark, land).drop("k"), target, ["event_id"], "ts",
                              scratch_path(spark, "l1-ckpt"), order=["ts"])
    return _ntz(spark.read.parquet(target), ["ts"])


@register("l2_stream_tumbling_counts", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def l2_stream_tumbling_counts(spark, sf_dir):
    out, ckpt = scratch_path(spark, "l2-out"), scratch_path(spark, "l2-ckpt")
    _in_arrivals(spark, sf_dir, lambda s: S.stream_window_counts(s, "ts", "event_type", "5 minutes", None, out, ckpt))
    return _ntz(S.read_latest(spark, out, ["window_start", "event_type"], COUNTS), ["window_start"])


@register("l3_stream_sliding_counts", """
SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (k * 15) MINUTE AS window_start, event_type, count(*) AS n
FROM events, range(0, 4) t(k) GROUP BY 1, 2""")
def l3_stream_sliding_counts(spark, sf_dir):
    out, ckpt = scratch_path(spark, "l3-out"), scratch_path(spark, "l3-ckpt")
    _in_arrivals(spark, sf_dir,
                 lambda s: S.stream_window_counts(s, "ts", "event_type", "1 hour", "15 minutes", out, ckpt))
    return _ntz(S.read_latest(spark, out, ["window_start", "event_type"], COUNTS), ["window_start"])


@register("l4_stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                      < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def l4_stream_sessions(spark, sf_dir):
    """Closed sessions from the sink, those still open from the state."""
    out, ckpt = scratch_path(spark, "l4-out"), scratch_path(spark, "l4-ckpt")
    _in_arrivals(spark, sf_dir, lambda s: S.stream_sessions(s, "ts", "user_id", "30 minutes", out, ckpt))
    closed = spark.read.parquet(out).drop("batch_id")
    return _ntz(closed.unionByName(S.open_sessions(spark, ckpt, "user_id")), ["session_start", "session_end"])


@register("l5_stream_static_join", sql(EV_CTES, body="""
SELECT e.event_id, e.k AS post_id, p.subreddit FROM ev e JOIN posts p ON p.post_id = e.k"""))
def l5_stream_static_join(spark, sf_dir):
    posts = forum_from_events(spark, sf_dir).posts.select(F.col("post_id").alias("k"), "subreddit")
    out = scratch_path(spark, "l5-out")
    s = _stream(spark, _land(spark, sf_dir)).select("event_id", "k")
    S.stream_static_join(s, posts, "k", out, scratch_path(spark, "l5-ckpt"))
    return spark.read.parquet(out).select("event_id", F.col("k").alias("post_id"), "subreddit")


@register("l6_stream_alerts", f"""
WITH c AS (SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2),
closed AS (SELECT * FROM c WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)),
h AS (SELECT *, count(*) OVER w AS known, coalesce(avg(n) OVER w, 0) AS mean, coalesce(stddev_samp(n) OVER w, 0) AS std
      FROM closed WINDOW w AS (PARTITION BY key ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, window_start, n, {sql_r6('mean')} AS mean, {sql_r6('std')} AS std,
       CAST(known >= 6 AND n > mean + 2 * std + 1e-9 AS INTEGER) AS alert FROM h""")
def l6_stream_alerts(spark, sf_dir):
    out, ckpt = scratch_path(spark, "l6-out"), scratch_path(spark, "l6-ckpt")
    _in_arrivals(spark, sf_dir, lambda s: S.stream_alerts(s, "ts", "event_type", "1 hour", out, ckpt))
    told = _ntz(spark.read.parquet(out).drop("batch_id"), ["window_start"])
    return told.withColumn("mean", r6("mean")).withColumn("std", r6("std"))


@register("l7_new_users_per_day", """
SELECT date_trunc('day', first_seen) AS window_start, count(*) AS new_users
FROM (SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id) GROUP BY 1""")
def l7_new_users_per_day(spark, sf_dir):
    out = scratch_path(spark, "l7-out")
    S.stream_first_seen(_stream(spark, _land(spark, sf_dir)), "ts", "user_id", out, scratch_path(spark, "l7-ckpt"))
    return _ntz(S.new_users_per_window(S.read_latest(spark, out, ["user_id"], FIRST_SEEN)), ["window_start"])


@register("l7_stream_first_seen", """
SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id""")
def l7_stream_first_seen(spark, sf_dir):
    out = scratch_path(spark, "l7-out")
    S.stream_first_seen(_stream(spark, _land(spark, sf_dir)), "ts", "user_id", out, scratch_path(spark, "l7-ckpt"))
    return _ntz(S.read_latest(spark, out, ["user_id"], FIRST_SEEN), ["first_seen"])


@register("l8_stream_daily_refresh", """
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, count(*) AS n, round(sum(value), 4) AS total_value FROM events GROUP BY 1""")
def l8_stream_daily_refresh(spark, sf_dir):
    table = scratch_path(spark, "l8-table")
    S.stream_daily_refresh(_stream(spark, _land(spark, sf_dir)), "ts", table, scratch_path(spark, "l8-ckpt"))
    t = spark.read.parquet(table)
    return t.select(F.col("day").cast("timestamp_ntz").alias("day"), "n", F.round("total_value", 4).alias("total_value"))
