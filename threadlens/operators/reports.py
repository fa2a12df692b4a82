"""Detection reports (inventory N2–N6, D29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.numeric import r6
from threadlens.operators import timeseries as TS


def daily_timeline(comments_scored: DataFrame, k: float = 2.0, n: int = 7) -> DataFrame:
    """One row per day — volume, mean sentiment (0 when none) and a spike
    flag (volume above mean + k·std of the previous n days)."""
    s = TS.slot_sentiment(comments_scored, "created_utc", "1D", "compound", "volume")
    return TS.burst_flags(s.withColumnRenamed("bucket", "day"), "day", "volume", k, n).withColumnRenamed(
        "is_burst", "is_spike")


def swarm_alerts(comments: DataFrame, min_users: int = 5, k: float = 3.0) -> DataFrame:
    """N3 + D29: (hour, thread) cells whose comment count exceeds the thread's
    hourly mean + k·std and that involve at least ``min_users`` distinct users;
    reported with their density (users, comments, comments per user).
    The thread's mean and deviation are over all hours from its first to its last one, empty
    hours as 0; counts, sums and sums of squares of the other hours are enough for that."""
    cells = (comments.groupBy("post_id", F.window("created_utc", "1 hour").start.alias("hour"))
             .agg(F.count(F.lit(1)).alias("n_comments"), F.countDistinct("author").alias("n_users")))
    hours = (F.timestamp_diff("HOUR", F.min("hour"), F.max("hour")) + 1).cast("double")
    st = cells.groupBy("post_id").agg(hours.alias("h"), F.sum("n_comments").cast("double").alias("s1"),
                                      F.sum(F.col("n_comments") * F.col("n_comments")).cast("double").alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("h")) / F.when(F.col("h") > 1, F.col("h") - 1)
    st = st.select("post_id", (F.col("s1") / F.col("h")).alias("mu"), F.sqrt(F.greatest(var, F.lit(0.0) * var)).alias("sd"))
    x = cells.join(st, "post_id")
    hit = x.filter((F.col("n_comments") > F.col("mu") + F.lit(k) * F.col("sd")) & (F.col("n_users") >= min_users))
    return hit.select("hour", "post_id", "n_comments", "n_users",
                      r6(F.col("n_comments") / F.col("n_users")).alias("comments_per_user"),
                      r6("mu").alias("baseline_mean"), r6("sd").alias("baseline_std"))


def insight_rows(overlap_users: DataFrame, timeline: DataFrame, overlap_threshold: int) -> DataFrame:
    """Rule hits as uniform rows (rule, entity, bucket, value, threshold)."""
    r1 = overlap_users.select(F.lit("user overlap spike in top posts").alias("rule"),
                              F.col("author").alias("entity"), F.lit(None).cast("timestamp_ntz").alias("bucket"),
                              F.col("top_posts").cast("double").alias("value"),
                              F.lit(float(overlap_threshold)).alias("threshold"))
    r2 = timeline.filter((F.col("is_spike") == 1) | (F.col("avg_sentiment") <= -0.05)).select(
        F.lit("volume spike or negative sentiment day").alias("rule"), F.lit("all").alias("entity"),
        F.col("day").alias("bucket"), F.col("avg_sentiment").alias("value"), F.lit(-0.05).alias("threshold"))
    return r1.unionByName(r2)


__all__ = ["daily_timeline", "swarm_alerts", "insight_rows", "Window"]
