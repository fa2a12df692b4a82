"""Batch ingest (inventory A5, A6, A9, A12, A13, A14, A15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Explicit schemas (the reference's CREATE TABLE and INSERT lists)
POSTS_SCHEMA = T.StructType([
    T.StructField("post_id", T.StringType(), False), T.StructField("subreddit", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("self_text", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("created_utc", T.TimestampNTZType()), T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()), T.StructField("flair", T.StringType())])
COMMENTS_SCHEMA = T.StructType([
    T.StructField("comment_id", T.StringType(), False), T.StructField("post_id", T.StringType()),
    T.StructField("parent_id", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("created_utc", T.TimestampNTZType()),
    T.StructField("score", T.LongType())])
INTERACTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("username", T.StringType()),
    T.StructField("interaction_type", T.StringType()), T.StructField("subreddit", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("post_id", T.StringType()),
    T.StructField("parent_id", T.StringType()), T.StructField("created_utc", T.TimestampNTZType()),
    T.StructField("score", T.IntegerType())])


def epoch_to_ts(col: str) -> F.Column:
    """Epoch seconds → timestamp_ntz in UTC (no session-zone dependence)."""
    return F.timestamp_add("MICROSECOND", (F.col(col) * F.lit(1_000_000)).cast("long"),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def map_posts(raw: DataFrame) -> DataFrame:
    """A5: raw API post records → posts rows; a missing author becomes 'None'
    (the reference stores ``str(author)``)."""
    return raw.select(
        F.col("id").cast("string").alias("post_id"), F.col("subreddit").cast("string"),
        F.coalesce(F.col("author").cast("string"), F.lit("None")).alias("author"),
        F.col("title"), F.col("selftext").alias("self_text"), F.col("url"),
        epoch_to_ts("created_utc").alias("created_utc"), F.col("score").cast("long"),
        F.col("num_comments").cast("long"), F.col("link_flair_text").alias("flair"))


def normalize_id(col: str) -> F.Column:
    """H9: strip the kind prefix ("t1_", "t3_") of fullname ids."""
    return F.regexp_replace(F.col(col), r"^t[0-9]_", "")


def id_kind(col: str) -> F.Column:
    """H9: 'comment' for t1_ ids, 'post' for t3_ ids, NULL otherwise."""
    p = F.substring(F.col(col), 1, 3)
    return F.when(p == "t1_", "comment").when(p == "t3_", "post")


def reply_tree(spark: SparkSession, msgs: DataFrame) -> DataFrame:
    """Depth and root of every message of a flat reply forest
    (msg_id, parent_msg_id), by pointer doubling: each round every open message
    jumps to its ancestor's ancestor, so a chain of depth d takes log2(d) rounds.
    Messages whose chain ends in a missing message or a cycle have no root and
    are left out. Only messages that are still open are joined."""
    from threadlens.session import written
    at = msgs.select("msg_id", "parent_msg_id")
    roots = at.filter("parent_msg_id IS NULL").select("msg_id", F.col("msg_id").alias("root_id"), F.lit(0).alias("depth"))
    known = written(roots, "tree")
    open_ = written(at.filter("parent_msg_id IS NOT NULL")
                    .select("msg_id", F.col("parent_msg_id").alias("up"), F.lit(1).alias("steps")), "tree-open")
    done, left = [known], open_.count()
    while left:
        # a message whose ancestor is known gets its root; the others take their ancestor's pointer
        found = written(open_.join(known.select(F.col("msg_id").alias("up"), "root_id", "depth"), "up")
                        .select("msg_id", "root_id", (F.col("depth") + F.col("steps")).alias("depth")), "tree")
        rest = open_.join(found.select("msg_id"), "msg_id", "left_anti")
        jump = rest.select(F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        known = found.unionByName(known)
        open_ = written(rest.join(jump, "up", "left").select(
            "msg_id", F.coalesce("up2", "up").alias("up"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")), "tree-open")
        done.append(found)
        left, before = open_.count(), left
        if left == before:      # nothing but cycles and missing messages
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("msg_id", "root_id", "depth")


def flatten_nested(comments: DataFrame) -> DataFrame:
    """A6 (nested input): comments with ``replies`` arrays of the same shape →
    flat rows with parent ids, one ``explode`` per level. The depth is that of
    the schema: the innermost level has no ``replies`` (or NULL ones)."""
    cols = ["id", "author", "body", "created_utc", "score"]
    level = comments.withColumn("parent_id", F.lit(None).cast("string"))
    out = level.select("id", "parent_id", *cols[1:])
    while "replies" in level.columns and isinstance(level.schema["replies"].dataType, T.ArrayType) \
            and isinstance(level.schema["replies"].dataType.elementType, T.StructType):
        level = level.select(F.col("id").alias("parent_id"), F.explode("replies").alias("r")).select("parent_id", "r.*")
        out = out.unionByName(level.select("id", F.col("parent_id").cast("string"), *cols[1:]))
    return out


def keep_first_arrival(batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A9 inside one batch: first arrival per key (min over a struct led by the
    arrival order — aggregated map-side)."""
    key, order = list(key), list(order)
    rest = [c for c in batch.columns if c not in key and c not in order]
    agg = batch.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return agg.select(*key, *[F.col(f"_r.{c}").alias(c) for c in order + rest]).select(*batch.columns)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: Sequence[str],
                     order: Sequence[str]) -> DataFrame:
    """``INSERT … ON CONFLICT (key) DO NOTHING`` — the rows to append:
    first arrival per key in the batch whose key is not in the target yet."""
    first = keep_first_arrival(batch, key, order)
    return first.join(target.select(*key), list(key), "left_anti")


def merge_listings(*listings: DataFrame, key: str = "post_id") -> DataFrame:
    """The same post from several listings survives once."""
    out = listings[0]
    for x in listings[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates([key])


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Consecutive ids 1..n in the total order of ``order`` (SERIAL-like,
    stable across runs for the same data). The rows are sorted by range partition
    and written with their place; the partitions' sizes (one row each) then give
    every partition its offset."""
    from threadlens.session import written
    place = F.monotonically_increasing_id()
    x = written(df.orderBy(*order).withColumn("_p", F.shiftright(place, 33))
                .withColumn("_i", place.bitwiseAND(F.lit((1 << 33) - 1))), "ids")
    sizes = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")
    x = x.join(sizes.select("_p", base.alias("_base")), "_p")
    return x.select((F.col("_base") + F.col("_i") + 1).alias(name), *df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV export (a folder of part files, no index column)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def external_events(spark: SparkSession, path: str) -> DataFrame:
    """External calendar of (date, name) rows (CSV with header)."""
    return spark.read.option("header", True).schema("date date, name string").csv(path)


def flag_event_days(days: DataFrame, events: DataFrame, day_col: str = "day") -> DataFrame:
    """is_event = 1 when the day has an external event (semi-join flag;
    the calendar is small and is grouped to one row per date first)."""
    ev = events.groupBy(F.col("date")).agg(F.count(F.lit(1)).alias("n_events"))
    x = days.join(ev, F.to_date(days[day_col]) == ev["date"], "left")
    return x.withColumn("is_event", F.col("n_events").isNotNull().cast("int")).drop("date", "n_events")


__all__ = ["POSTS_SCHEMA", "COMMENTS_SCHEMA", "INTERACTIONS_SCHEMA", "map_posts", "normalize_id", "id_kind",
           "reply_tree", "flatten_nested", "keep_first_arrival", "insert_if_absent", "merge_listings",
           "assign_ids", "write_csv", "read_csv", "external_events", "flag_event_days"]
