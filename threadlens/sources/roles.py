"""Table roles: the reference's posts / comments / interactions, built from any
pair of tables.

The reference keeps ``posts(post_id, subreddit, author, title, self_text, url,
created_utc, score, num_comments, flair)`` and ``comments(comment_id, post_id,
parent_id, author, body, created_utc, score)``. Every operator in this package
works on those column names; the builders below derive them from the driver's
tables so the same code runs on real forum data or on the fixtures.

Author columns are strings, as in the reference (``str(author)``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POST_COLS = ["post_id", "subreddit", "author", "title", "self_text", "url",
             "created_utc", "score", "num_comments", "flair"]
COMMENT_COLS = ["comment_id", "post_id", "parent_id", "author", "body",
                "created_utc", "score"]


@dataclass
class Forum:
    posts: DataFrame
    comments: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thread_key() -> F.Column:
    """Thread id of an event: the ``k`` field of its JSON props."""
    return F.get_json_object("props", "$.k").cast("bigint")


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", thread_key().alias("k"))


def forum_from_events(spark: SparkSession, sf_dir: str) -> Forum:
    """events → forum. Thread = JSON ``k``; its first event (by ts, event_id) is
    the post, every later event is a comment on it.

    The first event per thread comes from a ``min_by`` aggregate (partial
    aggregation before the shuffle, so a thread holding a third of all rows
    costs one row per map task); that small table is checkpointed once.
    Comments are the events minus those ids: an anti join on the unique
    ``event_id``, never on the skewed thread key.
    """
    from threadlens.session import cut_lineage
    ev = _events(spark, sf_dir)
    # one row per thread, referenced by every posts/comments branch: written
    # once to the shared folder instead of re-aggregating the events each time
    first = cut_lineage(ev.groupBy("k")
                        .agg(F.min_by(F.struct("event_id", "ts", "user_id", "event_type", "value"),
                                      F.struct("ts", "event_id")).alias("f"))
                        .select(F.col("k").alias("post_id"), "f.*"))
    posts = first.select(
        "post_id",
        F.col("event_type").alias("subreddit"),
        F.col("user_id").cast("string").alias("author"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("self_text"),
        F.lit(None).cast("string").alias("url"),
        F.col("ts").alias("created_utc"),
        F.col("value").alias("score"),
        F.lit(None).cast("bigint").alias("num_comments"),
        F.lit(None).cast("string").alias("flair"),
        F.col("event_id").alias("src_id"),
    )
    comments = (ev.join(first.select(F.col("event_id")), "event_id", "left_anti")
                .select(F.col("event_id").alias("comment_id"),
                        F.col("k").alias("post_id"),
                        F.col("k").cast("string").alias("parent_id"),
                        F.col("user_id").cast("string").alias("author"),
                        F.lit(None).cast("string").alias("body"),
                        F.col("ts").alias("created_utc"),
                        F.col("value").alias("score"),
                        F.col("event_type").alias("src_type")))
    return Forum(posts, comments)


def forum_from_orders(spark: SparkSession, sf_dir: str) -> Forum:
    """orders → posts, lineitem → comments (large-join fixture).

    comment key = (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate),
    unique in the data; it is kept as columns, not concatenated.
    """
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    posts = o.select(
        F.col("o_orderkey").alias("post_id"),
        F.col("o_orderpriority").alias("subreddit"),
        F.col("o_custkey").cast("string").alias("author"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("self_text"),
        F.lit(None).cast("string").alias("url"),
        F.col("o_orderdate").alias("created_utc"),
        F.col("o_totalprice").alias("score"),
        F.lit(None).cast("bigint").alias("num_comments"),
        F.col("o_orderstatus").alias("flair"),
    )
    comments = li.select(
        F.col("l_linenumber").alias("comment_line"),
        F.col("l_partkey").alias("comment_part"),
        F.col("l_orderkey").alias("post_id"),
        F.col("l_orderkey").cast("string").alias("parent_id"),
        F.col("l_suppkey").cast("string").alias("author"),
        F.lit(None).cast("string").alias("body"),
        F.col("l_shipdate").alias("created_utc"),
        F.col("l_quantity").alias("score"),
    )
    return Forum(posts, comments)


@lru_cache(maxsize=32)
def _doc_count(path: str) -> int:
    from pyspark.sql import SparkSession as _S
    return _S.getActiveSession().read.parquet(path).count()  # footer metadata only


def attach_text(spark: SparkSession, sf_dir: str, df: DataFrame, id_col: str,
                out_col: str) -> DataFrame:
    """Give each row a text: documents.text where doc_id = id mod count(documents).

    The document count is a parquet-footer count (no scan of the text). The
    join is an equi join on doc_id; AQE broadcasts documents only when the
    materialised side is under the threshold, else it sort-merges. Rows without
    text are small, so few tasks may hold them all; they are dealt over as many as
    a shuffle has before the texts come in, as what follows works on every text.
    """
    n = _doc_count(f"{sf_dir}/documents.parquet")
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_doc"), F.col("text").alias(out_col))
    keyed = df.drop(out_col).withColumn("_doc", F.pmod(F.col(id_col), F.lit(n)))
    keyed = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_doc")   # a number, or they'd be put together again
    return keyed.join(docs, "_doc", "left").drop("_doc")


def forum_with_text(spark: SparkSession, sf_dir: str) -> Forum:
    """events forum whose posts carry a title and comments a body."""
    f = forum_from_events(spark, sf_dir)
    posts = attach_text(spark, sf_dir, f.posts, "src_id", "title")
    comments = attach_text(spark, sf_dir, f.comments, "comment_id", "body")
    return Forum(posts, comments)


def flagged_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flagged_user_interactions(id, username, interaction_type, subreddit,
    content, post_id, parent_id, created_utc, score) from events.

    Duplicates as the reference accumulates them (its ON CONFLICT can never
    fire): every ``click`` event is stored a second time under a new id.
    """
    f = forum_from_events(spark, sf_dir)
    p = f.posts.select(
        F.col("src_id").alias("id"), F.col("author").alias("username"),
        F.lit("post").alias("interaction_type"), "subreddit",
        F.lit(None).cast("string").alias("content"), "post_id",
        F.lit(None).cast("string").alias("parent_id"), "created_utc",
        F.col("score").cast("int").alias("score"))
    c = f.comments.select(
        F.col("comment_id").alias("id"), F.col("author").alias("username"),
        F.lit("comment").alias("interaction_type"), F.col("src_type").alias("subreddit"),
        F.lit(None).cast("string").alias("content"), "post_id",
        "parent_id", "created_utc", F.col("score").cast("int").alias("score"))
    base = p.unionByName(c)
    dup = base.filter(F.col("subreddit") == "click").withColumn(
        "id", F.col("id") + F.lit(1_000_000_000))
    return base.unionByName(dup)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a reply forest: (conv_id, turn) replies to (conv_id, turn-1).

    Columns: msg_id, parent_msg_id, conv_id, turn, author, text.
    author = role + (conv_id mod 10), so authors recur across threads.
    """
    c = read_table(spark, sf_dir, "conversations")
    msg = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat_ws(
        ":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
    return c.select(msg.alias("msg_id"), parent.alias("parent_msg_id"), "conv_id", "turn",
                    F.concat(F.col("role"), F.pmod(F.col("conv_id"), F.lit(10)).cast("string"))
                    .alias("author"), "text")
