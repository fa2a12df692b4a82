"""Mixing sources to target weights by hash-threshold histograms.

A source's budget is met by whole passes over it plus those documents whose
hash lies under a threshold. The threshold is found without sorting: sum the
sizes by source and by the first bits of the hash, find the bucket in which the
budget ends, then look into that bucket alone with the next bits, and so on.
Budgets are nested: a smaller budget's documents are among a larger one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import ROW, materialise, words

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_PASSES = 2
BITS = 12          # of a histogram: 4,096 buckets a source
LEVELS = 4         # 48 bits of hash
# Tables of one row a source are broadcast up to so many sources (a few MB); with more,
# no source can hold much and the rows are shuffled by source.
BROADCAST_SOURCES = 1 << 16


def _hash(doc_id: Column, text: Column) -> Column:
    """48 bits. The text takes part, so that rows without an id are dealt too."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """A join key that tells null from any name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _by_source(rows: DataFrame, state: DataFrame, sources: int) -> DataFrame:
    return rows.join(F.broadcast(state) if sources <= BROADCAST_SOURCES else state, "key")


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target) from (key, source, size): weights 3, 1, 2 by code point
    order of the names, null last; a target stops at twice the source's size and what
    is over is shared again by weight. One row a source goes through the two windows."""
    by = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    most = F.col("source_size") * MAX_PASSES
    by = by.select("key", "source_size", place.alias("place"), weight.cast("double").alias("weight"))
    by = by.withColumn("ratio", most / F.col("weight"))
    # In the order of ratio, the sources that stop are a prefix: one stops if what
    # is left after those before it would still give it more than it may have.
    order = W.orderBy("ratio", "place")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy("ratio", "place").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) * TOTAL_SHARE - F.coalesce(F.sum(most).over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / share)
    by = by.withColumn("stops", F.col("level") >= F.col("ratio"))
    level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(whole)
    target = F.when(F.col("stops"), most.cast("double")).otherwise(level * F.col("weight"))
    return by.select("key", "source_size", target.alias("target"), "stops")


def thresholds(sizes: DataFrame) -> tuple[DataFrame, int]:
    """(key, source_size, target, passes, threshold) and the number of sources: a document is taken ``passes``
    times, and once more if its hash is below ``threshold``."""
    s = F.col("source_size")
    passes = F.when(F.col("stops"), F.lit(MAX_PASSES)).otherwise(F.floor(F.col("target") / s)).cast("int")
    state = targets(sizes).withColumn("passes", F.coalesce(passes, F.lit(0)))
    state = materialise(state.select("key", "source_size", "target", "passes",
                         (F.col("target") - F.col("passes") * s).alias("rest"),
                         F.lit(0).cast("long").alias("prefix")), "mix-targets")
    sources = state.count()
    carried = ["source_size", "target", "passes", "rest"]
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        # Only the documents of each source's boundary bucket go on to this level.
        inside = (_by_source(sizes.select("key", "size", "hash"), state.select("key", *carried, "prefix"), sources)
                  .where(F.shiftright("hash", shift + BITS) == F.col("prefix")))
        hist = (inside.groupBy("key", F.shiftright("hash", shift).alias("bucket"))
                .agg(F.sum("size").alias("own"), *[F.first(c).alias(c) for c in carried]))
        before = F.sum("own").over(W.partitionBy("key").orderBy("bucket")) - F.col("own")
        bucket = F.struct("bucket", F.col("before"), F.col("own"))
        # The first bucket that the rest doesn't cover; the last one if it covers all.
        edge = F.coalesce(F.min(F.when(F.col("before") + F.col("own") > F.col("rest"), bucket)), F.max(bucket))
        state = materialise(
            hist.withColumn("before", before).groupBy("key")
            .agg(*[F.first(c).alias(c) for c in carried], edge.alias("edge"))
            .select("key", "source_size", "target", "passes",
                    (F.col("rest") - F.col("edge.before")).alias("rest"),
                    F.col("edge.bucket").alias("prefix"), F.col("edge.own").alias("own")), f"mix-edge-{level}")
    # The last bucket is one value of the hash: in, if that comes nearer to the target.
    nearer = F.col("own") - F.col("rest") < F.col("rest")
    # A source whose whole passes meet its target takes nothing more, not even empty texts.
    more = F.col("target") > F.col("passes") * F.col("source_size")
    threshold = F.when(more, F.col("prefix") + nearer.cast("long")).otherwise(0)
    return state.select("key", "source_size", "target", "passes", threshold.alias("threshold")), sources


def _measured(docs: DataFrame, carry: bool) -> DataFrame:
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)] if carry else []
    m = docs.select(*own, "doc_id", F.col("source").cast("string").alias("source"),
                    F.size(words(F.col("text"))).cast("long").alias("size"),
                    _hash(F.col("doc_id"), F.col("text")).alias("hash"))
    return m.withColumn("key", _key(F.col("source")))


def mix(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target,
    taken (words) and copies (0, 1 or 2). With ``carry`` the column ``__threadlens_row``
    holds the whole row, which is then read a second time rather than stored.

    A null or empty text has size 0 and takes no words. A null source is a source of
    its own, the last. Rows with a null id are dealt by their text; rows that agree in
    id and text share a hash and are taken together. An empty table gives no rows.
    Further columns are ignored.
    """
    sizes = materialise(_measured(docs, False), "mix-sizes")
    taken = _by_source(_measured(docs, True) if carry else sizes, *thresholds(sizes))
    copies = F.col("passes") + (F.col("hash") < F.col("threshold")).cast("int")
    return taken.select(*([ROW] if carry else []), "doc_id", "size", "source_size", "target",
                        (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    taken = mix(docs, carry=True).where("copies > 0")
    return (taken.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns]))
