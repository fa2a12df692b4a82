"""Exact top-k search in Hamming space by incremental multi-index hashing.

A 64-bit code (the signs of a vector's elements) is cut into four segments of 16 bits,
each with an index of its own. A search looks up, in every segment, the values within a
radius of the query's; two codes that differ in at most 4 * (radius + 1) - 1 bits agree
within the radius in some segment, so once the k-th verified distance is no larger than
that, nothing nearer can be missing. Queries that aren't done go on with the next radius.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialise

BITS = 64
SEGMENTS = 4
SEGMENT_BITS = BITS // SEGMENTS
# The k-th distance in so many codes, chosen by a hash, bounds each query's from above.
BOUND_CODES = 2048


def code(vector: Column) -> Column:
    """Bit i (of 64) is set if the sum of elements i, i + 64, ... is above 0. Null and NaN
    elements count as 0; a null or empty vector has no code."""
    v = F.transform(vector, lambda x: F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    one = F.lit(1).cast("long")

    def bit(b: Column) -> Column:
        total = F.aggregate(F.sequence(b, F.size(v) - 1, F.lit(BITS)), F.lit(0.0), lambda a, i: a + F.get(v, i))
        return F.when(total > 0, F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))

    places = F.sequence(F.lit(0), F.least(F.size(v), F.lit(BITS)) - 1)
    return F.when(F.size(vector) > 0, F.aggregate(F.transform(places, bit), F.lit(0).cast("long"),
                                                  lambda a, b: a.bitwiseOR(b)))


def _segment(c: Column, s: Column | int) -> Column:
    shift = F.lit(s) * SEGMENT_BITS if isinstance(s, int) else s * SEGMENT_BITS
    return F.call_function("shiftright", c, shift).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query, ties by smaller id.

    ``rows`` and ``queries`` have (id, vector). A row isn't its own neighbour (same id).
    Rows without a vector or id are left out, repeated (id, code) rows count once, and a
    query with fewer than k others gets them all. Empty tables give no rows. An id with
    several vectors stands for several rows.

    Codes are indexed once each, with their k + 1 smallest ids, which is all that a result
    can use of them; so a code that very many rows share costs no more than another.
    """
    coded = lambda d: d.select("id", code(F.col("vector")).alias("code")).dropna().distinct()
    by_code = W.partitionBy("code").orderBy("id")
    index = materialise(coded(rows).withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k + 1)
                        .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-index")
    # An upper bound of each query's k-th distance: distinct codes hold distinct rows, and as
    # many places further on as there are other codes that may hold none but the query's id.
    few = [r["code"] for r in index.select("code").orderBy(F.xxhash64("code"), "code").limit(BOUND_CODES).collect()]
    some = F.expr("array(" + ",".join(f"{c}L" if c > -(1 << 63) else "(-9223372036854775807L - 1L)" for c in few) + ")") \
        if few else F.expr("cast(array() as array<bigint>)")
    near = F.array_sort(F.transform(F.filter(some, lambda c: c != F.col("code")), lambda c: _distance(c, F.col("code"))))
    own = coded(rows).groupBy("id").agg(F.count("*").cast("int").alias("own"), F.min("code").alias("first"))
    more = F.when((F.col("own") == 1) & (F.col("first") == F.col("code")), 0).otherwise(F.coalesce("own", F.lit(0)))
    pending = materialise(coded(queries).join(own, "id", "left").select(
        F.col("id").alias("query_id"), F.col("code").alias("query"),
        F.coalesce(F.get(near, more + (k - 1)), F.lit(BITS)).alias("bound")), "topk-queries")
    segments = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("s")
    entries = index.select("code", "ids", segments).withColumn("value", _segment(F.col("code"), F.col("s")))
    found, radius = [], 0
    while radius <= SEGMENT_BITS and not pending.isEmpty():
        flips = F.expr(f"filter(sequence(0L, {(1 << SEGMENT_BITS) - 1}L), m -> bit_count(m) = {radius})")
        probes = (pending.select("query_id", "query", "bound", segments)
                  .select("*", F.explode(flips).alias("flip"))
                  .withColumn("value", _segment(F.col("query"), F.col("s")).bitwiseXOR(F.col("flip")))
                  .withColumnRenamed("s", "at").drop("flip"))
        # A pair counts where its nearest segment is met for the first time, so once in all rounds.
        once = reduce(Column.__and__, [
            F.when(F.lit(t) < F.col("at"), d > radius).when(F.lit(t) > F.col("at"), d >= radius).otherwise(F.lit(True))
            for t in range(SEGMENTS)
            for d in [_distance(_segment(F.col("query"), t), _segment(F.col("code"), t))]])
        apart = _distance(F.col("query"), F.col("code"))
        same = (F.col("at") == F.col("s")) & (probes["value"] == entries["value"])
        # Probes look small to the planner before they are exploded: never broadcast them.
        hits = (probes.join(entries.hint("merge"), same & (apart <= F.col("bound")) & once)
                .select("query_id", "query", apart.alias("distance"),
                        F.filter("ids", lambda x: x != F.col("query_id")).alias("ids")))
        found.append(materialise(hits, f"topk-{radius}"))
        seen = reduce(DataFrame.unionAll, found).groupBy("query_id", "query", "distance").agg(
            F.sum(F.size("ids")).alias("n"))
        upto = F.sum("n").over(W.partitionBy("query_id", "query").orderBy("distance"))
        kth = (seen.withColumn("upto", upto).where(F.col("upto") >= k)
               .groupBy("query_id", "query").agg(F.min("distance").alias("kth")))
        covered = SEGMENTS * (radius + 1) - 1
        pending = materialise(
            pending.join(kth, ["query_id", "query"], "left").where(F.col("kth").isNull() | (F.col("kth") > covered))
            .select("query_id", "query", F.least("bound", "kth").alias("bound")), f"topk-left-{radius}")
        radius += 1
    if not found:
        return pending.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("id"),
                              F.col("bound").alias("distance")).limit(0)
    place = W.partitionBy("query_id", "query").orderBy("distance", "id")
    return (reduce(DataFrame.unionAll, found).select("query_id", "query", "distance", F.explode("ids").alias("id"))
            .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "distance"))
