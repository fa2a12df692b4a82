"""As-of join: the latest fact before a point in time, without one key's history in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import written


def latest_before(points: DataFrame, facts: DataFrame, key: str, ts: str, values: Sequence[str],
                  tiebreak: str | None = None) -> DataFrame:
    """``points`` with the ``values`` of the latest fact of their key at or before their time (NULL where there is
    none). Facts of one key and time are ordered by ``tiebreak``. A NULL key is a key of its own; rows with a
    NULL time know nothing and are no facts.

    Points and facts are range-partitioned by (key, time), so a key's history is spread by its rows. Each
    partition carries its own latest fact forward; what a key's earlier partitions hold comes from one row for
    each partition that the key reaches.
    """
    fact = F.struct(*[F.col(c).alias(c) for c in values])
    rest = F.struct(*[F.col(c).alias(c) for c in points.columns])
    none = F.lit(None)
    p = points.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_kind"), none.cast("string").alias("_tie"),
                      none.alias("_f"), rest.alias("_p"))
    tie = F.col(tiebreak) if tiebreak else F.lit(0)
    f = facts.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(ts).alias("_t")).agg(
        F.max_by(fact, tie).alias("_f"))
    p = p.drop("_tie").withColumn("_f", none.cast(f.schema["_f"].dataType))
    f = f.select("_k", "_t", F.lit(0).alias("_kind"), "_f", none.cast(p.schema["_p"].dataType).alias("_p"))
    x = written(p.unionByName(f).repartitionByRange("_k", "_t", "_kind").withColumn("_part", F.spark_partition_id()), "asof")
    order = Window.partitionBy("_part", "_k").orderBy("_t", "_kind")
    x = x.withColumn("_own", F.last("_f", ignorenulls=True).over(order))
    ends = x.groupBy("_k", "_part").agg(F.max_by("_f", F.when(F.col("_f").isNotNull(), F.col("_t"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).select(
        F.col("_k").alias("_k2"), F.col("_part").alias("_part2"), "_before")
    told = x.where("_kind = 1").join(ends, F.expr("_k <=> _k2 and _part = _part2"))
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_before"))
    return told.select("_p.*", *[found[c].alias(c) for c in values])
