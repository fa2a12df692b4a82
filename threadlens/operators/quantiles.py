"""Exact ranks and quantiles without holding a group in one task.

Distinct values with their counts are range-partitioned by (group, value), so a
group of any size or shape is spread by its rows, and written with their
partition. Counts per (group, partition) — one row for each partition that a
group reaches — give every partition its offset, and a running count inside the
partition does the rest. Every value then knows the ranks it holds, in the
column's own type.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) on equal keys, where two NULLs are equal; ``b`` adds its other columns."""
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda m, n: m & n, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(b, on, how).drop(*[f"_r_{k}" for k in keys])


def ranked_values(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys..., _v, _m, _first): each distinct non-NULL value of ``col``, how often
    it occurs and its first 0-based rank in its group."""
    from threadlens.session import written
    keys = list(keys)
    x = df.select(*keys, F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    counts = x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    x = written(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()), "ranked")
    sums = x.groupBy(*keys, "_p").agg(F.sum("_m").alias("_s"))
    base = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_s")
    sums = sums.select(*keys, "_p", base.alias("_base"))
    inside = F.sum("_m").over(Window.partitionBy("_p", *keys).orderBy("_v")) - F.col("_m")
    x = x.withColumn("_inside", inside)
    return null_safe_join(x, sums, keys + ["_p"]).select(
        *keys, "_v", "_m", (F.col("_inside") + F.col("_base")).alias("_first"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """One row per group: keys..., n, and one column per probability, with linear
    interpolation (``np.percentile``). NULL values are ignored (groups with only
    NULLs are absent)."""
    keys = list(keys)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    x = ranked_values(df.withColumn(col, F.col(col).cast("double")), keys, col)
    sizes = x.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    if keys:
        x = null_safe_join(x, sizes, keys)
    else:
        x = x.withColumn("_n", F.lit(sizes.first()["_n"]).cast("long"))

    def at(rank: Column) -> Column:
        held = (F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_m"))
        return F.max(F.when(held, F.col("_v")))

    lo = lambda p: F.floor(F.lit(float(p)) * (F.col("_n") - 1)).cast("long")
    found = x.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        *[at(lo(p)).alias(f"_a{i}") for i, p in enumerate(probs)],
        *[at(F.least(lo(p) + 1, F.col("_n") - 1)).alias(f"_b{i}") for i, p in enumerate(probs)])
    found = found.filter(F.col("_n").isNotNull())

    def value(i: int, p: float) -> Column:
        pos, a, b = F.lit(float(p)) * (F.col("_n") - 1), F.col(f"_a{i}"), F.col(f"_b{i}")
        return F.when(a == b, a).otherwise((lo(p) + 1 - pos) * a + (pos - lo(p)) * b)

    return found.select(*keys, F.col("_n").alias("n"), *[value(i, p).alias(nm) for i, (p, nm) in enumerate(zip(probs, names))])


def value_at_rank(df: DataFrame, col: str, rank: int):
    """The value with 0-based ``rank`` in ascending order of ``col`` (exact, in the
    column's own type), or None."""
    x = ranked_values(df, [], col)
    row = x.filter((F.col("_first") <= rank) & (F.lit(rank) < F.col("_first") + F.col("_m"))).select("_v").first()
    return row["_v"] if row is not None else None
