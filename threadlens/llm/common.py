"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import scratch_path, ship_package

# A word is a run of anything but the six ASCII white-space characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"

# Rows that Python workers receive at once. Texts are whole, so a batch is
# about this many times the mean text length.
BATCH_ROWS = 1000

ROW = "__threadlens_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the work
    is done once, lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare_workers(spark: SparkSession) -> None:
    """Before Python code runs on the executors: lower the Arrow batch size so that a batch
    of whole texts stays small, and ship this package, which they may not have installed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    ship_package(spark)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def remainder(doc_id: Column, modulus: int, value: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``value``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == value, F.lit(False))


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add the columns ``new``; those of the same name (in any case) are replaced.
    All new columns see the old ones."""
    taken = {k.lower() for k in new}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])


# Keys that hold more than this share of all rows number fewer than HEAVY.
HEAVY = 1024


def join_counted(big: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join on ``key`` (not null) of ``big``, a written table of ``total`` rows, with ``small``, which
    has each key once and in ``count`` how many rows of ``big`` hold it.

    Keys with more than a 1,024th of the rows, at most 1,023 keys whatever the table, are broadcast, so
    their rows stay where they are; all others are shuffled, and none of them is a large part.
    """
    rest = [c for c in small.columns if c != "count"]
    heavy = small.where(F.col("count") * HEAVY > total).select(*rest)
    light = small.where(F.col("count") * HEAVY <= total).select(*rest)
    return big.join(F.broadcast(heavy), key).unionByName(
        big.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))
