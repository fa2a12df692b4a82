"""Structured Streaming forms (inventory A4, A11, L1–L8).

Sources are file landings (JSON); sinks are Parquet folders under the shared
checkpoint folder, written per micro-batch with ``foreachBatch`` — no memory
sink, nothing collected to the driver. Every query has its own checkpoint
location, so a restarted query resumes from its last committed batch.
Event time must be TIMESTAMP for watermarks, so ``ts`` is cast on read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadlens.session import ship_package
from threadlens.sources.ingest import insert_if_absent


def land_json(df: DataFrame, path: str, files: int, order: str | None = None) -> None:
    """Write ``df`` as ``files`` JSON files (a landing folder for a stream);
    timestamps as plain wall-clock text. With ``order`` the files hold
    consecutive ranges of that column (arrival roughly in event time)."""
    out = df
    for f in df.schema.fields:
        if f.dataType.simpleString().startswith("timestamp"):
            out = out.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    out = out.repartitionByRange(files, order) if order else out.repartition(files)
    out.write.mode("overwrite").json(path)


def read_landing(spark: SparkSession, path: str, schema: str, ts: str = "ts",
                 max_files: int | None = None) -> DataFrame:
    """JSON landing as a stream; ``max_files`` bounds each micro-batch
    (the batched writes of the reference)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.json(path)
    return s.withColumn(ts, F.to_timestamp(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def run_available(stream_writer, checkpoint: str):
    q = stream_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _batch_sink(out: str):
    """One folder for each micro-batch, named by its id: a batch that is replayed
    after a failure replaces its own rows instead of adding them again."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={epoch}")
    return sink


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; any other trouble with the store is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def to_ntz(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return df


# ---------------------------------------------------------------- L1 / A4
def stream_insert_if_absent(stream: DataFrame, target_path: str, key: list[str], ts: str,
                            checkpoint: str, order: list[str] | None = None):
    """L1: insert-if-absent over all history. Each micro-batch keeps the first
    arrival per key, is anti-joined against the target table and appended, so
    a key written once is never written again — also when a batch is replayed
    after a failure (its keys are already in the target). No watermark state:
    a watermark would drop rows that arrive late, and here every row counts."""
    spark = stream.sparkSession

    def sink(batch: DataFrame, _epoch: int) -> None:
        target = spark.read.parquet(target_path) if path_exists(spark, target_path) else batch.limit(0)
        new = insert_if_absent(target, batch, key, order or [ts])
        new.write.mode("append").parquet(target_path)

    return run_available(stream.writeStream.foreachBatch(sink), checkpoint)


# ------------------------------------------------------------- upsert tables
def read_latest(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """The table that ``_batch_sink`` made of an update-mode stream: of each key, the row of the
    latest micro-batch. A replayed batch has replaced its own folder, so upserts are idempotent;
    a stream that has written nothing yet is an empty table of ``schema``."""
    if not path_exists(spark, out):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch_id long").parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v"))
    return newest.select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


def compact_latest(spark: SparkSession, out: str, keys: list[str], schema: str, into: str) -> None:
    """The latest rows of ``out`` as one batch of a new table folder ``into``, which later
    batches of the same stream go on from."""
    last = spark.read.schema(f"{schema}, batch_id long").parquet(out).agg(F.max("batch_id")).first()[0]
    read_latest(spark, out, keys, schema).write.mode("overwrite").parquet(f"{into}/batch_id={last}")


# ------------------------------------------------------------- L2 / L3 / L4
def stream_window_counts(stream: DataFrame, ts: str, by: str, size: str, slide: str | None,
                         out: str, checkpoint: str, watermark: str = "10 minutes"):
    """L2 (tumbling) / L3 (sliding): counts per (window, key) in update mode. A micro-batch
    writes the windows it changed (read them with ``read_latest``), and the watermark takes
    windows that can't change any more out of the state; rows later than that are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    agg = (stream.withWatermark(ts, watermark).groupBy(w.alias("w"), by)
           .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n"))
    return run_available(agg.writeStream.outputMode("update").foreachBatch(_batch_sink(out)), checkpoint)


def stream_sessions(stream: DataFrame, ts: str, by: str, gap: str, out: str, checkpoint: str,
                    watermark: str = "1 hour"):
    """L4: activity sessions per key (``session_window``), merged over micro-batches in the
    state. Append mode: a session is written once, when the watermark has passed its gap, and
    leaves the state; ``open_sessions`` tells those that may still grow."""
    agg = (stream.withWatermark(ts, watermark).groupBy(by, F.session_window(ts, gap).alias("s"))
           .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
           .select(by, "session_start", "session_end", "n"))
    return run_available(agg.writeStream.outputMode("append").foreachBatch(_batch_sink(out)), checkpoint)


def open_sessions(spark: SparkSession, checkpoint: str, by: str) -> DataFrame:
    """(by, session_start, session_end, n) of the sessions still in the state that
    ``stream_sessions`` left in its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)     # the aggregates are kept by their names
    return state.select(*[F.col(f"value.`{c}`").alias(name) for c, name in (
        (by, by), ("min", "session_start"), ("max", "session_end"), ("count", "n"))])


def stream_static_join(stream: DataFrame, static: DataFrame, key: str, out: str, checkpoint: str):
    """stream–static join (comments to their posts), one folder per batch."""
    j = stream.join(static, key, "inner")
    return run_available(j.writeStream.foreachBatch(_batch_sink(out)), checkpoint)


def stream_first_seen(stream: DataFrame, ts: str, user: str, out: str, checkpoint: str):
    """A user counts as new in the window of their first event. The first event per user is
    kept in state by ``groupBy(user).min(ts)`` (one row a user ever seen, which the definition
    needs); in update mode a micro-batch writes only users that are new or came earlier than
    known, to be read with ``read_latest``."""
    first = stream.groupBy(user).agg(F.min(ts).alias("first_seen"))
    return run_available(first.writeStream.outputMode("update").foreachBatch(_batch_sink(out)), checkpoint)


def new_users_per_window(first_seen: DataFrame, size: str = "1 day") -> DataFrame:
    """Number of users first seen in each window."""
    w = F.window("first_seen", size)
    return first_seen.groupBy(w.start.alias("window_start")).agg(F.count(F.lit(1)).alias("new_users"))


def stream_daily_refresh(stream: DataFrame, ts: str, table: str, checkpoint: str):
    """Incremental daily feature refresh — each batch recomputes the
    counts of the days it touches from the landed history of those days (the
    history is partitioned by batch and day, so no other day is read) and
    overwrites only those day partitions. A replayed batch replaces its own
    part of the history."""
    spark = stream.sparkSession
    history = table + "_events"

    def sink(batch: DataFrame, epoch: int) -> None:
        (batch.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day")
         .parquet(f"{history}/batch_id={epoch}"))
        days = batch.select(F.to_date(ts).alias("day")).distinct()
        touched = spark.read.parquet(history).join(days, "day", "left_semi")
        feats = touched.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
        (feats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(table))

    return run_available(stream.writeStream.foreachBatch(sink), checkpoint)


# ---------------------------------------------------------------- L6 alerts
ALERT_SCHEMA = "key string, window_start timestamp, n long, mean double, std double, alert int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Baseline(StatefulProcessor):
    """Per key the count, mean and M2 (Welford) of its closed windows' counts, as keyed state.

    A key without a window for ``idle_ms`` starts anew; a timer then removes its state.
    """

    def __init__(self, k: float, min_history: int, size_ms: int, idle_ms: int):
        self.k, self.min_history, self.size_ms, self.idle_ms = k, min_history, size_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("baseline", "cnt long, mean double, m2 double, last_end long, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cnt, mean, m2, last, expires = self.known.get() if self.known.exists() else (0, 0.0, 0.0, None, None)
        windows = pd.concat(list(rows)).sort_values("window_start")   # the key's windows closed by this batch
        told = []
        for start, n in zip(windows["window_start"], windows["n"].tolist()):
            at = start.value // 1_000_000
            if last is not None and at - last >= self.idle_ms:
                cnt, mean, m2 = 0, 0.0, 0.0
            std = (m2 / (cnt - 1)) ** 0.5 if cnt > 1 else 0.0
            told.append((key[0], start, n, mean, std, int(cnt >= self.min_history and n > mean + self.k * std + 1e-9)))
            cnt += 1
            apart = n - mean
            mean += apart / cnt
            m2 += apart * (n - mean)
            last = at + self.size_ms
        if expires is not None:
            self.handle.deleteTimer(expires)
        # A window that starts before the idle time is over is closed one window later at the latest.
        expires = last + self.idle_ms + self.size_ms
        self.handle.registerTimer(expires)
        self.known.update((cnt, mean, m2, last, expires))
        yield pd.DataFrame(told, columns=["key", "window_start", "n", "mean", "std", "alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_alerts(stream: DataFrame, ts: str, by: str, size: str, out: str, checkpoint: str,
                  k: float = 2.0, min_history: int = 6, watermark: str = "10 minutes", idle: str = "30 days"):
    """A window alerts when its count exceeds mean + k·std of the key's earlier windows
    (at least ``min_history``, none further apart than ``idle``). Windows are counted natively and
    closed by the watermark; only one row per (key, window) reaches the keyed state, which
    ``transformWithStateInPandas`` updates in place and a timer removes."""
    spark = stream.sparkSession
    ms = lambda text: pd.Timedelta(text).value // 1_000_000
    counts = (stream.withWatermark(ts, watermark).groupBy(F.window(ts, size).alias("w"), by)
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.col(by).cast("string").alias("key"), F.col("w.start").alias("window_start"), "n"))
    told = counts.groupBy("key").transformWithStateInPandas(
        Baseline(k, min_history, ms(size), ms(idle)), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="EventTime")
    ship_package(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)     # keyed state and timers need it; a query keeps its own for ever
    try:
        return run_available(told.writeStream.outputMode("append").foreachBatch(_batch_sink(out)), checkpoint)
    finally:
        spark.conf.set(provider, before)
