"""Time-series operators (inventory D7–D9, E1–E27).

Event-level work is aggregated to buckets first; windows then run over the
bucket series of one key (a few hundred to a few thousand rows), never over all
events of a key. Where an event-level order is needed (running means over a
thread, look-back counts per user) the key is split into time chunks so one
hot key spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.numeric import r6
from threadlens.functions.timebuckets import bucket, n_buckets, nth_label
from threadlens.operators.quantiles import null_safe_join

def epoch_col():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_seconds(col: str) -> F.Column:
    """Seconds since 1970-01-01 of a timestamp_ntz column (double, µs precision)."""
    return F.timestamp_diff("MICROSECOND", epoch_col(), F.col(col)) / F.lit(1e6)


# ------------------------------------------------------------- D7 / D8 / D9
def spine(spark, first, last, freq: str, name: str = "bucket") -> DataFrame:
    """All labels from ``first`` to ``last`` (distributed ``range``)."""
    n = n_buckets(first, last, freq)
    return spark.range(n).select(nth_label(F.lit(first).cast("timestamp_ntz"), F.col("id"), freq).alias(name))


def zero_filled_counts(df: DataFrame, ts: str, freq: str, name: str = "n",
                       extra_aggs: Sequence = ()) -> DataFrame:
    """Counts per bucket for every bucket between the first and the last
    event; empty buckets get 0 (``resample().size()``)."""
    from threadlens.session import written
    b = df.withColumn("bucket", bucket(ts, freq))
    # a row per bucket, written: it is read for its range and for the result
    counts = written(b.groupBy("bucket").agg(F.count(F.lit(1)).alias(name), *extra_aggs), "bucket-counts")
    rng = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).first()
    if rng["a"] is None:
        return counts
    sp = spine(df.sparkSession, rng["a"], rng["b"], freq)
    out = sp.join(counts, "bucket", "left")
    return out.fillna(0, subset=[name])


def keyed_zero_filled_counts(df: DataFrame, key: str, ts: str, freq: str, name: str = "n") -> DataFrame:
    """D7 per key (e.g. comments of each thread): a spine per key from the key's
    first to last bucket (``sequence`` over bucket indexes, exploded)."""
    from threadlens.functions.timebuckets import FIXED, FIXED_SECONDS
    if freq not in FIXED:
        raise ValueError("per-key spines use fixed-width buckets")
    w = FIXED_SECONDS[FIXED[freq]]
    b = df.withColumn("bi", F.floor(F.timestamp_diff("SECOND", epoch_col(), F.col(ts)) / F.lit(w)))
    counts = b.groupBy(key, "bi").agg(F.count(F.lit(1)).alias(name))
    rng = counts.groupBy(key).agg(F.min("bi").alias("lo"), F.max("bi").alias("hi"))
    sp = rng.select(key, F.explode(F.sequence("lo", "hi")).alias("bi"))
    out = null_safe_join(sp, counts, [key, "bi"], "left").fillna(0, subset=[name])
    return out.select(key, F.timestamp_add("SECOND", F.col("bi") * F.lit(w), epoch_col()).alias("bucket"), name)


def bucket_counts(df: DataFrame, ts: str, freq: str, by: str, name: str = "n") -> DataFrame:
    """(bucket, by) counts, observed combinations only."""
    return df.groupBy(bucket(ts, freq).alias("bucket"), by).agg(F.count(F.lit(1)).alias(name))


def slot_sentiment(df: DataFrame, ts: str, freq: str, score: str = "compound",
                   name: str = "n") -> DataFrame:
    """D7 + D9: zero-filled counts with the mean score of each slot (0 if none)."""
    out = zero_filled_counts(df, ts, freq, name, [F.avg(score).alias("avg_sentiment")])
    return out.withColumn("avg_sentiment", r6(F.coalesce("avg_sentiment", F.lit(0.0))))


def daily_shift(df: DataFrame, ts: str, score: str, name: str) -> DataFrame:
    """E22 by day: the mean score of each day with rows, and its change from the
    day before among them (one row a day goes through the window)."""
    d = df.groupBy(F.window(ts, "1 day").start.alias("day")).agg(r6(F.avg(score)).alias(name))
    return d.withColumn("shift", F.col(name) - F.lag(name).over(Window.orderBy("day")))


def post_slot_sentiment(posts: DataFrame, comments: DataFrame, freq: str,
                        score: str = "compound") -> DataFrame:
    """C4 + D9 (post form): per post slot, post count and the mean score of all
    comments on posts created in the slot. One join of comments to their
    post's slot, then one grouping — no loop over slots."""
    pb = posts.select("post_id", bucket("created_utc", freq).alias("bucket"))
    pc = zero_filled_counts(posts, "created_utc", freq, "post_count")
    cs = (comments.select("post_id", score).join(pb, "post_id")
          .groupBy("bucket").agg(F.avg(score).alias("avg_sentiment")))
    return (pc.join(cs, "bucket", "left")
            .withColumn("avg_sentiment", r6(F.coalesce("avg_sentiment", F.lit(0.0)))))


# -------------------------------------------------------- series features
def rolling(series: DataFrame, order: str, cols: Sequence[str], n: int = 7,
            by: Sequence[str] = ()) -> DataFrame:
    """N-row mean and sample std, NULL until n rows are available
    (``rolling(window=n)``)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    out = series
    for c in cols:
        full = F.count(F.col(c)).over(w) == n
        out = (out.withColumn(f"ma_{n}_{c}", F.when(full, r6(F.avg(c).over(w))))
                  .withColumn(f"std_{n}_{c}", F.when(full, r6(F.stddev_samp(c).over(w)))))
    return out


def ema(series: DataFrame, order: str, col: str, span: int, by: Sequence[str] = (),
        chunk: int = 512) -> DataFrame:
    """Exponential moving average with alpha = 2/(span+1) and adjusted
    weights (pandas ``ewm(span).mean()``): Σ (1-α)^i x_{t-i} / Σ (1-α)^i over the
    whole history. NULL values carry no weight; before the first value the
    result is NULL.

    The recurrence acc·(1-α) + x is folded inside chunks of ``chunk`` values, so
    a frame never holds more; each chunk then adds what the earlier chunks' end
    states decay to. The weights' sum is geometric."""
    q = 1 - 2.0 / (span + 1)
    by = list(by)
    upto = Window.partitionBy(*by).orderBy(order)
    x = series.withColumn("_v", F.col(col).cast("double"))
    x = x.withColumn("_i", F.count("_v").over(upto)).withColumn(
        "_c", F.floor((F.greatest("_i", F.lit(1)) - 1) / F.lit(chunk)).cast("int"))
    inside = Window.partitionBy(*by, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fold = lambda xs, f: F.aggregate(xs, F.lit(0.0), f)
    x = x.withColumn("_own", fold(F.collect_list("_v").over(inside), lambda acc, v: acc * F.lit(q) + v))
    ends = x.groupBy(*by, "_c").agg(F.max_by("_own", "_i").alias("_end"))
    # all chunks before a given one are full, so each is ``chunk`` steps older than the next
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_c", fold(F.collect_list("_end").over(before),
                                       lambda acc, e: acc * F.lit(q ** chunk) + e).alias("_past"))
    x = null_safe_join(x, ends, by + ["_c"])
    steps = F.col("_i") - F.col("_c") * F.lit(chunk)
    num = F.col("_own") + F.col("_past") * F.pow(F.lit(q), steps)
    den = (F.lit(1.0) - F.pow(F.lit(q), F.col("_i"))) / F.lit(1 - q)
    out = F.when(F.col("_i") > 0, r6(num / den))
    return x.select(*series.columns, out.alias(f"ema_{span}_{col}"))


def diffs(series: DataFrame, order: str, col: str, by: Sequence[str] = (),
          lags: Sequence[int] = (1, 7)) -> DataFrame:
    """Velocity (x − lag x), acceleration (Δ velocity), lag features."""
    w = Window.partitionBy(*by).orderBy(order)
    out = series.withColumn(f"velocity_{col}", F.col(col) - F.lag(col, 1).over(w))
    out = out.withColumn(f"acceleration_{col}",
                         F.col(f"velocity_{col}") - F.lag(f"velocity_{col}", 1).over(w))
    for k in lags:
        out = out.withColumn(f"lag{k}_{col}", F.lag(col, k).over(w))
    return out


def autocorrelation(series: DataFrame, order: str, col: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of x with its own lag k, per key."""
    w = Window.partitionBy(*by).orderBy(order)
    x = series.withColumn("_lag", F.lag(col, k).over(w)).filter(F.col("_lag").isNotNull())
    return x.groupBy(*by).agg(r6(F.corr(col, "_lag")).alias(f"autocorr_{k}"))


def local_extrema(series: DataFrame, order: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """is_peak = 1 at local maxima, −1 at local minima, else 0, as
    ``find_peaks`` on x and −x: a run of equal values is one candidate, it must
    be strictly higher (lower) than the runs on both sides, and its middle row
    (floor) is marked. First and last runs are never extrema."""
    w = Window.partitionBy(*by).orderBy(order)
    x = series.withColumn("_i", F.row_number().over(w) - 1)
    x = x.withColumn("_chg", F.when(F.lag(col).over(w).eqNullSafe(F.col(col)), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*by, "_run").agg(F.min("_i").alias("_s"), F.max("_i").alias("_e"),
                                       F.first(col).alias("_v"))
    wr = Window.partitionBy(*by).orderBy("_run")
    runs = (runs.withColumn("_pv", F.lag("_v").over(wr)).withColumn("_nv", F.lead("_v").over(wr))
            .withColumn("_kind", F.when((F.col("_pv") < F.col("_v")) & (F.col("_nv") < F.col("_v")), 1)
                        .when((F.col("_pv") > F.col("_v")) & (F.col("_nv") > F.col("_v")), -1)
                        .otherwise(0))
            .withColumn("_mid", F.floor((F.col("_s") + F.col("_e")) / 2)))
    marks = runs.filter(F.col("_kind") != 0).select(*by, F.col("_mid").alias("_i"), "_kind")
    out = null_safe_join(x, marks, list(by) + ["_i"], "left")
    out = out.withColumn("is_peak", F.coalesce("_kind", F.lit(0)).cast("int"))
    out = out.withColumn("is_trough", (F.col("is_peak") == -1).cast("int"))
    return out.drop("_chg", "_run", "_kind")


def auc_segments(marked: DataFrame, order: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area of x over days between consecutive extrema (both
    ends included), from the output of :func:`local_extrema`. Segment k runs
    from extremum k to extremum k+1; rows before the first or after the last
    extremum belong to none. Returns (by..., seg, start, end, auc). Without
    ``by`` the series is one key."""
    if not by:
        return auc_segments(marked.withColumn("_all", F.lit(0)), order, col, ["_all"]).drop("_all")
    w = Window.partitionBy(*by).orderBy(order)
    x = marked.withColumn("_ext", (F.col("is_peak") != 0).cast("int"))
    x = x.withColumn("_seg", F.sum("_ext").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_nx", F.lead(col).over(w)).withColumn("_nt", F.lead(order).over(w))
    x = x.withColumn("_trap", (F.col(col) + F.col("_nx")) / 2
                     * F.timestamp_diff("SECOND", F.col(order), F.col("_nt")) / F.lit(86400.0))
    n_ext = x.groupBy(*by).agg(F.sum("_ext").alias("_n"))
    seg = (x.filter(F.col("_seg") >= 1).groupBy(*by, "_seg")
           .agg(F.min(order).alias("start"), F.sum("_trap").alias("auc"),
                F.max(F.col("_nt")).alias("_end_next")))
    # segment end = the next extremum = first row of the next segment
    nxt = seg.select(*by, (F.col("_seg") - 1).alias("_seg"), F.col("start").alias("end"))
    out = null_safe_join(null_safe_join(seg, n_ext, list(by)).filter(F.col("_seg") < F.col("_n")), nxt, list(by) + ["_seg"])
    return out.select(*by, F.col("_seg").alias("seg"), "start", "end", r6("auc").alias("auc"))


def auc_labels(series: DataFrame, segs: DataFrame, order: str, hi: float, lo: float,
               by: Sequence[str] = ()) -> DataFrame:
    """E13 + C10: each day gets auc_spike / auc_drop from the latest segment
    covering it (start <= day <= end) that passes the threshold, else 0.

    Segments follow one another, so a day lies in the one that started last,
    and a starting day in the one before as well. Each segment is joined to its
    starting day and carried forward over the ordered series: linear in its
    length."""
    if not by:
        return auc_labels(series.withColumn("_all", F.lit(0)), segs.withColumn("_all", F.lit(0)), order, hi, lo,
                          ["_all"]).drop("_all")
    by = list(by)
    s = segs.withColumn("_prev", F.lag("auc").over(Window.partitionBy(*by).orderBy("seg")))
    s = s.select(*by, F.col("start").alias(order), F.struct("start", "end", "auc", "_prev").alias("_s"))
    x = null_safe_join(series, s, by + [order], "left")
    x = x.withColumn("_s", F.last("_s", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))

    def label(passes):
        own, before = F.col("_s.auc"), F.col("_s._prev")
        inside = F.when((F.col(order) <= F.col("_s.end")) & passes(own), own)
        return F.coalesce(inside, F.when((F.col(order) == F.col("_s.start")) & passes(before), before), F.lit(0.0))

    return x.select(*series.columns, label(lambda a: a > hi).alias("auc_spike"), label(lambda a: a < lo).alias("auc_drop"))


def zscore_flags(series: DataFrame, col: str, threshold: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """|x − mean| / std_samp > threshold over the whole series of a key."""
    st = series.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s")) if by else None
    if by:
        x = null_safe_join(series, st, list(by))
    else:
        r = series.agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s")).first()
        x = series.withColumn("_m", F.lit(r["_m"])).withColumn("_s", F.lit(r["_s"]))
    z = F.abs(F.col(col) - F.col("_m")) / F.when(F.col("_s") != 0, F.col("_s"))
    return (x.withColumn(f"z_{col}", r6(z)).withColumn(
        "is_anomaly", F.coalesce((z > threshold).cast("int"), F.lit(0))).drop("_m", "_s"))


def burst_flags(series: DataFrame, order: str, col: str, k: float = 2.0, n: int = 7,
                by: Sequence[str] = ()) -> DataFrame:
    """X > mean + k·std of the previous n rows (needs n previous rows)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-n, -1)
    full = F.count(F.col(col)).over(w) == n
    base = F.avg(col).over(w) + F.lit(k) * F.stddev_samp(col).over(w)
    return series.withColumn("is_burst", F.when(full & (F.col(col) > base), 1).otherwise(0))


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Day of week (1 = Sunday), hour, weekend flag, month, quarter,
    season (meteorological, northern: 1 winter … 4 autumn)."""
    m = F.month(ts)
    return df.select("*", F.dayofweek(ts).alias("day_of_week"), F.hour(ts).alias("hour"),
                     F.dayofweek(ts).isin(1, 7).cast("int").alias("is_weekend"),
                     m.alias("month"), F.quarter(ts).alias("quarter"),
                     (F.floor((m % 12) / 3) + 1).cast("int").alias("season"))


# -------------------------------------------------- event-level per key
def chunked_running(df: DataFrame, key: str, ts: str, value: str, tiebreak: str,
                    chunk_seconds: int = 3600) -> DataFrame:
    """Running count / sum / mean of ``value`` per key in (ts, tiebreak) order,
    exact, without one task per key: rows are cut into (key, time chunk)
    partitions; chunk totals (small) give each chunk its offset, and the running
    sum inside a chunk is a window over that chunk only. Adds run_n, run_sum,
    run_mean."""
    x = df.withColumn("_c", F.floor(epoch_seconds(ts) / F.lit(chunk_seconds)))
    tot = x.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_cn"), F.sum(value).alias("_cs"))
    wo = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(key, "_c", F.coalesce(F.sum("_cn").over(wo), F.lit(0)).alias("_on"),
                     F.coalesce(F.sum("_cs").over(wo), F.lit(0.0)).alias("_os"))
    wi = Window.partitionBy(key, "_c").orderBy(ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.count(F.lit(1)).over(wi)).withColumn("_is", F.sum(value).over(wi))
    x = null_safe_join(x, off, [key, "_c"])
    return (x.withColumn("run_n", F.col("_in") + F.col("_on"))
            .withColumn("run_sum", F.col("_is") + F.col("_os"))
            .withColumn("run_mean", r6(F.col("run_sum") / F.col("run_n")))
            .drop("_c", "_in", "_is", "_on", "_os"))


def shift_between_thirds(df: DataFrame, key: str, ts: str, value: str, tiebreak: str, middle: float = 0.0) -> DataFrame:
    """Per key the mean of ``value`` in the first and the last third of its events (as ``ntile(3)`` deals
    them), their difference, and whether the means lie on different sides of ``middle``. Ranks come from the
    chunked running count; NULL values count as events but not in the means."""
    r = chunked_running(df.withColumn("_one", F.lit(1.0)), key, ts, "_one", tiebreak)
    r = null_safe_join(r, df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), [key])
    base, rem = F.floor(F.col("_n") / 3), F.col("_n") % 3
    big = rem * (base + 1)
    third = F.when(F.col("run_n") <= big, F.floor((F.col("run_n") - 1) / (base + 1)) + 1).otherwise(
        rem + F.floor((F.col("run_n") - big - 1) / base) + 1)
    a = r.withColumn("_third", third).groupBy(key).agg(
        F.avg(F.when(F.col("_third") == 1, F.col(value))).alias("f"), F.avg(F.when(F.col("_third") == 3, F.col(value))).alias("l"))
    return a.select(key, r6("f").alias("first_third_mean"), r6("l").alias("last_third_mean"),
                    r6(F.col("l") - F.col("f")).alias("shift"),
                    (F.signum(F.col("f") - middle) != F.signum(F.col("l") - middle)).cast("int").alias("crosses_middle"))


def max_in_lookback(df: DataFrame, key: str, ts: str, seconds: int = 60,
                    chunk_seconds: int = 3600) -> DataFrame:
    """Per key, the largest number of events in any window
    [t − seconds, t] ending at an event. Rows are split into (key, hour chunk)
    partitions; each chunk also receives the previous chunk's last ``seconds``
    as a halo, so every look-back is complete inside one bounded partition."""
    us = 1_000_000
    e = df.select(key, F.timestamp_diff("MICROSECOND", epoch_col(), F.col(ts)).alias("_t"))
    e = e.withColumn("_c", F.floor(F.col("_t") / F.lit(chunk_seconds * us)))
    halo = (e.filter(F.col("_t") >= (F.col("_c") + 1) * F.lit(chunk_seconds * us) - F.lit(seconds * us))
            .withColumn("_c", F.col("_c") + 1).withColumn("_h", F.lit(1)))
    allr = e.withColumn("_h", F.lit(0)).unionByName(halo)
    w = Window.partitionBy(key, "_c").orderBy("_t").rangeBetween(-seconds * us, 0)
    cnt = allr.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_h") == 0)
    return cnt.groupBy(key).agg(F.max("_n").alias("max_actions_per_window"))


def sessions(df: DataFrame, key: str, ts: str, gap_minutes: int = 30, tiebreak: str | None = None,
             chunk_seconds: int = 3600) -> DataFrame:
    """Activity sessions per key — an event at least ``gap_minutes``
    after the key's previous event starts a new session. Returns
    (key, session_start, session_end, n).

    No key is processed in one task: (1) an event starts a session iff its
    key's previous event (by time, then ``tiebreak``) is missing or ``gap``
    or more earlier — a ``lag`` inside (key, hour-chunk) partitions that also
    carry the previous chunk's last ``gap`` as a halo, so a previous event
    within the gap is always present; (2) the session number is the running count of starts, from
    the chunked running sum; (3) sessions are then plain groups."""
    us = 1_000_000
    gap = gap_minutes * 60 * us
    chunk = max(chunk_seconds * us, gap)
    tb = tiebreak or ts
    e = df.select(key, ts, F.col(tb).alias("_tb") if tiebreak else F.col(ts).alias("_tb"),
                  F.timestamp_diff("MICROSECOND", epoch_col(), F.col(ts)).alias("_t"))
    e = e.withColumn("_c", F.floor(F.col("_t") / F.lit(chunk)))
    halo = (e.filter(F.col("_t") >= (F.col("_c") + 1) * F.lit(chunk) - F.lit(gap))
            .withColumn("_c", F.col("_c") + 1).withColumn("_h", F.lit(1)))
    allr = e.withColumn("_h", F.lit(0)).unionByName(halo)
    w = Window.partitionBy(key, "_c").orderBy("_t", "_tb")
    prev = F.lag("_t").over(w)
    starts = (allr.withColumn("_start", F.when(prev.isNull() | (F.col("_t") - prev >= F.lit(gap)), 1.0)
                              .otherwise(0.0))
              .filter(F.col("_h") == 0).drop("_h", "_c"))
    run = chunked_running(starts, key, ts, "_start", "_tb", chunk_seconds)
    return (run.groupBy(key, F.col("run_sum").alias("_sid"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
            .select(key, "session_start", "session_end", "n"))


def equal_count_windows(df: DataFrame, key: str, ts: str, n: int, tiebreak: str) -> DataFrame:
    """Adaptive windows of ``n`` consecutive events per key (window id =
    (rank − 1) div n), with their time span. Ranks come from the chunked
    running count, so no key is ranked in a single task."""
    r = chunked_running(df.withColumn("_one", F.lit(1.0)), key, ts, "_one", tiebreak)
    r = r.withColumn("window_id", F.floor((F.col("run_n") - 1) / F.lit(n)))
    return r.groupBy(key, "window_id").agg(F.count(F.lit(1)).alias("n_events"),
                                           F.min(ts).alias("window_start"), F.max(ts).alias("window_end"))


def extrema_with_distance(marked: DataFrame, order: str, col: str, by: Sequence[str] = (),
                          distance: int = 7) -> DataFrame:
    """Extrema at least ``distance`` rows apart (``find_peaks(distance=…)``):
    per series, peaks are taken highest first (ties → earlier row) and any
    other peak closer than ``distance`` rows is dropped; troughs the same on
    −x. Input is the output of :func:`local_extrema`; only its extremum rows
    (a few per series) go through the greedy step, grouped per series."""
    import pandas as pd
    by = list(by)
    cand = marked.filter(F.col("is_peak") != 0).select(*by, "_i", F.col(col).cast("double").alias("_x"),
                                                        "is_peak")
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cand.schema.fields if f.name in by)
    schema = (key_schema + ", " if key_schema else "") + "_i long, kept int"

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for kind in (1, -1):
            sub = pdf[pdf["is_peak"] == kind]
            order_ = sorted(zip(sub["_x"] * kind, sub["_i"]), key=lambda t: (-t[0], t[1]))
            chosen = []
            for _v, i in order_:
                if all(abs(i - j) >= distance for j in chosen):
                    chosen.append(i)
            keep += [(i, kind) for i in chosen]
        out = pd.DataFrame(keep, columns=["_i", "kept"])
        for b in by:
            out.insert(0, b, pdf[b].iloc[0] if len(pdf) else None)
        return out[[*by, "_i", "kept"]]

    grouped = cand.groupBy(*by) if by else cand.groupBy(F.lit(0).alias("_one"))
    if not by:
        cand = cand.withColumn("_one", F.lit(0))
        kept = cand.groupBy("_one").applyInPandas(
            lambda p: greedy(p.drop(columns=["_one"])), "_i long, kept int")
    else:
        kept = grouped.applyInPandas(greedy, schema)
    out = null_safe_join(marked, kept, by + ["_i"], "left")
    return out.withColumn("is_peak_distance", F.coalesce("kept", F.lit(0)).cast("int")).drop("kept")
