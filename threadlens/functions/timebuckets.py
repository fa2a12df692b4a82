"""Calendar buckets (E1) as timestamp_ntz labels, matching pandas
``resample``/``Grouper`` labels:

* fixed widths (1 s, 1 min, 5 min, 1 h, 1 day): bucket start, aligned to UTC
  midnight — ``window(ts, width).start``;
* ``W``: Monday–Sunday weeks labelled by their Sunday (pandas 'W' = 'W-SUN',
  closed/labelled right at whole days). ``window(ts,'7 days')`` is
  Thursday-aligned and is not used;
* ``M``: calendar months labelled by the month's last day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED = {
    "1S": "1 second", "1s": "1 second", "1min": "1 minute", "5min": "5 minutes",
    "1h": "1 hour", "1H": "1 hour", "1D": "1 day", "D": "1 day",
}
FIXED_SECONDS = {"1 second": 1, "1 minute": 60, "5 minutes": 300, "1 hour": 3600,
                 "1 day": 86400}


def _epoch_col():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def bucket(ts: str | Column, freq: str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    if freq in FIXED:
        # floor(seconds since epoch / width) * width, all on timestamp_ntz: no
        # time-zone conversion and usable several times in one projection.
        w = FIXED_SECONDS[FIXED[freq]]
        secs = F.floor(F.timestamp_diff("SECOND", _epoch_col(), c) / F.lit(w)) * F.lit(w)
        return F.timestamp_add("SECOND", secs, _epoch_col())
    d = F.to_date(c)
    if freq in ("W", "1W", "W-SUN"):
        return F.next_day(F.date_sub(d, 1), "Sun").cast("timestamp_ntz")
    if freq in ("M", "1M", "ME"):
        return F.last_day(d).cast("timestamp_ntz")
    raise ValueError(f"unsupported frequency {freq}")


def bucket_end(label: str | Column, freq: str) -> Column:
    """Exclusive end of the bucket that ``label`` names."""
    c = F.col(label) if isinstance(label, str) else label
    if freq in FIXED:
        return c + F.expr(f"INTERVAL {FIXED_SECONDS[FIXED[freq]]} SECONDS")
    if freq in ("W", "1W", "W-SUN"):
        return c + F.expr("INTERVAL 1 DAY")
    return c + F.expr("INTERVAL 1 DAY")


def nth_label(first: Column, i: Column, freq: str) -> Column:
    """Label of the i-th bucket after ``first`` (spine generation)."""
    if freq in FIXED:
        secs = FIXED_SECONDS[FIXED[freq]]
        return F.timestamp_add("SECOND", i * F.lit(secs), first)
    if freq in ("W", "1W", "W-SUN"):
        return first + F.make_dt_interval(days=(i * F.lit(7)).cast("int"))
    return F.last_day(F.add_months(F.to_date(first), i.cast("int"))).cast("timestamp_ntz")


def n_buckets(first, last, freq: str) -> int:
    """Number of labels from ``first`` to ``last`` inclusive (Python values)."""
    if freq in FIXED:
        return int((last - first).total_seconds() // FIXED_SECONDS[FIXED[freq]]) + 1
    if freq in ("W", "1W", "W-SUN"):
        return (last - first).days // 7 + 1
    return (last.year - first.year) * 12 + (last.month - first.month) + 1


# DuckDB forms of the same labels, for the oracle SQL.
def sql_bucket(ts: str, freq: str) -> str:
    if freq in FIXED:
        return f"time_bucket(INTERVAL '{FIXED[freq]}', {ts})"
    if freq in ("W", "1W", "W-SUN"):
        return f"CAST(CAST({ts} AS DATE) + CAST((7 - isodow({ts})) % 7 AS INTEGER) AS TIMESTAMP)"
    return f"CAST(last_day(CAST({ts} AS DATE)) AS TIMESTAMP)"
