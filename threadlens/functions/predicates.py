"""Row predicates (inventory B). All are Column expressions so Catalyst can push
them into the parquet scan."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def date_range(col: str, start, end, end_inclusive_day: bool = False) -> Column:
    """B1: ``col BETWEEN start AND end``, both inclusive. A date ``end`` means
    midnight at the start of that day, as in the reference; with
    ``end_inclusive_day`` the whole last day is kept (``< end + 1 day``)."""
    c = F.col(col)
    if end_inclusive_day:
        return (c >= _ts(start)) & (c < _ts(end) + F.expr("INTERVAL 1 DAY"))
    return c.between(_ts(start), _ts(end))


def check_range(start, end, max_days: int | None = None) -> None:
    """Reject start > end, and spans longer than ``max_days``."""
    s = _dt.datetime.fromisoformat(str(start))
    e = _dt.datetime.fromisoformat(str(end))
    if s > e:
        raise ValueError("start date must not be after end date")
    if max_days is not None and (e - s) > _dt.timedelta(days=max_days):
        raise ValueError(f"date range must not exceed {max_days} days")


def in_communities(df: DataFrame, col: str, values: Sequence[str] | DataFrame | None,
                   empty: str = "all") -> DataFrame:
    """Keep rows whose ``col`` is in ``values``.

    ``values`` may be a Python list (an ``IN`` list, pushed to the scan) or a
    one-column DataFrame (semi join). An empty or missing list means no filter
    (``empty="all"``) or no rows (``empty="none"``).
    """
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)).distinct(),
                       col, "left_semi")
    if not values:
        if empty == "none":
            return df.limit(0)
        return df
    return df.filter(F.col(col).isin(list(values)))


def optional_eq(df: DataFrame, col: str, value) -> DataFrame:
    """``col = value`` only when a value is given ("All"/None → no filter)."""
    if value is None or value == "All":
        return df
    return df.filter(F.col(col) == F.lit(value))


# Authors the reference excludes from the network (exact names,
# plus any name containing this text, case-insensitive).
EXCLUDED_AUTHORS = ("None", "autotldr")
EXCLUDED_AUTHOR_SUBSTRING = "moderator"


def author_ok(col: str = "author") -> Column:
    """Not 'None', not 'autotldr', no 'moderator' in any case. NULL authors
    are dropped too (the SQL predicate is NULL for them)."""
    c = F.col(col)
    return (~F.lower(c).contains(EXCLUDED_AUTHOR_SUBSTRING)) & (~c.isin(*EXCLUDED_AUTHORS))


def pair_authors_ok(c1: str = "user1", c2: str = "user2") -> Column:
    """The same rule on both pair ends, NULL counted as not matching."""
    def one(c):
        x = F.col(c)
        return (~F.coalesce(F.lower(x).contains(EXCLUDED_AUTHOR_SUBSTRING), F.lit(False))
                & F.coalesce(~x.isin(*EXCLUDED_AUTHORS), F.lit(True)))
    return one(c1) & one(c2)


def content(title: str = "title", body: str = "self_text") -> Column:
    """``fillna('')`` title + ' ' + ``fillna('')`` body. ``concat_ws`` would
    drop the separator for NULLs, so plain ``concat``."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "),
                    F.coalesce(F.col(body), F.lit("")))


def sentiment_sign(col: str, pos: float = 0.05, neg: float = -0.05) -> Column:
    """Positive / negative / neutral at ±0.05."""
    c = F.col(col)
    return F.when(c >= pos, "positive").when(c <= neg, "negative").otherwise("neutral")
