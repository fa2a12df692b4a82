"""Numeric helpers shared by operators and the oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_up(c: Column, scale: float) -> Column:
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def r6(c: Column | str) -> Column:
    """Report precision for divided values (means, shares, ratios).

    Written as plain IEEE operations — floor(x·10^9 + ½)/10^9, then the same at
    10^6 — so every engine gives bit-identical results; the first step absorbs
    summation-order noise (~1e-12) before the 6th-place rounding.
    """
    c = F.col(c) if isinstance(c, str) else c
    return _half_up(_half_up(c, 1e9), 1e6)


def sql_r6(expr: str) -> str:
    return f"(floor((floor(({expr}) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6)"


def r3(c: Column | str) -> Column:
    """Same as :func:`r6` at 3 places (percent labels)."""
    c = F.col(c) if isinstance(c, str) else c
    return _half_up(_half_up(c, 1e9), 1e3)


def sql_r3(expr: str) -> str:
    return f"(floor((floor(({expr}) * 1e9 + 0.5) / 1e9) * 1e3 + 0.5) / 1e3)"
