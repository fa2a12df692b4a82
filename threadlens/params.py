"""User thresholds and defaults (one frozen object passed to every job)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # co-engagement graph
    min_shared: int = 2            # HAVING COUNT(*) >= n
    min_user_score: float = 10.0   # users kept in the weighted graph
    pair_chunk_users: int = 2048   # users per tile of a hot thread (salting)
    # score histogram
    num_bins: int = 26
    iqr_multiplier: float = 1.5
    # time series
    rolling_rows: int = 7
    zscore_threshold: float = 2.0
    burst_k: float = 2.0
    session_gap_minutes: int = 30
    # text
    sentiment_pos: float = 0.05
    sentiment_neg: float = -0.05
    # ranking
    listing_limit: int = 1000
    top_users: int = 100
    # share of answered targets for the reciprocity tiers
    high_reciprocity: float = 0.75
    medium_reciprocity: float = 0.5
    low_reciprocity: float = 0.25
    # network guard
    max_span_days: int = 30


DEFAULT = Params()
