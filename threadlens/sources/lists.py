"""JSON list sources (A2, A3): target communities and flagged-user tiers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

DATA_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data")
TIERS = ("manual", "high_reciprocity", "medium_reciprocity", "low_reciprocity")


def _read(spark: SparkSession, path: str) -> dict:
    """A JSON list file: from the package folder or another local path by the driver
    (executors cannot see it), from any other store through Spark."""
    if "://" in path:
        rows = spark.read.text(path, wholetext=True).collect()   # one small file
        return json.loads(rows[0][0]) if rows else {}
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def community_list(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A2: ``{"subreddits": [...]}`` → one row per community. A missing key
    or file gives no rows."""
    names = _read(spark, path or os.path.join(DATA_DIR, "target_subreddits.json")).get("subreddits") or []
    return spark.createDataFrame([(str(n),) for n in names if n is not None], "community string")


def flagged_users(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A3: the four tier lists → (username, tier)."""
    tiers = _read(spark, path or os.path.join(DATA_DIR, "flagged_users.json"))
    return spark.createDataFrame([(str(n), t) for t in TIERS for n in tiers.get(t) or []], "username string, tier string")
