"""Rows with a NULL key are a group of their own, as SQL's PARTITION BY has it: results must equal
those of the same rows under a key that nobody else has."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import ml, timeseries as TS

OTHER = "zz"


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    out = [(rnd.choice(["a", "b", None]), start + dt.timedelta(minutes=rnd.randrange(0, 3000)), float(rnd.randrange(9)), i)
           for i in range(240)]
    return spark.createDataFrame(out, "key string, ts timestamp_ntz, x double, id long").coalesce(2).cache()


@pytest.fixture(scope="module")
def series(rows):
    s = rows.groupBy("key", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("day")).agg(F.sum("x").alias("x"))
    return s.cache()


def extrema(s):
    return TS.local_extrema(s, "day", "x", ["key"])


CASES = {
    "D7": ("rows", lambda d: TS.keyed_zero_filled_counts(d, "key", "ts", "1h")),
    "E10": ("series", lambda d: extrema(d)),
    "E11": ("series", lambda d: TS.extrema_with_distance(extrema(d), "day", "x", ["key"], 3)),
    "E12": ("series", lambda d: TS.auc_segments(extrema(d), "day", "x", ["key"])),
    "E13": ("series", lambda d: TS.auc_labels(d, TS.auc_segments(extrema(d), "day", "x", ["key"]), "day", 0.5, 0.2, ["key"])),
    "E14": ("series", lambda d: TS.zscore_flags(d, "x", 1.0, ["key"])),
    "E21": ("rows", lambda d: TS.chunked_running(d, "key", "ts", "x", "id")),
    "E26": ("rows", lambda d: TS.sessions(d, "key", "ts", 30, "id")),
    "E27": ("rows", lambda d: TS.equal_count_windows(d, "key", "ts", 7, "id")),
    "K7": ("rows", lambda d: ml.isolation_forest(d, "id", ["x"], n_trees=5, sample=16, group="key")),
}


@pytest.mark.parametrize("name", CASES)
def test_null_key_is_a_group(request, name):
    source, run = CASES[name]
    df = request.getfixturevalue(source)
    got = run(df)
    want = run(df.fillna(OTHER, subset=["key"]))
    back = sorted((tuple(None if v == OTHER else v for v in r) for r in want.select(got.columns).collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == back
    assert any(r[got.columns.index("key")] is None for r in back)


def test_reconstruction_error_of_unusable_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(50, None), (51, [float("nan")] * 4)]
    df = ml.vectors(spark.createDataFrame(rows, "id int, v array<double>"), "v")
    got = {r.id: (r.recon_error, r.is_anomaly) for r in ml.reconstruction_error(df, "features", 2).collect()}
    assert len(got) == 52 and got[50] == got[51] == (None, 0) and sum(f for _, f in got.values()) >= 1
