"""Streams over several micro-batches and restarts: late rows, replays, state that is let go."""

from __future__ import annotations

import datetime as dt
import statistics

import pytest

from threadlens.streaming import jobs as S

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts string"


class Landing:
    """Rows (key, minutes after START) landed in turns; each turn the stream is started anew."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.turn = spark, str(tmp_path / "land"), 0
        self.out, self.ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def add(self, rows, run):
        stamped = [(k, START + dt.timedelta(minutes=m)) for k, m in rows]
        S.land_json(self.spark.createDataFrame(stamped, "key string, ts timestamp_ntz"), f"{self.path}/{self.turn}", 2)
        self.turn += 1
        run(S.read_landing(self.spark, f"{self.path}/*", SCHEMA, "ts"))

    def state(self, **options):
        return self.spark.read.format("statestore").options(**options).load(self.ckpt)


@pytest.fixture
def land(spark, tmp_path):
    return Landing(spark, tmp_path)


def minutes(t):
    return (t - START).total_seconds() / 60


def test_window_counts_update_and_let_go(spark, land):
    keys, schema = ["window_start", "key"], "window_start timestamp, key string, n long"
    run = lambda s: S.stream_window_counts(s, "ts", "key", "5 minutes", None, land.out, land.ckpt)
    told = lambda: {(r.key, minutes(r.window_start)): r.n for r in S.read_latest(spark, land.out, keys, schema).collect()}
    assert S.read_latest(spark, land.out, keys, schema).collect() == []
    land.add([("a", 0), ("a", 1), ("b", 12)], run)
    assert told() == {("a", 0): 2, ("b", 10): 1}
    land.add([("a", 4), ("a", 13), ("b", 40)], run)     # the first is out of order, but not too late
    assert told() == {("a", 0): 3, ("b", 10): 1, ("a", 10): 1, ("b", 40): 1}
    land.add([("a", 2), ("a", 41)], run)                # the watermark is at 30: minute 2 is too late
    assert told() == {("a", 0): 3, ("b", 10): 1, ("a", 10): 1, ("b", 40): 1, ("a", 40): 1}
    assert land.state().count() == 2                    # windows from minute 30 on only
    last = spark.read.parquet(land.out).agg({"batch_id": "max"}).first()[0]
    again = spark.read.parquet(f"{land.out}/batch_id={last}").collect()
    S._batch_sink(land.out)(spark.createDataFrame(again, schema), last)     # a replayed batch changes nothing
    before = told()
    S.compact_latest(spark, land.out, keys, schema, land.out + "-small")
    compact = spark.read.parquet(land.out + "-small")
    assert before == told() and compact.count() == len(before)


def test_sessions_grow_over_batches(spark, land):
    run = lambda s: S.stream_sessions(s, "ts", "key", "30 minutes", land.out, land.ckpt)
    rows = lambda df: {(r.key, minutes(r.session_start), minutes(r.session_end), r.n) for r in df.collect()}
    land.add([("a", 0), ("a", 20), ("b", 5), ("a", 75)], run)
    assert rows(S.open_sessions(spark, land.ckpt, "key")) == {("a", 0, 20, 2), ("b", 5, 5, 1), ("a", 75, 75, 1)}
    land.add([("a", 47), ("b", 100)], run)              # joins a's two sessions
    assert rows(S.open_sessions(spark, land.ckpt, "key")) >= {("a", 0, 75, 4), ("b", 100, 100, 1)}
    land.add([("c", 400)], run)
    assert rows(spark.read.parquet(land.out)) == {("a", 0, 75, 4), ("b", 5, 5, 1), ("b", 100, 100, 1)}
    assert rows(S.open_sessions(spark, land.ckpt, "key")) == {("c", 400, 400, 1)}


def expected_alerts(counts, k, min_history, idle):
    """(key, hour, n, alert) from {key: {hour: n}}, hours ascending."""
    out = set()
    for key, windows in counts.items():
        past, last = [], None
        for hour, n in sorted(windows.items()):
            if last is not None and hour - last >= idle:
                past = []
            std = statistics.stdev(past) if len(past) > 1 else 0.0
            out.add((key, hour, n, int(len(past) >= min_history and n > statistics.fmean(past) + k * std + 1e-9)))
            past.append(n)
            last = hour + 1
    return out


def test_alert_state_restarts_and_expires(spark, land):
    run = lambda s: S.stream_alerts(s, "ts", "key", "1 hour", land.out, land.ckpt, k=2.0, min_history=3, idle="10 hours")
    a = {0: 2, 1: 3, 2: 2, 3: 9, 5: 2, 18: 30, 19: 2}       # 12 idle hours before hour 18: a new start
    b = {h: 1 + h % 2 for h in range(0, 20)} | {20: 8}
    every = sorted((h, key, i) for key, w in (("a", a), ("b", b)) for h, n in w.items() for i in range(n))
    cuts = [0, 20, 21, len(every) // 2, len(every)]
    for lo, hi in zip(cuts, cuts[1:]):
        land.add([(key, 60 * h + i) for h, key, i in every[lo:hi]], run)
    land.add([("end", 60 * 22 + 15)], run)                  # closes all hours before 22
    told = {(r.key, minutes(r.window_start) / 60, r.n, r.alert) for r in spark.read.parquet(land.out).collect()}
    assert told == expected_alerts({"a": a, "b": b}, 2.0, 3, 10)
    assert ("a", 3, 9, 1) in told and ("a", 18, 30, 0) in told and ("b", 20, 8, 1) in told
    known = lambda: {r["key"]["key"] for r in land.state(stateVarName="baseline").collect()}
    assert known() == {"a", "b"}
    land.add([("end", 60 * 100)], run)                      # both keys are idle for longer than 10 hours
    assert known() <= {"end"}
