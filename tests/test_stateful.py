"""Streams with state: answers expire, outcomes wait for their bars, alerts fire only while they live; all over restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlewick.operators import track
from candlewick.streaming import stateful, streams

T0 = dt.datetime(2024, 1, 1)


class Feed:
    """Batches of rows that arrive in a folder, and a stream over them that is stopped and started again."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/b={self.n}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")

    def run(self, df):
        with stateful.rocksdb(self.spark):
            q = streams.to_parquet(df, f"{self.path}/out", f"{self.path}/cp")
        q.awaitTermination()
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/out").collect()


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _answers(rows, life):
    held, out = {}, set()
    for kind, key, n, ts, value in sorted(rows, key=lambda r: (r[3], r[2])):
        have = held.get((kind, key))
        if have is None or ts >= have[0] + dt.timedelta(seconds=life[kind]):
            have = held[kind, key] = (ts, value)
            out.add((kind, key, n, value, ts, False))
        else:
            out.add((kind, key, n, have[1], have[0], True))
    return out


def test_answers_expire_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "kind string, key string, request_id long, ts timestamp, value double")
    life = {"a": 600, "b": 3600}
    rows = [(kind, f"k{k % 3}", n, _at(minutes), float(n)) for n, (kind, k, minutes) in enumerate((kind, k, 7 * k + shift) for kind, shift in (("a", 0), ("b", 3)) for k in range(60))]
    rows += [("a", "k0", 900, _at(0), -1.0), ("a", None, 901, _at(1), None), ("a", "end", 902, _at(2), 1.0), ("a", "end", 903, _at(12), 2.0)]  # ties, nulls, and a request at the very end
    rows.sort(key=lambda r: (r[3], r[2]))
    cut = len(rows) // 3
    before = spark.conf.get(stateful._PROVIDER, None)
    for part in (rows[:cut], rows[cut : 2 * cut]):
        feed.add(part)
    df = lambda: stateful.answered(feed.stream(), ttl=life)
    first = feed.run(df())
    assert len(first) == 2 * cut
    feed.add(rows[2 * cut :])
    got = {(r.kind, r.key, r.request_id, r.answer, r.cached_at, r.hit) for r in feed.run(df())}
    assert got == _answers(rows, life)
    assert spark.conf.get(stateful._PROVIDER, None) == before
    held = spark.read.format("statestore").option("stateVarName", "answer").load(f"{tmp_path}/cp").collect()
    end = max(r[3] for r in rows)
    live = {(r[0], r[1]) for r in _answers(rows, life) if r[4] + dt.timedelta(seconds=life[r[0]]) > end}
    assert {(r.key.kind, r.key.key) for r in held} == live


RECS = "symbol string, ts timestamp, close double, rec_id long, direction string, entry_price double, target_price double, stop_loss double"


def test_outcomes_go_from_pending_to_completed(spark, tmp_path):
    feed = Feed(spark, tmp_path, RECS)
    day = lambda d: T0 + dt.timedelta(days=d)
    bar = lambda s, d, close: (s, day(d), close, None, None, None, None, None)
    rec = lambda s, d, n, side: (s, day(d), None, n, side, 100.0, 105.0, 97.0)
    bars = [bar(s, d, 100.0 + (d * 7) % 13 - 5) for s in "AB" for d in range(0, 40) if d % 7 < 5]
    recs = [rec("A", 0, 1, "BUY"), rec("A", 3, 2, "SELL"), rec("B", 11, 3, "BUY"), rec("B", 11, 4, "HOLD"), rec("A", 38, 5, "SELL"), rec("C", 2, 6, "BUY")]
    rows = sorted(bars + recs, key=lambda r: (r[1], r[0], r[3] or 0))
    for a, b in ((0, 4), (4, 15), (15, 41)):
        feed.add([r for r in rows if day(a) <= r[1] < day(b)])
        got = feed.run(stateful.outcome_changes(feed.stream()))
        if b == 4:
            assert {(r.rec_id, r.horizon) for r in got if r.status == "completed"} == {(1, "1d")}
    table = spark.createDataFrame(recs, RECS).withColumn("created_at", F.col("ts").cast("date"))
    want = track.outcomes(table, spark.createDataFrame(bars, RECS).select("symbol", F.col("ts").cast("date").alias("bar_ts"), "close"))
    latest = stateful.latest_outcomes(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert {(r.rec_id, r.horizon, r.due.date(), r.seen and r.seen.date(), r.return_percent, r.profitable, r.hit_target, r.hit_stop, r.status) for r in latest} == {
        (r.rec_id, r.horizon, r.due, r.asof_bar_ts, r.return_percent, r.profitable, r.hit_target, r.hit_stop, r.status) for r in want.collect()}
    assert len(got) == len(latest) + sum(r.status == "completed" for r in latest)


def test_alerts_fire_while_they_live(spark, tmp_path):
    ticks = Feed(spark, tmp_path / "t", "symbol string, ts timestamp, tick_id long, price double")
    alerts = Feed(spark, tmp_path / "a", "alert_id string, symbol string, condition string, target_price double, percent_change double, status string, created_at timestamp, expires_at timestamp")
    alert = lambda n, a, b, kind="ABOVE", status="active": (n, "A", kind, 10.0, None, status, _at(a), None if b is None else _at(b))
    alerts.add([alert("always", 0, None), alert("short", 0, 20), alert("off", 0, None, status="cancelled"), alert("cross", 0, None, "CROSSES_ABOVE")])
    ticks.add([("A", _at(k), k, 5.0 + k) for k in range(0, 30, 5)] + [("B", _at(7), 7, 50.0)])
    alerts.add([alert("late", 40, 60), alert("never", 45, 45)])
    ticks.add([("A", _at(k), k, 3.0 if k == 50 else 20.0) for k in range(30, 80, 10)])
    got = {(r.alert_id, r.tick_id) for r in ticks.run(stateful.alert_hits(ticks.stream(), alerts.stream(), late="1 hour", most="1 day"))}
    above = [k for k in (10, 15, 20, 25, 30, 40, 60, 70)]
    assert got == {("always", k) for k in above} | {("short", 10), ("short", 15), ("late", 40), ("cross", 10), ("cross", 60)}


def test_alerts_end_after_their_longest_life(spark, tmp_path):
    ticks = Feed(spark, tmp_path / "t", "symbol string, ts timestamp, tick_id long, price double")
    alerts = Feed(spark, tmp_path / "a", "alert_id string, symbol string, condition string, target_price double, percent_change double, status string, created_at timestamp, expires_at timestamp")
    alerts.add([("x", "A", "ABOVE", 1.0, None, "active", _at(0), None)])
    ticks.add([("A", _at(m), m, 2.0) for m in (0, 59, 60, 61)])
    assert {r.tick_id for r in ticks.run(stateful.alert_hits(ticks.stream(), alerts.stream(), most="1 hour"))} == {0, 59, 60}


@pytest.mark.parametrize("rows", [[], [("a", "k", 1, None, 1.0)]])
def test_nothing_to_answer(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path, "kind string, key string, request_id long, ts timestamp, value double")
    feed.add(rows)
    assert feed.run(stateful.answered(feed.stream())) == []
