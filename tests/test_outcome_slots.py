"""The open recommendations of one symbol are many groups of a stream's state, each stored by the batch."""

import datetime as dt

from pyspark.sql import functions as F

from candlewick.operators import track
from candlewick.streaming import stateful, streams

T0 = dt.datetime(2024, 1, 1)
ROWS = "symbol string, ts timestamp, close double, rec_id long, direction string, entry_price double, target_price double, stop_loss double"


def test_one_symbol_is_many_groups(spark, tmp_path):
    day = lambda d: T0 + dt.timedelta(days=d)
    bars = [("A", day(d), 90.0 + (d * 7) % 23, None, None, None, None, None) for d in range(0, 30) if d % 7 < 5]
    recs = [("A", day(k % 28), None, k, ("BUY", "SELL")[k % 2], 100.0, None if k % 5 == 0 else 105.0, 97.0) for k in range(400)]
    for b, (low, high) in enumerate(((0, 10), (10, 30))):
        part = [r for r in bars + recs if day(low) <= r[1] < day(high)]
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/b={b}")
        df = stateful.outcome_changes(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), slots=8)
        with stateful.rocksdb(spark):
            running = streams.to_parquet(df, f"{tmp_path}/out", f"{tmp_path}/cp")
        running.awaitTermination()
    got = stateful.latest_outcomes(spark.read.schema(df.schema).parquet(f"{tmp_path}/out"))
    table = spark.createDataFrame(recs, ROWS).withColumn("created_at", F.col("ts").cast("date"))
    want = track.outcomes(table, spark.createDataFrame(bars, ROWS).select("symbol", F.col("ts").cast("date").alias("bar_ts"), "close"))
    key = lambda r, seen: (r.rec_id, r.horizon, seen, r.return_percent, r.profitable, r.hit_target, r.hit_stop, r.status)
    assert {key(r, r.seen and r.seen.date()) for r in got.collect()} == {key(r, r.asof_bar_ts) for r in want.collect()}
    pending = {r.rec_id for r in got.filter("status = 'pending'").collect()}
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/cp").collect()
    assert len({r.key.slot for r in held}) == len(held) == 8 and 8 < len(pending)  # one value for each slot, not one for each recommendation


def test_large_states_are_several_values():
    import pandas as pd

    frame = pd.DataFrame({"at": range(stateful.CHUNK + 1), "close": 1.0})
    values = stateful._packed(frame, stateful._BAR_TYPES)
    assert len(values) == 2

    class State:
        exists = staticmethod(lambda: True)
        get = staticmethod(lambda: iter(values))

    assert stateful._unpacked(State, stateful._BAR_TYPES)["at"].tolist() == list(range(stateful.CHUNK + 1))
