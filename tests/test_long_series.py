"""Chunks give what whole series give: scans, windows, running folds and chains of trades."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions import recursive as rec
from candlewick.operators import indicators as ind
from candlewick.operators import long_series


def _bars(spark, symbols):
    rng = np.random.default_rng(8)
    frames = []
    for symbol, n in symbols.items():
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        high, low = close + rng.random(n), close - rng.random(n)
        frames.append(pd.DataFrame({"symbol": symbol, "bar_ts": pd.date_range("2000-01-01", periods=n, freq="min"), "open": close, "high": high, "low": low, "close": close, "volume": rng.integers(1, 1000, n).astype(float), "chunk_note": "x"}))
    return spark.createDataFrame(pd.concat(frames)).repartition(5)


def _same(a, b, columns):
    a, b = (df.select("symbol", "bar_ts", *columns).toPandas().sort_values(["symbol", "bar_ts"]).reset_index(drop=True) for df in (a, b))
    assert len(a) == len(b)
    for c in columns:
        x, y = a[c].to_numpy(float), b[c].to_numpy(float)
        np.testing.assert_allclose(x, y, rtol=1e-7, atol=1e-6, err_msg=c)


@pytest.mark.parametrize("seeded", [False, True])
def test_means_of_pieces_are_means_of_the_whole(seeded):
    rng = np.random.default_rng(5)
    for n in (0, 1, 13, 14, 40, 300):
        x = rng.normal(size=n)
        x[rng.random(n) < 0.2] = np.nan
        m = long_series.wilder("x", 14, seeded)
        whole = rec.seeded_wilder(x, 14) if seeded else rec.wilder(x, 14)
        if not seeded:
            whole = np.where(np.isnan(x), np.nan, whole)
        out, seen, y = [], 0, 0.0
        for part in np.array_split(x, 7):
            slope = m.run(np.where(np.isnan(part), np.nan, 0.0), seen, 1.0)[2]
            summand = m.run(part, seen, 0.0)[2]
            found, after, end = m.run(part, seen, y)
            assert np.isclose(end, slope * y + summand)  # the piece's map tells its end without its start
            out.append(found)
            seen, y = after, end
        np.testing.assert_allclose(np.concatenate(out), whole, rtol=1e-9)


def test_recursive_and_windowed_of_a_long_series(spark):
    bars = _bars(spark, {"L": 6000, "S": 70, "T": 1})
    _same(long_series.recursive(bars, 500), rec.recursive(bars), long_series.COLUMNS)
    names = ["wma_50", "sma_200", "aroon_up", "aroon_down", "senkou_b", "stoch_d", "hma_16", "kst_signal", "ulcer_14", "obv", "ad", "vwap", "vpt", "nvi", "volume_ratio", "lag_10", "eom_sma_14"]
    _same(long_series.windowed(bars, 500), ind.windowed(bars), names)


def test_a_long_series_is_many_tasks(spark):
    bars = long_series.numbered(_bars(spark, {"L": 200_000}), 10_000)
    assert bars.select("chunk").distinct().count() == 20 and bars.agg(F.max("idx")).first()[0] == 199_999
    assert bars.groupBy("chunk").count().filter("count <> 10000").isEmpty()
    scanned = long_series.scanned(bars, {"ema_9": long_series.ema("close", 9)})
    seen = scanned.select("chunk", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(seen) == 20 and len({r.task for r in seen}) > 1  # one symbol, several tasks
    _same(scanned, rec.recursive(_bars(spark, {"L": 200_000})), ["ema_9"])


def test_no_bars(spark):
    none = _bars(spark, {"L": 60}).filter("false")
    assert long_series.recursive(none).count() == 0 and long_series.windowed(none).count() == 0


def test_jumps_choose_what_a_scan_chooses(spark):
    rng = random.Random(3)
    rows = []
    for s in "AB":
        rows += [(s, i, rng.randint(1, 20)) for i in sorted(rng.sample(range(5000), 700))]
    rows += [("C", 7, 3)]
    want, free = set(), {}
    for s, i, hold in sorted(rows):
        if i >= free.get(s, 0):
            want.add((s, i))
            free[s] = i + hold + 1
    for chunk in (50, 100_000):
        got = long_series.chosen(spark.createDataFrame(rows, "symbol string, idx int, hold_days int").repartition(4), chunk)
        assert {(r.symbol, r.idx) for r in got.collect()} == want
    assert long_series.chosen(spark.createDataFrame([], "symbol string, idx int, hold_days int")).count() == 0


def test_drawdowns(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.uniform(-5, 5)) for s in "AB" for i in range(0, 900, 3)]
    got = {r.symbol: (r.total_return, r.max_drawdown) for r in long_series.drawdowns(spark.createDataFrame(rows, "symbol string, idx int, return_percent double"), 100).collect()}
    for s in "AB":
        equity = np.cumsum([x for t, _, x in rows if t == s])
        assert np.allclose(got[s], (equity[-1], (np.maximum(np.maximum.accumulate(equity), 0) - equity).max()))
