"""Statistics of trades that all lose the same: what rounding leaves of their deviation is that of the SQL."""

import math
import random

import pytest

from candlewick.operators import backtest


def test_trades_that_all_stop_have_the_ratio_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    rows = []
    for symbol, n in (("A", 700), ("B", 33), ("C", 1), ("D", 2)):
        for k in range(n):
            entry = round(rng.uniform(900, 90000), 2)
            buy = rng.random() < 0.5
            stop = entry * (1 - 0.03) if buy else entry * (1 + 0.03)
            rows.append((symbol, 200 + 2 * k, (stop - entry if buy else entry - stop) / entry * 100, 1, "stop_loss"))
    rows += [("E", 200 + 5 * k, rng.choice([-3.0, 5.0, 0.0, None]), 4, "target") for k in range(200)] + [("F", 200 + 5 * k, -3.0, 4, "stop_loss") for k in range(9)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "symbol string, idx int, return_percent double, hold_days int, exit_reason string").repartition(5)
    got = {r.symbol: (r.mean_return, r.total_return, r.sharpe) for r in backtest.statistics(df).collect()}
    con = duckdb.connect()
    con.execute("create table t (symbol varchar, idx int, r double, hold int, why varchar)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", rows)
    want = {s: (a, b, c) for s, a, b, c in con.execute("""select symbol, avg(r), sum(r), case when count(*) < 2 or stddev_samp(r) = 0 then 0 else avg(r) / stddev_samp(r) * sqrt(252 / avg(hold)) end
        from (select * from t order by symbol, idx) group by 1""").fetchall()}
    assert got == want
    assert got["A"][2] < -1e15 and got["C"][2] == got["F"][2] == 0.0 and math.isfinite(got["E"][2])
