"""Candles, recursive filters, sentiment, rules and edge cases against hand-made inputs and plain loops."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.functions.recursive import recursive_columns
from candlewick.operators import alerts, backtest, market, patterns, scoring, text, track
from candlewick.operators import indicators as ind
from candlewick.plans import analysis
from candlewick.schemas import BARS
from candlewick.sources import bars as src

DAY = dt.date(2024, 1, 1)


def _bars(spark, candles, symbol="S", volume=1000.0):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(days=k), *map(float, c), volume) for k, c in enumerate(candles)], BARS)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(42)
    close = 100 + np.cumsum(rng.normal(0, 2, 320)) + 100
    open_ = np.concatenate(([close[0]], close[:-1])) + rng.normal(0, 0.5, 320)
    high, low = np.maximum(open_, close) + rng.random(320), np.minimum(open_, close) - rng.random(320)
    return pd.DataFrame({"symbol": "S", "bar_ts": [DAY + dt.timedelta(days=k) for k in range(320)], "open": open_, "high": high, "low": low, "close": close, "volume": rng.uniform(1e6, 5e6, 320).round()})


@pytest.fixture(scope="module")
def series(spark, walk):
    return analysis.indicator_series(spark.createDataFrame(walk, BARS)).toPandas().sort_values("bar_ts").reset_index(drop=True)


FLAT = [(10, 11, 9, 10.5)] * 2


@pytest.mark.parametrize("candles, name", [
    ([*FLAT, (100, 105, 95, 100.2)], "doji"),
    ([(12, 12.2, 10.8, 11), (11, 11.2, 10.8, 10.9), (10, 10.32, 9, 10.3)], "hammer"),
    ([(10, 11, 9.9, 11), (11, 12, 10.9, 12), (12, 12.32, 11, 12.3)], "hanging_man"),
    ([(12, 12.2, 10.8, 11), (11, 11.2, 10.8, 10.9), (10, 11.3, 9.98, 10.3)], "inverted_hammer"),
    ([(10, 11, 9.9, 11), (11, 12, 10.9, 12), (12, 13.3, 11.98, 12.3)], "shooting_star"),
    ([*FLAT, (10, 11, 9, 10.2)], "spinning_top"),
    ([*FLAT, (12, 12.5, 10.5, 11), (10.8, 13, 10.7, 12.5)], "bullish_engulfing"),
    ([*FLAT, (11, 12.5, 10.5, 12), (12.2, 12.5, 10, 10.5)], "bearish_engulfing"),
    ([*FLAT, (12, 12.5, 9.8, 10), (9.8, 11.6, 9.7, 11.5)], "piercing_line"),
    ([*FLAT, (10, 12.2, 9.8, 12), (12.2, 12.3, 10.3, 10.5)], "dark_cloud_cover"),
    ([*FLAT, (10, 14.2, 9.8, 14), (13, 13.5, 11, 12)], "harami"),
    ([*FLAT, (14, 14.2, 9.8, 10), (9.8, 10.2, 9.5, 10), (10.2, 13.2, 10, 13)], "morning_star"),
    ([*FLAT, (10, 14.2, 9.8, 14), (14.2, 14.6, 14, 14.3), (13.8, 14, 10.8, 11)], "evening_star"),
    ([*FLAT, (10, 11.2, 9.9, 11), (10.5, 12.2, 10.4, 12), (11.5, 13.2, 11.4, 13)], "three_white_soldiers"),
    ([*FLAT, (13, 13.1, 11.9, 12), (12.5, 12.6, 10.9, 11), (11.5, 11.6, 9.9, 10)], "three_black_crows"),
    ([(10, 20.5, 9.8, 20), (19, 19.5, 17.5, 18), (18, 18.5, 16.5, 17), (17, 17.5, 15.5, 16), (16, 22, 15.8, 21)], "rising_three_methods"),
    ([(20, 20.2, 9.5, 10), (11, 12.5, 10.5, 12), (12, 13.5, 11.5, 13), (13, 14.5, 12.5, 14), (14, 14.2, 8, 9)], "falling_three_methods"),
])
def test_patterns(spark, candles, name):
    events = patterns.detected(_bars(spark, candles)).collect()
    last = DAY + dt.timedelta(days=len(candles) - 1)
    assert name in {e.pattern for e in events if e.bar_ts == last}
    assert all(0 <= e.score <= 100 and e.direction == patterns.KINDS[e.pattern][1] for e in events)


def test_patterns_need_three_bars_and_restart_in_the_tail(spark):
    assert patterns.detected(_bars(spark, [(100, 105, 95, 100.2)] * 2)).count() == 0
    assert patterns.detected(_bars(spark, [(100, 105, 95, 100.2)] * 60)).select("bar_ts").distinct().count() == 50
    summary = patterns.summary(patterns.recent(patterns.detected(_bars(spark, [(100, 105, 95, 100.2)] * 20)), _bars(spark, [(100, 105, 95, 100.2)] * 20))).first()
    assert summary.latest_signal == "indecision" and summary.indecision >= 6


def test_rolling_indicators_equal_pandas(series, walk):
    c = walk["close"]
    want = {"sma_20": c.rolling(20).mean(), "bb_upper": c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0), "vol_10": (c.pct_change() * 100).rolling(10).std(), "ret_5": c.pct_change(5) * 100}
    low, high = walk["low"].rolling(14).min(), walk["high"].rolling(14).max()
    want |= {"stoch_k": 100 * (c - low) / (high - low), "williams_r": -100 * (high - c) / (high - low), "obv": (np.sign(c.diff()).fillna(0) * walk["volume"]).cumsum(), "wma_10": c.rolling(10).apply(lambda x: (x * np.arange(1, 11)).sum() / 55, raw=True)}
    tp = (walk["high"] + walk["low"] + c) / 3
    want["cci_20"] = (tp - tp.rolling(20).mean()) / (0.015 * tp.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True))
    for name, w in want.items():
        np.testing.assert_allclose(series[name].astype(float), w, rtol=1e-9, atol=1e-9, err_msg=name)


def test_recursive_indicators_equal_pandas(series, walk):
    c = walk["close"]
    ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
    macd = ema(c, 12) - ema(c, 26)
    d = c.diff().fillna(0)
    up, down = (s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for s in (d.clip(lower=0), -d.clip(upper=0)))
    for name, w in {"ema_9": ema(c, 9), "macd": macd, "macd_signal": ema(macd.dropna(), 9).reindex(c.index), "rsi_14": 100 - 100 / (1 + up / down)}.items():
        np.testing.assert_allclose(series[name].astype(float), w, rtol=1e-9, err_msg=name)


def test_invariants(series):
    s = series.dropna(subset=["rsi_14", "bb_upper", "atr_wilder_14", "adx"])
    assert len(s) > 250 and s["rsi_14"].between(0, 100).all() and (s["bb_upper"] >= s["bb_lower"]).all() and (s["atr_wilder_14"] > 0).all() and s["adx"].between(0, 100).all()
    s = s[s["psar_up"] == s["psar_up"].shift(1)]  # not where the stop turns
    assert (np.where(s["psar_up"].astype(bool), s["low"] - s["psar"], s["psar"] - s["high"]).astype(float) >= -1e-9).all()
    assert series["sma_20"].isna().sum() == 19 and series["ema_50"].isna().sum() == 49


def test_short_flat_and_empty_series(spark):
    flat = _bars(spark, [(10, 10, 10, 10)] * 60, volume=0.0)
    row = analysis.indicator_record(flat).first()
    assert row.stoch_k is None and row.cci_20 is None and row.rsi_14 == 100.0 and row.vwap is None
    assert analysis.indicator_record(_bars(spark, [(10, 11, 9, 10)] * 10)).count() == 0
    assert analysis.analysed(flat.filter("false")).count() == 0
    assert len(recursive_columns(flat.limit(1).toPandas())) == 1


def _trades(df):
    """The backtest as a plain loop over one symbol's rows."""
    rows, out, i = df.to_dict("records"), [], backtest.START
    while i < len(rows) - 1:
        r = rows[i]
        ratios = {}
        for side in ("BUY", "SELL"):
            b = side == "BUY"
            known = lambda *v: all(x is not None and x == x for x in v)
            checks = []
            if known(r["rsi_14"]):
                checks.append(r["rsi_14"] < 70 if b else r["rsi_14"] > 30)
            if known(r["macd"], r["macd_signal"]):
                checks.append(r["macd"] > r["macd_signal"] if b else r["macd"] < r["macd_signal"])
            if known(r["sma_20"], r["sma_50"]):
                checks.append(r["close"] > r["sma_20"] or r["close"] > r["sma_50"] if b else r["close"] < r["sma_20"] or r["close"] < r["sma_50"])
            if known(r["stoch_k"]):
                checks.append(r["stoch_k"] < 80 if b else r["stoch_k"] > 20)
            if known(r["volume_ratio"]):
                checks.append(r["volume_ratio"] >= 0.7)
            ratios[side] = sum(checks) / len(checks) if len(checks) >= 3 else 0
        side = "BUY" if ratios["BUY"] >= 0.7 else "SELL" if ratios["SELL"] >= 0.7 else None
        if side is None:
            i += 1
            continue
        b, entry = side == "BUY", r["close"]
        stop, goal = (entry * 0.97, entry * 1.05) if b else (entry * 1.03, entry * 0.95)
        for hold, x in enumerate(rows[i + 1 : i + 21], 1):
            if (x["low"] <= stop) if b else (x["high"] >= stop):
                price, why = stop, "stop_loss"
                break
            if (x["high"] >= goal) if b else (x["low"] <= goal):
                price, why = goal, "target"
                break
        else:
            price, why = x["close"], "time_exit"
        out.append((i, side, round(price, 6), hold, why))
        i += hold + 1
    return out


def test_backtest_equals_a_plain_loop(spark, walk, series):
    trades, stats = analysis.backtested(spark.createDataFrame(walk, BARS))
    got = [(r.idx, r.direction, round(r.exit_price, 6), r.hold_days, r.exit_reason) for r in trades.orderBy("idx").collect()]
    assert got == _trades(series) and got
    s, returns = stats.first(), [r.return_percent for r in trades.orderBy("idx").collect()]
    equity = np.cumsum(returns)
    assert s.trades == len(returns) and s.max_drawdown == pytest.approx((np.maximum(np.maximum.accumulate(equity), 0) - equity).max())
    assert s.mean_return == pytest.approx(np.mean(returns)) and s.n_stop_loss + s.n_target + s.n_time_exit == s.trades


LEX = text.Lexicon(positive={"gain": 1.0, "strong": 0.8, "stable": 0.5}, negative={"loss": 1.0, "weak": 0.7}, neutral=frozenset({"trade"}), negations=frozenset({"not", "never"}), bigrams={"record high": 1.5, "sharp fall": -1.2}, modifiers={"very": 1.5, "slightly": 0.5})


def _sentiment(t):
    w = re.findall(r"\b[\w']+\b", (t or "").lower())
    values, used = [], set()
    negated = lambda i: any(x in LEX.negations for x in w[max(0, i - 3) : i])
    for i in range(len(w) - 1):
        b = LEX.bigrams.get(f"{w[i]} {w[i + 1]}")
        if b:
            values.append(b * (LEX.modifiers.get(w[i - 1], 1.0) if i else 1.0) * (-1 if negated(i) else 1))
            used |= {i, i + 1}
    n = len(values)
    for i, x in enumerate(w):
        if i in used or not (x in LEX.positive or x in LEX.negative or x in LEX.neutral):
            continue
        v = LEX.positive.get(x) or -LEX.negative.get(x, 0.0)
        m = LEX.modifiers.get(w[i - 1], 1.0) if i and i - 1 not in used else 1.0
        values.append(v * m * (-1 if negated(i) else 1))
        n += 1
    p, q = sum(v for v in values if v > 0), -sum(v for v in values if v < 0)
    return (p - q) / (p + q) if p + q else 0.0, min(np.log(1 + n) / np.log(21), 1.0)


def test_sentiment_equals_a_plain_loop(spark):
    rng = random.Random(3)
    bits = ["gain", "strong", "stable", "loss", "weak", "trade", "not", "never", "record", "high", "sharp", "fall", "very", "slightly", "the", "don't", "x"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for k in range(300)] + [(300, None), (301, ""), (302, "Not GAIN!")]
    for r in text.scored(spark.createDataFrame(rows, "id long, t string"), "t", LEX).collect():
        score, confidence = _sentiment(r.t)
        assert r.sentiment.score == pytest.approx(score, abs=6e-4) and r.sentiment.confidence == pytest.approx(confidence, abs=6e-4), r.t
    labels = dict(text.scored(spark.createDataFrame([("strong gain",), ("heavy loss",), ("nothing",)], "t string"), "t", LEX).select("t", "sentiment.label").collect())
    assert labels == {"strong gain": "positive", "heavy loss": "negative", "nothing": "neutral"}


def test_keep_first_and_similar_titles(spark):
    rows = [(1, "A b c d e", "u1", "q"), (2, "a B c d e", "u2", "q"), (3, "other words here", "u1", "q"), (4, "new thing entirely", "u4", "q"), (5, "", "u5", "q"), (6, None, "u6", "q"), (7, "a b c d e f", "u7", "q")]
    df = spark.createDataFrame(rows, "article_id long, title string, url string, query string")
    assert {r.article_id for r in text.keep_first(df, "query").collect()} >= {1, 4} and not {2, 3, 7} & {r.article_id for r in text.keep_first(df, "query").collect()}
    assert [(r.a, r.b) for r in text.similar_titles(df).collect()] == [(1, 7)]


@pytest.mark.parametrize("condition, target, percent, price, previous, want", [
    ("ABOVE", 2600, None, 2650, None, True), ("ABOVE", 2600, None, 2550, None, False), ("BELOW", 2500, None, 2450, None, True), ("BELOW", 2500, None, 2550, None, False),
    ("CROSSES_ABOVE", 2600, None, 2650, 2550, True), ("CROSSES_ABOVE", 2600, None, 2650, 2620, False), ("CROSSES_ABOVE", 2600, None, 2650, None, False), ("CROSSES_BELOW", 100, None, 99, 100, True),
    ("PERCENT_CHANGE_UP", None, 5, 105, 100, True), ("PERCENT_CHANGE_DOWN", None, 5, 95, 100, True), ("PERCENT_CHANGE_UP", None, None, 105, 100, False), ("PERCENT_CHANGE_UP", None, 5, 105, 0, False), ("OTHER", 1, 1, 1, 1, False),
])
def test_alert_conditions(spark, condition, target, percent, price, previous, want):
    f = lambda v: None if v is None else float(v)
    df = spark.createDataFrame([(condition, f(target), f(percent), f(price), f(previous))], "condition string, target_price double, percent_change double, price double, previous double")
    assert df.select(alerts.fires(F.col("price"), F.col("previous")).alias("x")).first().x is want


def test_signals_and_validation(spark):
    row = dict(close=100.0, price=100.0, rsi_14=25.0, macd=5.0, macd_signal=3.0, sma_20=95.0, sma_50=90.0, stoch_k=15.0, atr_14=12.0, volume_ratio=1.0, recommendation="BUY", confidence=70.0, entry_price=100.0, target_price=110.0, stop_loss=95.0, risk_reward=2.0, reasoning="RSI " + "x" * 100, key_risks=["a", "b"])
    got = scoring.validated(scoring.signals(spark.createDataFrame([row]))).first()
    assert (got.rsi_signal, got.macd_label, got.trend, got.momentum, got.volatility) == ("oversold", "bullish", "strong_uptrend", "oversold", "high")
    assert got.quality_score == 100 and got.quality_rating == "excellent" and got.confidence_recalibrated == 75.0 and got.warnings == []
    bad = scoring.validated(spark.createDataFrame([row | {"recommendation": "SELL", "target_price": 110.0, "stop_loss": 95.0, "reasoning": "", "key_risks": ["a"]}])).first()
    assert bad.quality_score == 0 and len(bad.warnings) == 10 and bad.confidence_recalibrated == 60.0


def test_parsing_and_masks(spark):
    rows = [('{"a": 1}',), ('text ```json\n{"a": 2}\n``` more',), ('see {"a": 3, "b": {"c": 1}} end',), ("nothing",), (None,)]
    got = [r.x.a if r.x else None for r in spark.createDataFrame(rows, "t string").select(scoring.parsed_analysis(F.col("t"), "a int").alias("x")).collect()]
    assert got == [1, 2, 3, None, None]
    masks = [r.m for r in spark.createDataFrame([("short",), ("abcdefghijklmnop",), ("",)], "k string").select(scoring.masked("k").alias("m")).collect()]
    assert masks == ["****", "abcdefgh...mnop", None]


def test_quotes_fallback_and_history(spark):
    bars = _bars(spark, [(1, 1, 1, 10), (1, 1, 1, 11)])
    q = src.latest_quotes(bars).first()
    assert q.change == 1.0 and q.change_percent == pytest.approx(10.0) and src.latest_quotes(bars.limit(1)).first().change == 0.0
    series = spark.createDataFrame([("X", 0, k) for k in range(5)] + [("X", 1, k) for k in range(12)] + [("Y", 2, k) for k in range(10)], "base_symbol string, priority int, k int")
    assert {(r.base_symbol, r.priority) for r in src.first_series(series).select("base_symbol", "priority").distinct().collect()} == {("X", 1), ("Y", 2)}
    valid = spark.createDataFrame([(10.0, 9.0), (None, 1.0), (float("nan"), 1.0), (0.0, 1.0), (10.0, 1.0), (10.0, None), (1.0, 6.0)], "price double, previous_close double")
    assert [r.v for r in valid.select(src.valid_quote().alias("v")).collect()] == [True, False, False, False, False, True, False]


def test_as_of_joins(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 1), (4, "a", 7)], "id long, k string, t int")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 8, 80.0)], "k string, u int, v double")
    assert {(r.id, r.asof_v) for r in track.as_of_forward(left, right, "k", "t", "u", ["v"]).collect()} == {(1, 50.0), (2, None), (3, None), (4, 80.0)}
    assert {(r.id, r.asof_v) for r in track.as_of_backward(left, right, "k", "t", "u", ["v"]).collect()} == {(1, 50.0), (2, 80.0), (3, None), (4, 50.0)}


def test_dates_and_feeds(spark):
    now = F.lit("2024-05-10 12:00:00").cast("timestamp")
    rows = [("2024-05-01T10:00:00Z",), ("3 hours ago",), ("May 2, 2024",), ("nonsense",), (None,)]
    got = [r.d.isoformat(" ") for r in spark.createDataFrame(rows, "t string").select(text.parsed_date(F.col("t"), now).alias("d")).collect()]
    assert got == ["2024-05-01 10:00:00", "2024-05-10 09:00:00", "2024-05-02 00:00:00", "2024-05-10 12:00:00", "2024-05-10 12:00:00"]


def test_volume_profile_leaves_out_the_highest_close(spark):
    bars = _bars(spark, [(1, 1, 1, c) for c in range(1, 22)], volume=10.0)
    rows = market.volume_profile(bars, bins=20).collect()
    assert len(rows) == 20 and sum(r.volume for r in rows) == 200.0 and sum(r.is_poc for r in rows) == 1 and sum(r.in_value_area for r in rows) == 14
    assert market.volume_profile(_bars(spark, [(1, 1, 1, 5)] * 30)).count() == 0 and ind.latest(bars).count() == 1
