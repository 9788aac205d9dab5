"""Technical indicators that are windows over each symbol's bars.

Every function takes bars and adds columns for the whole series; ``latest`` takes the newest row of each symbol. True
highs and lows are used throughout, values stay null until their window is full, and divisions by zero are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import PLACE, before, deviation, full, highest, last, lowest, mean, numbered, ordered, percent_change, ratio, running, total, weighted, weighted_in_order


def typical():
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def momentum(bars: DataFrame) -> DataFrame:
    """Stochastic(14, 3), Williams %R(14), ROC(12), CCI(20), MFI(14), DPO(20), KST and its signal."""
    df = bars.withColumns({"tp": typical(), "hh14": highest("high", 14), "ll14": lowest("low", 14)})
    df = df.withColumns({
        "stoch_k": 100 * ratio(F.col("close") - F.col("ll14"), F.col("hh14") - F.col("ll14")),
        "williams_r": -100 * ratio(F.col("hh14") - F.col("close"), F.col("hh14") - F.col("ll14")),
        "roc_12": percent_change("close", 12),
        "tp_mean": mean("tp", 20),
        "tp_list": F.collect_list("tp").over(last(20)),
        "tp_up": F.when(F.col("tp") > before("tp"), F.col("tp") * F.col("volume")).when(before("tp").isNotNull(), 0.0),
        "tp_down": F.when(F.col("tp") < before("tp"), F.col("tp") * F.col("volume")).when(before("tp").isNotNull(), 0.0),
        "dpo_20": before("close", 11) - mean("close", 20),
        **{f"r{k}": percent_change("close", k) for k in (10, 15, 20, 30)},
    })
    off = F.aggregate(F.transform("tp_list", lambda v: F.abs(v - F.col("tp_mean"))), F.lit(0.0), lambda a, v: a + v) / 20
    df = df.withColumns({
        "stoch_d": mean("stoch_k", 3),
        "cci_20": ratio(F.col("tp") - F.col("tp_mean"), 0.015 * off),
        "mfi_14": 100 - ratio(F.lit(100.0), 1 + ratio(total("tp_up", 14), total("tp_down", 14))),
        "kst": mean("r10", 10) + 2 * mean("r15", 10) + 3 * mean("r20", 10) + 4 * mean("r30", 15),
    })
    df = df.withColumn("kst_signal", mean("kst", 9)).withColumn("kst_diff", F.col("kst") - F.col("kst_signal"))
    return df.drop("tp", "hh14", "ll14", "tp_mean", "tp_list", "tp_up", "tp_down", "r10", "r15", "r20", "r30")


def trend(bars: DataFrame) -> DataFrame:
    """SMA 10/20/50/100/200 and distances, WMA 10/20/50, HMA(16), Vortex(14)."""
    df = numbered(bars).withColumns({f"sma_{n}": mean("close", n) for n in (10, 20, 50, 100, 200)} | {f"wma_{n}": weighted("close", n) for n in (10, 20, 50)})
    df = df.withColumns({f"dist_sma_{n}": (ratio(F.col("close"), F.col(f"sma_{n}")) - 1) * 100 for n in (20, 50, 200)})
    df = df.withColumns({"__raw": 2 * weighted_in_order("close", 8) - weighted_in_order("close", 16)}).withColumn("hma_16", weighted_in_order("__raw", 4))
    df = df.withColumns({"__up": F.abs(F.col("high") - before("low")), "__down": F.abs(F.col("low") - before("high")), "__tr": true_range()})
    df = df.withColumns({"vortex_pos": ratio(total("__up", 14), total("__tr", 14)), "vortex_neg": ratio(total("__down", 14), total("__tr", 14))})
    return df.withColumn("vortex_diff", F.col("vortex_pos") - F.col("vortex_neg")).drop("__raw", "__up", "__down", "__tr", PLACE)


def true_range():
    """Null on the first bar, which has no previous close."""
    c = before("close")
    return F.when(c.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c)))


def volatility(bars: DataFrame) -> DataFrame:
    """Bollinger(20, 2), rolling ATR(14), Keltner(20), Donchian(20), Ulcer(14), historical volatility 10/20/30."""
    df = bars.withColumns({"__ret": percent_change("close"), "__tr": true_range(), "bb_middle": mean("close", 20), "__sd": deviation("close", 20, sample=False), "__tp": typical(), "__ku": (4 * F.col("high") - 2 * F.col("low") + F.col("close")) / 3, "__kl": (-2 * F.col("high") + 4 * F.col("low") + F.col("close")) / 3, "__peak": F.max("close").over(last(14))})
    df = df.withColumns({
        "bb_upper": F.col("bb_middle") + 2 * F.col("__sd"), "bb_lower": F.col("bb_middle") - 2 * F.col("__sd"),
        "atr_14": mean("__tr", 14), "kc_middle": mean("__tp", 20), "kc_upper": mean("__ku", 20), "kc_lower": mean("__kl", 20),
        "dc_upper": highest("high", 20), "dc_lower": lowest("low", 20), "__dd": F.pow((F.col("close") / F.col("__peak") - 1) * 100, 2.0),
        **{f"vol_{n}": deviation("__ret", n) for n in (10, 20, 30)},
    })
    df = df.withColumns({"bb_width": 100 * ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle")), "bb_percent": ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), "atr_percent": 100 * ratio(F.col("atr_14"), F.col("close")), "ulcer_14": F.sqrt(mean("__dd", 14))})
    return df.drop("__ret", "__tr", "__sd", "__tp", "__ku", "__kl", "__peak", "__dd")


#: Running totals from the start of a series, and the columns made of them.
TOTALS = ("signed", "flow", "typical_volume", "volume_sum", "trend_volume", "falling")
CUMULATIVE = ("obv", "ad", "vwap", "vpt", "nvi")


def increments(bars: DataFrame) -> DataFrame:
    """What each bar adds to TOTALS, as ``__inc_`` columns."""
    c = before("close")
    clv = F.coalesce(ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")), F.lit(0.0))
    falling = F.when(F.col("volume") < before("volume"), F.log(ratio(F.col("close"), c))).otherwise(0.0)
    inc = {"signed": F.coalesce(F.signum(F.col("close") - c) * F.col("volume"), F.lit(0.0)), "flow": clv * F.col("volume"), "typical_volume": typical() * F.col("volume"), "volume_sum": F.col("volume"),
           "trend_volume": F.coalesce((ratio(F.col("close"), c) - 1) * F.col("volume"), F.lit(0.0)), "falling": F.coalesce(falling, F.lit(0.0))}
    return bars.withColumns({f"__inc_{k}": v for k, v in inc.items()})


def cumulative(df: DataFrame, totals: dict) -> DataFrame:
    """CUMULATIVE from the running totals of ``increments``, whose columns go."""
    out = df.withColumns({"obv": totals["signed"], "ad": totals["flow"], "vwap": ratio(totals["typical_volume"], totals["volume_sum"]), "vpt": totals["trend_volume"], "nvi": 1000 * F.exp(totals["falling"])})
    return out.drop(*[f"__inc_{k}" for k in TOTALS])


def volume(bars: DataFrame) -> DataFrame:
    """OBV, volume SMA(20) and ratio, A/D line, CMF(20), cumulative VWAP, VPT, ease of movement(14), NVI."""
    df = increments(bars).withColumns({
        "__move": ((F.col("high") + F.col("low")) / 2 - before(F.col("high") + F.col("low")) / 2),
        "volume_sma_20": mean("volume", 20),
    })
    df = df.withColumns({
        "cmf_20": ratio(total("__inc_flow", 20), total("volume", 20)),
        "eom": ratio(F.col("__move") * (F.col("high") - F.col("low")), F.col("volume")) * 1e8,
        "volume_ratio": F.when(F.col("volume_sma_20") > 0, F.col("volume") / F.col("volume_sma_20")).when(F.col("volume_sma_20").isNotNull(), 1.0),
        **{f"__total_{k}": F.sum(f"__inc_{k}").over(running()) for k in TOTALS},
    })
    df = cumulative(df, {k: F.col(f"__total_{k}") for k in TOTALS})
    return df.withColumn("eom_sma_14", mean("eom", 14)).drop("__move", *[f"__total_{k}" for k in TOTALS])


def advanced(bars: DataFrame) -> DataFrame:
    """Aroon(25), Ultimate Oscillator(7, 14, 28), Awesome Oscillator(5, 34), Ichimoku(9, 26, 52), pivots, lags and returns."""
    c = before("close")
    newest = lambda x, most: F.col(PLACE) - (F.max(F.struct(x, PLACE)).over(last(26))[PLACE] if most else -F.min(F.struct(x, (-F.col(PLACE)).alias("at"))).over(last(26))["at"])
    df = numbered(bars).withColumns({
        "__h": newest("high", True), "__l": newest("low", False),
        "__bp": F.col("close") - F.least(F.col("low"), c), "__tr": F.greatest(F.col("high"), c) - F.least(F.col("low"), c), "__mid": (F.col("high") + F.col("low")) / 2,
    })
    df = df.withColumns({"__bp": F.when(before("close").isNotNull(), F.col("__bp")), "__tr": F.when(before("close").isNotNull(), F.col("__tr"))})
    average = lambda n: ratio(total("__bp", n), total("__tr", n))
    mid = lambda n: (highest("high", n) + lowest("low", n)) / 2
    df = df.withColumns({
        "aroon_up": full("high", 26, 100.0 * (25 - F.col("__h")) / 25), "aroon_down": full("low", 26, 100.0 * (25 - F.col("__l")) / 25),
        "ultimate": 100 * (4 * average(7) + 2 * average(14) + average(28)) / 7, "awesome": mean("__mid", 5) - mean("__mid", 34),
        "tenkan": mid(9), "kijun": mid(26), "senkou_b": mid(52),
        "pivot": (F.col("high") + F.col("low") + F.col("close")) / 3, "recent_high": highest("high", 20), "recent_low": lowest("low", 20),
        **{f"lag_{n}": before("close", n) for n in (1, 5, 10)}, **{f"ret_{n}": percent_change("close", n) for n in (1, 5, 10, 20)},
    })
    df = df.withColumn("senkou_a", (F.col("tenkan") + F.col("kijun")) / 2)
    top, bottom = F.greatest("senkou_a", "senkou_b"), F.least("senkou_a", "senkou_b")
    cloud = F.col("senkou_a").isNotNull() & F.col("senkou_b").isNotNull()
    df = df.withColumns({
        "cloud": F.when(cloud, F.when(F.col("senkou_a") > F.col("senkou_b"), "bullish").otherwise("bearish")),
        "cloud_position": F.when(cloud, F.when(F.col("close") > top, "above").when(F.col("close") < bottom, "below").otherwise("inside")),
        "r1": 2 * F.col("pivot") - F.col("low"), "s1": 2 * F.col("pivot") - F.col("high"), "r2": F.col("pivot") + F.col("high") - F.col("low"), "s2": F.col("pivot") - (F.col("high") - F.col("low")),
    })
    return df.drop("__h", "__l", "__bp", "__tr", "__mid", PLACE)


def crossings(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """1 where ``a`` comes above ``b``, -1 where it comes below, 0 elsewhere."""
    up = (F.col(a) > F.col(b)) & (before(a) <= before(b))
    down = (F.col(a) < F.col(b)) & (before(a) >= before(b))
    return df.withColumn(name, F.when(up, 1).when(down, -1).otherwise(0))


def latest(df: DataFrame, rows: int = 1) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy(F.col("bar_ts").desc())
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= rows).drop("__rank")


def tail(df: DataFrame, rows: int) -> DataFrame:
    """The newest ``rows`` bars of each symbol; windows built on the result start inside the tail."""
    return latest(df, rows)


def enough_history(df: DataFrame, bars: int) -> DataFrame:
    return df.withColumn("__n", F.count("*").over(Window.partitionBy("symbol"))).filter(F.col("__n") >= bars).drop("__n")


def windowed(bars: DataFrame) -> DataFrame:
    """All windowed indicators."""
    for step in (momentum, trend, volatility, volume, advanced):
        bars = step(bars)
    return bars


