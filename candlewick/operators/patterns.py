"""Candlestick patterns: one boolean for each pattern over lagged candles, then exploded events with a strength score."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import last, ordered
from .indicators import enough_history, tail, true_range

#: Fixed values. name: (candles, direction, strength, type, description)
KINDS = {
    "doji": (1, "indecision", "weak", "indecision", "Market indecision with small body and equal shadows"),
    "hammer": (1, "bullish", "medium", "bullish_reversal", "Bullish reversal with long lower shadow"),
    "hanging_man": (1, "bearish", "medium", "bearish_reversal", "Bearish reversal with long lower shadow"),
    "inverted_hammer": (1, "bullish", "medium", "bullish_reversal", "Bullish reversal with long upper shadow"),
    "shooting_star": (1, "bearish", "medium", "bearish_reversal", "Bearish reversal with long upper shadow"),
    "spinning_top": (1, "indecision", "weak", "indecision", "Indecision with small body and long shadows"),
    "bullish_engulfing": (2, "bullish", "strong", "bullish_reversal", "Strong bullish reversal - current candle engulfs previous"),
    "bearish_engulfing": (2, "bearish", "strong", "bearish_reversal", "Strong bearish reversal - current candle engulfs previous"),
    "piercing_line": (2, "bullish", "medium", "bullish_reversal", "Bullish reversal - closes above midpoint of previous candle"),
    "dark_cloud_cover": (2, "bearish", "medium", "bearish_reversal", "Bearish reversal - closes below midpoint of previous candle"),
    "harami": (2, "indecision", "weak", "indecision", "Indecision - small candle within previous candle's body"),
    "morning_star": (3, "bullish", "strong", "bullish_reversal", "Strong bullish reversal - three candle pattern"),
    "evening_star": (3, "bearish", "strong", "bearish_reversal", "Strong bearish reversal - three candle pattern"),
    "three_white_soldiers": (3, "bullish", "strong", "bullish_reversal", "Strong bullish continuation - three consecutive bullish candles"),
    "three_black_crows": (3, "bearish", "strong", "bearish_reversal", "Strong bearish continuation - three consecutive bearish candles"),
    "rising_three_methods": (5, "bullish", "medium", "bullish_continuation", "Bullish continuation pattern"),
    "falling_three_methods": (5, "bearish", "medium", "bearish_continuation", "Bearish continuation pattern"),
}
#: Fixed values. name: (signal, meaning), what a pattern implies.
IMPLICATIONS = {
    "doji": ("⚠️ Wait for confirmation", "Buyers and sellers are balanced. Wait for next candle to confirm direction."),
    "hammer": ("📈 Potential upside", "Buyers rejected lower prices. Stock may reverse upward from here."),
    "inverted_hammer": ("📈 Potential upside", "After downtrend, buyers showing interest. Watch for confirmation."),
    "hanging_man": ("📉 Potential downside", "After uptrend, selling pressure emerging. Consider taking profits."),
    "shooting_star": ("📉 Potential downside", "Buyers failed to hold highs. Reversal likely, watch for follow-through."),
    "spinning_top": ("⚠️ Wait for confirmation", "Market is undecided. Trend may pause or reverse - wait for clarity."),
    "bullish_engulfing": ("🚀 Strong buy signal", "Buyers overpowered sellers completely. High probability of upward move."),
    "bearish_engulfing": ("🔻 Strong sell signal", "Sellers overpowered buyers completely. High probability of downward move."),
    "piercing_line": ("📈 Bullish reversal", "Strong buying after gap down. Recovery likely to continue."),
    "dark_cloud_cover": ("📉 Bearish reversal", "Strong selling after gap up. Decline likely to continue."),
    "morning_star": ("🚀 Strong buy signal", "Classic bottom reversal. High confidence upward move expected."),
    "evening_star": ("🔻 Strong sell signal", "Classic top reversal. High confidence downward move expected."),
    "three_white_soldiers": ("🚀 Strong bullish momentum", "Sustained buying pressure. Uptrend likely to continue."),
    "three_black_crows": ("🔻 Strong bearish momentum", "Sustained selling pressure. Downtrend likely to continue."),
    "harami": ("⚠️ Trend weakening", "Current trend losing momentum. Possible reversal or consolidation ahead."),
    "rising_three_methods": ("📈 Bullish continuation", "Brief pause in uptrend. Expect continuation higher."),
    "falling_three_methods": ("📉 Bearish continuation", "Brief pause in downtrend. Expect continuation lower."),
}
BASE = {"strong": 70, "medium": 50, "weak": 30}
#: The newest bars that are looked at, and the fewest that give patterns.
LOOKBACK, LEAST = 50, 3


class Candle:
    """Columns of the candle ``k`` bars back."""

    def __init__(self, k: int):
        at = lambda c: F.lag(c, k).over(ordered()) if k else F.col(c)
        self.open, self.high, self.low, self.close = at("open"), at("high"), at("low"), at("close")
        self.body, self.reach = F.abs(self.close - self.open), self.high - self.low
        self.upper, self.lower = self.high - F.greatest(self.open, self.close), F.least(self.open, self.close) - self.low
        self.bull = self.close > self.open
        self.bear = ~self.bull
        self.mid = (self.open + self.close) / 2


def conditions() -> dict[str, Column]:
    """A flat candle counts as bearish; a comparison with a missing candle is false."""
    c, p, pp = Candle(0), Candle(1), Candle(2)
    long_lower = (c.lower > 2 * c.body) & (c.upper < 0.5 * c.body) & (c.body > 0.2 * c.reach)
    long_upper = (c.upper > 2 * c.body) & (c.lower < 0.5 * c.body) & (c.body > 0.2 * c.reach)
    after_bear = F.coalesce(p.bear, F.lit(False))
    five = [Candle(k) for k in (4, 3, 2, 1, 0)]
    small = lambda side: [x.body < 0.5 * five[0].body for x in five[1:4]] + [side(x) for x in five[1:4]]
    every = lambda parts: functools.reduce(operator.and_, parts)
    out = {
        "doji": (c.reach > 0) & (c.body < 0.1 * c.reach),
        "hammer": long_lower & after_bear, "hanging_man": long_lower & ~after_bear,
        "inverted_hammer": long_upper & after_bear, "shooting_star": long_upper & ~after_bear,
        "spinning_top": (c.body < 0.3 * c.reach) & (c.upper > c.body) & (c.lower > c.body) & (F.abs(c.upper - c.lower) < 0.3 * c.reach),
        "bullish_engulfing": p.bear & c.bull & (c.open < p.close) & (c.close > p.open),
        "bearish_engulfing": p.bull & c.bear & (c.open > p.close) & (c.close < p.open),
        "piercing_line": p.bear & c.bull & (c.open < p.close) & (c.close > p.mid) & (c.close < p.open),
        "dark_cloud_cover": p.bull & c.bear & (c.open > p.close) & (c.close < p.mid) & (c.close > p.open),
        "harami": (F.least(p.open, p.close) < F.least(c.open, c.close)) & (F.greatest(p.open, p.close) > F.greatest(c.open, c.close)),
        "morning_star": pp.bear & (p.body < 0.5 * pp.body) & c.bull & (c.close > pp.mid),
        "evening_star": pp.bull & (p.body < 0.5 * pp.body) & c.bear & (c.close < pp.mid),
        "three_white_soldiers": pp.bull & p.bull & c.bull & (p.open > pp.open) & (c.open > p.open) & (p.close > pp.close) & (c.close > p.close),
        "three_black_crows": pp.bear & p.bear & c.bear & (p.open < pp.open) & (c.open < p.open) & (p.close < pp.close) & (c.close < p.close),
        "rising_three_methods": every([five[0].bull, five[0].body > 0.5 * five[0].reach, *[x.bear for x in five[1:4]], *small(lambda x: x.low > five[0].low), five[4].bull, five[4].close > five[0].close]),
        "falling_three_methods": every([five[0].bear, five[0].body > 0.5 * five[0].reach, *[x.bull for x in five[1:4]], *small(lambda x: x.high < five[0].high), five[4].bear, five[4].close < five[0].close]),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def detected(bars: DataFrame, lookback: int | None = LOOKBACK) -> DataFrame:
    """(symbol, bar_ts, pattern, direction, strength, score, close): one row for each pattern at each of the newest bars.

    Candles before the tail are not looked at, and its averages start inside it. Score: a base by strength, plus up to
    15 for volume against its 20-bar mean (only if the tail has 20 bars), plus up to 10 for the body against ATR.
    """
    df = enough_history(tail(bars, lookback) if lookback else bars, LEAST)
    n = F.count("*").over(Window.partitionBy("symbol"))
    average = F.when(F.count("volume").over(last(20)) == 20, F.avg("volume").over(last(20)))
    reach = F.coalesce(true_range(), F.col("high") - F.col("low"))
    df = df.withColumns({"__tr": reach, "__n": n, "__vol": F.when(average == 0, F.col("volume")).otherwise(F.col("volume") / average)})
    atr = F.when(F.col("__n") >= 14, F.when(F.count("__tr").over(last(14)) == 14, F.avg("__tr").over(last(14)))).otherwise(F.when(F.count("__tr").over(last(5)) == 5, F.avg(F.col("high") - F.col("low")).over(last(5))))
    df = df.withColumns({"__vol": F.when(F.col("__n") >= 20, F.col("__vol")).otherwise(1.0), "__atr": atr, "__body": F.abs(F.col("close") - F.col("open"))})
    entry = lambda k: F.struct(F.lit(k).alias("pattern"), F.lit(KINDS[k][1]).alias("direction"), F.lit(KINDS[k][2]).alias("strength"), F.lit(BASE[KINDS[k][2]]).alias("base"))
    flags = conditions()
    df = df.withColumn("__hits", F.array_compact(F.array(*[F.when(flags[k], entry(k)) for k in KINDS])))
    events = df.select("symbol", "bar_ts", "close", "__vol", "__atr", "__body", F.explode("__hits").alias("e"))
    by_volume = F.when(F.col("__vol") > 1.5, 15).when(F.col("__vol") > 1.2, 10).when(F.col("__vol") < 0.7, -10).otherwise(0)
    body = F.try_divide("__body", "__atr")
    by_body = F.when(body > 0.8, 10).when(body > 0.5, 5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("e.base") + by_volume + by_body))
    return events.select("symbol", "bar_ts", "e.pattern", "e.direction", "e.strength", score.alias("score"), "close")


def recent(events: DataFrame, bars: DataFrame, days: int = 5) -> DataFrame:
    """Events at most ``days`` days before the last bar of their symbol."""
    ends = bars.groupBy("symbol").agg(F.max("bar_ts").alias("__last"))
    return events.join(ends, "symbol").filter(F.datediff("__last", "bar_ts") <= days).drop("__last")


def summary(events: DataFrame) -> DataFrame:
    """Counts by direction and the newest signal of each symbol."""
    newest = F.max_by("direction", F.struct("bar_ts", "score", "pattern"))
    return events.groupBy("symbol").agg(F.count_if(F.col("direction") == "bullish").alias("bullish"), F.count_if(F.col("direction") == "bearish").alias("bearish"), F.count_if(F.col("direction") == "indecision").alias("indecision"), newest.alias("latest_signal"))


def described(events: DataFrame) -> DataFrame:
    """Add each pattern's type (reversal, continuation or indecision), description and implication (direction, signal, meaning)."""
    table = lambda f: F.create_map(*[F.lit(x) for k in KINDS for x in (k, f(k))])[F.col("pattern")]
    side = F.when(F.col("direction") == "indecision", "neutral").otherwise(F.col("direction"))
    return events.withColumns({
        "type": table(lambda k: KINDS[k][3]), "description": table(lambda k: KINDS[k][4]),
        "implication": F.struct(side.alias("direction"), table(lambda k: IMPLICATIONS[k][0]).alias("signal"), table(lambda k: IMPLICATIONS[k][1]).alias("meaning"))})


def formatted(events: DataFrame) -> DataFrame:
    """For display: day/month/year, the default time of daily bars, a title and a price text."""
    return events.withColumns({"date": F.date_format("bar_ts", "dd/MM/yyyy"), "time": F.lit("15:30:00"), "name": F.initcap(F.replace("pattern", F.lit("_"), F.lit(" "))), "price_text": F.concat(F.lit("₹"), F.format_number("close", 2))})
