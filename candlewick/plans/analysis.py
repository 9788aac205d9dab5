"""Compositions that answer whole requests for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recursive import recursive
from ..functions.windows import whole
from ..operators import backtest as bt
from ..operators import indicators as ind
from ..operators import scoring, wording


def indicator_series(bars: DataFrame, least_bars: int = 50) -> DataFrame:
    """Recursive and windowed indicators of symbols with enough history.

    The recursive ones come first: they need bars alone, and Catalyst can prune the windows above them.
    """
    return ind.windowed(recursive(ind.enough_history(bars, least_bars)))


def indicator_record(bars: DataFrame, least_bars: int = 50) -> DataFrame:
    """One row for each symbol: the newest values of all indicators."""
    return ind.latest(indicator_series(bars, least_bars))


def analysed(bars: DataFrame) -> DataFrame:
    """Newest indicators, signals, percentile ranks, composite score and their texts of each symbol."""
    series = scoring.percentile_ranks(indicator_series(bars), {"rsi_14": "rsi_pct", "volume_sma_20": "volume_pct", "vol_10": "volatility_pct"})
    place = F.try_divide(F.col("close") - F.min("close").over(whole()), F.max("close").over(whole()) - F.min("close").over(whole())) * 100
    return wording.percentile_texts(scoring.composite(scoring.signals(ind.latest(series.withColumn("range_position", place)))))


def recommended(bars: DataFrame, answers: DataFrame) -> DataFrame:
    """``analysed`` joined to recommendations (symbol, recommendation, ...), validated and recalibrated."""
    return scoring.validated(analysed(bars).withColumn("price", F.col("close")).join(answers, "symbol"))


def explained(bars: DataFrame, answers: DataFrame) -> DataFrame:
    """``recommended`` with insights and a summary; what the answers don't have is unknown."""
    rows = recommended(bars, answers)
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in (("sector_trend", "string"), ("relative_strength", "string"), ("time_horizon", "string"), ("key_opportunities", "array<string>")) if c not in rows.columns})
    return wording.insights(rows)


def backtested(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades and statistics of the signal-alignment backtest."""
    series = indicator_series(bars, bt.LEAST_BARS)
    trades = bt.simulated(series)
    return trades, bt.statistics(trades)
