"""The same results from chunks of few bars: indicators, trades and drawdowns of series that no task holds as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import long_series
from .queries import SQL, _TRADES, _recursive_sql, out, query, rounded
from .sources import bars as src

#: Bars of a chunk, far fewer than a task could hold, so that each of the symbols is many chunks.
CHUNK = 100


def _columns(name: str) -> list[str]:
    """The columns of the query that has the same results in one pass."""
    return {
        "indicators_momentum": ["stoch_k", "stoch_d", "williams_r", "roc_12", "cci_20", "mfi_14", "dpo_20", "kst", "kst_signal"],
        "indicators_trend": ["sma_10", "sma_50", "sma_100", "sma_200", "wma_10", "wma_20", "wma_50", "hma_16", "vortex_pos", "vortex_neg", "dist_sma_50"],
        "indicators_advanced": ["aroon_up", "aroon_down", "ultimate", "awesome", "tenkan", "kijun", "senkou_a", "senkou_b", "ret_5", "lag_10", "r1", "cloud", "cloud_position"],
        "indicators_volume": ["obv", "ad_millions", "cmf_20", "vwap", "vpt", "eom_sma", "log_nvi"],
    }[name]


def _windowed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = long_series.windowed(src.daily_bars(spark, sf_dir), CHUNK)
    df = df.withColumns({"ad_millions": F.col("ad") / 1e6, "eom_sma": F.col("eom_sma_14") / 1e12, "log_nvi": F.log("nvi")})
    return rounded(df, "symbol", "bar_ts", *_columns(name))


@query(SQL["indicators_momentum"])
def long_series_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, "indicators_momentum")


@query(SQL["indicators_trend"])
def long_series_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, "indicators_trend")


@query(SQL["indicators_advanced"])
def long_series_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, "indicators_advanced")


@query(SQL["indicators_volume"])
def long_series_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, "indicators_volume")


@query(f"{_recursive_sql()} SELECT {out(*long_series.COLUMNS)} FROM done")
def long_series_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long_series.recursive(src.daily_bars(spark, sf_dir), CHUNK), "symbol", "bar_ts", *long_series.COLUMNS)


@query(SQL["backtest_trades"])
def long_series_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long_series.backtested(src.daily_bars(spark, sf_dir), CHUNK))


@query(f"{_TRADES}, eq AS (SELECT *, sum(return_percent) OVER (PARTITION BY symbol ORDER BY idx) AS equity FROM trades), dd AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY idx)) - equity AS dropped FROM eq) SELECT symbol, round(sum(return_percent), 4) AS total_return, round(max(dropped), 4) AS max_drawdown FROM dd GROUP BY 1")
def long_series_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long_series.drawdowns(long_series.backtested(src.daily_bars(spark, sf_dir), CHUNK), CHUNK))
