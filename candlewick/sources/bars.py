"""Bars: daily OHLCV series of many symbols, their resampling, quotes and fallback between providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A total order of lineitem rows; (orderkey, linenumber) alone is not unique.
TRADE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def aggregated(trades: DataFrame, keys: list, order: Column, price: str = "price", volume: str = "volume") -> DataFrame:
    """One bar for each group of trades; min_by and max_by keep it deterministic and combine before the shuffle."""
    return trades.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"))


def daily_bars(spark: SparkSession, sf_dir: str, symbol: Column | None = None) -> DataFrame:
    """Bars (symbol, bar_ts, open, high, low, close, volume) from line items: symbol is the flag and status unless another is given, price the extended price."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    symbol = F.concat("l_returnflag", "l_linestatus") if symbol is None else symbol
    trades = items.select(symbol.alias("symbol"), F.col("l_shipdate").cast("date").alias("bar_ts"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("volume"), *TRADE_ORDER)
    return aggregated(trades, ["symbol", "bar_ts"], F.struct(*TRADE_ORDER))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks (symbol, ts, tick_id, price) from events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"))


def resampled(bars: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    """First open, highest high, lowest low, last close and summed volume of each bucket; empty buckets don't occur."""
    order = F.struct("bar_ts")
    return bars.groupBy("symbol", bucket.alias(name)).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))


def weekly(bars: DataFrame) -> DataFrame:
    """Weeks from Monday to Sunday, labelled by their Sunday."""
    return resampled(bars, F.date_add(F.date_trunc("week", "bar_ts").cast("date"), 6))


def monthly(bars: DataFrame) -> DataFrame:
    return resampled(bars, F.last_day("bar_ts"))


def four_hourly(ticks_: DataFrame) -> DataFrame:
    """Four-hour bars from local midnight."""
    hour = F.floor(F.hour("ts") / 4).cast("int") * 4
    bucket = F.date_trunc("day", "ts") + F.make_dt_interval(F.lit(0), hour, F.lit(0), F.lit(0).cast("decimal(18,6)"))
    return ticks_.groupBy("symbol", bucket.cast("timestamp_ntz").alias("bucket")).agg(
        F.min_by("price", F.struct("ts", "tick_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "tick_id")).alias("close"), F.count("*").alias("ticks"))


def latest_quotes(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol with change and change percent against the one before; 0 without a previous close."""
    order = Window.partitionBy("symbol").orderBy(F.col("bar_ts").desc())
    two = bars.withColumn("previous_close", F.lead("close").over(order)).withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
    known = F.coalesce("previous_close", F.lit(0.0)) != 0
    return two.withColumns({"change": F.when(known, F.col("close") - F.col("previous_close")).otherwise(0.0), "change_percent": F.when(known, (F.col("close") - F.col("previous_close")) / F.col("previous_close") * 100).otherwise(0.0)})


def with_age(quotes: DataFrame, now: Column, at: str = "ts", zone: str = "Asia/Kolkata", intraday: Column | None = None, fresh: int = 5) -> DataFrame:
    """``data_age_minutes`` of quotes whose local time ``at`` has no zone of its own, and ``is_realtime``: from intraday data and younger than ``fresh`` minutes.

    ``now`` is in UTC. Ages are whole minutes, cut towards zero.
    """
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.to_utc_timestamp(F.col(at).cast("timestamp"), zone))
    age = (seconds / 60).cast("long")
    return quotes.withColumns({"data_age_minutes": age, "is_realtime": (F.lit(True) if intraday is None else intraday) & (age < fresh)})


def valid_quote(price: str = "price", previous: str = "previous_close") -> Column:
    """Positive, not NaN, and within a fifth and five times the previous close if there is one."""
    p, b = F.col(price), F.col(previous)
    sane = F.when(F.coalesce(b, F.lit(0.0)) > 0, (p / b >= 0.2) & (p / b <= 5)).otherwise(F.lit(True))
    return F.coalesce(p.isNotNull() & ~F.isnan(p) & (p > 0) & sane, F.lit(False))


def first_provider(candidates: DataFrame, key: str = "symbol", priority: str = "priority", usable: Column | None = None) -> DataFrame:
    """The usable row of best priority for each key: provider fallback as a union and a rank."""
    rows = candidates.filter(usable) if usable is not None else candidates
    order = Window.partitionBy(key).orderBy(F.col(priority).asc())
    return rows.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def first_series(candidates: DataFrame, least_bars: int = 10) -> DataFrame:
    """Of several series for a base symbol, all bars of the first with at least ``least_bars`` rows."""
    counts = candidates.groupBy("base_symbol", "priority").agg(F.count("*").alias("n")).filter(F.col("n") >= least_bars)
    chosen = counts.groupBy("base_symbol").agg(F.min("priority").alias("priority"))
    return candidates.join(chosen, ["base_symbol", "priority"], "left_semi")


def since(bars: DataFrame, days: int) -> DataFrame:
    """The last ``days`` days of each symbol."""
    return bars.withColumn("__last", F.max("bar_ts").over(Window.partitionBy("symbol"))).filter(F.col("bar_ts") >= F.date_sub("__last", days)).drop("__last")


def normalised_symbol(symbol: str, suffix: str = ".NS", suffixes: tuple[str, ...] = (".NS", ".BO")) -> Column:
    s = F.upper(F.trim(symbol))
    known = F.lit(False)
    for x in suffixes:
        known = known | s.endswith(x)
    return F.when(known, s).otherwise(F.concat(s, F.lit(suffix)))


def base_symbol(symbol: str) -> Column:
    return F.regexp_replace(F.upper(F.trim(symbol)), r"\.(NS|BO)$", "")
