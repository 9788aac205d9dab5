"""Universe, indices and profiles: screens, searches, movers, synthetic index levels, delistings, volume profiles, multi-timeframe views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursive import recursive
from ..functions.windows import mean
from ..sources.bars import monthly, weekly
from .indicators import latest


def universe(rows: DataFrame, least_cap: float = 100.0, most: int | None = 2000) -> DataFrame:
    """One row for each symbol (the largest cap), caps of at least ``least_cap``, largest first."""
    one = rows.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("market_cap").desc(), "name"))).filter("__r = 1").drop("__r")
    out = one.filter(F.col("market_cap") >= least_cap).orderBy(F.col("market_cap").desc(), "symbol")
    return out.limit(most) if most else out


def screen(rows: DataFrame, *, least_cap_cr=None, most_pe=None, least_roe=None, least_margin=None, most_debt=None, least_dividend=None, sector=None, limit: int | None = None) -> DataFrame:
    """Fundamental screen. A null P/E, ROE or margin fails its test; a null debt ratio or dividend passes. The cap is in crores, 1e7 each."""
    keep = F.lit(True)
    strict = lambda c, test: F.coalesce(test, F.lit(False))
    if least_cap_cr is not None:
        keep &= strict("market_cap", F.col("market_cap") >= least_cap_cr * 1e7)
    if most_pe is not None:
        keep &= strict("pe_ratio", F.col("pe_ratio") <= most_pe)
    if least_roe is not None:
        keep &= strict("roe", F.col("roe") >= least_roe)
    if least_margin is not None:
        keep &= strict("margin", F.col("margin") >= least_margin)
    if most_debt is not None:
        keep &= F.coalesce(F.col("debt_to_equity") <= most_debt, F.lit(True))
    if least_dividend is not None:
        keep &= F.coalesce(F.col("dividend_yield") >= least_dividend, F.lit(True))
    if sector is not None:
        keep &= strict("sector", F.contains(F.lower("sector"), F.lit(sector.lower())))
    out = rows.filter(keep)
    return out.orderBy(F.col("market_cap").desc(), "symbol").limit(limit) if limit else out


def company_info(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Facts of the asked symbols, unknown ones with nulls; sector and industry are "N/A" where unknown."""
    facts = symbols.select("symbol").join(rows, "symbol", "left")
    return facts.withColumns({c: F.coalesce(F.col(c), F.lit("N/A")) for c in ("sector", "industry") if c in facts.columns})


#: What is known of a company's business and of its figures.
FACTS = ("name", "sector", "industry", "description", "website", "employees")
FIGURES = ("market_cap", "pe_ratio", "forward_pe", "peg_ratio", "price_to_book", "dividend_yield", "profit_margin", "roe", "debt_to_equity")


def _projected(rows: DataFrame, symbols: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    known = rows.select("symbol", *[F.col(c) if c in rows.columns else F.lit(None).cast("string" if c in FACTS and c != "employees" else "double").alias(c) for c in columns], "source")
    return symbols.select("symbol").join(known, "symbol")


def facts(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, FACTS, source) of the asked symbols that the source knows; what it doesn't have is null."""
    return _projected(rows, symbols, FACTS)


def fundamentals(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, FIGURES, source) of the asked symbols that the source knows; what it doesn't have is null."""
    return _projected(rows, symbols, FIGURES)


def search(rows: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Exact symbols first, then prefixes, then symbols or names that contain the trimmed query; larger caps first inside a tier. ``names.search_many`` takes many queries at once."""
    q = F.lit(query.strip().upper())
    s, n = F.upper("symbol"), F.upper("name")
    tier = F.when(s == q, 1).when(F.startswith(s, q), 2).when(F.contains(s, q) | F.contains(n, q), 3)
    return rows.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.col("market_cap").desc(), "symbol").limit(limit)


def prefer_listing(rows: DataFrame, key: str = "name", preferred: str = "NSE") -> DataFrame:
    """One listing for each name, the preferred exchange first, with the previous close from the change percent."""
    order = Window.partitionBy(key).orderBy(F.when(F.col("exchange") == preferred, 0).otherwise(1), "exchange", "symbol")
    one = rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")
    return one.withColumn("previous_close", F.col("price") - F.col("price") * F.col("change_percent") / 100)


def constituents(indices: DataFrame) -> DataFrame:
    """(index_name, pos, symbol) from (index_name, members)."""
    return indices.select("index_name", F.posexplode("members").alias("pos", "symbol"))


def movers(members: DataFrame, quotes: DataFrame, k: int = 5, key: str = "symbol") -> DataFrame:
    """Top and bottom ``k`` of each index by change percent, unknown ones last; the same symbol may be in both if there are few. ``key`` is unique in ``quotes``."""
    both = members.join(quotes, key)
    up = F.row_number().over(Window.partitionBy("index_name").orderBy(F.col("change_percent").desc(), "symbol"))
    down = F.row_number().over(Window.partitionBy("index_name").orderBy(F.col("change_percent").asc_nulls_last(), "symbol"))
    ranked = both.withColumns({"up": up, "down": down})
    gainers = ranked.filter(F.col("up") <= k).select("index_name", F.lit("gainer").alias("kind"), F.col("up").alias("rank"), "symbol", "change_percent")
    return gainers.unionByName(ranked.filter(F.col("down") <= k).select("index_name", F.lit("loser").alias("kind"), F.col("down").alias("rank"), "symbol", "change_percent"))


def index_levels(members: DataFrame, quotes: DataFrame, base: float = 10_000.0, first: int = 5, key: str = "symbol") -> DataFrame:
    """A synthetic level for each index: the mean change of its first members on a base, highs and lows half a percent around. ``key`` is unique in ``quotes``."""
    change = F.avg("change_percent")
    out = members.filter(F.col("pos") < first).join(quotes, key).groupBy("index_name").agg(change.alias("change_percent"))
    out = out.withColumn("level", base * (1 + F.col("change_percent") / 100))
    return out.withColumns({"high": F.col("level") * 1.005, "low": F.col("level") * 0.995})


def volume_profile(bars: DataFrame, bins: int = 20, value_area: float = 0.7, least_bars: int = 20) -> DataFrame:
    """Volume by equal bins of close; the last edge is exclusive, so the highest close is in no bin.

    A bin is in the value area while the bins of larger volume before it hold less than ``value_area`` of all;
    ``is_poc`` marks the largest (the lowest of equals).
    """
    whole = Window.partitionBy("symbol")
    df = bars.withColumns({"lo": F.min("close").over(whole), "hi": F.max("close").over(whole), "n": F.count("*").over(whole)}).filter((F.col("n") >= least_bars) & (F.col("hi") > F.col("lo")))
    width = (F.col("hi") - F.col("lo")) / bins
    df = df.withColumns({"width": width, "bin": F.floor((F.col("close") - F.col("lo")) / width).cast("int")}).filter((F.col("bin") < bins) & (F.col("close") < F.col("hi")))
    out = df.groupBy("symbol", "bin").agg(F.sum("volume").alias("volume"), F.min("lo").alias("lo"), F.min("width").alias("width"))
    order = Window.partitionBy("symbol").orderBy(F.col("volume").desc(), "bin")
    so_far = F.coalesce(F.sum("volume").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("volume").over(whole)
    return out.select("symbol", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("price_low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("price_high"), "volume", (F.col("volume") / total * 100).alias("percent"), (F.row_number().over(order) == 1).alias("is_poc"), (so_far < value_area * total).alias("in_value_area"))


def overlays(bars: DataFrame, *lengths: int) -> DataFrame:
    """Simple means of the close for charts of weekly or four-hour bars."""
    return bars.withColumns({f"sma_{n}": mean("close", n) for n in lengths})


def multi_timeframe(bars: DataFrame) -> DataFrame:
    """One row for each symbol: RSI14, MACD and SMA20 daily, RSI14 and SMA10 weekly, SMA6 and trend (last against third last close) monthly, and their alignment.

    A timeframe votes by close against its mean. Weeks need 35 days and 14 weeks, months 150 days and 6 months; what has too few is null and doesn't vote up.
    """
    side = lambda c, s: F.when(F.col(c) > F.col(s), "above").when(F.col(s).isNotNull(), "below")
    series = recursive(bars).select("symbol", "bar_ts", "close", "rsi_14", "macd")
    count = F.count("*").over(Window.partitionBy("symbol"))
    d = latest(series.withColumns({"sma_20": mean("close", 20), "days": count})).select("symbol", "days", F.col("rsi_14").alias("daily_rsi"), F.col("macd").alias("daily_macd"), F.col("sma_20").alias("daily_sma_20"), side("close", "sma_20").alias("daily"))
    week = recursive(weekly(bars).withColumnRenamed("bucket", "bar_ts")).select("symbol", "bar_ts", "close", "rsi_14")
    w = latest(week.withColumns({"sma_10": mean("close", 10), "weeks": count})).select("symbol", "weeks", F.col("rsi_14").alias("weekly_rsi"), F.col("sma_10").alias("weekly_sma_10"), side("close", "sma_10").alias("weekly"))
    month = monthly(bars).withColumnRenamed("bucket", "bar_ts").select("symbol", "bar_ts", "close")
    third = F.lag("close", 2).over(Window.partitionBy("symbol").orderBy("bar_ts"))
    m = latest(month.withColumns({"sma_6": mean("close", 6), "third": third, "months": count})).select("symbol", "months", F.col("sma_6").alias("monthly_sma_6"), side("close", "sma_6").alias("monthly"), F.when(F.col("close") > F.col("third"), "up").otherwise("down").alias("monthly_trend"))
    out = d.join(w, "symbol").join(m, "symbol")
    by_week, by_month = (F.col("days") >= 35) & (F.col("weeks") >= 14), (F.col("days") >= 150) & (F.col("months") >= 6)
    out = out.withColumns({c: F.when(by_week, F.col(c)) for c in ("weekly_rsi", "weekly_sma_10", "weekly")} | {c: F.when(by_month, F.col(c)) for c in ("monthly_sma_6", "monthly", "monthly_trend")})
    score = sum((F.when(F.col(c) == "above", 1).otherwise(0) for c in ("daily", "weekly", "monthly")), F.lit(0))
    out = out.withColumn("score", score).drop("days", "weeks", "months")
    return out.withColumn("alignment", F.when(F.col("score") >= 2, "bullish").when(F.col("score") == 0, "bearish").otherwise("mixed"))


def listed_on(delistings: DataFrame, symbols: DataFrame, day: Column) -> DataFrame:
    """(symbol, listed, member): unknown symbols are listed and no member; a symbol is listed before its last day."""
    out = symbols.join(delistings, "symbol", "left")
    return out.select("symbol", F.coalesce(day < F.col("delisted_date"), F.lit(True)).alias("listed"), F.coalesce((day >= F.col("index_entry")) & (F.col("index_exit").isNull() | (day < F.col("index_exit"))), F.lit(False)).alias("member"))


def surviving(symbols: DataFrame, delistings: DataFrame, day: Column) -> DataFrame:
    return symbols.join(delistings.filter(F.col("delisted_date") <= day), "symbol", "left_anti")


def survivorship(symbols: DataFrame, delistings: DataFrame, start: Column, end: Column) -> DataFrame:
    """Delisted symbols in a period: how many, which, their mean loss from the peak (final prices of 0 are left out), and a label."""
    gone = symbols.join(delistings.filter(F.col("delisted_date").between(start, end)), "symbol")
    loss = F.when((F.col("peak_price") > 0) & (F.col("final_price") > 0), (F.col("peak_price") - F.col("final_price")) / F.col("peak_price") * 100)
    out = gone.agg(F.count("*").alias("n_delisted"), F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"), F.avg(loss).alias("mean_loss"))
    return out.withColumn("impact", F.when(F.col("n_delisted") > 2, "significant").when(F.col("n_delisted") >= 1, "moderate").otherwise("minimal"))


def declines(delistings: DataFrame) -> DataFrame:
    return delistings.select("symbol", F.when(F.col("peak_price") > 0, (F.col("peak_price") - F.col("final_price")) / F.col("peak_price") * 100).alias("decline"))


def reasons(delistings: DataFrame) -> DataFrame:
    return delistings.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("index_exit").isNotNull()).alias("index_exits"))


def market_sentiment(recommendations: DataFrame) -> DataFrame:
    b, s = F.count_if(F.col("direction") == "BUY"), F.count_if(F.col("direction") == "SELL")
    out = recommendations.agg(b.alias("buys"), s.alias("sells"))
    return out.withColumn("sentiment", F.when(F.col("buys") > 1.5 * F.col("sells"), "Bullish").when(F.col("sells") > 1.5 * F.col("buys"), "Bearish").otherwise("Neutral"))


def top_recommendations(recommendations: DataFrame, least: float = 65.0, limits: dict[str, int] | None = None) -> DataFrame:
    """Confident BUY and SELL rows, best first, as many of each as the limits say."""
    limits = limits or {"BUY": 50, "SELL": 30}
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.col("confidence").desc(), "rec_id"))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    rows = recommendations.filter(F.col("direction").isin(*limits) & (F.col("confidence") >= least)).withColumn("rank", rank)
    return rows.filter(F.col("rank") <= most[F.col("direction")])
