"""Signal-alignment backtest: a signal for each bar, exits looked up ahead, trades that don't overlap, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered
from .scoring import alignment_ratio

START, HOLD, STOP, TARGET, LEAST_BARS, THRESHOLD = 200, 20, 0.03, 0.05, 250, 0.7


def with_signals(df: DataFrame) -> DataFrame:
    """``signal`` BUY if BUY alignment is at least 0.7, else SELL if SELL alignment is; the columns are causal, so one window pass equals recomputing each prefix."""
    return df.withColumns({"buy_alignment": alignment_ratio("BUY"), "sell_alignment": alignment_ratio("SELL")}).withColumn("signal", F.when(F.col("buy_alignment") >= THRESHOLD, "BUY").when(F.col("sell_alignment") >= THRESHOLD, "SELL"))


def candidate_trades(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, idx, ... and ``keep``): the trade that each signalled bar from START on would make: the stop is tested before the target, else the close after HOLD bars or the last."""
    index = F.col("idx") if "idx" in df.columns else F.row_number().over(ordered()) - 1  # bars that come in chunks are numbered
    ahead = F.collect_list(F.struct("bar_ts", "high", "low", "close")).over(ordered().rowsBetween(1, HOLD))
    rows = df.withColumns({"idx": index, "ahead": ahead}).filter(F.col("signal").isNotNull() & (F.col("idx") >= START) & (F.size("ahead") > 0))
    buy, entry = F.col("signal") == "BUY", F.col("close")
    rows = rows.withColumns({"stop": F.when(buy, entry * (1 - STOP)).otherwise(entry * (1 + STOP)), "goal": F.when(buy, entry * (1 + TARGET)).otherwise(entry * (1 - TARGET))})
    stopped = lambda x: F.when(F.col("signal") == "BUY", x["low"] <= F.col("stop")).otherwise(x["high"] >= F.col("stop"))
    reached = lambda x: F.when(F.col("signal") == "BUY", x["high"] >= F.col("goal")).otherwise(x["low"] <= F.col("goal"))
    steps = F.transform("ahead", lambda x, i: F.struct((i + 1).alias("hold"), F.when(stopped(x), "stop_loss").when(reached(x), "target").alias("reason"), x["bar_ts"].alias("exit_ts"), x["close"].alias("close")))
    hit = F.filter(steps, lambda s: s["reason"].isNotNull())
    last = F.element_at(steps, -1)
    exit_ = F.coalesce(F.get(hit, F.lit(0)), last)
    rows = rows.withColumn("exit", exit_)
    price = F.when(F.col("exit.reason") == "stop_loss", F.col("stop")).when(F.col("exit.reason") == "target", F.col("goal")).otherwise(F.col("exit.close"))
    rows = rows.withColumn("exit_price", price)
    gain = F.when(buy, F.col("exit_price") - entry).otherwise(entry - F.col("exit_price")) / entry * 100
    return rows.select("symbol", "idx", F.col("bar_ts").alias("entry_ts"), "exit.exit_ts", F.col("signal").alias("direction"), entry.alias("entry_price"), "exit_price", gain.alias("return_percent"), F.col("exit.hold").cast("int").alias("hold_days"), F.coalesce("exit.reason", F.lit("time_exit")).alias("exit_reason"), *keep)


def simulated(df: DataFrame) -> DataFrame:
    """Trades of each symbol with at least LEAST_BARS bars: after one, the scan goes on at the bar behind its exit."""
    counted = df.withColumn("__n", F.count("*").over(Window.partitionBy("symbol"))).filter(F.col("__n") >= LEAST_BARS).drop("__n")
    trades = candidate_trades(with_signals(counted))
    rest = [c for c in trades.columns if c != "symbol"]  # idx first, so that trades sort by it
    steps = F.array_sort(F.collect_list(F.struct(*rest)))
    start = F.struct(F.lit(-1).alias("free"), F.slice("steps", 1, 0).alias("taken"))
    take = lambda a, t: F.when(t["idx"] >= a["free"], F.struct((t["idx"] + t["hold_days"] + 1).alias("free"), F.array_append(a["taken"], t).alias("taken"))).otherwise(a)
    chosen = trades.groupBy("symbol").agg(steps.alias("steps"))
    return chosen.select("symbol", F.inline(F.aggregate("steps", start, take, lambda a: a["taken"])))


def _running(returns: Column) -> Column:
    """Number, total, mean and sum of squared deviations of an array, by Welford's update from left to right."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "total", "mean", "squares")])

    def add(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), (a["total"] + x).alias("total"), mean.alias("mean"), (a["squares"] + (x - a["mean"]) * (x - mean)).alias("squares"))

    return F.aggregate(returns, start, add)


def statistics(trades: DataFrame) -> DataFrame:
    """Counts, win rate, means, profit factor, drawdown of the summed returns, Sharpe ratio and exit reasons for each symbol.

    Returns are added up trade by trade in order of idx, with the steps that SQL engines take: where every trade loses 3 %, their deviation is
    what rounding left, and a ratio by ``F.stddev_samp``, which groups its terms otherwise, differs in the third digit.
    """
    order = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("return_percent")
    df = trades.withColumn("equity", F.sum("return_percent").over(order)).withColumn("drop", F.greatest(F.lit(0.0), F.max("equity").over(order)) - F.col("equity"))
    won, lost = F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r <= 0, r)))
    factor = F.when(F.count_if(r <= 0) == 0, F.coalesce(won, F.lit(0.0)) / 0.001).when(lost == 0, F.lit(float("inf"))).otherwise(F.coalesce(won, F.lit(0.0)) / F.when(lost == 0, None).otherwise(lost))
    hold = F.avg("hold_days")
    steps = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", "return_percent"))), lambda t: t["return_percent"]), lambda x: x.isNotNull())
    known = F.col("__r.n")
    average, deviation = F.try_divide("__r.total", known), F.when(known > 1, F.sqrt(F.try_divide(F.col("__r.squares"), known - 1)))
    year = F.sqrt(F.when(F.col("mean_hold") == 0, F.lit(12.0)).otherwise(F.try_divide(F.lit(252), "mean_hold")))
    sharpe = F.when((F.col("trades") < 2) | (deviation == 0), 0.0).otherwise(F.try_divide(average, deviation) * year)
    counts = {name: F.count_if(F.col("exit_reason") == name).alias(f"n_{name}") for name in ("stop_loss", "target", "time_exit")}
    out = df.groupBy("symbol").agg(F.count("*").alias("trades"), F.count_if(r > 0).alias("wins"), (F.count_if(r > 0) / F.count("*") * 100).alias("win_rate"), factor.alias("profit_factor"), hold.alias("mean_hold"), F.max("drop").alias("max_drawdown"), _running(steps).alias("__r"), *counts.values())
    return out.select("symbol", "trades", "wins", "win_rate", average.alias("mean_return"), F.when(known > 0, F.col("__r.total")).alias("total_return"), "profit_factor", "mean_hold", "max_drawdown", sharpe.alias("sharpe"), *[f"n_{name}" for name in counts])


def statistics_of(symbols: DataFrame, trades: DataFrame) -> DataFrame:
    """``statistics`` of each of ``symbols`` (symbol); those without trades have zeros."""
    found = statistics(trades)
    rows = symbols.select("symbol").distinct().join(found, "symbol", "left")
    return rows.select("symbol", *[F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)).alias(c) for c in found.columns if c != "symbol"])
