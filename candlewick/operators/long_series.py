"""Indicators of series that are too long for one task: bars in chunks of equal length, whatever their symbol.

Windows see a chunk and a halo of bars before it. Running totals add what the chunks before a chunk add up to. Recursive filters are
affine maps of their state: a chunk composes those of its bars into one, the maps of all chunks give the state each
begins with, and a second pass starts from there. Every result equals that of the whole series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shared import scratch
from ..functions.windows import before, highest, lowest, ratio, total
from . import backtest as bt
from . import indicators as ind

#: Bars of a chunk, and those before it that windows see: the longest frame is 200, and windows on windows reach 234 back.
ROWS, HALO = 10_000, 256


def numbered(bars: DataFrame, rows: int = ROWS) -> DataFrame:
    """``bars`` with ``idx``, their place in their symbol's series from 0, and ``chunk``; a table in the shared folder.

    Bars are dealt by range of (symbol, bar_ts), so a long series is many tasks; only the number of bars of each
    symbol in each part is looked at in one place.
    """
    spark = bars.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "bars")
    bars.write.parquet(f"{path}/given")  # ranges are found by a look at all rows, which would make them twice
    bars = spark.read.schema(bars.schema).parquet(f"{path}/given")
    bars.repartitionByRange(parts, "symbol", "bar_ts").withColumn("__part", F.spark_partition_id()).write.parquet(f"{path}/dealt")
    dealt = spark.read.parquet(f"{path}/dealt")
    earlier = Window.partitionBy("symbol").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("symbol", "__part").agg(F.count("*").alias("__n"))
    first = counts.select("symbol", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    own = Window.partitionBy("symbol", "__part").orderBy("bar_ts")
    out = dealt.withColumn("__at", F.row_number().over(own) - 1).join(first, [dealt["symbol"].eqNullSafe(first["symbol"]), dealt["__part"] == first["__part"]]).drop(first["symbol"], first["__part"])
    out = out.withColumn("idx", F.col("__first") + F.col("__at")).withColumn("chunk", F.floor(F.col("idx") / rows).cast("long"))
    out.drop("__part", "__at", "__first").write.parquet(f"{path}/numbered")
    return spark.read.parquet(f"{path}/numbered")


def in_chunks(bars: DataFrame, step: Callable[[DataFrame], DataFrame], rows: int = ROWS, halo: int = HALO, ahead: int = 0) -> DataFrame:
    """``step``, a function that adds columns by windows over symbol and bar_ts of ``halo`` bars before and ``ahead`` bars after at most, on numbered ``bars``.

    Each bar also goes to the chunks whose halo it is in. Windows inside ``step`` take symbol and chunk together for the symbol.
    """
    chunk = lambda idx: F.floor(idx / rows).cast("long")
    seen = bars.withColumn("__in", F.explode(F.sequence(F.greatest(chunk(F.col("idx") - ahead), F.lit(0).cast("long")), chunk(F.col("idx") + halo))))
    done = step(seen.withColumn("symbol", F.struct("symbol", "__in")).drop("__in"))
    return done.filter(F.col("chunk") == F.col("symbol.__in")).withColumn("symbol", F.col("symbol.symbol"))


def running(bars: DataFrame, what: dict[str, Column], fold=F.sum, join: Callable[[Column, Column], Column] = lambda a, b: a + F.coalesce(b, F.lit(0.0))) -> DataFrame:
    """Add running folds of expressions of numbered ``bars`` from the start of each series: those inside the chunk, joined to those of the chunks before it."""
    rows = bars.withColumns({f"__{k}": v for k, v in what.items()})
    inside = Window.partitionBy("symbol", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("symbol", "chunk").agg(*[fold(f"__{k}").alias(k) for k in what])
    behind = whole.select(F.col("symbol").alias("__symbol"), F.col("chunk").alias("__chunk"), *[fold(k).over(earlier).alias(f"__before_{k}") for k in what])
    rows = rows.withColumns({k: fold(f"__{k}").over(inside) for k in what})
    joined = rows.join(behind, rows["symbol"].eqNullSafe(behind["__symbol"]) & (rows["chunk"] == behind["__chunk"]))
    return joined.withColumns({k: join(F.col(k), F.col(f"__before_{k}")) for k in what}).drop("__symbol", "__chunk", *[f"__{k}" for k in what], *[f"__before_{k}" for k in what])


# ---------------------------------------------------------------- associative scan


@dataclass(frozen=True)
class Mean:
    """An exponential mean of ``x``: null until ``least`` values; from the first value on, or, if ``seeded``, from the mean of the first ``least``."""

    x: str
    alpha: float
    least: int
    seeded: bool = False

    def run(self, x: np.ndarray, seen: int, y: float) -> tuple[np.ndarray, int, float]:
        """The means of ``x`` after ``seen`` values that ended in ``y``, how many values there are then, and the last mean.

        Value j moves the mean by its j-th weight, which is 1 / j in the seed and alpha after it, so the last mean is affine in ``y``.
        """
        good = np.flatnonzero(~np.isnan(x))
        out = np.full(len(x), np.nan)
        if not len(good):
            return out, seen, y
        values, start = x[good], self.least if self.seeded else 1
        seed = max(0, min(start - seen, len(values)))
        means = np.empty(len(values))
        if seed:
            means[:seed] = (seen * y + np.cumsum(values[:seed])) / (seen + np.arange(1, seed + 1))
            y = means[seed - 1]
        if seed < len(values):
            means[seed:] = pd.Series(np.concatenate(([y], values[seed:]))).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]
        late = seen + np.arange(1, len(values) + 1) >= self.least
        out[good[late]] = means[late]
        return out, seen + len(values), float(means[-1])


def ema(x: str, n: int) -> Mean:
    return Mean(x, 2 / (n + 1), n)


def wilder(x: str, n: int, seeded: bool = False) -> Mean:
    return Mean(x, 1 / n, n, seeded)


def scanned(bars: DataFrame, means: dict[str, Mean]) -> DataFrame:
    """Add exponential means to numbered ``bars``, each from a column.

    1. How many values each chunk has, and so how many come before it.
    2. Each chunk's map from the mean before it to that at its end, a factor and a summand.
    3. The maps of one symbol's chunks, one row each, give the mean each chunk begins with.
    4. Each chunk is run from there.
    """
    spark = bars.sparkSession
    path = scratch(spark, "scan")
    earlier = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    names = list(means)
    inputs = sorted({m.x for m in means.values()})
    counts = bars.groupBy("symbol", "chunk").agg(*[F.count(F.nanvl(x, F.lit(None).cast("double"))).alias(f"__n_{x}") for x in inputs])
    seen = counts.select("symbol", "chunk", *[F.coalesce(F.sum(f"__n_{x}").over(earlier), F.lit(0)).cast("long").alias(f"__seen_{x}") for x in inputs])

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        out = {"symbol": pdf["symbol"].iloc[0], "chunk": pdf["chunk"].iloc[0]}
        for k, m in means.items():
            x, n = pdf[m.x].to_numpy(np.float64), int(pdf[f"__seen_{m.x}"].iloc[0])
            out[f"b_{k}"] = m.run(x, n, 0.0)[2]
            out[f"a_{k}"] = m.run(np.where(np.isnan(x), np.nan, 0.0), n, 1.0)[2]
        return pd.DataFrame([out])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk").reset_index(drop=True)
        for k in names:
            a, b, y, begin = pdf[f"a_{k}"].to_numpy(), pdf[f"b_{k}"].to_numpy(), 0.0, np.empty(len(pdf))
            for i in range(len(pdf)):
                begin[i] = y
                y = a[i] * y + b[i]
            pdf[f"y_{k}"] = begin
        return pdf[["symbol", "chunk", *[f"y_{k}" for k in names]]]

    kind = bars.schema["symbol"].dataType.simpleString()
    pairs = lambda prefixes: "".join(f", {p}_{k} double" for k in names for p in prefixes)
    keyed = bars.select("symbol", "chunk", "idx", *[x for x in inputs]).join(seen, ["symbol", "chunk"])
    composed = keyed.groupBy("symbol", "chunk").applyInPandas(maps, f"symbol {kind}, chunk long{pairs('ab')}")
    composed.groupBy("symbol").applyInPandas(fold, f"symbol {kind}, chunk long{pairs('y')}").join(seen, ["symbol", "chunk"]).write.parquet(f"{path}/starts")
    starts = spark.read.parquet(f"{path}/starts")
    extra = [c for c in starts.columns if c not in ("symbol", "chunk")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        found = {k: m.run(pdf[m.x].to_numpy(np.float64), int(pdf[f"__seen_{m.x}"].iloc[0]), float(pdf[f"y_{k}"].iloc[0]))[0] for k, m in means.items()}
        return pd.concat([pdf.drop(columns=extra), pd.DataFrame(found)], axis=1)

    schema = StructType(list(bars.schema.fields))
    for k in names:
        schema = schema.add(k, "double")
    out = bars.join(starts, ["symbol", "chunk"]).select(*bars.columns, *extra).groupBy("symbol", "chunk").applyInPandas(run, schema)
    return out.withColumns({k: F.nanvl(k, F.lit(None).cast("double")) for k in names})


# ---------------------------------------------------------------- indicators

COLUMNS = ("rsi_14", "rsi_7", "macd", "macd_signal", "macd_hist", "ema_9", "ema_21", "ema_50", "ema_200", "atr_wilder_14", "trix_15", "mass_index", "tsi", "stc", "ppo", "ppo_signal", "ppo_hist", "force_13", "adx", "di_plus", "di_minus")


def _moves(bars: DataFrame) -> DataFrame:
    c = before("close")
    known = c.isNotNull()
    up, down = F.col("high") - before("high"), before("low") - F.col("low")
    return bars.withColumns({
        "__change": F.col("close") - c, "__up": F.greatest(F.coalesce(F.col("close") - c, F.lit(0.0)), F.lit(0.0)), "__down": F.greatest(F.coalesce(c - F.col("close"), F.lit(0.0)), F.lit(0.0)),
        "__size": F.abs(F.col("close") - c), "__force": (F.col("close") - c) * F.col("volume"), "__span": F.col("high") - F.col("low"), "__reach": ind.true_range(),
        "__plus": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)), "__minus": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)),
    })


def _stochastic(x: str) -> Column:
    return 100 * ratio(F.col(x) - lowest(x, 10), highest(x, 10) - lowest(x, 10))


def recursive(bars: DataFrame, rows: int = ROWS, halo: int = HALO) -> DataFrame:
    """The exponential indicators in COLUMNS of bars (symbol, bar_ts, high, low, close, volume), by three layers of scans.

    Parabolic stops and the adaptive mean aren't among them. Repeated bars of one time are in any order, as in one pass.
    """
    columns = bars.columns
    df = in_chunks(numbered(bars, rows), _moves, rows, halo)
    rsi = {f"__{side}_{n}": wilder(f"__{side}", n) for side in ("up", "down") for n in (14, 7)}
    df = scanned(df, rsi | {f"ema_{n}": ema("close", n) for n in (9, 21, 50, 200)} | {f"__e{n}": ema("close", n) for n in (12, 26, 15, 23)} | {
        "__s1": ema("__span", 9), "__c1": ema("__change", 25), "__m1": ema("__size", 25), "force_13": ema("__force", 13),
        "atr_wilder_14": wilder("__reach", 14, True), "__p": wilder("__plus", 14, True), "__q": wilder("__minus", 14, True)})
    strength = lambda n: F.when(F.col(f"__up_{n}").isNotNull(), F.when(F.col(f"__down_{n}") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col(f"__up_{n}"), F.col(f"__down_{n}")))))
    df = df.withColumns({"rsi_14": strength(14), "rsi_7": strength(7), "macd": F.col("__e12") - F.col("__e26"), "di_plus": 100 * ratio(F.col("__p"), F.col("atr_wilder_14")), "di_minus": 100 * ratio(F.col("__q"), F.col("atr_wilder_14")), "__wave": F.col("__e23") - F.col("ema_50")})
    df = df.withColumns({"ppo": 100 * ratio(F.col("macd"), F.col("__e26")), "__dx": 100 * ratio(F.abs(F.col("di_plus") - F.col("di_minus")), F.col("di_plus") + F.col("di_minus"))})
    df = in_chunks(df, lambda x: x.withColumn("__k1", _stochastic("__wave")), rows, halo)
    df = scanned(df, {"macd_signal": ema("macd", 9), "ppo_signal": ema("ppo", 9), "__e15b": ema("__e15", 15), "__s2": ema("__s1", 9), "__c2": ema("__c1", 13), "__m2": ema("__m1", 13), "adx": wilder("__dx", 14, True), "__k2": ema("__k1", 3)})
    df = df.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "ppo_hist": F.col("ppo") - F.col("ppo_signal"), "tsi": 100 * ratio(F.col("__c2"), F.col("__m2")), "__mass": ratio(F.col("__s1"), F.col("__s2"))})
    df = in_chunks(df, lambda x: x.withColumns({"__k3": _stochastic("__k2"), "mass_index": total("__mass", 25)}), rows, halo)
    df = scanned(df, {"__e15c": ema("__e15b", 15), "stc": ema("__k3", 3)})
    df = in_chunks(df, lambda x: x.withColumn("trix_15", 100 * ratio(F.col("__e15c") - before("__e15c"), before("__e15c"))), rows, halo)
    return df.select(*columns, *COLUMNS)


def windowed(bars: DataFrame, rows: int = ROWS, halo: int = HALO) -> DataFrame:
    """``indicators.windowed`` of series of any length: frames by halos, cumulative columns by running totals."""
    columns = bars.columns
    kept = numbered(bars, rows)
    df = in_chunks(kept, ind.windowed, rows, halo)
    names = [c for c in df.columns if c not in kept.columns and c not in ind.CUMULATIVE]
    df = running(in_chunks(df.drop(*ind.CUMULATIVE), ind.increments, rows, halo), {k: F.col(f"__inc_{k}") for k in ind.TOTALS})
    return ind.cumulative(df, {k: F.col(k) for k in ind.TOTALS}).select(*columns, *names, *ind.CUMULATIVE)


# ---------------------------------------------------------------- backtest


def next_trades(trades: DataFrame, rows: int = ROWS) -> DataFrame:
    """(symbol, idx, next): the first trade of the symbol at or behind the bar after each one's exit, or null.

    Trades and the bars where they end meet by chunk; a chunk without a later trade takes the first of the next chunk that has any.
    """
    chunk = F.floor(F.col("at") / rows).cast("long")
    none = F.lit(None).cast("long")
    begin = trades.select("symbol", F.col("idx").cast("long").alias("at"), F.lit(0).alias("side"), F.col("idx").cast("long").alias("begins"), none.alias("idx"))
    end = trades.select("symbol", (F.col("idx") + F.col("hold_days") + 1).cast("long").alias("at"), F.lit(1).alias("side"), none.alias("begins"), F.col("idx").cast("long"))
    both = begin.unionByName(end).withColumn("chunk", chunk)
    behind = Window.partitionBy("symbol", "chunk").orderBy(F.col("at").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("inside", F.min("begins").over(behind)).filter("side = 1")
    later = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    firsts = both.groupBy("symbol", "chunk").agg(F.min("begins").alias("first")).select("symbol", "chunk", F.min("first").over(later).alias("beyond"))
    return found.join(firsts, ["symbol", "chunk"]).select("symbol", "idx", F.coalesce("inside", "beyond").alias("next"))


def chosen(trades: DataFrame, rows: int = ROWS) -> DataFrame:
    """The trades of (symbol, idx, hold_days, ...) that a scan takes which goes on at the bar behind each exit, by pointer jumping.

    The first trade of a symbol is taken; what is taken after n jumps and jumps of n together give 2 n, so a chain of t trades takes log2(t) joins.
    """
    spark = trades.sparkSession
    path = scratch(spark, "jumps")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    trades = kept(trades, "trades")
    jumps = kept(next_trades(trades, rows).filter("next IS NOT NULL"), "next-0")
    taken = kept(trades.groupBy("symbol").agg(F.min("idx").cast("long").alias("idx")), "taken-0")
    step = 0
    while not jumps.isEmpty():
        step += 1
        further = taken.join(jumps, ["symbol", "idx"]).select("symbol", F.col("next").alias("idx"))
        taken = kept(taken.unionByName(further).distinct(), f"taken-{step}")
        then = jumps.select("symbol", F.col("idx").alias("next"), F.col("next").alias("then"))
        jumps = kept(jumps.join(then, ["symbol", "next"]).select("symbol", "idx", F.col("then").alias("next")), f"next-{step}")
    return trades.join(taken, ["symbol", "idx"], "left_semi")


def simulated(series: DataFrame, rows: int = ROWS, halo: int = HALO) -> DataFrame:
    """``backtest.simulated`` of numbered bars with their indicators, for series of any length."""
    counts = series.groupBy("symbol").agg(F.count("*").alias("__n")).filter(F.col("__n") >= bt.LEAST_BARS).select("symbol")
    long_ = series.join(counts, "symbol", "left_semi")
    picked = in_chunks(bt.with_signals(long_), lambda x: bt.candidate_trades(x, ("chunk",)), rows, 0, bt.HOLD)
    return chosen(picked.drop("chunk"), rows)


def drawdowns(trades: DataFrame, rows: int = ROWS) -> DataFrame:
    """(symbol, total_return, max_drawdown) of trades: of the summed returns, the end and the deepest fall below their highest point so far, which is 0 at first."""
    df = trades.withColumn("chunk", F.floor(F.col("idx") / rows).cast("long"))
    df = running(df, {"equity": F.col("return_percent")})
    df = running(df, {"peak": F.greatest(F.lit(0.0), F.col("equity"))}, F.max, lambda a, b: F.greatest(a, b))
    return df.groupBy("symbol").agg(F.sum("return_percent").alias("total_return"), F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"))


def backtested(bars: DataFrame, rows: int = ROWS, halo: int = HALO) -> DataFrame:
    """Trades of bars of any length: indicators, signals and exits by chunks, the scan by pointer jumping."""
    series = windowed(recursive(bars, rows, halo), rows, halo)
    return simulated(numbered(series, rows), rows, halo)
