"""Signals, percentile ranks, composite scores, validation and insights: row-wise rules over indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import whole


def signals(df: DataFrame) -> DataFrame:
    """Labels of RSI, MACD, trend, momentum and volatility; null where an input is."""
    price, s20, s50 = F.col("close"), F.col("sma_20"), F.col("sma_50")
    return df.withColumns({
        "rsi_signal": F.when(F.col("rsi_14") < 30, "oversold").when(F.col("rsi_14") > 70, "overbought").when(F.col("rsi_14").isNotNull(), "neutral"),
        "macd_label": F.when(F.col("macd") > F.col("macd_signal"), "bullish").when(F.col("macd_signal").isNotNull(), "bearish"),
        "trend": F.when(s50.isNotNull() & s20.isNotNull(), F.when((price > s20) & (s20 > s50), "strong_uptrend").when(price > s20, "uptrend").when((price < s20) & (s20 < s50), "strong_downtrend").otherwise("downtrend")),
        "momentum": F.when(F.col("stoch_k") < 20, "oversold").when(F.col("stoch_k") > 80, "overbought").when(F.col("stoch_k").isNotNull(), "neutral"),
        "volatility": F.when(F.col("atr_14") > 10, "high").when(F.col("atr_14") < 5, "low").when(F.col("atr_14").isNotNull(), "moderate"),
    })


def percentile_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, for each column, the share of the symbol's series strictly below its newest value, in percent; windows on the same key, no join."""
    newest = {c: F.max_by(c, "bar_ts").over(whole()) for c in columns}
    df = df.withColumns({f"__{c}": v for c, v in newest.items()})
    below = {name: F.try_divide(F.count_if(F.col(c) < F.col(f"__{c}")).over(whole()) * 100.0, F.count(c).over(whole())) for c, name in columns.items()}
    return df.withColumns(below).drop(*[f"__{c}" for c in columns])


def range_position(df: DataFrame, value: str = "close") -> DataFrame:
    low, high = F.min(value), F.max(value)
    return df.groupBy("symbol").agg((F.try_divide(F.max_by(value, "bar_ts") - low, high - low) * 100).alias("range_position"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def composite(df: DataFrame) -> DataFrame:
    """``composite_score`` from 50: RSI and volume percentiles, distances from SMAs, MACD histogram (an unknown one counts as 0, which isn't positive) and volatility percentile."""
    points = lambda *cases: F.coalesce(_ladder(cases), F.lit(0))
    total = (
        F.lit(50)
        + points((F.col("rsi_pct") < 30, 15), (F.col("rsi_pct") > 70, -15))
        + points(((F.col("volume_pct") > 60) & (F.col("ret_1") > 0), 12), (F.col("volume_pct") < 40, -8))
        + points(((F.col("dist_sma_20") > 0) & (F.col("dist_sma_50") > 0), 12), ((F.col("dist_sma_20") < 0) & (F.col("dist_sma_50") < 0), -12))
        + F.when(F.col("macd_hist") > 0, 10).otherwise(-10)
        + points((F.col("volatility_pct") > 80, -5)))
    return df.withColumn("composite_score", clamp(total, 0, 100))


def _ladder(cases) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out


def alignment(side: str) -> tuple[Column, Column]:
    """(aligned checks, checks made) of RSI, MACD, trend, stochastic and volume for BUY or SELL; unknown inputs make no check."""
    buy = side == "BUY"
    above = lambda s: F.col("close") > F.col(s) if buy else F.col("close") < F.col(s)
    checks = [
        (F.col("rsi_14") < 70) if buy else (F.col("rsi_14") > 30),
        (F.col("macd") > F.col("macd_signal")) if buy else (F.col("macd") < F.col("macd_signal")),
        F.when(F.col("sma_20").isNotNull() & F.col("sma_50").isNotNull(), above("sma_20") | above("sma_50")),
        (F.col("stoch_k") < 80) if buy else (F.col("stoch_k") > 20),
        F.col("volume_ratio") >= 0.7,
    ]
    made = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in checks), F.lit(0))
    good = sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0))
    return good, made


def alignment_ratio(side: str, least: int = 3) -> Column:
    good, made = alignment(side)
    return F.when(made >= least, good / made).otherwise(0.0)


def recalibrated(confidence: Column, ratio: Column) -> Column:
    """A ratio below a half caps the confidence at 60; one of 0.8 and more adds 5, up to 85, to confidences below 80."""
    return F.when(ratio < 0.5, F.least(confidence, F.lit(60.0))).when((ratio >= 0.8) & (confidence < 80), F.least(confidence + 5, F.lit(85.0))).otherwise(confidence)


def validated(df: DataFrame) -> DataFrame:
    """``quality_score``, ``quality_rating`` and ``warnings`` of recommendations joined to indicators.

    Needs recommendation, confidence, entry_price, target_price, stop_loss, risk_reward, reasoning, key_risks, price and
    the indicator columns; deductions start from 100.
    """
    rec = F.col("recommendation")
    buy, sell = rec == "BUY", rec == "SELL"
    entry, goal, stop = F.col("entry_price"), F.col("target_price"), F.col("stop_loss")
    both = lambda op: (op(F.col("price"), F.col("sma_20"))) & (op(F.col("price"), F.col("sma_50")))
    side = F.when(buy, alignment_ratio("BUY")).when(sell, alignment_ratio("SELL")).otherwise(1.0)
    rules = [
        ("invalid recommendation", ~rec.isin("BUY", "SELL", "HOLD") | rec.isNull(), 50),
        ("confidence out of range", F.col("confidence").isNull() | ~F.col("confidence").between(0, 100), 10),
        ("target on the wrong side", (buy & (goal <= entry)) | (sell & (goal >= entry)), 15),
        ("stop on the wrong side", (buy & (stop >= entry)) | (sell & (stop <= entry)), 15),
        ("entry far from price", F.abs(F.try_divide(entry - F.col("price"), F.col("price"))) > 0.1, 5),
        ("contradicts RSI", (buy & (F.col("rsi_14") > 70)) | (sell & (F.col("rsi_14") < 30)), 10),
        ("contradicts MACD", (buy & (F.col("macd") < F.col("macd_signal"))) | (sell & (F.col("macd") > F.col("macd_signal"))), 8),
        ("against both averages", (buy & both(lambda a, b: a < b)) | (sell & both(lambda a, b: a > b)), 10),
        ("low volume", F.col("volume_ratio") < 0.5, 5),
        ("contradicts stochastic", (buy & (F.col("stoch_k") > 80)) | (sell & (F.col("stoch_k") < 20)), 8),
        ("weak alignment", side < 0.6, 10),
        ("short reasoning", F.length(F.coalesce("reasoning", F.lit(""))) < 100, 15),
        ("no indicator named", ~F.coalesce(F.lower("reasoning"), F.lit("")).rlike("rsi|macd|trend|support|resistance"), 5),
        ("fewer than two risks", F.coalesce(F.size("key_risks"), F.lit(0)) < 2, 5),
        ("poor risk and reward", F.col("risk_reward") < 1.5, 5),
    ]
    hit = [(text, F.coalesce(cond, F.lit(False)), points) for text, cond, points in rules]
    score = F.greatest(F.lit(0), F.lit(100) - sum((F.when(c, p).otherwise(0) for _, c, p in hit), F.lit(0)))
    warnings = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c, _ in hit]))
    df = df.withColumns({"alignment": F.round(side, 2), "quality_score": score, "warnings": warnings})
    rating = F.when(F.col("quality_score") >= 90, "excellent").when(F.col("quality_score") >= 75, "good").when(F.col("quality_score") >= 60, "fair").otherwise("poor")
    return df.withColumns({"quality_rating": rating, "confidence_recalibrated": recalibrated(F.col("confidence").cast("double"), F.col("alignment"))})


def confidence_band(c: Column) -> Column:
    return F.when(c >= 85, "very_high").when(c >= 70, "high").when(c >= 55, "medium").when(c >= 40, "low").otherwise("very_low")


def merged_ensemble(df: DataFrame) -> DataFrame:
    """Primary and secondary analyses in one: confidence int(0.6 p + 0.4 s), 5 more on agreement up to 100, 10 less otherwise down to 0; lists united, first spelling kept."""
    agree = F.col("primary.recommendation") == F.col("secondary.recommendation")
    mixed = F.floor(0.6 * F.col("primary.confidence") + 0.4 * F.col("secondary.confidence"))
    union = lambda name: F.aggregate(
        F.concat(F.coalesce(F.col(f"primary.{name}"), F.array().cast("array<string>")), F.coalesce(F.col(f"secondary.{name}"), F.array().cast("array<string>"))),
        F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x))), a).otherwise(F.array_append(a, x)))
    return df.withColumns({"recommendation": F.col("primary.recommendation"), "confidence": F.when(agree, F.least(mixed + 5, F.lit(100))).otherwise(F.greatest(mixed - 10, F.lit(0))), "agreement": agree, "key_risks": union("key_risks"), "key_opportunities": union("key_opportunities")})


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def parsed_analysis(raw: Column, schema: str) -> Column:
    """A model's answer as a struct: plain JSON, else the fenced JSON, else the first balanced braces."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})", 1)
    good = lambda s: F.when(F.try_parse_json(s).isNotNull() & F.startswith(F.trim(s), F.lit("{")), F.from_json(s, schema))
    return F.coalesce(good(raw), good(fenced), good(braces))


def is_masked(value: str) -> Column:
    """Whether a value is what ``masked`` makes, so that it must not be stored as a secret."""
    return F.coalesce((F.col(value) == "****") | F.contains(value, F.lit("...")), F.lit(False))


def masked(secret: str) -> Column:
    s = F.col(secret)
    return F.when(F.length(s) > 12, F.concat(F.substring(s, 1, 8), F.lit("..."), F.right(s, F.lit(4)))).when(s != "", "****")
