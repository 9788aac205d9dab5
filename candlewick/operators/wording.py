"""Texts of analyses: percentile sentences, insights, a summary, ladders of indicator readings, fallback records.

Numbers are written as given; a sentence whose inputs are missing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(x: Column | str, places: int) -> Column:
    """A number with so many places; halves go to the even neighbour."""
    value = F.col(x) if isinstance(x, str) else x
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.bround(value.cast("double"), places)))


def _first(*cases) -> Column:
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case) if isinstance(case, tuple) else out.otherwise(case)
    return out


def _fifths(x: Column, texts: tuple[str, ...]) -> Column:
    return _first(*[(x < 20 * (k + 1), t) for k, t in enumerate(texts[:4])], (x.isNotNull(), texts[4]))


#: What follows each reading, for percentiles below 20, 40, 60, 80 and above.
RSI = ("extremely oversold historically", "below average, oversold territory", "neutral zone", "above average, overbought territory", "extremely overbought historically")
VOLATILITY = ("extremely low volatility, tight range", "below average volatility", "normal volatility range", "elevated volatility", "extreme volatility, high risk")
VOLUME = ("very low participation", "below average participation", "normal participation", "strong participation, accumulation", "exceptional volume, institutional activity")
POSITION = ("near lows, potential support", "lower third, consolidation zone", "mid-range, neutral", "upper third, strength", "near highs, potential resistance")
COMPOSITE = (
    "Extremely bearish setup - Strong sell signals across multiple indicators", "Bearish setup - Multiple negative factors, consider reducing exposure", "Neutral setup - Mixed signals, wait for clearer direction",
    "Bullish setup - Multiple positive factors align, favorable for entry", "Extremely bullish setup - Strong buy signals across multiple indicators")


def percentile_texts(df: DataFrame) -> DataFrame:
    """``rsi_text``, ``volatility_text``, ``volume_text``, ``position_text`` and ``composite_text`` from the readings (rsi_14, vol_10 in percent,
    volume_ratio, range_position) and their percentiles; null where a reading or percentile is unknown."""
    said = lambda head, pct, texts: F.concat(head, F.lit(" is in the "), number(pct, 0), F.lit("th percentile - "), _fifths(F.col(pct), texts))
    place = F.concat(F.lit("Price at "), number("range_position", 0), F.lit("th percentile of 6-month range - "), _fifths(F.col("range_position"), POSITION))
    return df.withColumns({
        "rsi_text": said(F.concat(F.lit("RSI at "), number("rsi_14", 1)), "rsi_pct", RSI),
        "volatility_text": said(F.concat(F.lit("10D volatility at "), number("vol_10", 2), F.lit("%")), "volatility_pct", VOLATILITY),
        "volume_text": said(F.concat(F.lit("Volume at "), number("volume_ratio", 2), F.lit("x average")), "volume_pct", VOLUME),
        "position_text": place,
        "composite_text": _fifths(F.col("composite_score"), COMPOSITE),
    })


def insights(df: DataFrame) -> DataFrame:
    """``insights``: up to twelve sentences in a fixed order, and ``summary``.

    Needs recommendation, confidence, entry_price, target_price, stop_loss, risk_reward, composite_score, the texts of ``percentile_texts``,
    sector_trend, relative_strength, sector_score, ret_5, ret_20, key_opportunities, key_risks and time_horizon; any may be null.
    """
    rec, sure = F.coalesce("recommendation", F.lit("HOLD")), F.coalesce(F.col("confidence").cast("int"), F.lit(50)).cast("string")
    entry, goal, stop, ratio, score = (F.col(c) for c in ("entry_price", "target_price", "stop_loss", "risk_reward", "composite_score"))
    whole = number("composite_score", 0)
    priced = (entry != 0) & (goal != 0)
    move = lambda name, x: F.coalesce(F.when(priced, F.concat(F.lit(f" - Potential {name} of "), number(x / entry * 100, 1), F.lit("% to target ₹"), number(goal, 2))), F.lit(""))
    action = F.concat(
        _first((rec == "BUY", "🟢 **"), (rec == "SELL", "🔴 **"), F.lit("🟡 **")), rec, F.when(rec.isin("BUY", "SELL"), F.lit("** signal with ")).otherwise("** recommendation with "), sure, F.lit("% confidence"),
        _first((rec == "BUY", move("upside", goal - entry)), (rec == "SELL", move("downside", entry - goal)), F.lit(" - Wait for clearer signals")))
    odds = F.concat(number("risk_reward", 2), F.lit(":1"))
    at = F.concat(F.lit(" with stop-loss at ₹"), number("stop_loss", 2))
    reward = F.when((ratio != 0) & (stop != 0), _first(
        (ratio >= 2, F.concat(F.lit("✅ Favorable risk-reward ratio of "), odds, at)), (ratio >= 1.5, F.concat(F.lit("⚖️ Acceptable risk-reward ratio of "), odds, at)),
        F.concat(F.lit("⚠️ Limited risk-reward ratio of "), odds, F.lit(" - Consider waiting for better setup"))))
    composite = F.concat(F.lit("📊 Composite score of "), whole, _first((score >= 70, "/100 indicates strong bullish alignment across indicators"), (score <= 30, "/100 indicates strong bearish alignment across indicators"), F.lit("/100 shows mixed signals - exercise caution")))
    wide = F.lower("volatility_text").rlike("extreme|elevated")
    volatility = F.when(wide, F.concat(F.lit("⚠️ "), "volatility_text", F.lit(" - Use wider stops"))).otherwise(F.concat(F.lit("📉 "), "volatility_text"))
    trend, strength = F.lower("sector_trend"), F.lower("relative_strength")
    over, under = F.contains(strength, F.lit("outperforming")), F.contains(strength, F.lit("underperforming"))
    sector = F.when((trend != "") & (strength != ""), _first(
        (F.contains(trend, F.lit("bullish")) & over, "🚀 Stock is outperforming in a bullish sector - strong positive tailwinds"), (F.contains(trend, F.lit("bearish")) & under, "⚠️ Stock is underperforming in a bearish sector - significant headwinds"),
        (over, "💪 Stock showing relative strength vs sector peers"), (under, "⚠️ Stock showing relative weakness vs sector peers")))
    r5, r20 = F.col("ret_5"), F.col("ret_20")
    both = lambda a, b, c: F.concat(F.lit(a), number("ret_5", 1), F.lit(b), number("ret_20", 1), F.lit(c))
    momentum = _first(
        ((r5 > 0) & (r20 > 0) & (r5 > r20), both("⚡ Momentum accelerating - 5D return (", "%) exceeds 20D return (", "%)")), ((r5 > 0) & (r20 > 0), both("📈 Positive momentum maintained - 5D: ", "%, 20D: ", "%")),
        ((r5 < 0) & (r20 < 0) & (r5 < r20), both("⚠️ Momentum deteriorating - 5D return (", "%) worse than 20D (", "%)")), ((r5 < 0) & (r20 < 0), both("📉 Negative momentum - 5D: ", "%, 20D: ", "%")))
    position = F.concat(F.lit("💡 "), "position_text", _first((F.contains("position_text", F.lit("near lows")), " - potential bounce zone"), (F.contains("position_text", F.lit("near highs")), " - watch for breakout or rejection"), F.lit("")))
    horizon = F.coalesce(F.create_map(*[F.lit(x) for x in ("short_term", "Short-term trade (days to weeks)", "medium_term", "Medium-term position (weeks to months)", "long_term", "Long-term investment (months+)")])[F.coalesce("time_horizon", F.lit(""))], F.when(F.col("time_horizon") != "", F.col("time_horizon")))
    lines = [
        action, reward, composite, F.concat(F.lit("📈 "), "rsi_text"), F.concat(F.lit("📊 "), "volume_text"), volatility, sector, momentum, position,
        F.concat(F.lit("💎 Key catalyst: "), F.get("key_opportunities", F.lit(0))), F.concat(F.lit("⚠️ Primary risk: "), F.get("key_risks", F.lit(0))), F.concat(F.lit("⏱️ Recommended timeframe: "), horizon)]
    c, s = F.coalesce(F.col("confidence"), F.lit(50)), F.coalesce(score, F.lit(50))
    mood = _first(
        ((rec == "BUY") & (c >= 70) & (s >= 60), "Strong buying opportunity"), ((rec == "BUY") & (c >= 50), "Moderate buying opportunity"), ((rec == "SELL") & (c >= 70) & (s <= 40), "Strong selling pressure"),
        ((rec == "SELL") & (c >= 50), "Consider reducing exposure"), (s >= 60, "Bullish setup, but wait for confirmation"), (s <= 40, "Bearish setup, avoid entry"), F.lit("Neutral setup with mixed signals"))
    context = F.coalesce(F.when(strength != "", _first((over, " with relative sector strength"), (under, " despite sector weakness"), F.lit(" in line with sector"))), F.lit(""))
    summary = F.concat(mood, context, F.lit(" (Confidence: "), sure, F.lit("%, Composite: "), number(s, 0), F.lit("/100)"))
    return df.withColumns({"insights": F.array_compact(F.array(*lines)), "summary": summary})


def readings(df: DataFrame) -> DataFrame:
    """Ladders: ``from_high`` and ``from_low`` (percent off the 52-week range), RSI, MACD histogram, ATR percent, volatility and ADX in words; "N/A" where unknown."""
    known = lambda x: F.coalesce(x, F.lit("N/A"))
    price, high, low = F.col("price"), F.coalesce("week_52_high", "price"), F.coalesce("week_52_low", "price")
    rsi, hist, adx = F.col("rsi_14"), F.col("macd_hist"), F.col("adx")
    atr = F.try_divide(F.coalesce("atr_14", F.lit(0.0)), price) * 100
    return df.withColumns({
        "from_high": known(F.when(high > 0, number((high - price) / high * 100, 1))),
        "from_low": known(F.when(low > 0, number((price - low) / low * 100, 1))),
        "rsi_reading": known(_first((rsi < 25, "Extremely Oversold - Strong bounce expected"), (rsi < 30, "Oversold - Watch for reversal"), (rsi < 40, "Approaching oversold"), (rsi > 80, "Extremely Overbought - Correction likely"), (rsi > 70, "Overbought - Caution advised"), (rsi > 60, "Approaching overbought"), (rsi.isNotNull(), "Neutral zone"))),
        "macd_reading": known(_first((hist > 0.5, "Strong bullish momentum"), (hist > 0, "Bullish momentum building"), (hist < -0.5, "Strong bearish momentum"), (hist < 0, "Bearish momentum building"), (hist.isNotNull(), "Neutral"))),
        "atr_text": known(number(atr, 1)),
        "volatility_reading": known(_first((atr > 4, "HIGH volatility - use wider stops"), (atr > 2, "MODERATE volatility"), (atr.isNotNull(), "LOW volatility - tighter stops possible"))),
        "adx_reading": known(_first((adx > 50, "Very strong trend"), (adx > 25, "Strong trend - trade with trend"), (adx > 20, "Developing trend"), (adx.isNotNull(), "Weak/No trend - range-bound"))),
    })


def fallback_sentiment(aggregate: DataFrame) -> DataFrame:
    """The rule-based record of an ``aggregate`` of article sentiments (overall, mean_score, n), for when there is no model's answer."""
    none = F.array().cast("array<string>")
    mood = F.coalesce("overall", F.lit("neutral"))
    return aggregate.withColumns({
        "overall_sentiment": mood, "score": F.coalesce("mean_score", F.lit(0.0)), "confidence": F.lit(0.6), "summary": F.concat(F.lit("Analysis of "), F.coalesce("n", F.lit(0)), F.lit(" articles")), "key_themes": none,
        "market_impact": mood, "key_risks": none, "key_opportunities": none, "recommended_action": F.lit("HOLD")})
