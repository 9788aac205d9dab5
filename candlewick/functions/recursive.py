"""Recursive filters: exponential means and what is built on them, the directional index, parabolic stops, adaptive means.

Spark has no recursive window, so each symbol's series goes through one Arrow-backed grouped function that
computes all filters in one pass of linear cost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def ewm(x: np.ndarray, alpha: float, least: int = 1) -> np.ndarray:
    """y = alpha * x + (1 - alpha) * y before, from the first value on; null until ``least`` values."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean().to_numpy()


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return ewm(x, 2 / (n + 1), n)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return ewm(x, 1 / n, n)


def seeded_wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean, started from the mean of the first n values; null where there is no value."""
    out = np.full(len(x), np.nan)
    good = np.flatnonzero(~np.isnan(x))
    if len(good) >= n:
        out[good[n - 1 :]] = ewm(np.concatenate(([x[good[:n]].mean()], x[good[n:]])), 1 / n)
    return out


def _divide(a, b):
    with np.errstate(all="ignore"):
        return np.where(b != 0, a / np.where(b != 0, b, 1), np.nan)


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    change = np.diff(close, prepend=close[:1]) if len(close) else close
    up, down = wilder(np.maximum(change, 0), n), wilder(np.maximum(-change, 0), n)
    return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + _divide(up, down))))


def directional(high, low, close, n: int = 14):
    """ADX, DI+ and DI-."""
    if len(close) < 2:
        return (np.full(len(close), np.nan),) * 3
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    before = np.concatenate(([np.nan], close[:-1]))
    reach = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    plus[0] = minus[0] = reach[0] = np.nan
    span = seeded_wilder(reach, n)
    p, m = 100 * _divide(seeded_wilder(plus, n), span), 100 * _divide(seeded_wilder(minus, n), span)
    dx = 100 * _divide(np.abs(p - m), p + m)
    return seeded_wilder(dx, n), p, m


def parabolic(high, low, step: float = 0.02, most: float = 0.2):
    """Parabolic stop and reverse: the stop, and whether the trend is up."""
    n = len(high)
    stop, rising = np.full(n, np.nan), np.zeros(n, bool)
    if n < 2:
        return stop, rising
    up, factor, extreme, value = True, step, high[0], low[0]
    for i in range(1, n):
        value = value + factor * (extreme - value)
        if up:
            value = min(value, low[i - 1], low[i - 2] if i > 1 else low[i - 1])
            if low[i] < value:
                up, value, extreme, factor = False, extreme, low[i], step
            elif high[i] > extreme:
                extreme, factor = high[i], min(factor + step, most)
        else:
            value = max(value, high[i - 1], high[i - 2] if i > 1 else high[i - 1])
            if high[i] > value:
                up, value, extreme, factor = True, extreme, high[i], step
            elif low[i] < extreme:
                extreme, factor = low[i], min(factor + step, most)
        stop[i], rising[i] = value, up
    return stop, rising


def adaptive(close: np.ndarray, n: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive mean: the smoothing follows the ratio of net to total movement."""
    out = np.full(len(close), np.nan)
    if len(close) < n:
        return out
    moved = np.abs(np.diff(close, prepend=close[0]))
    state = close[n - 1]
    out[n - 1] = state
    for i in range(n, len(close)):
        noise = moved[i - n + 1 : i + 1].sum()
        efficiency = abs(close[i] - close[i - n]) / noise if noise else 0.0
        smooth = (efficiency * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
        state += smooth * (close[i] - state)
        out[i] = state
    return out


def _stochastic(x: np.ndarray, n: int) -> np.ndarray:
    s = pd.Series(x)
    low, high = s.rolling(n).min().to_numpy(), s.rolling(n).max().to_numpy()
    return 100 * _divide(x - low, high - low)


COLUMNS = ("rsi_14", "rsi_7", "macd", "macd_signal", "macd_hist", "ema_9", "ema_21", "ema_50", "ema_200", "atr_wilder_14", "trix_15", "mass_index", "tsi", "stc", "ppo", "ppo_signal", "ppo_hist", "force_13", "adx", "di_plus", "di_minus", "psar", "kama")


def recursive_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bar_ts", kind="stable").reset_index(drop=True)
    high, low, close, volume = (pdf[c].to_numpy(np.float64) for c in ("high", "low", "close", "volume"))
    n = len(pdf)
    before = np.concatenate(([np.nan], close[:-1]))
    out = {"rsi_14": rsi(close, 14), "rsi_7": rsi(close, 7)}
    macd = ema(close, 12) - ema(close, 26)
    out |= {"macd": macd, "macd_signal": ema(macd, 9)}
    out["macd_hist"] = macd - out["macd_signal"]
    out |= {f"ema_{k}": ema(close, k) for k in (9, 21, 50, 200)}
    reach = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    out["atr_wilder_14"] = seeded_wilder(reach, 14)
    triple = ema(ema(ema(close, 15), 15), 15)
    out["trix_15"] = 100 * _divide(np.diff(triple, prepend=np.nan), np.concatenate(([np.nan], triple[:-1])))
    single = ema(high - low, 9)
    out["mass_index"] = pd.Series(_divide(single, ema(single, 9))).rolling(25).sum().to_numpy()
    change = close - before
    out["tsi"] = 100 * _divide(ema(ema(change, 25), 13), ema(ema(np.abs(change), 25), 13))
    first = _stochastic(ema(close, 23) - ema(close, 50), 10)
    out["stc"] = ema(_stochastic(ema(first, 3), 10), 3)
    out["ppo"] = 100 * _divide(macd, ema(close, 26))
    out["ppo_signal"] = ema(out["ppo"], 9)
    out["ppo_hist"] = out["ppo"] - out["ppo_signal"]
    out["force_13"] = ema(change * volume, 13)
    out["adx"], out["di_plus"], out["di_minus"] = directional(high, low, close)
    out["psar"], rising = parabolic(high, low)
    out["kama"] = adaptive(close)
    added = pd.DataFrame({k: pd.Series(v, dtype="float64") for k, v in out.items()}, index=range(n))
    return pd.concat([pdf, added[list(COLUMNS)], pd.Series(rising, name="psar_up", dtype=bool)], axis=1)


def recursive(bars: DataFrame) -> DataFrame:
    """Add all recursive indicators to bars; one shuffle by symbol."""
    schema = StructType(list(bars.schema.fields))
    for c in COLUMNS:
        schema = schema.add(c, "double")
    return bars.groupBy("symbol").applyInPandas(recursive_columns, schema.add("psar_up", "boolean"))
