"""Streams with keyed state that ends: answers with a time to live, outcomes that wait for their day, alerts that expire.

State is in RocksDB and leaves by event-time timers or watermarks, so it holds what is open and not what has been. Every stream equals a batch
operator on the same rows, whatever the batches, if rows come no later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType

from ..operators.track import DEFAULT_TTL, TTL
from ..schemas import HORIZONS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000  # microseconds


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _millis_after(micros: int) -> int:
    return -(-int(micros) // 1000)


# ---------------------------------------------------------------- answers with a time to live


class _Answers(StatefulProcessor):
    """The live answer of one key: from ``cached_at`` until ``expires``, in microseconds."""

    def init(self, handle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "cached_at long, expires long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable")
        held = self.answer.get() if self.answer.exists() else None
        kept, out = held, []
        for at, life, value in zip(frame["at"].tolist(), frame["life"].tolist(), frame["value"].tolist()):
            if held is not None and held[0] <= at < held[1]:
                out.append((held[2], held[0], True))
                continue
            out.append((value, at, False))
            if held is None or at >= held[1]:  # a request older than the answer doesn't replace it
                held = (at, at + life, value)
        if held is not kept:
            self.answer.update(tuple(held))
            self.handle.registerTimer(_millis_after(held[1]))
        answer, cached_at, hit = zip(*out)
        yield frame[["kind", "key", "request_id", "at"]].assign(answer=np.array(answer, float), cached_at=np.array(cached_at, np.int64), hit=np.array(hit, bool))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.answer.exists() and _millis_after(self.answer.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def answered(requests: DataFrame, late: str = "0 seconds", ttl: dict[str, int] = TTL) -> DataFrame:
    """Each of ``requests`` (kind, key, request_id, ts, value) with the answer it gets: that of its kind and key if one is live, else its own value, which then lives for its kind's seconds.

    ``ts`` is a timestamp, ``value`` what a request would fetch. Timers take answers out of the state when the
    watermark reaches their end. A request at exactly the end is answered anew; at one time the smaller request_id comes first. Rows without a time have no
    place in the series and are passed over, here and below.
    """
    life = F.coalesce(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv])[F.col("kind")], F.lit(DEFAULT_TTL)).cast("long") * 1_000_000
    rows = requests.filter("ts IS NOT NULL").withWatermark("ts", late).select("kind", "key", "request_id", "ts", F.unix_micros("ts").alias("at"), life.alias("life"), F.col("value").cast("double").alias("value"))
    out = rows.groupBy("kind", "key").transformWithStateInPandas(_Answers(), "kind string, key string, request_id long, at long, answer double, cached_at long, hit boolean", "append", "EventTime")
    return out.select("kind", "key", "request_id", F.timestamp_micros("at").alias("ts"), F.nanvl("answer", F.lit(None).cast("double")).alias("answer"), F.timestamp_micros("cached_at").alias("cached_at"), "hit")


# ---------------------------------------------------------------- outcomes of recommendations

_OPEN = ["rec_id", "horizon", "due", "direction", "entry_price", "target_price", "stop_loss"]
#: Groups that the recommendations or ticks of a symbol are dealt to, and rows that go to the state as one value.
SLOTS, CHUNK = 64, 50_000
_OPEN_TYPES = pa.schema([("rec_id", pa.int64()), ("horizon", pa.string()), ("due", pa.int64()), ("direction", pa.string()), ("entry_price", pa.float64()), ("target_price", pa.float64()), ("stop_loss", pa.float64())])
_BAR_TYPES = pa.schema([("at", pa.int64()), ("close", pa.float64())])


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> list[tuple[bytes]]:
    """The rows as record batches, each the value of one state row: a state is read and written by the batch, not by the row."""
    out = []
    for start in range(0, len(frame), CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_batch(pa.RecordBatch.from_pandas(frame.iloc[start : start + CHUNK], schema, preserve_index=False))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(state, schema: pa.Schema) -> pd.DataFrame:
    batches = [b for (value,) in (state.get() if state.exists() else ()) for b in pa.ipc.open_stream(value)]
    return pa.Table.from_batches(batches, schema).to_pandas()


class _Outcomes(StatefulProcessor):
    """Open recommendations of one symbol and slot, and the bars that one of them may need.

    One timer stands at the first bar that completes any of them; when the watermark reaches it, no earlier bar can come.
    """

    def __init__(self, horizons: dict[str, int]):
        self.horizons = horizons

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")
        self.bars = handle.getListState("bars", "rows binary")

    def _state(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        return _unpacked(self.open, _OPEN_TYPES), _unpacked(self.bars, _BAR_TYPES)

    def _keep(self, waiting: pd.DataFrame, bars: pd.DataFrame, watermark: int, changed: bool = True) -> None:
        """Store what is open; bars before the first due time and the watermark are needed no more."""
        first = min(int(waiting["due"].min()) if len(waiting) else watermark, watermark)
        bars = bars[bars["at"] >= first]
        for state, frame, schema in ((self.open, waiting, _OPEN_TYPES), (self.bars, bars, _BAR_TYPES)):
            if state is self.open and not changed:
                continue
            if len(frame):
                state.put(_packed(frame, schema))
            elif state.exists():
                state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if len(waiting) and len(bars):
            times = np.sort(bars["at"].to_numpy(np.int64))
            at = np.searchsorted(times, waiting["due"].to_numpy(np.int64))
            if (at < len(times)).any():
                self.handle.registerTimer(_millis_after(times[at[at < len(times)].min()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        waiting, bars = self._state()
        new_bars = frame[frame["rec_id"].isna()][["at", "close"]]
        recs = frame[frame["rec_id"].notna()]
        new = pd.concat([recs.assign(horizon=h, due=recs["at"] + d * DAY) for h, d in self.horizons.items()])[_OPEN] if len(recs) else waiting.iloc[:0]
        if len(new):
            new = new.astype({"rec_id": np.int64, "due": np.int64})
            yield self._rows(key, new, None, None)
        joined = [x for x in (waiting, new) if len(x)]
        every = [x for x in (bars, new_bars) if len(x)]
        self._keep(pd.concat(joined) if joined else waiting, pd.concat(every) if every else bars, 1000 * timerValues.getCurrentWatermarkInMs(), len(new) > 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, bars = self._state()
        watermark = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        bars = bars.sort_values("at")
        sure = bars[bars["at"] <= watermark]
        at = np.searchsorted(sure["at"].to_numpy(np.int64), waiting["due"].to_numpy(np.int64))
        done = at < len(sure)
        if done.any():
            yield self._rows(key, waiting[done], sure["at"].to_numpy(np.int64)[at[done]], sure["close"].to_numpy(float)[at[done]])
        self._keep(waiting[~done], bars, watermark, bool(done.any()))

    def _rows(self, key, recs: pd.DataFrame, seen, price) -> pd.DataFrame:
        out = recs.assign(symbol=key[0], seen=None if seen is None else seen, price=np.nan if price is None else price, status="pending" if price is None else "completed")
        return out[["symbol", "rec_id", "horizon", "due", "seen", "price", "direction", "entry_price", "target_price", "stop_loss", "status"]]

    def close(self) -> None:
        pass


def outcome_changes(changes: DataFrame, late: str = "0 seconds", horizons: dict[str, int] = HORIZONS, slots: int = SLOTS) -> DataFrame:
    """The outcomes of a stream of bars and recommendations as rows that are added: first ``pending`` for every horizon, then ``completed`` with the first bar at or after its due day.

    ``changes`` (symbol, ts, close, rec_id, direction, entry_price, target_price, stop_loss) holds bars, which have no rec_id, and BUY and SELL
    recommendations; others are passed over. A symbol's recommendations are dealt to ``slots`` groups by rec_id, and its bars, which are few, go to each. The newest state of each recommendation and horizon is ``latest_outcomes``.
    """
    kept = changes.withWatermark("ts", late).filter("ts IS NOT NULL").filter(F.col("rec_id").isNull() | F.col("direction").isin("BUY", "SELL"))
    slot = F.explode(F.when(F.col("rec_id").isNull(), F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(F.array(F.pmod(F.xxhash64("rec_id"), F.lit(slots)).cast("int")))).alias("slot")
    rows = kept.select("symbol", "ts", F.unix_micros("ts").alias("at"), "close", "rec_id", "direction", "entry_price", "target_price", "stop_loss", slot)
    schema = "symbol string, rec_id long, horizon string, due long, seen long, price double, direction string, entry_price double, target_price double, stop_loss double, status string"
    out = rows.groupBy("symbol", "slot").transformWithStateInPandas(_Outcomes(horizons), schema, "append", "EventTime")
    price = F.nanvl("price", F.lit(None).cast("double"))
    out = out.select("symbol", "rec_id", "horizon", F.timestamp_micros("due").alias("due"), F.timestamp_micros("seen").alias("seen"), price.alias("price"), "direction", "entry_price", "target_price", "stop_loss", "status")
    buy, entry, price = F.col("direction") == "BUY", F.col("entry_price"), F.col("price")
    gain = F.try_divide(F.when(buy, price - entry).otherwise(entry - price), entry) * 100
    out = out.withColumns({"return_percent": gain, "profitable": gain > 0, "hit_target": F.when(buy, price >= F.col("target_price")).otherwise(price <= F.col("target_price")), "hit_stop": F.when(buy, price <= F.col("stop_loss")).otherwise(price >= F.col("stop_loss"))})
    return out.drop("direction", "entry_price", "target_price", "stop_loss")


def latest_outcomes(changes: DataFrame) -> DataFrame:
    """One row for each recommendation and horizon of the table that ``outcome_changes`` wrote: the completed one if there is one."""
    rest = [c for c in changes.columns if c not in ("rec_id", "horizon")]
    newest = F.max_by(F.struct(*rest), F.when(F.col("status") == "completed", 1).otherwise(0))
    return changes.groupBy("rec_id", "horizon").agg(newest.alias("t")).select("rec_id", "horizon", "t.*")


# ---------------------------------------------------------------- alerts that arrive and expire


class _Previous(StatefulProcessor):
    """The last tick of a symbol."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "at long, tick_id long, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "tick_id"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        if last is not None:  # ticks older than the last one have no place any more
            frame = frame[(frame["at"] > last[0]) | ((frame["at"] == last[0]) & (frame["tick_id"] > last[1]))]
        if len(frame):
            before = frame["price"].shift(fill_value=np.nan if last is None or last[2] is None else last[2])
            end = frame.iloc[-1]
            self.last.update((int(end["at"]), int(end["tick_id"]), float(end["price"])))
            yield frame[["symbol", "ts", "tick_id", "price"]].assign(previous_price=before)

    def close(self) -> None:
        pass


#: Cells of ticks and alerts that are looked at together.
CELLS = 1_000_000


def _beyond(a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
    """Whether each of ``a`` is above each of ``b``, or ``equal``; as in Spark, NaN is above all numbers and equals itself."""
    x, y = a[:, None], b[None, :]
    out = x >= y if equal else x > y
    if np.isnan(a).any():
        out |= np.isnan(x) if equal else np.isnan(x) & ~np.isnan(y)
    return out


def _firing(kind: str, ticks: pd.DataFrame, alerts: pd.DataFrame) -> np.ndarray:
    """``alerts.fires`` of ticks (rows) and alerts of one condition (columns), whose prices, targets and percents are known."""
    price, previous = ticks["price"].to_numpy(float), ticks["previous_price"].to_numpy(float)
    target, percent = alerts["target_price"].to_numpy(float), alerts["percent_change"].to_numpy(float)
    if kind == "ABOVE":
        return _beyond(price, target, False)
    if kind == "BELOW":
        return _beyond(target, price, False).T
    known = ~np.isnan(previous)
    if kind == "CROSSES_ABOVE":
        return _beyond(target, previous, True).T & _beyond(price, target, False) & known[:, None]
    if kind == "CROSSES_BELOW":
        return _beyond(previous, target, True) & _beyond(target, price, False).T & known[:, None]
    known &= previous != 0
    with np.errstate(all="ignore"):
        change = (price - previous) / np.where(known, previous, 1.0) * 100
    return (_beyond(change, percent, True) if kind == "PERCENT_CHANGE_UP" else _beyond(-percent, change, True).T) & known[:, None]


class _Hits(StatefulProcessor):
    """Alerts of one symbol and slot that live, and the slot's ticks that an alert may still come for, as packed rows."""

    def __init__(self, kind: pa.DataType):
        self.alert_types = pa.schema([("at", pa.int64()), ("until", pa.int64()), ("alert_id", kind), ("condition", pa.string()), ("target_price", pa.float64()), ("percent_change", pa.float64())])
        self.tick_types = pa.schema([("at", pa.int64()), ("tick_id", pa.int64()), ("price", pa.float64()), ("previous_price", pa.float64())])

    def init(self, handle) -> None:
        self.handle = handle
        self.alerts = handle.getListState("alerts", "rows binary")
        self.ticks = handle.getListState("ticks", "rows binary")

    def _keep(self, alerts: pd.DataFrame, ticks: pd.DataFrame, watermark: int) -> None:
        """Store what rows behind the watermark may meet; one timer stands where nothing of it is needed any more."""
        alerts, ticks = alerts[alerts["until"] > watermark], ticks[ticks["at"] >= watermark]
        for state, frame, schema in ((self.alerts, alerts, self.alert_types), (self.ticks, ticks, self.tick_types)):
            if len(frame):
                state.put(_packed(frame, schema))
            elif state.exists():
                state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        ends = [int(f[c].max()) for f, c in ((alerts, "until"), (ticks, "at")) if len(f)]
        if ends:
            self.handle.registerTimer(_millis_after(max(ends) + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        alert = frame["condition"].notna()
        new_alerts, new_ticks = frame.loc[alert, self.alert_types.names], frame.loc[~alert, self.tick_types.names]
        alerts, ticks = _unpacked(self.alerts, self.alert_types), _unpacked(self.ticks, self.tick_types)
        yield from self._rows(key, ticks, new_alerts)
        alerts = pd.concat([alerts, new_alerts]) if len(alerts) else new_alerts
        yield from self._rows(key, new_ticks, alerts)
        ticks = pd.concat([ticks, new_ticks]) if len(ticks) else new_ticks
        self._keep(alerts, ticks, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._keep(_unpacked(self.alerts, self.alert_types), _unpacked(self.ticks, self.tick_types), watermark)
        return iter(())

    def _rows(self, key, ticks: pd.DataFrame, alerts: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ticks = ticks.sort_values("at", kind="stable")
        for kind, asked in alerts.groupby("condition", sort=False) if len(ticks) else ():
            step = max(CELLS // len(asked), 1)
            for start in range(0, len(ticks), step):
                part = ticks.iloc[start : start + step]
                at = part["at"].to_numpy(np.int64)
                live = asked[(asked["at"] <= at[-1]) & (asked["until"] > at[0])]
                begin, until = live["at"].to_numpy(np.int64), live["until"].to_numpy(np.int64)
                hit = _firing(kind, part, live) & (at[:, None] >= begin) & (at[:, None] < until)
                n = np.count_nonzero(hit, axis=1)
                if n.any():
                    ids = live["alert_id"].to_numpy()[np.nonzero(hit)[1]].tolist()  # Spark takes numbers of numpy one by one
                    ends = np.cumsum(n[n > 0]).tolist()
                    lists = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                    yield part[n > 0].assign(symbol=key[0], condition=kind, alert_ids=lists)[["symbol", "condition", "at", "tick_id", "price", "previous_price", "alert_ids"]]

    def close(self) -> None:
        pass


def packed_hits(ticks: DataFrame, alerts: DataFrame, late: str = "0 seconds", most: str = "30 days", slots: int = SLOTS) -> DataFrame:
    """``alert_hits`` with one row for a tick and condition: (symbol, condition, ts, tick_id, price, previous_price, alert_ids).

    Ticks of a symbol are dealt to ``slots`` groups by tick_id, and its alerts, which are fewer, go to each. A group holds its alerts until they
    expire and its ticks until no alert can come for them.
    """
    moved = ticks.filter("ts IS NOT NULL").withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at"), "tick_id", "price")
    moved = moved.groupBy("symbol").transformWithStateInPandas(_Previous(), "symbol string, ts timestamp, tick_id long, price double, previous_price double", "append", "EventTime", eventTimeColumnName="ts")
    number = isinstance(alerts.schema["alert_id"].dataType, LongType)
    none, no_id = F.lit(None).cast("double"), F.lit(0).cast("long") if number else F.lit("")
    moved = moved.filter("symbol IS NOT NULL AND price IS NOT NULL").select(
        "symbol", F.pmod(F.xxhash64("tick_id"), F.lit(slots)).cast("int").alias("slot"), "ts", F.unix_micros("ts").alias("at"), "tick_id", "price", F.nanvl("previous_price", none).alias("previous_price"),
        F.lit(0).cast("long").alias("until"), no_id.alias("alert_id"), F.lit(None).cast("string").alias("condition"), none.alias("target_price"), none.alias("percent_change"))
    needed = F.when(F.col("condition").isin("PERCENT_CHANGE_UP", "PERCENT_CHANGE_DOWN"), F.col("percent_change")).when(F.col("condition").isin("ABOVE", "BELOW", "CROSSES_ABOVE", "CROSSES_BELOW"), F.col("target_price"))
    last = F.unix_micros(F.col("created_at") + F.expr(f"INTERVAL {most}")) + 1
    active = alerts.withWatermark("created_at", late).filter(needed.isNotNull() & F.expr("status = 'active' AND symbol IS NOT NULL AND created_at IS NOT NULL"))
    active = active.select(
        "symbol", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.col("created_at").alias("ts"), F.unix_micros("created_at").alias("at"), F.lit(0).cast("long").alias("tick_id"), none.alias("price"), none.alias("previous_price"),
        F.least(last, F.unix_micros("expires_at")).alias("until"), F.col("alert_id") if number else F.col("alert_id").cast("string").alias("alert_id"), "condition", F.col("target_price").cast("double").alias("target_price"), F.col("percent_change").cast("double").alias("percent_change"))
    kind = "long" if number else "string"
    schema = f"symbol string, condition string, at long, tick_id long, price double, previous_price double, alert_ids array<{kind}>"
    out = moved.unionByName(active).groupBy("symbol", "slot").transformWithStateInPandas(_Hits(pa.int64() if number else pa.string()), schema, "append", "EventTime")
    return out.select("symbol", "condition", F.timestamp_micros("at").alias("ts"), "tick_id", "price", F.nanvl("previous_price", none).alias("previous_price"), "alert_ids")


def alert_hits(ticks: DataFrame, alerts: DataFrame, late: str = "0 seconds", most: str = "30 days") -> DataFrame:
    """Ticks that fire an alert of a stream of alerts, from its created_at until its expires_at; an alert lives ``most`` at most.

    Both sides have watermarks, by which an alert leaves the state once it has expired and a tick once no alert can come for it.
    ``alerts`` is (alert_id, symbol, condition, target_price, percent_change, status, created_at, expires_at) with timestamps.
    """
    kind = alerts.schema["alert_id"].dataType
    hits = packed_hits(ticks, alerts, late, most).withColumn("alert_id", F.explode("alert_ids"))
    return hits.select(F.col("alert_id").cast(kind).alias("alert_id"), "symbol", "condition", "ts", "tick_id", "price", "previous_price")
