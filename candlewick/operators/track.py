"""Track record of recommendations: outcomes at horizons by a forward as-of join, and accuracy by direction and horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HORIZONS


def as_of_forward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the first right row of its key at or after its time; nulls where there is none.

    Both sides are put in one series, newest first, and the last right row seen is carried along: one shuffle by key, a running
    window of linear cost, and no range join whose pairs could multiply.
    """
    r = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(1).alias("__side"), F.struct(F.col(right_time), *values).alias("__r"), F.lit(None).cast(left.schema.simpleString()).alias("__l"))
    row = left.select(F.col(key), F.col(left_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    order = Window.partitionBy(key).orderBy(F.col("__t").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(row).withColumn("__n", F.last("__r", ignorenulls=True).over(order)).filter("__side = 0")
    return out.select("__l.*", F.col(f"__n.{right_time}").alias(f"asof_{right_time}"), *[F.col(f"__n.{v}").alias(f"asof_{v}") for v in values])


def as_of_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the last right row of its key at or before its time."""
    r = right.select(F.col(key), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_time), *values).alias("__r"), F.lit(None).cast(left.schema.simpleString()).alias("__l"))
    row = left.select(F.col(key), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    order = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(row).withColumn("__n", F.last("__r", ignorenulls=True).over(order)).filter("__side = 1")
    return out.select("__l.*", F.col(f"__n.{right_time}").alias(f"asof_{right_time}"), *[F.col(f"__n.{v}").alias(f"asof_{v}") for v in values])


def outcomes(recommendations: DataFrame, bars: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """One row for each BUY or SELL recommendation and horizon, with the first close at or after its due day.

    return_percent follows the direction; hit_target and hit_stop compare that price with the levels; all are null while pending.
    """
    long = recommendations.filter(F.col("direction").isin("BUY", "SELL")).withColumn("h", F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(v).alias("days")) for k, v in horizons.items()])))
    due = long.select(*recommendations.columns, "h.horizon", F.date_add("created_at", F.col("h.days")).alias("due"))
    found = as_of_forward(due, bars, "symbol", "due", "bar_ts", ["close"])
    buy, price, entry = F.col("direction") == "BUY", F.col("asof_close"), F.col("entry_price")
    gain = F.try_divide(F.when(buy, price - entry).otherwise(entry - price), entry) * 100
    return found.withColumns({
        "return_percent": gain, "profitable": gain > 0,
        "hit_target": F.when(buy, price >= F.col("target_price")).otherwise(price <= F.col("target_price")),
        "hit_stop": F.when(buy, price <= F.col("stop_loss")).otherwise(price >= F.col("stop_loss")),
        "status": F.when(price.isNotNull(), "completed").otherwise("pending"),
    })


def accuracy(found: DataFrame) -> DataFrame:
    """Counts, accuracy, mean return and hit rates by direction and horizon, with all subtotals in one pass (grouping sets)."""
    done = found.filter("status = 'completed'")
    rate = lambda c: F.avg(F.col(c).cast("double")) * 100
    out = done.cube("direction", "horizon").agg(F.count("*").alias("n"), rate("profitable").alias("accuracy"), F.avg("return_percent").alias("mean_return"), rate("hit_target").alias("target_rate"), rate("hit_stop").alias("stop_rate"))
    return out.withColumns({"direction": F.coalesce("direction", F.lit("all")), "horizon": F.coalesce("horizon", F.lit("all"))})


def summary(found: DataFrame) -> DataFrame:
    """The outcomes of each recommendation as a map, and its status: completed when all horizons are."""
    value = F.struct(F.col("asof_close").alias("price"), "return_percent", "profitable", "hit_target", "hit_stop")
    out = found.groupBy("rec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", value)))).alias("outcomes"), F.count_if(F.col("status") == "pending").alias("open"))
    return out.withColumn("status", F.when(F.col("open") == 0, "completed").otherwise("pending")).drop("open")


def upserted(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace by key: the row of the highest version stays. Write the result to a new place and swap."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return stored.unionByName(changes).withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def deleted(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys, key, "left_anti")


def generated_within(stored: DataFrame, at: str, now: Column, minutes: int = 60) -> bool:
    """Whether a row is younger than ``minutes``."""
    return not stored.filter(F.col(at) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).isEmpty()


def refreshed(stored: DataFrame, new: DataFrame, key: str, at: str, minutes: int = 60) -> DataFrame:
    """A new row takes the place of the newest stored row of its key if that is at most ``minutes`` older, and is added otherwise. ``new`` has one row for each key."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc())
    ranked = stored.withColumn("__r", F.row_number().over(order))
    young = F.col(at) >= F.col("__at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    kept = ranked.join(new.select(key, F.col(at).alias("__at")), key, "left").filter(~((F.col("__r") == 1) & F.coalesce(young, F.lit(False))))
    return kept.drop("__r", "__at").unionByName(new)


#: Seconds that a cached answer of each kind stays good; others stay DEFAULT_TTL.
TTL = {"market_news": 300, "trending": 600, "symbol_news": 300, "fii_dii": 1800, "sentiment": 300, "market_overview": 120, "stock_quote": 60, "index_data": 120}
DEFAULT_TTL = 300


def live(cached: DataFrame, now: Column, kind: str = "kind", at: str = "cached_at", ttl: dict[str, int] = TTL) -> DataFrame:
    """Cached rows that are not stale at ``now``, with their ``ttl`` in seconds: the newest of each kind and key."""
    seconds = F.coalesce(F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv])[F.col(kind)], F.lit(DEFAULT_TTL))
    good = cached.withColumn("ttl", seconds).filter((F.col(at) <= now) & (F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl").cast("decimal(18,6)")) > now))
    order = Window.partitionBy(kind, "key").orderBy(F.col(at).desc())
    return good.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def cleared(cached: DataFrame, pattern: str) -> DataFrame:
    """Cached rows whose key doesn't match a pattern with ``*``."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return cached.filter(~F.coalesce(F.col("key").like(like), F.lit(False)))
