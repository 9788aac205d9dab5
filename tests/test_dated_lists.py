"""Hits of rules with a time become those of alerts by lists, and what leaves Python are lists of plain numbers."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from candlewick.operators import alerts
from candlewick.streaming import stateful, streams


def test_numbers_of_hits_are_plain():
    hits = stateful._Hits(pa.int64())
    ticks = pd.DataFrame({"at": [5, 6, 7], "tick_id": [1, 2, 3], "price": [4.0, 1.0, 9.0], "previous_price": [np.nan, 4.0, 1.0]})
    asked = pd.DataFrame({"at": 0, "until": [9, 7, 9], "alert_id": [10, 11, 12], "condition": ["ABOVE", "ABOVE", "BELOW"], "target_price": [2.0, 3.0, 8.0], "percent_change": np.nan})
    rows = pd.concat(hits._rows(("A",), ticks, asked))
    got = {(r.tick_id, r.condition): r.alert_ids for r in rows.itertuples()}
    assert got == {(1, "ABOVE"): [10, 11], (3, "ABOVE"): [10], (1, "BELOW"): [12], (2, "BELOW"): [12]}
    assert all(type(x) is int for ids in got.values() for x in ids)  # Spark would take numbers of numpy one by one


def test_lists_give_the_rows_of_members(spark, monkeypatch):
    monkeypatch.setattr(alerts, "TOGETHER", 7)
    members = spark.range(100).select(F.concat(F.lit("a"), "id").alias("alert_id"), (F.col("id") % 9).alias("rule"), F.lit("A").alias("symbol"), F.lit("ABOVE").alias("condition"))
    lists = alerts.by_rule(members)
    assert 1 < lists.agg(F.max(F.size("alert_ids"))).first()[0] <= 7
    hits = spark.range(40).select((F.col("id") % 11).alias("rule"), F.current_timestamp().alias("ts"), F.col("id").alias("tick_id"), F.lit(3.0).alias("price"), F.lit(None).cast("double").alias("previous_price"))
    key = lambda df: sorted((r.alert_id, r.symbol, r.condition, r.tick_id, r.price, r.previous_price) for r in df.collect())
    assert key(streams.of_lists(hits, lists)) == key(streams.of_alerts(hits, members)) != []
