"""Bars that are dealt by range are made once."""

import datetime as dt

from pyspark.sql import functions as F

from candlewick.operators import long_series


def test_bars_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([(s, day + dt.timedelta(days=k), float(k)) for s in "AB" for k in range(100)], "symbol string, bar_ts date, price double").repartition(4)
    out = long_series.numbered(rows.withColumn("close", counted("price")), 30)
    assert made.value == 200
    assert {(r.symbol, r.idx, r.chunk) for r in out.collect()} == {(s, k, k // 30) for s in "AB" for k in range(100)} and out.filter("close <> idx").isEmpty()
