"""Window specifications and guards that the time-series operators share.

All of them partition by symbol and order by time, so Spark plans one exchange and one sort for all
the columns that are built on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered():
    return Window.partitionBy("symbol").orderBy("bar_ts")


def running():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return Window.partitionBy("symbol")


def last(n: int):
    return ordered().rowsBetween(-(n - 1), 0)


def full(x, n: int, value: Column) -> Column:
    """``value`` once the window of ``n`` rows is full of non-null ``x``, else null."""
    return F.when(F.count(x).over(last(n)) == n, value)


def mean(x, n: int) -> Column:
    return full(x, n, F.avg(x).over(last(n)))


def total(x, n: int) -> Column:
    return full(x, n, F.sum(x).over(last(n)))


def highest(x, n: int) -> Column:
    return full(x, n, F.max(x).over(last(n)))


def lowest(x, n: int) -> Column:
    return full(x, n, F.min(x).over(last(n)))


def deviation(x, n: int, sample: bool = True) -> Column:
    return full(x, n, (F.stddev_samp if sample else F.stddev_pop)(x).over(last(n)))


def before(x, n: int = 1) -> Column:
    return F.lag(x, n).over(ordered())


def ratio(a, b) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


#: A bar's place in its series, from 1, that ``numbered`` adds.
PLACE = "__place"


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn(PLACE, F.row_number().over(ordered()))


def weighted(x: str, n: int) -> Column:
    """Mean with weights 1 .. n, the newest counting most, of ``numbered`` rows: two sums, since a bar's weight is its place less that of the bar before the window."""
    placed = F.sum(F.col(x) * F.col(PLACE)).over(last(n)) - (F.col(PLACE) - n) * F.sum(x).over(last(n))
    return full(x, n, placed / (n * (n + 1) / 2))


def weighted_in_order(x: str, n: int) -> Column:
    """``weighted`` of short frames whose values are added in their order: means of means keep their last places, and rows need no number."""
    values = F.collect_list(x).over(last(n))
    summed = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return full(x, n, summed / (n * (n + 1) / 2))


def percent_change(x, n: int = 1) -> Column:
    return (ratio(F.col(x), before(x, n)) - 1) * 100
