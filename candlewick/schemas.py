"""Explicit schemas of the tables that operators take and give."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _struct(text: str) -> StructType:
    kinds = {"string": StringType(), "double": DoubleType(), "long": LongType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(), "strings": ArrayType(StringType()), "scores": MapType(StringType(), DoubleType())}
    return StructType([StructField(n, kinds[k]) for n, k in (part.split() for part in text.split(","))])


BARS = _struct("symbol string,bar_ts date,open double,high double,low double,close double,volume double")
QUOTES = _struct("symbol string,name string,price double,previous_close double,open double,high double,low double,volume double,market_cap double,pe_ratio double,week_52_high double,week_52_low double,sector string,industry string")
UNIVERSE = _struct("symbol string,name string,sector string,industry string,market_cap double,price double,change_percent double")
ARTICLES = _struct("article_id long,title string,description string,source string,url string,published timestamp")
ALERTS = StructType([*_struct("alert_id string,user_id string,symbol string,condition string,target_price double,percent_change double,message string,delivery_channels strings,status string,created_at timestamp,triggered_at timestamp,expires_at timestamp").fields])
RECOMMENDATIONS = _struct("rec_id long,symbol string,direction string,confidence double,entry_price double,target_price double,stop_loss double,created_at date")
DELISTINGS = _struct("symbol string,name string,delisted_date date,reason string,peak_price double,final_price double,index_name string,index_entry date,index_exit date")

CONDITIONS = ("ABOVE", "BELOW", "CROSSES_ABOVE", "CROSSES_BELOW", "PERCENT_CHANGE_UP", "PERCENT_CHANGE_DOWN")
HORIZONS = {"1d": 1, "5d": 5, "20d": 20}
