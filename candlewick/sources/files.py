"""Readers and writers with explicit schemas: Parquet, ORC, CSV and JSON tables, news feeds as JSON lines, prioritised union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", **options) -> DataFrame:
    """Never infers a schema; filters and columns reach the scan."""
    return spark.read.schema(schema).options(**options).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).format(kind).partitionBy(*partition_by).save(path)


def news_feed(spark: SparkSession, path: str) -> DataFrame:
    """Articles with nested ticker sentiments, one JSON object a line: (title, url, published, source, ticker, relevance, score, label)."""
    schema = "title string, url string, time_published string, source string, summary string, ticker_sentiment array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string,ticker_sentiment_label:string>>"
    rows = read(spark, path, schema, "json")
    flat = rows.withColumn("t", F.explode_outer("ticker_sentiment"))
    return flat.select("title", "url", F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss")).alias("published"), "source", F.substring("summary", 1, 500).alias("summary"), F.col("t.ticker").alias("ticker"), F.expr("try_cast(t.relevance_score AS double)").alias("relevance"), F.expr("try_cast(t.ticker_sentiment_score AS double)").alias("score"), F.col("t.ticker_sentiment_label").alias("label"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of several sources with their rank as ``priority``."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("priority", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
