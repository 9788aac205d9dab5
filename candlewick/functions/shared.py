"""The folder that driver and executors share, and rounding."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def rounded_as_stored(value: str | Column, places: int) -> Column:
    """A double to a few places, halves away from zero, by what the double holds times a power of ten.

    ``F.round`` rounds the shortest decimal that names the double: 0.285 goes to 0.29 there, here and in SQL engines to 0.28, as 100 times it is below 28.5.
    """
    value = F.col(value) if isinstance(value, str) else value
    scaled = value * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0**places).otherwise(value)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under the local temporary folder where that is unset and Spark runs in one process; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'candlewick-shared')}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path
