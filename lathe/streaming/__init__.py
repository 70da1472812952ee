"""Streams are no part of the engine's SQL; DataFrames of spark.readStream can be registered as views and queried
with the same dialect, as `lathe.streaming.query` does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.dialect import rewrite


def query(stream: DataFrame, name: str, sql: str, time_column: str, late: str = "10 minutes") -> DataFrame:
    """A streaming query in the dialect over one stream, named `name`, whose rows may be `late`."""
    timed = stream.withColumn(time_column, F.col(time_column).cast("timestamp"))  # watermarks need a zone
    timed.withWatermark(time_column, late).createOrReplaceTempView(name)
    return stream.sparkSession.sql(rewrite(sql))
