"""Running statistics of scores that arrive as a stream: the batch query's aggregates under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_best(scores: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """(key, best, tie, n, mean): of equal values the smallest tie; a batch and a stream give the same rows."""
    x = F.max(F.struct(F.col(value).alias("v"), (-F.col(tie)).alias("t")))
    out = scores.groupBy(key).agg(x.alias("x"), F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(key, F.col("x.v").alias("best"), (-F.col("x.t")).alias(tie), "n", "mean")


def windowed_best(scores: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Per window of event time; rows later than ``late`` are left out once the watermark has passed."""
    return scores.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.max(value).alias("best"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "best", "n")


def stream_files(spark, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
