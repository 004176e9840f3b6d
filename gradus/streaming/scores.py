"""Scores as they arrive: Structured Streaming forms of the grouped metrics.

An extension: evaluation runs write their results file by file, and these keep
running figures of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_means(scores: DataFrame, by: list[str], time: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and number per window and group; rows later than the watermark are left out and state behind it is dropped."""
    windows = scores.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *by)
    return windows.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "mean", "n")


def first_results(scores: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key to arrive, as far back as the watermark."""
    return scores.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def write_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, then stop; started again it goes on where it ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
