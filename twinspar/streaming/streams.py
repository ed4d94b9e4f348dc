"""Counters over streams: the corpus counts and histograms of the batch operators, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_at_once: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).parquet(path)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Times without a zone count in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def counts(stream: DataFrame, time: str, window: str, by: list[Column], late: str) -> DataFrame:
    """start, end, by, n, in tumbling windows; rows later than `late` behind the newest are left out and their windows closed."""
    return _timed(stream, time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str) -> DataFrame:
    """start, end, by, n of sessions that end after a gap."""
    return _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_deliveries(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose keys were not seen within the time for late rows; state is bounded by the watermark."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there, to Parquet, and stop. Run again, it goes on where it stopped."""
    return result.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
