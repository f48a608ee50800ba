"""The rating log as a stream: files of JSON lines in, valid ratings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import accepted
from ..sources.raw_files import FEEDBACK_SCHEMA


def rating_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def store_ratings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return accepted(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ratings_by_day(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """Ratings a day in event time; rows later than the watermark are left to batch summaries."""
    at = F.try_to_timestamp(F.regexp_replace("at", "Z$", "+00:00"))
    return stream.withColumn("ts", at).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "rating").agg(F.count("*").alias("n"))
