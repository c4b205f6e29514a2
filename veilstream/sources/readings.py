"""Readings from topics and image folders. Works on any ``(key, value, timestamp)`` DataFrame, e.g.
``spark.readStream.format("kafka")``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_scalar(topic: DataFrame) -> DataFrame:
    """Key = section, value = number as UTF-8 text; the record time is the source timestamp.

    A value that is not a number gets a null ``scalar`` (see ``rejects``).
    """
    return topic.select(
        F.col("key").cast("string").alias("section"),
        F.trim(F.col("value").cast("string")).try_cast("double").alias("scalar"),
        F.unix_millis("timestamp").alias("generate_ms"),
        *_others(topic))


def parse_location(topic: DataFrame) -> DataFrame:
    """Value = ``x,y``; further parts are ignored. A bad number gives a null ``location``."""
    parts = F.split(F.col("value").cast("string"), ",")
    x = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double")
    y = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    return topic.select(
        F.lit("location").alias("section"),
        F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))).alias("location"),
        F.unix_millis("timestamp").alias("generate_ms"),
        *_others(topic))


def _others(topic: DataFrame) -> list[str]:
    return [c for c in topic.columns if c not in ("key", "value", "timestamp")]


def rejects(parsed: DataFrame, value: str) -> DataFrame:
    """Rows whose value could not be parsed."""
    return parsed.where(F.col(value).isNull())


def accepted(parsed: DataFrame, value: str) -> DataFrame:
    return parsed.where(F.col(value).isNotNull())


def read_frames(spark: SparkSession, folder: str, end: int | None = None,
                stream: bool = False, decoded: bool = False) -> DataFrame:
    """Frames named ``<n>.png``: their bytes (or decoded pixels) with ``sequence_number`` n."""
    reader = spark.readStream if stream else spark.read
    if decoded:
        frames = reader.format("image").load(folder).select("image.*")
        path = F.col("origin")
    else:
        reader = reader.option("pathGlobFilter", "*.png")
        if stream:
            reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
        frames = reader.format("binaryFile").load(folder)
        path = F.col("path")
    numbered = frames.withColumn(
        "sequence_number", F.regexp_extract(path, r"(\d+)\.png$", 1).try_cast("long"))
    numbered = numbered.where(F.col("sequence_number").isNotNull())
    return numbered if end is None else numbered.where(F.col("sequence_number") < end)


def read_topic(spark: SparkSession, servers: str, topic: str, stream: bool = True) -> DataFrame:
    """A Kafka topic (needs Spark's Kafka package on the class path)."""
    reader = spark.readStream if stream else spark.read
    return (reader.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).load())
