"""An inbox as a stream: captures as they arrive, counted by type and arrival window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, inbox: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(inbox)
    kind = core.detected_type(F.col("path"), F.col("content"))
    return files.select("path", F.col("modificationTime").alias("arrived"), F.col("length").alias("bytes"), core.content_hash(F.col("content")).alias("sha256"), kind.alias("detected_type"))


def counted(captures: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    return captures.withWatermark("arrived", late).groupBy(F.window("arrived", window), "detected_type").agg(F.count("*").alias("captures"), F.sum("bytes").alias("bytes"))
