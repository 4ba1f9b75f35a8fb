"""Tables as Parquet, and other files that Spark reads and writes itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table (a file or a folder) in a folder that any of Spark's file systems may hold."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Inputs of executions as JSON lines; with a schema, so that nothing is read twice to infer it."""
    return spark.read.schema(schema).json(path)


def media(spark: SparkSession, path: str) -> DataFrame:
    """Files with their path, content hash and bytes; equal contents once, the first path by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("content_hash"), "content")
    first = hashed.groupBy("content_hash").agg(F.min("path").alias("first_path"))  # the bytes aren't shuffled by hash
    return hashed.join(first.withColumnRenamed("content_hash", "h"), (F.col("content_hash") == F.col("h")) & (F.col("path") == F.col("first_path"))).drop("h", "first_path")


def jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ranges of a numeric column, one task each."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_events(events: DataFrame, path: str) -> None:
    """Event rows as JSON lines, in order within each partition."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.text(path)
