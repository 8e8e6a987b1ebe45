"""Message streams: a Kafka topic if Spark's connector is installed, or folders of message files as its double."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "key string, value string, timestamp timestamp"


def kafka_stream(spark: SparkSession, brokers: list[str], topic: str, most: int = 1_000_000, lossy: bool = False) -> DataFrame:
    """key, value, timestamp from the topic's start; offsets are kept by the query's checkpoint. lossy: go on where data are gone."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most).option("failOnDataLoss", str(not lossy).lower())
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def kafka_table(spark: SparkSession, brokers: list[str], topic: str) -> DataFrame:
    """All of a topic as it stands, with partition and offset: for compacted topics such as shared templates."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", "latest")
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "partition", "offset")


def folder_stream(spark: SparkSession, path: str, most_files: int = 100, schema: str = MESSAGES) -> DataFrame:
    """Message (or, by schema, datagram) files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").parquet(path)


def landed_stream(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """Datagrams of the landing daemon's files by the data source that goes by arrivals."""
    from .landed import LandedSource

    spark.dataSource.register(LandedSource)
    return spark.readStream.format(LandedSource.name()).option("path", path).option("mostFiles", str(most_files)).load()


def folder_table(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
