"""Message files as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_eml(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder)


def stream_eml(spark: SparkSession, folder: str, files_per_batch: int = 1000, archive: str | None = None) -> DataFrame:
    """New files as they come; with ``archive`` the source moves what it has read, which is its commit."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)
