"""File listings and content through Spark's binary source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.operators.ingest import container, suffix, supported


def list_files(spark: SparkSession, folder: str, recursive: bool = False, with_hash: bool = False, extensions=fixed.SUPPORTED_EXTENSIONS) -> DataFrame:
    """Regular files with a supported suffix: path, size, modification time and, only on request, content facts."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = supported(reader.load(folder), extensions)
    columns = ["path", F.col("length").alias("size_bytes"), "modificationTime", suffix(F.col("path")).alias("extension")]
    if with_hash:
        columns += [F.sha2("content", 256).alias("sha256"), container(F.col("content")).alias("container")]
    return files.select(*columns)
