"""Session defaults for local runs and tests. On a cluster the submitted configuration wins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str, name: str, checkpoint_dir: str) -> SparkSession:
    """``checkpoint_dir``: where intermediate tables go; on a cluster a folder that all executors share."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.checkpoint.dir", checkpoint_dir)
            .config("plateworks.text.partitions", "8")
            .getOrCreate())


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Used where several reports share one result and filter on it: lineage ends here, lost executors
    re-read files, and the readers get column pruning and pushed filters.
    """
    spark = df.sparkSession
    path = f"{shared_checkpoint_dir(spark)}/plateworks/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
