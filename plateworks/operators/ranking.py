"""Exact positions and neighbours over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plateworks.session import materialize


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """1-based global row number by unique ``order`` columns.

    Rows are range-partitioned and written, so that partition numbers are frozen; each range is numbered
    on its own and shifted by the sizes of the ranges before it (one small row per range).
    """
    ranged = df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range: bounded by the partition count
    offsets = sizes.select("range_no", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "range_no").withColumn(name, (local + F.col("offset")).cast("bigint")).drop("range_no", "offset")


def with_next(df: DataFrame, key: str, name: str = "next_id") -> DataFrame:
    """Adds position, total and the key of the following row (the first one after the last)."""
    placed = materialize(with_position(df, key), "positions")
    total = placed.agg(F.count("*").alias("total"))
    following = placed.select(F.col(key).alias(name), (F.col("position") - 1).alias("follows"))
    wrapped = following.join(F.broadcast(total)).withColumn("follows", F.when(F.col("follows") == 0, F.col("total")).otherwise(F.col("follows")))
    return placed.join(wrapped, placed["position"] == wrapped["follows"], "left").drop("follows")
