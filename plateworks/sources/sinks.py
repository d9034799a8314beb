"""Sinks: batch manifests and JSON records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from plateworks.session import shared_checkpoint_dir


def _target(df: DataFrame, label: str, folder: str | None) -> str:
    return folder or f"{shared_checkpoint_dir(df.sparkSession)}/plateworks/{label}-{uuid.uuid4().hex}"


def write_manifest(rows: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """CSV manifests with a header, one folder per platform and batch; returns what was written."""
    path = _target(rows, label, folder)
    rows.repartition("platform", "batch", "asset_id").write.partitionBy("platform", "batch").option("header", True).csv(path)
    partitions = ("platform", "batch")
    body = [f for f in rows.schema.fields if f.name not in partitions]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in body) + ", platform STRING, batch BIGINT"
    return rows.sparkSession.read.schema(schema).option("header", True).csv(path)


def write_jsonl(rows: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """One JSON record per row."""
    path = _target(rows, label, folder)
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)
