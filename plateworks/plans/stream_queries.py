"""Streaming queries over the driver's event file, compared with their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.plans.bindings import Tables
from plateworks.plans.registry import query
from plateworks.session import shared_checkpoint_dir
from plateworks.streaming import jobs


def _stream(t: Tables, table: str):
    """A table as a stream of its files. The name stands as a pattern, because a stream reads a plain path only where it is a folder,
    and a table is one file or a folder of files."""
    schema = t.table(table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.{{parquet}}")


def _folder(t: Tables) -> str:
    return f"{shared_checkpoint_dir(t.spark)}/plateworks/stream-{uuid.uuid4().hex}"


def _events(t: Tables):
    return t.compose("b_events", events=_stream(t, "events"))


@query("str_latest_state", "SELECT asset_id, stage, status, max(id) AS event_id FROM b_events GROUP BY ALL")
def str_latest_state(t: Tables):
    jobs.latest_state(_events(t), folder := _folder(t)).awaitTermination()
    return jobs.latest_state_so_far(t.spark, folder)


@query("str_retry_counter", "SELECT asset_id, stage, count(*) AS failed, count(*) >= 3 AS exhausted FROM b_events WHERE status = 'FAILED' GROUP BY ALL")
def str_retry_counter(t: Tables):
    jobs.retry_counter(_events(t), folder := _folder(t)).awaitTermination()
    return jobs.retry_counter_so_far(t.spark, folder, fixed.RETRY_MAX_FAILED)


@query("str_notify_dedup", "SELECT DISTINCT asset_id, json_extract_string(message, '$.kind') AS kind, json_extract_string(message, '$.key') AS key FROM b_events WHERE stage = 'NOTIFY' AND status = 'SENT'")
def str_notify_dedup(t: Tables):
    jobs.notify_dedup(_events(t), folder := _folder(t)).awaitTermination()
    return jobs.notify_dedup_so_far(t.spark, folder)


@query("str_daily_digest", "SELECT CAST(created_at AS DATE) AS day, stage, count(*) AS n FROM b_events GROUP BY ALL")
def str_daily_digest(t: Tables):
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")  # days of the log are UTC days
    jobs.daily_digest(_events(t), folder := _folder(t)).awaitTermination()
    return jobs.daily_digest_so_far(t.spark, folder)


@query("str_ingest", """
WITH c AS (SELECT *, file_size >= 100 AS decodable, CASE WHEN extension NOT IN ('.en', '.de', '.fr') THEN 'UNSUPPORTED' END AS refused FROM b_arrivals),
firsts AS (SELECT file_hash, min(path) FILTER (WHERE decodable) AS path FROM c WHERE refused IS NULL AND file_hash NOT IN (SELECT file_hash FROM b_registry) GROUP BY file_hash)
SELECT c.path, c.file_hash, CASE WHEN refused IS NOT NULL THEN refused WHEN firsts.path IS NOT NULL THEN 'REGISTERED' WHEN NOT decodable THEN 'UNDECODABLE' ELSE 'DUPLICATE' END AS outcome FROM c LEFT JOIN firsts ON firsts.path = c.path""")
def str_ingest(t: Tables):
    arrivals = t.compose("b_arrivals", documents=_stream(t, "documents")).withColumn("decodable", F.col("file_size") >= 100)
    jobs.ingest_arrivals(arrivals, t.b_registry, (".en", ".de", ".fr"), folder := _folder(t)).awaitTermination()
    return jobs.arrivals_so_far(t.spark, folder).select("path", "file_hash", "outcome")
