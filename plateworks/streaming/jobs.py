"""Streaming forms of the log reductions.

Every job takes a folder that outlives it: ``checkpoint`` below it keeps the progress and the keyed state, ``out/batch=<id>`` what a
micro-batch wrote, so a job that was stopped goes on where it was, and a repeated batch overwrites itself. What a job knows of earlier
batches (keys seen, contents registered, counts) lies in Spark's state store, by key: a micro-batch looks up its own keys and reads no
output of earlier ones. Jobs return their query; the ``..._so_far`` functions reduce what has been written over the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plateworks.operators.ranking import with_position
from plateworks.session import materialize

LATEST = "asset_id BIGINT, stage STRING, status STRING, event_id BIGINT"
RETRIES = "asset_id BIGINT, stage STRING, failed BIGINT"
NOTICES = "asset_id BIGINT, kind STRING, key STRING"
DAYS = "day DATE, stage STRING, n BIGINT"
ARRIVALS = "path STRING, file_hash STRING, asset_id BIGINT, outcome STRING"


def _start(stream: DataFrame, mode: str, folder: str, every: str | None, write=None) -> StreamingQuery:
    """Starts the job; without an interval it ends when all input that is there has been processed."""
    root = folder.rstrip("/")

    def store(rows: DataFrame, batch: int) -> None:
        (write(rows, batch) if write else rows).write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(store)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", batch BIGINT").parquet(f"{folder.rstrip('/')}/out")


def latest_state(events: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Newest event id per (asset, stage, status); ids decide, so late and out-of-order input is safe."""
    return _start(events.groupBy("asset_id", "stage", "status").agg(F.max("id").alias("event_id")), "update", folder, every)


def latest_state_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, LATEST).groupBy("asset_id", "stage", "status").agg(F.max("event_id").alias("event_id"))


def retry_counter(events: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Failures per (asset, stage)."""
    return _start(events.filter(F.col("status") == "FAILED").groupBy("asset_id", "stage").agg(F.count("*").alias("failed")), "update", folder, every)


def retry_counter_so_far(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    seen = _written(spark, folder, RETRIES).groupBy("asset_id", "stage").agg(F.max("failed").alias("failed"))
    return seen.withColumn("exhausted", F.col("failed") >= limit)


def notify_dedup(events: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Each (asset, kind, key) once, however late it comes again: the keys seen are the state (nulls are equal), and have no horizon."""
    sent = events.filter((F.col("stage") == "NOTIFY") & (F.col("status") == "SENT")).select(
        "asset_id", F.get_json_object("message", "$.kind").alias("kind"), F.get_json_object("message", "$.key").alias("key"))
    return _start(sent.dropDuplicates(["asset_id", "kind", "key"]), "append", folder, every)


def notify_dedup_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, NOTICES).drop("batch")


def daily_digest(events: DataFrame, folder: str, every: str | None = None) -> StreamingQuery:
    """Events per day and stage. The state is one count per day and stage and has no horizon, so late rows count."""
    day = F.to_date(F.col("created_at").cast("timestamp"))
    return _start(events.groupBy(day.alias("day"), "stage").agg(F.count("*").alias("n")), "update", folder, every)


def daily_digest_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, DAYS).groupBy("day", "stage").agg(F.max("n").alias("n"))


_JUDGED = "path STRING, file_hash STRING, outcome STRING"


def _judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Outcomes of the arrivals of one content. The state says whether the content is registered; the smallest decodable path of the batch
    registers it. Arrivals come in chunks; only the path that may register is kept until the last one."""
    registered = state.exists and state.get[0]
    best = None
    for rows in chunks:
        registered = registered or bool(rows["known"].any())
        able = rows[(~rows["refused"]) & rows["decodable"]]
        first = None if able.empty else able["path"].min()
        waiting = None if registered or first is None else min(first, best) if best is not None else first
        outcome = pd.Series("DUPLICATE", index=rows.index).mask(~rows["decodable"], "UNDECODABLE").mask(rows["refused"], "UNSUPPORTED")
        out = pd.DataFrame({"path": rows["path"], "file_hash": rows["file_hash"], "outcome": outcome})
        if waiting is not None and waiting != best:
            out = out[out["path"] != waiting]
            if best is not None:
                out = pd.concat([out, pd.DataFrame({"path": [best], "file_hash": [key[0]], "outcome": ["DUPLICATE"]})])
            best = waiting
        yield out
    if best is not None:
        registered = True
        yield pd.DataFrame({"path": [best], "file_hash": [key[0]], "outcome": ["REGISTERED"]})
    state.update((bool(registered),))


def ingest_arrivals(arrivals: DataFrame, registry: DataFrame, extensions, folder: str, every: str | None = None) -> StreamingQuery:
    """Registers arriving files (unique paths) batch by batch.

    Contents of the registry are joined to the arrivals; contents registered since are keyed state. New ids follow the last id of the batch
    before, which is one row.
    """
    root = folder.rstrip("/")
    known = registry.select("file_hash").distinct().withColumn("known", F.lit(True))
    judged = arrivals.join(known, "file_hash", "left").select(
        "path", "file_hash", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("decodable", F.lit(False)).alias("decodable"), (~F.lower("extension").isin(*extensions)).alias("refused")) \
        .groupBy("file_hash").applyInPandasWithState(_judge, _JUDGED, "registered BOOLEAN", "append", GroupStateTimeout.NoTimeout)

    def numbered(rows: DataFrame, batch: int) -> DataFrame:
        spark = rows.sparkSession
        rows = materialize(rows, "judged")  # the state is advanced once per batch
        if batch == 0:
            last = registry.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).first()[0]
        else:
            last = spark.read.schema("last_id BIGINT").parquet(f"{root}/ids/batch={batch - 1}").first()[0]
        new = materialize(with_position(rows.filter("outcome = 'REGISTERED'").select("path"), "path").select("path", (F.col("position") + F.lit(last)).alias("asset_id")), "new-ids")
        top = new.agg(F.coalesce(F.max("asset_id"), F.lit(last)).cast("bigint").alias("last_id"))
        top.write.mode("overwrite").parquet(f"{root}/ids/batch={batch}")
        return rows.join(new, "path", "left").select("path", "file_hash", "asset_id", "outcome")

    return _start(judged, "append", folder, every, numbered)


def arrivals_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, ARRIVALS).drop("batch")
