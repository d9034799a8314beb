"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets of bounded bytes and writes them to the shared folder.
Pass two permutes each bucket in memory (``shuffle``, which is Fisher-Yates) and gives every record its place in the
whole permutation: the sizes of the buckets before it plus its place in its own. Places are dealt to the shards
in turn, so the shards' row counts differ by one at most (law ``rows``) and their slots have no gaps. Each bucket is written
to all shards from the task that permuted it; no second shuffle follows.

Null and empty texts weigh one byte. A text larger than a bucket makes one large bucket. An empty table gives empty shards. Columns of any
name may be present; ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plateworks.llm.storage import shared_folder, stage

#: Bytes of records per bucket; a bucket is permuted in one task's memory.
BUCKET_BYTES = 32 << 20
#: Compression of the scattered records and of the shards: both hold all texts.
CODEC = "zstd"


def weight() -> Column:
    """UTF-8 bytes of the text plus one; a null text has none."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def _by_draw(a, b):
    return F.when(a["__draw"] < b["__draw"], -1).when(a["__draw"] > b["__draw"], 1).otherwise(0)


def external_shuffle(records: DataFrame, size: str | Column = "size", shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` with shard (0 to shards-1) and slot (0, 1, ... within the shard).

    The scatter hashes a number given to each record when it is first written, so equal texts, equal ids, nulls and
    repeated rows spread like any others. Any columns may be present; ``shard`` and ``slot`` are replaced. An empty
    table gives no rows.
    """
    records = records.drop("shard", "slot")
    fields = records.columns
    drawn = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = stage(records.select(F.struct(*fields).alias("__record"), (F.col(size) if isinstance(size, str) else size).alias("__size"), drawn.alias("__draw")), "scattered", CODEC)
    total = scattered.agg(F.sum("__size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    placed = scattered.withColumn("__bucket", F.pmod("__draw", F.lit(buckets)))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
              .select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    permuted = (placed.groupBy("__bucket").agg(F.array_sort(F.collect_list(F.struct("__draw", "__record")), _by_draw).alias("__all"))
                .join(starts, "__bucket").sortWithinPartitions("__bucket")  # a repeated task permutes alike
                .select("__start", F.posexplode(F.shuffle("__all", seed)).alias("__at", "__one")))
    place = F.col("__start") + F.col("__at")
    return permuted.select("__one.__record.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes whole documents in shuffled order, one folder ``shard=k`` per shard, and reads them back.

    A file holds what one bucket, or a few, gave to the shard, in the order of the slots.
    """
    dealt = external_shuffle(docs, weight(), shards, seed, bucket_bytes)
    dealt.sortWithinPartitions("shard", "slot").write.option("compression", CODEC).partitionBy("shard").parquet(path)
    fields = [f for f in dealt.schema if f.name != "shard"]
    return docs.sparkSession.read.schema(T.StructType([*fields, T.StructField("shard", T.IntegerType())])).parquet(path)


def assignments(docs: DataFrame, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """What the written shards hold, one row per document: doc_id, size, text_crc32 (of no bytes for a null text), law, shard, slot, grown_shard (null: the law is not ``key``)."""
    written = write_shards(docs, f"{shared_folder(docs.sparkSession)}/llm/shards-{uuid.uuid4().hex}", shards, seed, bucket_bytes)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return written.select("doc_id", weight().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
