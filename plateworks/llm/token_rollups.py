"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch holds events of documents: inserted, revised (a new count, source or language) or deleted. It is turned into signed rows
against the state that the batches before it left: an insert adds, a delete takes the standing count away, a revision
takes the old away and adds the new. Totals are those of the batch before plus the batch's signed sums; no
text is read again.

Commits are idempotent. A batch's rows and totals replace what a failed attempt of the same number wrote, and count
from the moment its number stands in the log of commits; a number that stands there is not applied again.

Definitions. One event per document and version counts in a batch: deletes before others, then the largest (tokens, source, lang).
An insert of a standing document is a revision; a revision of one that isn't there is an insert; a delete of it is nothing. A null
doc_id is a document of its own; null sources and languages are groups. Null texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateworks.llm.bpe import encode_text

KEYS = ("source", "lang", "version")
EVENT = "kind string, doc_id long, source string, lang string, version string, tokens long"
SIGNED = "doc_id long, source string, lang string, version string, docs long, tokens long"
TOTALS = "source string, lang string, version string, docs long, tokens long"


def bpe_counts(docs: DataFrame, version: str, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, source, lang, version, tokens: ids that byte-level BPE gives each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([len(encode_text(t.as_py(), rank_file, pattern)) for t in batch.column(3)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts)], ["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens")


def word_counts(docs: DataFrame, version: str) -> DataFrame:
    """The same for words between white space."""
    trimmed = F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("version"), words.cast("long").alias("tokens"))


class Rollup:
    """Signed rows and totals in a shared folder, one subfolder per batch, and a log of the committed batches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], "batch long").write.mode("append").parquet(f"{self.folder}/commits")

    def batches(self) -> list[int]:
        """Committed batches; one small row each."""
        return sorted({r.batch for r in self.spark.read.schema("batch long").parquet(f"{self.folder}/commits").collect()})

    def _path(self, what: str, batch: int) -> str:
        return f"{self.folder}/{what}/batch={batch}"

    def standing(self) -> DataFrame:
        """The documents that the committed batches left, with their counts."""
        paths = [self._path("signed", b) for b in self.batches()]
        rows = self.spark.read.schema(SIGNED).parquet(*paths) if paths else self.spark.createDataFrame([], SIGNED)
        return rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0").drop("docs")

    def signed(self, events: DataFrame) -> DataFrame:
        """The signed rows of a batch against the standing documents."""
        order = [F.when(F.col("kind") == "delete", 0).otherwise(1), F.desc("tokens"), F.desc("source"), F.desc("lang")]
        once = Window.partitionBy("doc_id", "version").orderBy(*order)
        new = (events.select("kind", "doc_id", *KEYS, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
               .withColumn("k", F.row_number().over(once)).where("k = 1").drop("k"))
        old = self.standing().select("doc_id", F.col("version").alias("v"), F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("tokens").alias("old_tokens"))
        both = new.alias("n").join(old.alias("o"), F.expr("n.doc_id <=> o.doc_id AND n.version = o.v"), "left")
        added = F.struct(F.col("source").alias("source"), F.col("lang").alias("lang"), F.lit(1).cast("long").alias("docs"), F.col("tokens").alias("tokens"))
        taken = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).cast("long").alias("docs"), (-F.col("old_tokens")).alias("tokens"))
        rows = F.filter(F.array(F.when(F.col("kind") != "delete", added), F.when(F.col("old_tokens").isNotNull(), taken)), lambda x: x.isNotNull())
        return (both.select(F.col("n.doc_id").alias("doc_id"), F.col("n.version").alias("version"), F.explode(rows).alias("x"))
                .select("doc_id", "x.source", "x.lang", "version", "x.docs", "x.tokens"))

    def commit(self, batch: int, events: DataFrame) -> DataFrame:
        """Applies a batch once and returns the totals; a committed number is left as it is, others must rise."""
        done = self.batches()
        if batch not in done:
            if done and batch < done[-1]:
                raise ValueError(f"batch {batch} comes after {done[-1]}")
            self.signed(events).write.mode("overwrite").parquet(self._path("signed", batch))
            self._roll(batch, done[-1] if done else None)
            self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return self.totals()

    def _roll(self, batch: int, earlier: int | None) -> None:
        signed = self.spark.read.schema(SIGNED).parquet(self._path("signed", batch)).drop("doc_id")
        if earlier is not None:
            signed = signed.unionByName(self.spark.read.schema(TOTALS).parquet(self._path("totals", earlier)))
        rolled = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        rolled.write.mode("overwrite").parquet(self._path("totals", batch))

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens after the last batch; groups without documents are left out."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(self._path("totals", done[-1])).where("docs > 0")
