"""Lists with filters, totals and pages.

A page deep in a long list is found without sorting or counting the list again: the list is stored once in key order, cut into ranges, and an
index holds the least and greatest key, the rows and the rows before of every range. A page reads the one or two ranges it lies in.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.session import materialize

MAX_LIMIT = 500
PER_RANGE = 100_000


def matching(rows: DataFrame, **equals) -> DataFrame:
    """Rows whose columns equal the given values; None means no condition."""
    for column, value in equals.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


@dataclass(frozen=True)
class Range:
    number: int
    least: object
    greatest: object
    rows: int
    before: int


class Listing:
    """Rows by a unique, comparable ``key`` without nulls, stored in key order. ``per_range``: rows a range holds about; the index has one
    entry per range, so it grows with the list divided by this number."""

    def __init__(self, rows: DataFrame, key: str = "asset_id", per_range: int = PER_RANGE):
        self.key = key
        parts = rows.agg(F.count(F.lit(1))).first()[0] // per_range + 1
        ranged = rows.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("range_no", F.spark_partition_id())
        self.stored = materialize(ranged, "listing", ("range_no",))
        found = self.stored.groupBy("range_no").agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.count(F.lit(1)).alias("rows")).orderBy("least").collect()
        self.index, before = [], 0
        for r in found:
            self.index.append(Range(r.range_no, r.least, r.greatest, r["rows"], before))
            before += r["rows"]
        self.total = before

    def _read(self, ranges: list[Range]) -> DataFrame:
        """The rows of some ranges: the folder of each is a partition of the stored list."""
        return self.stored.filter(F.col("range_no").isin([r.number for r in ranges])).drop("range_no").withColumn("total", F.lit(self.total).cast("bigint"))

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """One page in key order (limit 1..500) with the total of the list on every row."""
        if not 1 <= limit <= MAX_LIMIT or offset < 0:
            raise ValueError(f"limit must be 1..{MAX_LIMIT} and offset not negative")
        held = [r for r in self.index if r.before < offset + limit and r.before + r.rows > offset]
        skip = offset - held[0].before if held else 0
        return self._read(held).orderBy(self.key).offset(skip).limit(limit)

    def after(self, key, limit: int = 50) -> DataFrame:
        """The next rows behind a key, whether or not a row has it: what a reader asks for who goes from page to page."""
        if not 1 <= limit <= MAX_LIMIT:
            raise ValueError(f"limit must be 1..{MAX_LIMIT}")
        first = bisect_right([r.greatest for r in self.index], key)
        held, sure = [], 0
        for r in self.index[first:]:
            if sure >= limit:
                break
            held.append(r)
            sure += r.rows if r.least > key else 0
        return self._read(held).filter(F.col(self.key) > key).orderBy(self.key).limit(limit)


def page(rows: DataFrame, limit: int = 50, offset: int = 0, key: str = "asset_id") -> DataFrame:
    """One page of a list that is asked for once."""
    return Listing(rows, key).page(limit, offset)
