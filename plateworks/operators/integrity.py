"""Consistency of catalogue, log and files. Logs are reduced to one row per asset before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.operators import log


def result_without_event(assets: DataFrame, events: DataFrame) -> DataFrame:
    """(check, asset_id) of results that no event explains."""
    checks = (("INGEST/DONE", F.lit(True), "ingest_done"), ("QC", F.col("qc_result").isNotNull(), "qc"),
              ("AI/PASSED", F.col("ai_result").isNotNull(), "ai_passed"), ("METADATA", F.col("metadata_json").isNotNull(), "metadata"))
    present = log.latest_slots(events, [slot for _, _, slot in checks])
    rows = assets.join(present, "asset_id", "left")
    missing = F.filter(F.array(*[F.when(has & F.col(f"{slot}_id").isNull(), name) for name, has, slot in checks]), lambda c: c.isNotNull())
    return rows.select("asset_id", F.explode(missing).alias("check"))


def event_without_result(assets: DataFrame, events: DataFrame) -> DataFrame:
    checks = (("AI/PASSED", F.col("ai_result").isNull(), "ai_passed"), ("METADATA_AI/PASSED", F.col("metadata_json").isNull(), "metadata_ai_passed"))
    present = log.latest_slots(events, [slot for _, _, slot in checks])
    found = F.filter(F.array(*[F.when(empty & F.col(f"{slot}_id").isNotNull(), name) for name, empty, slot in checks]), lambda c: c.isNotNull())
    return assets.join(present, "asset_id").select("asset_id", F.explode(found).alias("check"))


def orphan_events(assets: DataFrame, events: DataFrame) -> DataFrame:
    return events.select("asset_id").distinct().join(assets.select("asset_id"), "asset_id", "left_anti")


def broken(found_hash: Column, expected: Column) -> Column:
    return found_hash.isNull() | (found_hash != expected)


def derivative_problems(events: DataFrame, listing: DataFrame) -> DataFrame:
    """Newest manifest names a derived file that is absent or has other content."""
    slots = log.latest_slots(events, ("normalize_passed",), ("normalize_passed",))
    named = slots.select("asset_id", F.col("normalize_passed.derivative.path").alias("path"), F.col("normalize_passed.derivative.sha256").alias("expected"))
    found = listing.select("path", F.col("sha256").alias("found"))
    return named.filter(F.col("path").isNotNull()).join(found, "path", "left").filter(broken(F.col("found"), F.col("expected"))).select("asset_id", "path")


def export_problems(assets: DataFrame, events: DataFrame, listing: DataFrame) -> DataFrame:
    """Newest export per platform is absent (tolerated for rejected assets) or changed (never)."""
    slots = log.latest_slots(events, [f"export_{p}" for p in fixed.PLATFORMS], [f"export_{p}" for p in fixed.PLATFORMS])
    files = F.array(*[F.struct(F.lit(p).alias("platform"), F.col(f"export_{p}.path").alias("path"), F.col(f"export_{p}.sha256").alias("expected")) for p in fixed.PLATFORMS])
    named = slots.select("asset_id", F.inline(files)).filter(F.col("path").isNotNull())
    rejected = assets.select("asset_id", (F.get_json_object("metadata_json", "$.state") == "rejected").alias("rejected"))
    rows = named.join(listing.select("path", F.col("sha256").alias("found")), "path", "left").join(rejected, "asset_id", "left")
    absent = F.col("found").isNull() & ~F.coalesce("rejected", F.lit(False))
    return rows.filter(absent | (F.col("found") != F.col("expected"))).select("asset_id", "platform")


def orphan_files(events: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of the derived and export trees that no event references."""
    internal = (F.col("stage") == "NORMALIZE") & (F.col("status") == "PASSED")
    export = (F.col("stage") == "DERIVATIVE") & (F.col("status") == "CREATED")
    path = F.when(internal, F.get_json_object("message", "$.derivative.path")).when(export, F.get_json_object("message", "$.path"))
    referenced = events.filter(internal | export).select(path.alias("path")).filter(F.col("path").isNotNull()).distinct()
    return listing.filter(F.col("path").startswith("internal/") | F.col("path").startswith("export/")).join(referenced, "path", "left_anti").select("path")


def batch_pending(exports: DataFrame, collected: DataFrame, listing: DataFrame) -> DataFrame:
    """exports(asset_id, state, platform, status, sha256, path, filename, text, has_file, export_event_id) -> outcome per asset and platform."""
    held = collected.select("asset_id", "platform", "sha256", F.lit(True).alias("held"))
    rows = exports.filter("has_file").join(held, ["asset_id", "platform", "sha256"], "left").join(
        listing.select("path", F.col("sha256").alias("found")), "path", "left")
    current = F.col("status") == "ready_for_export"
    outcome = (F.when(~current & (F.col("state") == "rejected"), None).when(~current, F.concat(F.lit("skipped: export "), "status"))
               .when(F.col("held"), "already collected").when(broken(F.col("found"), F.col("sha256")), "skipped: export file missing or changed").otherwise("collect"))
    return rows.withColumn("outcome", outcome).filter(F.col("outcome").isNotNull())
