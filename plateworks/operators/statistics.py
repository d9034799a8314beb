"""Catalogue statistics: every report is one scan, map-side combined counts, one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions.arrays import first_match, flag, or_empty
from plateworks.operators import log


def frequencies(rows: DataFrame, **dimensions: Column) -> DataFrame:
    """(dimension, key, n) of several columns from one pass: rows are unpivoted and counted together."""
    entries = F.array(*[F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("key")) for name, value in dimensions.items()])
    return rows.select(F.inline_outer(entries)).groupBy("dimension", "key").agg(F.count("*").alias("n"))


def code_frequencies(rows: DataFrame, **arrays: Column) -> DataFrame:
    """(dimension, key, n) over exploded arrays of codes."""
    def entries_of(name: str, codes: Column) -> Column:
        return F.transform(or_empty(codes), lambda c: F.struct(F.lit(name).alias("dimension"), c.alias("key")))

    entries = F.concat(*[entries_of(name, codes) for name, codes in arrays.items()])
    return rows.select(F.inline(entries)).groupBy("dimension", "key").agg(F.count("*").alias("n"))


def state_statistics(rows: DataFrame) -> DataFrame:
    """rows(qc, decision, decided_by, vision, metadata_state, completeness) -> counts per dimension."""
    counted = frequencies(rows, qc=F.col("qc"), enhancement=F.coalesce("decision", F.lit("not_assessed")), decided_by=F.col("decided_by"),
                          vision=F.col("vision"), metadata_state=F.col("metadata_state"), completeness=F.col("completeness"))
    return counted.filter(F.col("key").isNotNull())


def code_statistics(rows: DataFrame) -> DataFrame:
    """State rows -> counts of QC errors and warnings, enhancement reasons and notes, validation and gate codes."""
    md = F.col("md")

    def code(items: Column) -> Column:
        return F.transform(items, lambda x: x["code"])
    return code_frequencies(
        rows, qc_error=F.transform(F.col("qc_doc.errors"), lambda e: F.substring_index(e, ":", 1)), qc_warning=F.col("qc_doc.warnings"),
        enhancement_note=code(F.col("enhancement_assessed.notes")), validation_error=code(md["validation"]["errors"]),
        validation_warning=code(md["validation"]["warnings"]), review_reason=F.col("review_reasons"), gate_note=code(md["review_gate"]["notes"]))


def failure_statistics(events: DataFrame) -> DataFrame:
    """Failed events by stage and error type (``stage:error`` inside the enhancement stage, ? when absent)."""
    m = F.col("message")
    error = F.coalesce(F.get_json_object(m, "$.error_type"), F.lit("?"))
    key = F.when(F.col("stage") == "ENHANCEMENT", F.concat_ws(":", F.coalesce(F.get_json_object(m, "$.stage"), F.lit("None")), error)).otherwise(error)
    failed = events.filter((F.col("status") == "FAILED") & F.col("stage").isin("AI", "METADATA_AI", "ENHANCEMENT"))
    return failed.groupBy("stage", key.alias("error")).agg(F.count("*").alias("n"))


def durations(events: DataFrame) -> DataFrame:
    """n, median and maximum of model durations per stage, to a tenth of a second.

    Durations are counted by tenths of a second first; only the tenths that hold the two middle ranks are looked into for
    their values, so no task gets all values of a stage and the median is exact.
    """
    value = F.get_json_object("message", "$.duration_s").cast("double")
    rows = events.filter(F.col("stage").isin("AI", "METADATA_AI") & (F.col("status") == "PASSED")).select("stage", value.alias("value")).filter(F.col("value").isNotNull())
    tenth = F.floor(F.col("value") * 10).alias("tenth")
    tenths = rows.groupBy("stage", tenth).agg(F.count("*").alias("times"), F.max("value").alias("most"))
    before = Window.partitionBy("stage").orderBy("tenth").rowsBetween(Window.unboundedPreceding, -1)
    tenths = tenths.withColumns({"before": F.coalesce(F.sum("times").over(before), F.lit(0)), "n": F.sum("times").over(Window.partitionBy("stage"))})
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = tenths.filter((F.col("before") <= high) & (F.col("before") + F.col("times") > low)).select("stage", "tenth", "before", "n")
    inside = (rows.withColumn("tenth", tenth).join(middle, ["stage", "tenth"]).groupBy("stage", "tenth", "before", "n", "value").agg(F.count("*").alias("same")))
    last = F.col("before") + F.sum("same").over(Window.partitionBy("stage", "tenth").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - 1
    ranked = inside.withColumn("last", last).withColumn("hits", F.expr("int(last >= floor((n - 1) / 2) AND last - same + 1 <= floor((n - 1) / 2)) + int(last >= floor(n / 2) AND last - same + 1 <= floor(n / 2))"))
    medians = ranked.groupBy("stage").agg(F.round(F.sum(F.col("value") * F.col("hits")) / 2, 1).alias("median_s"))
    return tenths.groupBy("stage").agg(F.sum("times").alias("n"), F.round(F.max("most"), 1).alias("max_s")).join(medians, "stage").select("stage", "n", "median_s", "max_s")


def readiness_statistics(rows: DataFrame) -> DataFrame:
    """rows(fp_readiness, readiness_evaluated) -> platform status counts; checks and categories of fresh results only."""
    done = F.col("readiness_evaluated")
    stale = ~done["fingerprint"].eqNullSafe(F.col("fp_readiness"))

    def entry(dimension: str, key: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), key.alias("key"))

    statuses = F.array(*[entry("status", F.concat(F.lit(f"{p}:"), first_match([(done.isNull(), "not_evaluated"), (stale, "stale")], done["platforms"][p]["status"]))) for p in fixed.PLATFORMS])

    def of_platform(p: str) -> tuple[Column, Column]:
        result = done["platforms"][p]
        return (F.transform(result["checks"], lambda c: entry("check", F.concat_ws(":", F.lit(p), c["code"], c["level"]))),
                F.transform(result["categories"], lambda c: entry("category", F.concat_ws(":", F.lit(p), c))))

    details = F.concat(*[x for p in fixed.PLATFORMS for x in of_platform(p)])
    entries = F.when(done.isNotNull() & ~stale, F.concat(statuses, details)).otherwise(statuses)
    return rows.select(F.inline(entries)).groupBy("dimension", "key").agg(F.count("*").alias("n"))


def review_queue(rows: DataFrame) -> DataFrame:
    """One row of totals over the catalogue, states and metadata states zero-filled as columns."""
    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))
    state = F.col("state")
    return rows.agg(
        F.count("*").alias("total"), *[count(state == s).alias(f"state_{s}") for s in fixed.ASSET_STATES],
        count(F.col("metadata_approved")).alias("approved"),
        count(state.isin("platform_ready", "publication_approved", "ready_for_export")).alias("platform_ready_total"),
        count(state.isin("publication_approved", "ready_for_export")).alias("publication_approved_total"),
        *[count(F.col("metadata_state") == s).alias(f"metadata_{s}") for s in fixed.METADATA_STATES])


def problem_key(code: Column) -> Column:
    return F.when(code.startswith("STALE:"), F.substring_index(code, ":", 2)).otherwise(F.substring_index(code, ":", 1))


def problem_counts(rows: DataFrame) -> DataFrame:
    """Assets per problem key, each asset counted once per key."""
    return (rows.select(F.explode(F.array_distinct(F.transform("problems", problem_key))).alias("key"))
            .groupBy("key").agg(F.count("*").alias("n")))


def counters(rows: DataFrame, exports: DataFrame, collected: DataFrame) -> DataFrame:
    """Numbers of the front page; collecting is allowed only when nothing waits for a person."""
    held = collected.select("asset_id", "platform", "sha256", F.lit(True).alias("held"))
    open_files = exports.join(held, ["asset_id", "platform", "sha256"], "left").groupBy("asset_id").agg(
        F.bool_or(F.col("held").isNull() | (F.col("status") != "ready_for_export")).alias("uncollected"))
    joined = rows.select("asset_id", "state").join(open_files, "asset_id", "left")

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))
    state = F.col("state")
    approved = state.isin("publication_approved", "ready_for_export")
    totals = joined.agg(count(approved & F.coalesce("uncollected", F.lit(True))).alias("approved"), count(approved).alias("approved_total"), count(state == "human_review").alias("attention"),
                        count(state == "blocked").alias("blocked"), count(state == "rejected").alias("rejected"), count(state.isin("source_invalid", "stale")).alias("source"), F.count("*").alias("total"))
    return totals.withColumn("can_collect", F.col("attention") == 0)


def facts_profile(rows: DataFrame) -> DataFrame:
    """Frequency tables over source facts, with the quality and megapixel buckets, and sums of flags."""
    megapixels = F.col("width") * F.col("height") / 1000000
    bucket = first_match([(megapixels < 1, "<1"), (megapixels < 4, "1-4"), (megapixels < 12, "4-12")], "12+")
    return frequencies(
        rows, container=F.col("container"), format=F.col("format"), color_mode=F.col("color_mode"), bit_depth=F.col("bit_depth"), alpha=F.col("has_alpha"),
        color_profile=F.col("color_kind"), color_source=F.col("color_source"), hdr=F.coalesce("hdr", F.lit("None")), orientation=F.col("orientation"),
        frames=F.concat_ws("/", F.col("frames_readable").cast("string"), F.col("frames_declared").cast("string")),
        jpeg_quality=(F.floor(F.col("jpeg_quality") / 10) * 10), megapixels=bucket, software=F.substring_index(F.coalesce("software", F.lit("-")), " ", 1),
        motion_video=flag(F.col("motion_video"), "yes"), c2pa=flag(F.col("c2pa"), "yes"), changed=flag(~F.col("unchanged"), "yes"))


def next_batch(collected: DataFrame, folders: DataFrame) -> DataFrame:
    """Next batch number per platform, over events and folder names (temporary ones too); 1 when there is none."""
    number = F.regexp_extract(F.regexp_replace("folder", r"^\.|\.tmp$", ""), fixed.BATCH_FOLDER_PATTERN, 1).try_cast("bigint")
    known = collected.select("platform", F.col("batch").cast("bigint").alias("batch")).unionByName(folders.select("platform", number.alias("batch")))
    return known.groupBy("platform").agg((F.coalesce(F.max("batch"), F.lit(0)) + 1).alias("next_batch"))


def order_of_state(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fixed.ASSET_STATES]), state)


def problem_assets(rows: DataFrame) -> DataFrame:
    """Assets with problems, most important state first."""
    return (rows.filter(F.size("problems") > 0).withColumn("rank", order_of_state(F.col("state"))).orderBy("rank", "asset_id")
            .select("asset_id", "filename", "state", "rank", F.array_join("problems", ",").alias("problems")))


def digest(rows: DataFrame) -> DataFrame:
    """The first problem assets (a top-k) with the severity of the whole catalogue."""
    urgent = rows.agg(F.bool_or(F.col("state").isin("human_review", "blocked", "error", "source_invalid") | (F.size("problems") > 0)).alias("urgent"))
    shown = problem_assets(rows).limit(fixed.DIGEST_PROBLEM_ASSETS)
    return shown.join(F.broadcast(urgent)).withColumn("severity", F.when(F.col("urgent"), "attention").otherwise("info")).drop("urgent", "rank")


def gate_transitions(events: DataFrame) -> DataFrame:
    """Gate decisions by state before and decision, and how many assets got another decision than the time before.

    The previous decision of an asset needs the order of its own gate events only. A history is first cut into
    id ranges and reduced to (first, last, changes) per range, so a very long one is not ordered by one task.
    """
    m = F.col("message")
    gated = events.filter((F.col("stage") == "METADATA") & (F.col("status") == "GATED")).select(
        "asset_id", "id", F.get_json_object(m, "$.decision").alias("decision"), F.get_json_object(m, "$.state_before").alias("state_before"))
    span = F.floor(F.col("id") / 100000)
    within = Window.partitionBy("asset_id", "span").orderBy("id")
    marked = gated.withColumn("span", span).withColumn("previous", F.lag("decision").over(within))
    ranges = marked.groupBy("asset_id", "span").agg(F.min_by("decision", "id").alias("first"), F.max_by("decision", "id").alias("last"),
                                                   F.count(F.when(F.col("previous") != F.col("decision"), 1)).alias("changes"))
    across = Window.partitionBy("asset_id").orderBy("span")
    changed = ranges.withColumn("changes", F.col("changes") + F.coalesce((F.lag("last").over(across) != F.col("first")).cast("int"), F.lit(0))) \
        .groupBy("asset_id").agg(F.sum("changes").alias("changes")).filter(F.col("changes") > 0)
    counts = gated.groupBy("state_before", "decision").agg(F.count("*").alias("n"))
    return counts.unionByName(changed.agg(F.lit(None).cast("string").alias("state_before"), F.lit("changed_assets").alias("decision"), F.count("*").alias("n")))


def invariant_violations(rows: DataFrame) -> DataFrame:
    """Assets shown as approved although their publication is not current or approves nothing."""
    shown = F.col("state").isin("publication_approved", "ready_for_export")
    return rows.agg(F.count("*").alias("assets"), F.count(F.when(shown, 1)).alias("approved"),
                    F.count(F.when(shown & ((F.col("publication_status") != "current") | (F.size("approved_for") == 0)), 1)).alias("violations"))


def label_medians(scores: DataFrame, labels: DataFrame, *group: str) -> DataFrame:
    """Median score and recommendation counts per human label group.

    Scores are whole points from 0 to 100, so they are counted per value before the median is taken.
    """
    rows = scores.join(labels, "asset_id")
    counted = rows.groupBy(*group, "score").agg(F.count("*").alias("times"), *[
        F.count(F.when(F.col("recommendation") == r, 1)).alias(r) for r in ("proceed", "attention", "skip_suggested")])
    return counted.groupBy(*group).agg(F.sum("times").alias("n"), F.expr("percentile(score, 0.5, times)").alias("median_score"),
                                       *[F.sum(r).alias(r) for r in ("proceed", "attention", "skip_suggested")])
