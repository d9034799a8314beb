"""Reductions of the append-only event log.

"Newest" always means the greatest id, never the greatest timestamp, and every reduction is a
map-side combinable aggregate per key: one asset holding a large share of the log only costs its
partial aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import documents as doc
from plateworks.functions.arrays import first_match
from plateworks.sources.schemas import MESSAGES

# slot -> (stage, status or None for any status[, members the JSON message must have])
SLOTS = {
    "ingest_done": ("INGEST", "DONE"),
    "source_invalid": ("SOURCE", "INVALID"),
    "normalize_evaluated": ("NORMALIZE", "EVALUATED"),
    "normalize_passed": ("NORMALIZE", "PASSED"),
    "normalize_failed": ("NORMALIZE", "FAILED"),
    "view_failed": ("VIEW", "FAILED"),
    "qc": ("QC", None),
    "enhancement_assessed": ("ENHANCEMENT", "ASSESSED"),
    "enhancement_advised": ("ENHANCEMENT", "ADVISED"),
    "enhancement_failed": ("ENHANCEMENT", "FAILED"),
    "ai_passed": ("AI", "PASSED"),
    "ai_failed": ("AI", "FAILED"),
    "metadata": ("METADATA", None),
    "metadata_ai_passed": ("METADATA_AI", "PASSED"),
    "readiness_evaluated": ("READINESS", "EVALUATED"),
    "readiness_failed": ("READINESS", "FAILED"),
    "creative_advised": ("CREATIVE_REVIEW", "ADVISED"),
    "publication_evaluated": ("PUBLICATION", "EVALUATED"),
    "attested": ("HUMAN", "PEOPLE_ATTESTED"),
    "export_adobe": ("DERIVATIVE", "CREATED", {"purpose": "export", "platform": "adobe"}),
    "export_shutterstock": ("DERIVATIVE", "CREATED", {"purpose": "export", "platform": "shutterstock"}),
    "export_failed_adobe": ("EXPORT", "FAILED", {"platform": "adobe"}),
    "export_failed_shutterstock": ("EXPORT", "FAILED", {"platform": "shutterstock"}),
}


def is_slot(slot: str) -> Column:
    stage, status, *match = SLOTS[slot]
    test = F.col("stage") == stage
    if status is not None:
        test = test & (F.col("status") == status)
    for member, value in (match[0] if match else {}).items():
        test = test & (doc.field(F.col("message"), f"$.{member}") == value)
    return test


def latest(events: DataFrame, keys: Iterable[str] = ("asset_id", "stage", "status")) -> DataFrame:
    """Newest event per key: event_id, message."""
    return events.groupBy(*keys).agg(F.max("id").alias("event_id"), F.max_by("message", "id").alias("message"))


def latest_matching(events: DataFrame, stage: str, status: str, by: dict[str, str], **match: str) -> DataFrame:
    """Newest event of a stage/status whose JSON message has the given members, per asset and message keys ``by``."""
    hits = events.filter((F.col("stage") == stage) & (F.col("status") == status))
    for member, value in match.items():
        hits = hits.filter(doc.field(F.col("message"), f"$.{member}") == value)
    keyed = hits.select("asset_id", "id", "message", *[doc.field(F.col("message"), p).alias(c) for c, p in by.items()])
    return latest(keyed, ("asset_id", *by))


def latest_slots(events: DataFrame, slots: Iterable[str] = tuple(SLOTS), messages: Iterable[str] = ()) -> DataFrame:
    """One row per asset: newest event id per slot, and for ``messages`` the typed message of that event.

    One scan and one shuffle. Messages travel raw and are decoded after the reduction, so JSON is
    parsed once per asset and slot, not once per event. Without messages the aggregate holds only
    fixed-width buffers and runs as a hash aggregate.
    """
    slots, messages = tuple(slots), tuple(messages)
    stages = sorted({SLOTS[s][0] for s in slots})
    reduced = events.filter(F.col("stage").isin(*stages)).groupBy("asset_id").agg(
        *[F.max(F.when(is_slot(s), F.col("id"))).alias(f"{s}_id") for s in slots],
        *[F.max_by("message", F.when(is_slot(s), F.col("id"))).alias(f"{s}_text") for s in messages])
    typed = [doc.decode(F.col(f"{s}_text"), MESSAGES[s]).alias(s) for s in messages if s in MESSAGES]
    plain = [F.col(f"{s}_text") for s in messages if s not in MESSAGES]
    return reduced.select("asset_id", *[F.col(f"{s}_id") for s in slots], *typed, *plain)


def newer(a: Column, b: Column) -> Column:
    """Event a exists and is newer than b (or b does not exist)."""
    return a.isNotNull() & (b.isNull() | (a > b))


def log_verdict(events: DataFrame) -> DataFrame:
    """Whether the newest negative evidence about a source file is newer than the newest positive one."""
    stage, status = F.col("stage"), F.col("status")
    source_code = doc.field(F.col("message"), "$.error_type").isin(*fixed.SOURCE_NEGATIVE_CODES)
    negative = ((stage == "SOURCE") & (status == "INVALID")) | ((stage == "NORMALIZE") & (status == "FAILED") & source_code)
    positive = ((stage == "NORMALIZE") & status.isin("EVALUATED", "PASSED")) | (stage == "QC")
    return (events.filter(stage.isin("SOURCE", "NORMALIZE", "QC")).groupBy("asset_id")
            .agg(F.max(F.when(negative, F.col("id"))).alias("negative_id"), F.max(F.when(positive, F.col("id"))).alias("positive_id"))
            .withColumn("changed", newer(F.col("negative_id"), F.col("positive_id"))))


def history(events: DataFrame, stage: str | None = None) -> DataFrame:
    """Events by asset and id; JSON messages are marked, other texts stay as they are."""
    rows = events if stage is None else events.filter(F.col("stage") == stage)
    return (rows.select("asset_id", "id", "stage", "status", "message", doc.is_json(F.col("message")).alias("is_document"))
            .orderBy("asset_id", "id"))


def recent(events: DataFrame, limit: int = fixed.RECENT_EVENTS) -> DataFrame:
    """The newest events of the catalogue with a one-line summary (a top-k, no full sort)."""
    top = events.orderBy(F.desc("id")).limit(limit)
    text = F.col("message")
    picked = F.coalesce(*[F.nullif(doc.field(text, f"$.{m}"), F.lit("")) for m in ("reason", "outcome", "platform")], F.lit(""))
    summary = F.when(doc.is_json_object(text), picked).otherwise(F.coalesce(text, F.lit("")))
    return top.select("id", "asset_id", "stage", "status", F.substring(summary, 1, fixed.SUMMARY_CHARS).alias("summary"))


def stage_counts(events: DataFrame) -> DataFrame:
    """Event counts by stage/status and by actor from one scan and one shuffle."""
    def entry(dimension: str, key: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), key.alias("key"))
    keys = F.array(entry("stage", F.concat_ws("/", "stage", "status")),
                   entry("actor", F.coalesce(doc.field(F.col("message"), "$.actor"), F.lit("-"))))
    return events.select(F.inline(keys)).groupBy("dimension", "key").agg(F.count("*").alias("events"))


def error_text(message: Column) -> Column:
    return F.concat_ws(": ", F.coalesce(doc.field(message, "$.error_type"), F.lit("")), F.coalesce(doc.field(message, "$.error"), F.lit("")))


def failures(events: DataFrame) -> DataFrame:
    """FAILED events per asset and stage with the newest error text."""
    failed = events.filter(F.col("status") == "FAILED")
    return (failed.groupBy("asset_id", "stage").agg(F.count("*").alias("failed"), F.max_by("message", "id").alias("message"))
            .select("asset_id", "stage", "failed", error_text(F.col("message")).alias("last_error")))


# --- retries ---------------------------------------------------------------------------------

def retry_candidates(assets: DataFrame) -> DataFrame:
    """assets(asset_id, vision, metadata_state, completeness) -> what could be retried, vision before drafts."""
    vision = assets.filter(F.col("vision") == "failed").select(
        "asset_id", F.lit("AI").alias("stage"), F.lit("asset.process").alias("operation"), F.lit(0).alias("kind_order"))
    drafts = assets.filter((F.col("metadata_state") == "draft") & (F.col("completeness") == "partial")).select(
        "asset_id", F.lit("METADATA_AI").alias("stage"), F.lit("metadata.build").alias("operation"), F.lit(1).alias("kind_order"))
    return vision.unionByName(drafts)


def sent_notices(events: DataFrame) -> DataFrame:
    """Distinct (asset, kind, key) of notices already delivered."""
    return (events.filter((F.col("stage") == "NOTIFY") & (F.col("status") == "SENT"))
            .select("asset_id", doc.field(F.col("message"), "$.kind").alias("kind"), doc.field(F.col("message"), "$.key").alias("key"))
            .distinct())


def retry_plan(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """candidates(asset_id, stage, operation, kind_order, history_ok) -> action per candidate."""
    counts = failures(events)
    notices = sent_notices(events).filter(F.col("kind") == "retry_exhausted").select(
        "asset_id", F.col("key").alias("exhausted_key"), F.lit(True).alias("notified"))
    planned = candidates.join(counts, ["asset_id", "stage"], "left")
    readable = F.col("history_ok")
    planned = (planned.withColumn("failed", F.when(readable, F.coalesce("failed", F.lit(0))).otherwise(0).cast("bigint"))
               .withColumn("last_error", F.when(readable, F.col("last_error")))
               .withColumn("exhausted_key", F.concat_ws(":", "stage", F.col("failed").cast("string")))
               .join(notices, ["asset_id", "exhausted_key"], "left"))
    action = first_match([
        (~readable, "history_error"),
        ((F.col("failed") >= fixed.RETRY_MAX_FAILED) & F.col("notified").isNotNull(), "exhausted_notified"),
        (F.col("failed") >= fixed.RETRY_MAX_FAILED, "exhausted"),
    ], "retry")
    return planned.select("asset_id", "stage", "operation", "kind_order", "failed", "exhausted_key", "last_error", action.alias("action"))


def retry_batch(plan: DataFrame, limit: int = fixed.RETRY_MAX_PER_RUN) -> DataFrame:
    """The first retries in candidate order (top-k)."""
    return plan.filter(F.col("action") == "retry").orderBy("kind_order", "asset_id").limit(limit)


def retry_report(batch: DataFrame, results: DataFrame) -> DataFrame:
    """results(asset_id, stage, ok): attempt number and outcome per retried item."""
    return (batch.join(results, ["asset_id", "stage"], "left")
            .select("asset_id", "operation", (F.col("failed") + 1).alias("attempt"), F.coalesce("ok", F.lit(False)).alias("recovered"))
            .withColumn("key", F.concat_ws(":", "operation", F.col("attempt").cast("string")))
            .withColumn("severity", F.when(F.col("recovered"), "info").otherwise("warning")))


def retry_alert(plan: DataFrame, day: str) -> DataFrame:
    """Newly exhausted or unreadable items as notice rows with their dedupe key; no rows, no alert."""
    key = F.when(F.col("action") == "history_error", F.lit(f"history_error:{day}")).otherwise(F.col("exhausted_key"))
    return plan.filter(F.col("action").isin("exhausted", "history_error")).select(
        "asset_id", F.lit("retry_exhausted").alias("kind"), F.lit("warning").alias("severity"), key.alias("key"), "failed", "last_error")


def ingest_report(results: DataFrame) -> DataFrame:
    """results(asset_id, ok, state) of one run -> counts and severity."""
    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))
    report = results.agg(F.count("*").alias("processed"), count(F.col("state") == "auto_approved").alias("auto_ready"),
                         count(F.col("state") == "human_review").alias("waiting_review"), count(~F.col("ok")).alias("failed"))
    return report.withColumn("severity", first_match([(F.col("failed") > 0, "warning"), (F.col("waiting_review") > 0, "attention")], "info"))


# --- notices and idempotence -----------------------------------------------------------------

def shape_notices(notices: DataFrame) -> DataFrame:
    """Only notices with items; title and item list cut to what a notice may carry."""
    return notices.filter(F.size("items") > 0).withColumn("title", F.substring("title", 1, fixed.NOTICE_TITLE_CHARS)) \
        .withColumn("items", F.slice("items", 1, fixed.NOTICE_MAX_ITEMS))


def dedupe_notices(requests: DataFrame, sent: DataFrame, known: DataFrame) -> DataFrame:
    """requests(batch, pos, asset_id, kind, key) -> outcome; a batch naming an unknown asset is refused whole.

    The first position of a key is a plain minimum (combined map-side) and is joined back by the unique
    position, so a key repeated in a third of the requests is never gathered in one task.
    """
    # keep one row per asset before the check: a hot asset must not travel once per request
    named = requests.select("batch", "asset_id").distinct()
    refused = named.join(known.select("asset_id"), "asset_id", "left_anti").select("batch").distinct().withColumn("refused", F.lit(True))
    accepted = requests.join(refused, "batch", "left")
    firsts = (accepted.filter(F.col("refused").isNull()).groupBy("asset_id", "kind", "key").agg(F.min("pos").alias("pos"))
              .join(sent, ["asset_id", "kind", "key"], "left_anti").select("pos", F.lit(True).alias("fresh")))
    outcome = first_match([(F.col("refused"), "REFUSED"), (F.col("fresh"), "RECORDED")], "ALREADY_SENT")
    return accepted.join(firsts, "pos", "left").select("batch", "pos", "asset_id", "kind", "key", outcome.alias("outcome"))


def write_if_changed(candidates: DataFrame, last: DataFrame) -> DataFrame:
    """candidates(asset_id, fingerprint) against last(asset_id, last_fingerprint): EVALUATED or UNCHANGED."""
    same = F.col("last_fingerprint").isNotNull() & F.col("fingerprint").eqNullSafe(F.col("last_fingerprint"))
    return candidates.join(last, "asset_id", "left").withColumn("outcome", F.when(same, "UNCHANGED").otherwise("EVALUATED"))


def repeated_failure(stage: Column, error_type: Column, fingerprint: Column, failed: Column, failed_id: Column,
                     success_ids: Iterable[Column]) -> Column:
    """A failure equal to the last stored one, with no newer success: nothing is written."""
    same = failed["fingerprint"].eqNullSafe(fingerprint) & (failed["error_type"] == error_type) & (failed["stage"] == stage)
    newest_success = F.greatest(*success_ids)
    return F.coalesce(failed_id.isNotNull() & same & ~newer(newest_success, failed_id), F.lit(False))


def collected(events: DataFrame) -> DataFrame:
    """Newest batch that already holds exactly this file."""
    m = F.col("message")
    rows = events.filter((F.col("stage") == "OUTBOX") & (F.col("status") == "COLLECTED")).select(
        "asset_id", "id", doc.field(m, "$.platform").alias("platform"), doc.field(m, "$.sha256").alias("sha256"),
        doc.field(m, "$.batch").cast("bigint").alias("batch"), doc.field(m, "$.folder").alias("folder"))
    return rows.groupBy("asset_id", "platform", "sha256").agg(
        F.max("id").alias("event_id"), F.max_by("batch", "id").alias("batch"), F.max_by("folder", "id").alias("folder"))


def attestation(slots: DataFrame) -> DataFrame:
    """slots(asset_id, file_hash, attested, attested_id) -> the attestation in force, if any."""
    kind = F.col("attested.kind")
    return slots.filter(kind.isin(*fixed.LIFTING_ATTESTATIONS) & (F.col("attested.file_hash") == F.col("file_hash"))).select(
        "asset_id", kind.alias("kind"), F.col("attested_id").alias("event_id"))


# --- summaries over slots --------------------------------------------------------------------

def advice_applies() -> Column:
    """The stored advice names the assessment that is current."""
    return F.coalesce(F.col("enhancement_advised.assessment_event_id") == F.col("enhancement_assessed_id"), F.lit(False))


def effective_decision() -> Column:
    """Decision of the rules, else of the advice, else disputed."""
    assessed = F.col("enhancement_assessed")
    return F.coalesce(assessed["decision"], F.when(advice_applies(), F.col("enhancement_advised.advice.decision")),
                      F.when(assessed["disputed"], "disputed"))


def enhancement_summary(slots: DataFrame) -> DataFrame:
    """slots with fp_enh -> assessed, stale, decision, decided_by, reasons."""
    assessed = F.col("enhancement_assessed")
    has = F.col("enhancement_assessed_id").isNotNull() & assessed.isNotNull()
    by_advice = assessed["decision"].isNull() & advice_applies()
    reasons = F.when(by_advice, F.transform("enhancement_advised.advice.reasons", lambda r: r["reason"])) \
        .otherwise(F.transform(assessed["reasons"], lambda r: r["reason"]))
    return slots.select(
        "asset_id", has.alias("assessed"),
        (has & ~assessed["fingerprint"].eqNullSafe(F.col("fp_enh"))).alias("stale"),
        F.when(has, effective_decision()).alias("decision"),
        F.when(has, first_match([(assessed["decision"].isNotNull(), "rules"), (by_advice, "advisor")])).alias("decided_by"),
        F.when(has, reasons).alias("reasons"))


def normalize_summary(slots: DataFrame) -> DataFrame:
    """slots with fp_facts, fp_rep -> facts and representation state."""
    evaluated, passed = F.col("normalize_evaluated"), F.col("normalize_passed")
    success = F.greatest("normalize_evaluated_id", "normalize_passed_id")
    return slots.select(
        "asset_id", evaluated.isNotNull().alias("evaluated"),
        (evaluated.isNotNull() & ~evaluated["fingerprint"].eqNullSafe(F.col("fp_facts"))).alias("stale"),
        F.when(newer(F.col("normalize_failed_id"), success), F.col("normalize_failed.error_type")).alias("failed"),
        evaluated["facts"]["container"].alias("container"), evaluated["facts"]["color_kind"].alias("color_kind"),
        evaluated["facts"]["motion_video"].alias("motion_video"), passed["representation"].alias("representation"),
        (passed.isNotNull() & ~passed["fingerprint"].eqNullSafe(F.col("fp_rep"))).alias("representation_stale"))
