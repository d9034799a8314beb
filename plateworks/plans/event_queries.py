"""Queries of the log reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks.functions import fingerprints
from plateworks.functions.arrays import joined
from plateworks.operators import log
from plateworks.plans.bindings import Tables, sql_view
from plateworks.plans.registry import query


def _filter(slot: str) -> str:
    stage, status, *match = log.SLOTS[slot]
    test = f"stage = '{stage}'" + (f" AND status = '{status}'" if status else "")
    if match:  # the CASE keeps plain-text messages of other stages away from the JSON functions
        members = " AND ".join(f"json_extract_string(message, '$.{k}') = '{v}'" for k, v in match[0].items())
        test = f"CASE WHEN {test} THEN {members} ELSE FALSE END"
    return f"FILTER (WHERE {test})"


sql_view("b_slots", "SELECT asset_id, " + ", ".join(
    f"max(id) {_filter(s)} AS {s}_id, max_by(message, id) {_filter(s)} AS {s}_text" for s in log.SLOTS) + " FROM b_events GROUP BY asset_id")

_J = "json_extract_string"


@query("evt_last", "SELECT asset_id, stage, status, max(id) AS event_id, max_by(message, id) AS message FROM b_events GROUP BY ALL")
def evt_last(t: Tables):
    return log.latest(t.b_events)


@query("evt_last_match", f"""
SELECT asset_id, {_J}(message, '$.platform') AS platform, max(id) AS event_id, max_by(message, id) AS message
FROM b_events WHERE stage = 'DERIVATIVE' AND status = 'CREATED' AND {_J}(message, '$.purpose') = 'export' GROUP BY 1, 2""")
def evt_last_match(t: Tables):
    return log.latest_matching(t.b_events, "DERIVATIVE", "CREATED", {"platform": "$.platform"}, purpose="export")


def catalog_slots(t: Tables, *names: str):
    """Catalogue rows with the newest event of the given slots."""
    return t.b_catalog.withColumns(fingerprints.of_file(F.col("file_hash"))).join(log.latest_slots(t.b_events, names, names), "asset_id", "left")


@query("evt_vision_provenance", f"""
SELECT c.asset_id, ai_passed_id AS event_id,
  CASE WHEN json_valid(ai_passed_text) THEN {_J}(ai_passed_text, '$.provider') END AS provider,
  CASE WHEN json_valid(ai_passed_text) THEN {_J}(ai_passed_text, '$.model') END AS model,
  CASE WHEN json_valid(ai_passed_text) THEN {_J}(ai_passed_text, '$.prompt_version') END AS prompt_version
FROM b_catalog c LEFT JOIN b_slots s USING (asset_id) WHERE ai_result IS NOT NULL""")
def evt_vision_provenance(t: Tables):
    rows = catalog_slots(t, "ai_passed").filter(F.col("ai_result").isNotNull())
    return rows.select("asset_id", F.col("ai_passed_id").alias("event_id"), "ai_passed.provider", "ai_passed.model", "ai_passed.prompt_version")


@query("evt_newer", """
SELECT asset_id, normalize_failed_id IS NOT NULL AND (normalize_passed_id IS NULL OR normalize_failed_id > normalize_passed_id) AS normalize_failed_newer,
  ai_failed_id IS NOT NULL AND (ai_passed_id IS NULL OR ai_failed_id > ai_passed_id) AS ai_failed_newer
FROM b_slots WHERE coalesce(normalize_failed_id, normalize_passed_id, ai_failed_id, ai_passed_id) IS NOT NULL""")
def evt_newer(t: Tables):
    slots = log.latest_slots(t.b_events, ("normalize_failed", "normalize_passed", "ai_failed", "ai_passed"))
    slots = slots.filter(F.coalesce("normalize_failed_id", "normalize_passed_id", "ai_failed_id", "ai_passed_id").isNotNull())
    return slots.select("asset_id", log.newer(F.col("normalize_failed_id"), F.col("normalize_passed_id")).alias("normalize_failed_newer"),
                        log.newer(F.col("ai_failed_id"), F.col("ai_passed_id")).alias("ai_failed_newer"))


@query("evt_success_latest", """
SELECT asset_id, greatest(normalize_evaluated_id, normalize_passed_id) AS success_id FROM b_slots
WHERE coalesce(normalize_evaluated_id, normalize_passed_id) IS NOT NULL""")
def evt_success_latest(t: Tables):
    slots = log.latest_slots(t.b_events, ("normalize_evaluated", "normalize_passed"))
    return slots.select("asset_id", F.greatest("normalize_evaluated_id", "normalize_passed_id").alias("success_id")).filter("success_id IS NOT NULL")


sql_view("b_verdict", f"""
SELECT asset_id, negative_id, positive_id, negative_id IS NOT NULL AND (positive_id IS NULL OR negative_id > positive_id) AS changed FROM (
  SELECT asset_id,
    max(id) FILTER (WHERE (stage = 'SOURCE' AND status = 'INVALID') OR (stage = 'NORMALIZE' AND status = 'FAILED'
        AND {_J}(message, '$.error_type') IN ('SOURCE_MISSING', 'SOURCE_CHANGED'))) AS negative_id,
    max(id) FILTER (WHERE (stage = 'NORMALIZE' AND status IN ('EVALUATED', 'PASSED')) OR stage = 'QC') AS positive_id
  FROM b_events WHERE stage IN ('SOURCE', 'NORMALIZE', 'QC') GROUP BY asset_id)""")


@query("evt_evidence", "SELECT * FROM b_verdict")
def evt_evidence(t: Tables):
    return log.log_verdict(t.b_events)


@query("evt_history", "SELECT asset_id, id, stage, status, message, json_valid(message) AS is_document FROM b_events")
def evt_history(t: Tables):
    return log.history(t.b_events)


@query("evt_recent", f"""
SELECT id, asset_id, stage, status, substr(CASE WHEN json_valid(message) AND json_type(CASE WHEN json_valid(message) THEN message END) = 'OBJECT' THEN
  coalesce(nullif({_J}(message, '$.reason'), ''), nullif({_J}(message, '$.outcome'), ''), nullif({_J}(message, '$.platform'), ''), '')
  ELSE coalesce(message, '') END, 1, 120) AS summary
FROM (SELECT * FROM b_events ORDER BY id DESC LIMIT 15)""")
def evt_recent(t: Tables):
    return log.recent(t.b_events)


@query("evt_stage_counts", f"""
SELECT 'stage' AS dimension, stage || '/' || status AS key, count(*) AS events FROM b_events GROUP BY 2
UNION ALL SELECT 'actor', CASE WHEN json_valid(message) THEN coalesce({_J}(message, '$.actor'), '-') ELSE '-' END, count(*) FROM b_events GROUP BY 2""")
def evt_stage_counts(t: Tables):
    return log.stage_counts(t.b_events)


sql_view("b_failures", f"""
SELECT asset_id, stage, count(*) AS failed, coalesce({_J}(max_by(message, id), '$.error_type'), '') || ': ' || coalesce({_J}(max_by(message, id), '$.error'), '') AS last_error
FROM b_events WHERE status = 'FAILED' GROUP BY asset_id, stage""")


@query("evt_fail_count", "SELECT * FROM b_failures")
def evt_fail_count(t: Tables):
    return log.failures(t.b_events)


# vision / metadata state of every asset, as retry and list operators read it
sql_view("b_list", f"""
SELECT c.asset_id, c.source, c.filename,
  CASE WHEN ai_result IS NOT NULL THEN 'done' WHEN ai_failed_id IS NOT NULL AND (ai_passed_id IS NULL OR ai_failed_id > ai_passed_id) THEN 'failed' ELSE 'pending' END AS vision,
  coalesce({_J}(metadata_json, '$.state'), 'none') AS metadata_state, {_J}(metadata_json, '$.completeness') AS completeness
FROM b_catalog c LEFT JOIN b_slots USING (asset_id)""")


def asset_list(t: Tables):
    ids = log.latest_slots(t.b_events, ("ai_failed", "ai_passed"))
    vision = (F.when(F.col("ai_result").isNotNull(), "done")
              .when(log.newer(F.col("ai_failed_id"), F.col("ai_passed_id")), "failed").otherwise("pending"))
    return t.b_catalog.join(ids, "asset_id", "left").select(
        "asset_id", "source", "filename", vision.alias("vision"),
        F.coalesce(F.get_json_object("metadata_json", "$.state"), F.lit("none")).alias("metadata_state"),
        F.get_json_object("metadata_json", "$.completeness").alias("completeness"))


sql_view("b_candidates", """
SELECT asset_id, 'AI' AS stage, 'asset.process' AS operation, 0 AS kind_order FROM b_list WHERE vision = 'failed'
UNION ALL SELECT asset_id, 'METADATA_AI', 'metadata.build', 1 FROM b_list WHERE metadata_state = 'draft' AND completeness = 'partial'""")


@query("evt_retry_candidates", "SELECT * FROM b_candidates")
def evt_retry_candidates(t: Tables):
    return log.retry_candidates(asset_list(t))


# every asset is a candidate here, so that all actions occur; histories of one source count as unreadable
sql_view("b_retry_plan", f"""
SELECT asset_id, stage, operation, kind_order, failed, exhausted_key, last_error,
  CASE WHEN NOT history_ok THEN 'history_error' WHEN failed >= 3 AND notified THEN 'exhausted_notified' WHEN failed >= 3 THEN 'exhausted' ELSE 'retry' END AS action
FROM (SELECT p.*, n.asset_id IS NOT NULL AS notified FROM (
  SELECT c.asset_id, 'AI' AS stage, 'asset.process' AS operation, 0 AS kind_order, c.source <> 'src17' AS history_ok,
    CASE WHEN c.source <> 'src17' THEN coalesce(f.failed, 0) ELSE 0 END AS failed,
    'AI:' || CASE WHEN c.source <> 'src17' THEN coalesce(f.failed, 0) ELSE 0 END AS exhausted_key,
    CASE WHEN c.source <> 'src17' THEN f.last_error END AS last_error
  FROM b_catalog c LEFT JOIN b_failures f ON f.asset_id = c.asset_id AND f.stage = 'AI') p
 LEFT JOIN (SELECT DISTINCT asset_id, {_J}(message, '$.key') AS key FROM b_events WHERE stage = 'NOTIFY' AND status = 'SENT'
            AND {_J}(message, '$.kind') = 'retry_exhausted') n ON n.asset_id = p.asset_id AND n.key = p.exhausted_key)""")


def _retry_plan(t: Tables):
    everyone = t.b_catalog.select("asset_id", F.lit("AI").alias("stage"), F.lit("asset.process").alias("operation"),
                                  F.lit(0).alias("kind_order"), (F.col("source") != "src17").alias("history_ok"))
    return log.retry_plan(everyone, t.b_events)


@query("evt_retry_plan", "SELECT * FROM b_retry_plan")
def evt_retry_plan(t: Tables):
    return _retry_plan(t)


@query("evt_retry_cap", "SELECT * FROM b_retry_plan WHERE action = 'retry' ORDER BY kind_order, asset_id LIMIT 5")
def evt_retry_cap(t: Tables):
    return log.retry_batch(_retry_plan(t))


@query("evt_retry_report", """
SELECT b.asset_id, operation, failed + 1 AS attempt, coalesce(ok, FALSE) AS recovered, operation || ':' || (failed + 1) AS key,
  CASE WHEN coalesce(ok, FALSE) THEN 'info' ELSE 'warning' END AS severity
FROM (SELECT * FROM b_retry_plan WHERE action = 'retry') b LEFT JOIN (
  SELECT asset_id, ai_passed_id IS NOT NULL AND (ai_failed_id IS NULL OR ai_passed_id > ai_failed_id) AS ok FROM b_slots) r ON r.asset_id = b.asset_id""")
def evt_retry_report(t: Tables):
    ids = log.latest_slots(t.b_events, ("ai_failed", "ai_passed"))
    results = ids.select("asset_id", F.lit("AI").alias("stage"), log.newer(F.col("ai_passed_id"), F.col("ai_failed_id")).alias("ok"))
    return log.retry_report(_retry_plan(t).filter("action = 'retry'"), results)


@query("evt_retry_alert", """
SELECT asset_id, 'retry_exhausted' AS kind, 'warning' AS severity, CASE WHEN action = 'history_error' THEN 'history_error:2024-02-01' ELSE exhausted_key END AS key,
  failed, last_error FROM b_retry_plan WHERE action IN ('exhausted', 'history_error')""")
def evt_retry_alert(t: Tables):
    return log.retry_alert(_retry_plan(t), "2024-02-01")


@query("evt_ingest_report", """
SELECT *, CASE WHEN failed > 0 THEN 'warning' WHEN waiting_review > 0 THEN 'attention' ELSE 'info' END AS severity FROM (
SELECT count(*) AS processed, count(*) FILTER (WHERE metadata_state = 'auto_approved') AS auto_ready,
 count(*) FILTER (WHERE metadata_state = 'human_review') AS waiting_review, count(*) FILTER (WHERE vision = 'failed') AS failed FROM b_list)""")
def evt_ingest_report(t: Tables):
    return log.ingest_report(asset_list(t).select("asset_id", (F.col("vision") != "failed").alias("ok"), F.col("metadata_state").alias("state")))


@query("evt_notify_shape", """
SELECT asset_id, substr(text, 1, 200) AS title, len(items[1:200]) AS items, array_to_string(items[1:200], '|') AS item_text
FROM (SELECT asset_id, text, list_filter(text_visible, lambda x: x <> '') AS items FROM b_vision) WHERE len(items) > 0""")
def evt_notify_shape(t: Tables):
    notices = t.b_vision.select("asset_id", F.col("text").alias("title"), F.filter("text_visible", lambda x: x != "").alias("items"))
    return log.shape_notices(notices).select("asset_id", "title", F.size("items").cast("bigint").alias("items"), joined(F.col("items"), "|").alias("item_text"))


_REQUESTS = "SELECT CAST(created_at AS DATE) AS batch, id AS pos, asset_id * 7 AS asset_id, 'retry_exhausted' AS kind, 'AI:' || (k - 52) AS key FROM b_events WHERE stage = 'AI' AND status = 'FAILED'"


@query("evt_notify_dedup", f"""
WITH req AS ({_REQUESTS}), refused AS (SELECT DISTINCT batch FROM req WHERE asset_id NOT IN (SELECT asset_id FROM b_catalog)),
sent AS (SELECT DISTINCT asset_id * 7 AS asset_id, {_J}(message, '$.kind') AS kind, {_J}(message, '$.key') AS key FROM b_events WHERE stage = 'NOTIFY' AND status = 'SENT'),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.asset_id, r.kind, r.key ORDER BY pos) AS rn FROM req r WHERE batch NOT IN (SELECT batch FROM refused))
SELECT req.batch, req.pos, req.asset_id, req.kind, req.key,
 CASE WHEN req.batch IN (SELECT batch FROM refused) THEN 'REFUSED' WHEN ranked.rn = 1 AND s.asset_id IS NULL THEN 'RECORDED' ELSE 'ALREADY_SENT' END AS outcome
FROM req LEFT JOIN ranked ON ranked.pos = req.pos LEFT JOIN sent s ON s.asset_id = req.asset_id AND s.kind = req.kind AND s.key = req.key""")
def evt_notify_dedup(t: Tables):
    req = t.b_events.filter("stage = 'AI' AND status = 'FAILED'").select(
        F.col("created_at").cast("date").alias("batch"), F.col("id").alias("pos"), (F.col("asset_id") * 7).alias("asset_id"),
        F.lit("retry_exhausted").alias("kind"), F.concat(F.lit("AI:"), (F.col("k") - 52).cast("string")).alias("key"))
    sent = log.sent_notices(t.b_events).withColumn("asset_id", F.col("asset_id") * 7)
    return log.dedupe_notices(req, sent, t.b_catalog)


@query("evt_idempotent_write", f"""
SELECT c.asset_id, CASE WHEN {_J}(enhancement_assessed_text, '$.fingerprint') = fp_enh THEN 'UNCHANGED' ELSE 'EVALUATED' END AS outcome,
 coalesce(enhancement_failed_id IS NOT NULL AND {_J}(enhancement_failed_text, '$.fingerprint') = fp_enh AND {_J}(enhancement_failed_text, '$.error_type') = 'TimeoutError'
  AND {_J}(enhancement_failed_text, '$.stage') = 'rules' AND NOT coalesce(greatest(enhancement_assessed_id, enhancement_advised_id) > enhancement_failed_id, FALSE), FALSE) AS failure_repeated
FROM b_catalog c LEFT JOIN b_slots USING (asset_id)""")
def evt_idempotent_write(t: Tables):
    names = ("enhancement_assessed", "enhancement_advised", "enhancement_failed")
    slots = log.latest_slots(t.b_events, names, names)
    last = slots.withColumn("last_fingerprint", F.col("enhancement_assessed.fingerprint"))
    rows = log.write_if_changed(t.b_catalog.select("asset_id", fingerprints.of_file(F.col("file_hash"))["fp_enh"].alias("fingerprint")), last)
    repeated = log.repeated_failure(F.lit("rules"), F.lit("TimeoutError"), F.col("fingerprint"), F.col("enhancement_failed"),
                                    F.col("enhancement_failed_id"), [F.col("enhancement_assessed_id"), F.col("enhancement_advised_id")])
    return rows.select("asset_id", "outcome", repeated.alias("failure_repeated"))


sql_view("b_collected", f"""
SELECT asset_id, platform, sha256, max(id) AS event_id, max_by(batch, id) AS batch, max_by(folder, id) AS folder FROM (
 SELECT asset_id, id, {_J}(message, '$.platform') AS platform, {_J}(message, '$.sha256') AS sha256, CAST({_J}(message, '$.batch') AS BIGINT) AS batch, {_J}(message, '$.folder') AS folder
 FROM b_events WHERE stage = 'OUTBOX' AND status = 'COLLECTED') GROUP BY asset_id, platform, sha256""")


@query("evt_collected", "SELECT * FROM b_collected")
def evt_collected(t: Tables):
    return log.collected(t.b_events)


@query("evt_attestation_current", f"""
SELECT c.asset_id, {_J}(attested_text, '$.kind') AS kind, attested_id AS event_id FROM b_catalog c JOIN b_slots USING (asset_id)
WHERE {_J}(attested_text, '$.kind') IN ('not_identifiable', 'release_on_file') AND {_J}(attested_text, '$.file_hash') = file_hash""")
def evt_attestation_current(t: Tables):
    return log.attestation(catalog_slots(t, "attested"))


# advice of the binding: confident advice is bound to the wrong assessment, the rest to the newest one
def enhancement_slots(t: Tables):
    rows = catalog_slots(t, "enhancement_assessed", "enhancement_advised")
    target = F.when(F.col("enhancement_advised.advice.confidence") < 0.88, F.col("enhancement_assessed_id")) \
        .otherwise(F.col("enhancement_advised.assessment_event_id"))
    return rows.withColumn("enhancement_advised", F.when(F.col("enhancement_advised").isNotNull(),
                                                         F.col("enhancement_advised").withField("assessment_event_id", target)))


sql_view("b_enhancement", f"""
SELECT asset_id, has AS assessed, has AND fp IS DISTINCT FROM fp_enh AS stale,
 CASE WHEN has THEN coalesce(decision, CASE WHEN applies THEN advice_decision END, CASE WHEN disputed THEN 'disputed' END) END AS decision,
 CASE WHEN NOT has THEN NULL WHEN decision IS NOT NULL THEN 'rules' WHEN applies THEN 'advisor' END AS decided_by,
 CASE WHEN NOT has THEN NULL WHEN decision IS NULL AND applies THEN list_transform(CAST(advice_reasons AS JSON[]), lambda r: json_extract_string(r, '$.reason'))
   ELSE list_transform(CAST(reasons AS JSON[]), lambda r: json_extract_string(r, '$.reason')) END AS reasons,
 applies, notes
FROM (SELECT c.asset_id, fp_enh, enhancement_assessed_id IS NOT NULL AS has, {_J}(enhancement_assessed_text, '$.fingerprint') AS fp,
  {_J}(enhancement_assessed_text, '$.decision') AS decision, {_J}(enhancement_assessed_text, '$.disputed') = 'true' AS disputed,
  json_extract(enhancement_assessed_text, '$.reasons') AS reasons, json_extract(enhancement_advised_text, '$.advice.reasons') AS advice_reasons,
  json_extract(enhancement_assessed_text, '$.notes') AS notes, {_J}(enhancement_advised_text, '$.advice.decision') AS advice_decision,
  coalesce(enhancement_assessed_id IS NOT NULL AND CAST({_J}(enhancement_advised_text, '$.advice.confidence') AS DOUBLE) < 0.88, FALSE) AS applies
 FROM b_catalog c LEFT JOIN b_slots USING (asset_id))""")


@query("evt_advice_for", "SELECT asset_id, applies, decision FROM b_enhancement WHERE assessed")
def evt_advice_for(t: Tables):
    rows = enhancement_slots(t).filter(F.col("enhancement_assessed_id").isNotNull())
    return rows.select("asset_id", log.advice_applies().alias("applies"), log.effective_decision().alias("decision"))


@query("evt_enhancement_summary", "SELECT asset_id, assessed, stale, decision, decided_by, array_to_string(reasons, ',') AS reasons FROM b_enhancement")
def evt_enhancement_summary(t: Tables):
    return log.enhancement_summary(enhancement_slots(t)).withColumn("reasons", joined(F.col("reasons")))


@query("evt_normalize_summary", f"""
SELECT c.asset_id, normalize_evaluated_id IS NOT NULL AS evaluated,
 normalize_evaluated_id IS NOT NULL AND {_J}(normalize_evaluated_text, '$.fingerprint') IS DISTINCT FROM fp_facts AS stale,
 CASE WHEN normalize_failed_id > coalesce(greatest(normalize_evaluated_id, normalize_passed_id), -1) THEN {_J}(normalize_failed_text, '$.error_type') END AS failed,
 {_J}(normalize_evaluated_text, '$.facts.container') AS container, {_J}(normalize_evaluated_text, '$.facts.color_kind') AS color_kind,
 CAST({_J}(normalize_evaluated_text, '$.facts.motion_video') AS BOOLEAN) AS motion_video, {_J}(normalize_passed_text, '$.representation') AS representation,
 normalize_passed_id IS NOT NULL AND {_J}(normalize_passed_text, '$.fingerprint') IS DISTINCT FROM fp_rep AS representation_stale
FROM b_catalog c LEFT JOIN b_slots USING (asset_id)""")
def evt_normalize_summary(t: Tables):
    return log.normalize_summary(catalog_slots(t, "normalize_evaluated", "normalize_passed", "normalize_failed"))
