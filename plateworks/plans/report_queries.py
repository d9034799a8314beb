"""Queries of statistics, lists, queue positions and retry-free reports over the state table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions.arrays import joined
from plateworks.operators import creative, log, paging, ranking, statistics
from plateworks.operators.exporting import padded
from plateworks.plans.bindings import Tables, sql_view
from plateworks.plans.event_queries import enhancement_slots
from plateworks.plans.registry import query
from plateworks.plans.source_queries import exports
from plateworks.plans.stage_queries import _codes, state_table

_J = "json_extract_string"


def _flat(t: Tables):
    """State dimensions straight from catalogue and log: one log scan, no derivation of stages needed."""
    from plateworks.operators import stages
    rows = stages.with_documents(enhancement_slots(t))
    ids = log.latest_slots(t.b_events, ("ai_failed", "ai_passed"))
    rows = stages.pipeline_summary(rows.join(ids, "asset_id", "left"))
    summary = log.enhancement_summary(rows).select("asset_id", "decision", "decided_by")
    return rows.select("asset_id", "qc", "vision", "metadata_state", "completeness").join(summary, "asset_id")


@query("agg_stats_states", """
SELECT dimension, key, count(*) AS n FROM (
 SELECT unnest(['qc', 'enhancement', 'decided_by', 'vision', 'metadata_state', 'completeness']) AS dimension,
  unnest([CASE WHEN coalesce(qc_result, '{}') = '{}' THEN 'pending' WHEN json_extract_string(qc_result, '$.passed') = 'true' THEN 'passed' ELSE 'failed' END, coalesce(e.decision, 'not_assessed'), e.decided_by, l.vision, l.metadata_state, l.completeness]) AS key
 FROM b_catalog c JOIN b_enhancement e USING (asset_id) JOIN b_list l USING (asset_id)) WHERE key IS NOT NULL GROUP BY ALL""")
def agg_stats_states(t: Tables):
    return statistics.state_statistics(_flat(t))


@query("agg_stats_codes", "SELECT dimension, key, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, unnest({e}) AS key FROM b_state0 JOIN b_pipeline p USING (asset_id)" for d, e in (
    ("qc_error", "list_transform(CAST(json_extract(qc_result, '$.errors') AS VARCHAR[]), lambda x: split_part(x, ':', 1))"), ("qc_warning", "CAST(json_extract(qc_result, '$.warnings') AS VARCHAR[])"),
    ("enhancement_note", _codes("enhancement_assessed_text", "$.notes")), ("validation_error", _codes("b_state0.metadata_json", "$.validation.errors")), ("validation_warning", _codes("b_state0.metadata_json", "$.validation.warnings")),
    ("review_reason", "p.review_reasons"), ("gate_note", _codes("b_state0.metadata_json", "$.review_gate.notes")))) + ") GROUP BY ALL")
def agg_stats_codes(t: Tables):
    return statistics.code_statistics(state_table(t))


@query("agg_stats_failures", f"""
SELECT stage, CASE WHEN stage = 'ENHANCEMENT' THEN {_J}(message, '$.stage') || ':' ELSE '' END || coalesce({_J}(message, '$.error_type'), '?') AS error, count(*) AS n
FROM b_events WHERE status = 'FAILED' AND stage IN ('AI', 'METADATA_AI', 'ENHANCEMENT') GROUP BY ALL""")
def agg_stats_failures(t: Tables):
    return statistics.failure_statistics(t.b_events)


@query("agg_durations", f"""
SELECT stage, count(v) AS n, round(median(v), 1) AS median_s, round(max(v), 1) AS max_s FROM (SELECT stage, CASE WHEN json_valid(message) THEN CAST({_J}(message, '$.duration_s') AS DOUBLE) END AS v
FROM b_events WHERE status = 'PASSED' AND stage IN ('AI', 'METADATA_AI')) WHERE v IS NOT NULL GROUP BY stage""")
def agg_durations(t: Tables):
    return statistics.durations(t.b_events)


@query("agg_readiness", "WITH r AS (SELECT readiness_evaluated_text AS m, json_extract_string(readiness_evaluated_text, '$.fingerprint') IS DISTINCT FROM fp_readiness AS stale FROM b_pipeline) SELECT dimension, key, count(*) AS n FROM ("
       + " UNION ALL ".join(f"""SELECT 'status' AS dimension, '{p}:' || CASE WHEN m IS NULL THEN 'not_evaluated' WHEN stale THEN 'stale' ELSE {_J}(m, '$.platforms.{p}.status') END AS key FROM r
 UNION ALL SELECT 'check', '{p}:' || {_J}(c, '$.code') || ':' || {_J}(c, '$.level') FROM (SELECT unnest(CAST(json_extract(m, '$.platforms.{p}.checks') AS JSON[])) AS c FROM r WHERE m IS NOT NULL AND NOT stale)
 UNION ALL SELECT 'category', '{p}:' || c FROM (SELECT unnest(CAST(json_extract(m, '$.platforms.{p}.categories') AS VARCHAR[])) AS c FROM r WHERE m IS NOT NULL AND NOT stale)""" for p in fixed.PLATFORMS) + ") GROUP BY ALL")
def agg_readiness(t: Tables):
    return statistics.readiness_statistics(state_table(t))


_POINTS = f"""CASE {_J}(m, '$.features.composition') WHEN 'good' THEN 35 WHEN 'acceptable' THEN 20 ELSE 5 END + CASE {_J}(m, '$.features.demand') WHEN 'high' THEN 30 WHEN 'medium' THEN 18 ELSE 5 END
 + CASE {_J}(m, '$.features.uniqueness') WHEN 'high' THEN 25 WHEN 'medium' THEN 15 ELSE 5 END + least(2 * json_array_length(m, '$.features.commercial_use_cases'), 10)"""
sql_view("b_creative", f"""
SELECT asset_id, m, CAST({_POINTS} AS BIGINT) AS score, {_J}(m, '$.features.recommendation') AS recommendation, {_J}(m, '$.profile.name') AS profile FROM (SELECT asset_id, creative_advised_text AS m, creative_advised_id FROM b_slots) WHERE m IS NOT NULL""")


@query("agg_creative", """
SELECT dimension, key, count(*) AS n FROM (SELECT unnest(['recommendation', 'potential']) AS dimension, unnest([coalesce(recommendation, 'not_reviewed'), CASE WHEN score IS NULL THEN 'not_reviewed' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END]) AS key
FROM b_catalog LEFT JOIN b_creative USING (asset_id)) GROUP BY ALL""")
def agg_creative(t: Tables):
    slots = log.latest_slots(t.b_events, ("creative_advised",), ("creative_advised",))
    rows = creative.summary(t.b_catalog.select("asset_id").join(slots, "asset_id", "left"))
    return statistics.frequencies(rows, recommendation=F.coalesce("recommendation", F.lit("not_reviewed")), potential=F.coalesce("potential", F.lit("not_reviewed")))


@query("agg_per_asset", """
SELECT p.asset_id, p.filename, p.qc, coalesce(e.decision, 'not_assessed') AS enhancement, p.vision, p.metadata_state, array_to_string(p.review_reasons, ',') AS review_reasons, c.score, c.recommendation
FROM b_pipeline p JOIN b_enhancement e USING (asset_id) LEFT JOIN b_creative c USING (asset_id)""")
def agg_per_asset(t: Tables):
    rows = state_table(t)
    scored = creative.summary(rows).select("asset_id", "score", "recommendation")
    return rows.select("asset_id", "filename", "qc", F.coalesce("enhancement_decision", F.lit("not_assessed")).alias("enhancement"), "vision", "metadata_state",
                       joined(F.col("review_reasons")).alias("review_reasons")).join(scored, "asset_id")


@query("agg_review_queue", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS state_{s}" for s in fixed.ASSET_STATES) + """, count(*) FILTER (WHERE metadata_approved) AS approved,
 count(*) FILTER (WHERE state IN ('platform_ready', 'publication_approved', 'ready_for_export')) AS platform_ready_total, count(*) FILTER (WHERE state IN ('publication_approved', 'ready_for_export')) AS publication_approved_total, """
       + ", ".join(f"count(*) FILTER (WHERE metadata_state = '{s}') AS metadata_{s}" for s in fixed.METADATA_STATES) + " FROM b_pipeline")
def agg_review_queue(t: Tables):
    return statistics.review_queue(state_table(t))


@query("agg_problem_counts", """
SELECT key, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(problems, lambda c: CASE WHEN starts_with(c, 'STALE:') THEN split_part(c, ':', 1) || ':' || split_part(c, ':', 2) ELSE split_part(c, ':', 1) END))) AS key FROM b_pipeline) GROUP BY key""")
def agg_problem_counts(t: Tables):
    return statistics.problem_counts(state_table(t))


def _approved_exports(t: Tables):
    files = exports(t)
    approved = state_table(t).filter("state IN ('publication_approved', 'ready_for_export')").select("asset_id", F.explode("approved_for").alias("platform"))
    return files.join(approved, ["asset_id", "platform"])


@query("agg_ui_counters", """
SELECT *, attention = 0 AS can_collect FROM (SELECT count(*) FILTER (WHERE ok AND coalesce(uncollected, TRUE)) AS approved, count(*) FILTER (WHERE ok) AS approved_total, count(*) FILTER (WHERE state = 'human_review') AS attention,
 count(*) FILTER (WHERE state = 'blocked') AS blocked, count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) FILTER (WHERE state IN ('source_invalid', 'stale')) AS source, count(*) AS total
FROM (SELECT asset_id, state, state IN ('publication_approved', 'ready_for_export') AS ok FROM b_pipeline) LEFT JOIN (
 SELECT e.asset_id, bool_or(c.asset_id IS NULL OR e.status <> 'ready_for_export') AS uncollected FROM b_exports e LEFT JOIN b_collected c ON c.asset_id = e.asset_id AND c.platform = e.platform AND c.sha256 = e.sha256
 WHERE approved AND e.state IN ('publication_approved', 'ready_for_export') GROUP BY 1) USING (asset_id))""")
def agg_ui_counters(t: Tables):
    return statistics.counters(state_table(t), _approved_exports(t), log.collected(t.b_events))


_PROFILE = (("container", "container"), ("format", "format"), ("color_mode", "color_mode"), ("bit_depth", "CAST(bit_depth AS VARCHAR)"), ("alpha", "CAST(has_alpha AS VARCHAR)"), ("color_profile", "color_kind"), ("color_source", "color_source"),
            ("hdr", "coalesce(hdr, 'None')"), ("orientation", "CAST(orientation AS VARCHAR)"), ("frames", "frames_readable || '/' || frames_declared"), ("jpeg_quality", "CAST(CAST(floor(jpeg_quality / 10.0) * 10 AS BIGINT) AS VARCHAR)"),
            ("megapixels", "CASE WHEN width * height / 1000000.0 < 1 THEN '<1' WHEN width * height / 1000000.0 < 4 THEN '1-4' WHEN width * height / 1000000.0 < 12 THEN '4-12' ELSE '12+' END"), ("software", "split_part(software, ' ', 1)"),
            ("motion_video", "CASE WHEN motion_video THEN 'yes' END"), ("c2pa", "CASE WHEN c2pa THEN 'yes' END"), ("changed", "CASE WHEN NOT unchanged THEN 'yes' END"))


@query("agg_facts_profile", "SELECT dimension, key, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"'{d}'" for d, _ in _PROFILE) + "]) AS dimension, unnest([" + ", ".join(e for _, e in _PROFILE) + "]) AS key FROM b_facts) GROUP BY ALL")
def agg_facts_profile(t: Tables):
    return statistics.facts_profile(t.b_facts)


_FOLDERS = "SELECT CASE l_returnflag WHEN 'A' THEN 'adobe' ELSE 'shutterstock' END AS platform, CASE WHEN l_linestatus = 'O' THEN '.' ELSE '' END || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(l_suppkey AS VARCHAR))) AS INT), '0') || '_2024-01-0' || l_linenumber || CASE WHEN l_linestatus = 'O' THEN '.tmp' ELSE '' END AS folder FROM b_batches"


@query("agg_next_batch", f"""
SELECT platform, coalesce(max(batch), 0) + 1 AS next_batch FROM (SELECT platform, batch FROM b_collected UNION ALL
 SELECT platform, CAST(nullif(regexp_extract(regexp_replace(folder, '^\\.|\\.tmp$', '', 'g'), '^(\\d{{3,}})_\\d{{4}}-\\d{{2}}-\\d{{2}}$', 1), '') AS BIGINT) FROM ({_FOLDERS.replace('b_batches', '(SELECT *, batch AS l_linenumber FROM b_batches)')})) GROUP BY platform""")
def agg_next_batch(t: Tables):
    open_ = F.col("l_linestatus") == "O"
    folder = F.concat(F.when(open_, ".").otherwise(""), padded(F.col("l_suppkey")), F.lit("_2024-01-0"), F.col("batch").cast("string"), F.when(open_, ".tmp").otherwise(""))
    return statistics.next_batch(log.collected(t.b_events), t.b_batches.select("platform", folder.alias("folder")))


_RANK = "CASE state " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(fixed.ASSET_STATES)) + " END"


@query("agg_digest", f"""
SELECT asset_id, filename, state, array_to_string(problems, ',') AS problems, CASE WHEN (SELECT bool_or(state IN ('human_review', 'blocked', 'error', 'source_invalid') OR len(problems) > 0) FROM b_pipeline) THEN 'attention' ELSE 'info' END AS severity
FROM b_pipeline WHERE len(problems) > 0 ORDER BY {_RANK}, asset_id LIMIT 10""")
def agg_digest(t: Tables):
    return statistics.digest(state_table(t))


@query("agg_event_invariant", """
SELECT count(*) AS assets, count(*) FILTER (WHERE state IN ('publication_approved', 'ready_for_export')) AS approved,
 count(*) FILTER (WHERE state IN ('publication_approved', 'ready_for_export') AND (publication_status <> 'current' OR len(approved_for) = 0)) AS violations FROM b_pipeline""")
def agg_event_invariant(t: Tables):
    return statistics.invariant_violations(state_table(t))


@query("agg_state_transitions", f"""
WITH g AS (SELECT asset_id, id, {_J}(message, '$.decision') AS decision, {_J}(message, '$.state_before') AS state_before FROM b_events WHERE stage = 'METADATA' AND status = 'GATED'),
 d AS (SELECT asset_id, decision, lag(decision) OVER (PARTITION BY asset_id ORDER BY id) AS previous FROM g)
SELECT state_before, decision, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT NULL, 'changed_assets', count(DISTINCT asset_id) FROM d WHERE previous <> decision""")
def agg_state_transitions(t: Tables):
    return statistics.gate_transitions(t.b_events)


@query("agg_label_medians", """
SELECT quality, toxic, count(*) AS n, median(score) AS median_score, count(*) FILTER (WHERE recommendation = 'proceed') AS proceed, count(*) FILTER (WHERE recommendation = 'attention') AS attention, count(*) FILTER (WHERE recommendation = 'skip_suggested') AS skip_suggested
FROM b_creative JOIN labels ON doc_id = asset_id GROUP BY ALL""")
def agg_label_medians(t: Tables):
    slots = log.latest_slots(t.b_events, ("creative_advised",), ("creative_advised",))
    return statistics.label_medians(creative.summary(slots).filter("score IS NOT NULL"), t.labels.withColumnRenamed("doc_id", "asset_id"), "quality", "toxic")


# --- lists -----------------------------------------------------------------------------------

@query("lim_asset_list", """
SELECT asset_id, filename, state, (SELECT count(*) FROM b_pipeline WHERE qc = 'passed' AND vision = 'done' AND metadata_approved) AS total FROM b_pipeline WHERE qc = 'passed' AND vision = 'done' AND metadata_approved ORDER BY asset_id LIMIT 100 OFFSET 20""")
def lim_asset_list(t: Tables):
    rows = paging.matching(state_table(t), qc="passed", vision="done", metadata_state=None, state=None, metadata_approved=True)
    return paging.page(rows.select("asset_id", "filename", "state"), 100, 20).select("asset_id", "filename", "state", "total")


@query("lim_queue_page", """
SELECT asset_id, array_to_string(review_reasons, ',') AS reasons, (SELECT count(*) FROM b_pipeline WHERE state = 'human_review') AS total FROM b_pipeline WHERE state = 'human_review' ORDER BY asset_id LIMIT 50""")
def lim_queue_page(t: Tables):
    queue = paging.matching(state_table(t), state="human_review").select("asset_id", joined(F.col("review_reasons")).alias("reasons"))
    return paging.page(queue, 50).select("asset_id", "reasons", "total")


@query("lim_problem_order", f"SELECT asset_id, filename, state, CAST({_RANK} AS BIGINT) AS rank, array_to_string(problems, ',') AS problems FROM b_pipeline WHERE len(problems) > 0")
def lim_problem_order(t: Tables):
    return statistics.problem_assets(state_table(t)).withColumn("rank", F.col("rank").cast("bigint"))


@query("win_review_neighbour", """
SELECT asset_id, position, total, coalesce(lead(asset_id) OVER (ORDER BY asset_id), first_value(asset_id) OVER (ORDER BY asset_id)) AS next_id
FROM (SELECT asset_id, row_number() OVER (ORDER BY asset_id) AS position, count(*) OVER () AS total FROM b_pipeline WHERE metadata_state = 'human_review')""")
def win_review_neighbour(t: Tables):
    queue = paging.matching(state_table(t), metadata_state="human_review").select("asset_id")
    return ranking.with_next(queue, "asset_id").select("asset_id", "position", "total", "next_id")
