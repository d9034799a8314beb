"""Queries of stage statuses, state, problems, actions, and of recompute planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import fingerprints as fp
from plateworks.functions.arrays import joined, n
from plateworks.operators import log, recompute, stages
from plateworks.plans.bindings import IDENTITIES, Tables, sql_view
from plateworks.plans.registry import query
from plateworks.session import materialize

PROMPT = "creative-v2"
_J = "json_extract_string"


def inputs(t: Tables):
    """Stage inputs of the binding: metadata names the newest vision event except for one source."""
    rows = stages.stage_inputs(t.b_catalog, t.b_events, t.b_files)
    event = F.when(F.col("source") == "src14", F.col("ai_passed_id") - 1).otherwise(F.col("ai_passed_id"))
    named = F.struct(F.struct(event.alias("event_id")).alias("vision"), F.col("md.sources.builder_version").alias("builder_version"))
    advised = F.col("enhancement_advised")
    target = F.when(advised["advice"]["confidence"] < 0.88, F.col("enhancement_assessed_id")).otherwise(advised["assessment_event_id"])
    return rows.withColumn("md", F.when(F.col("md").isNotNull(), F.col("md").withField("sources", named))) \
        .withColumn("enhancement_advised", F.when(advised.isNotNull(), advised.withField("assessment_event_id", target)))


def own(t: Tables, verify: bool = False):
    return stages.own_statuses(inputs(t), IDENTITIES, PROMPT, verify)


def derived(t: Tables, verify: bool = False):
    return stages.derive(inputs(t), IDENTITIES, PROMPT, verify)


#: What reports read of the derived state. Every stored column is copied through some thirty projections and written for every asset, so
#: the table holds no others; a report that needs one more names it here.
REPORTED = (
    "asset_id", "filename", "source_path", "file_hash", "file_size", "source_status", *[f"{s}_{part}" for s in stages.STAGES for part in ("status", "reason")], "metadata_own_reason",
    "export_status", "export_reason", "export_ready", "adobe_file", "shutterstock_file", "state", "reasons", "reprocess_from", "problems", "actions", "ready_for", "approved_for",
    "enhancement_decision", "fp_readiness", "ai_passed_id", "export_adobe_id", "export_shutterstock_id", "export_failed_adobe_id", "export_failed_shutterstock_id",
    "export_adobe", "export_shutterstock", "export_failed_adobe", "export_failed_shutterstock", "readiness_evaluated",
    "qc", "vision", "metadata_state", "completeness", "metadata_approved", "review_reasons")
#: Of some documents reports read a few members.
REPORTED_MEMBERS = {
    "qc_doc": ("errors", "warnings"), "ai_passed": ("provider", "model", "prompt_version"), "creative_advised": ("features", "profile"), "enhancement_assessed": ("notes",),
    "publication_evaluated": ("inputs",), "md": ("state", "fields", "edited_fields", "review", "grounding", "validation", "review_gate")}
_STATE_TABLES: dict[tuple, object] = {}


def _reported(rows):
    """A document that is null stays null."""
    return rows.select(*REPORTED, *[F.when(F.col(c).isNotNull(), F.struct(*[F.col(c)[m].alias(m) for m in members])).alias(c) for c, members in REPORTED_MEMBERS.items()])


def state_table(t: Tables, verify: bool = False):
    """The derived state as a written table, built once per application, data folder and version of its files: every report
    on states reads it with its filters pushed to the files instead of deriving the catalogue again."""
    key = (t.spark.sparkContext.applicationId, t.folder, verify, t.version("b_events"), t.version("b_catalog"))
    if key not in _STATE_TABLES:
        rows = stages.pipeline_summary(derived(t, verify))
        _STATE_TABLES[key] = materialize(_reported(rows), "state")
    return _STATE_TABLES[key]


def _list(text: str, path: str) -> str:
    return f"coalesce(CAST(json_extract({text}, '{path}') AS VARCHAR[]), [])"


def _codes(text: str, path: str) -> str:
    return f"coalesce(list_transform(CAST(json_extract({text}, '{path}') AS JSON[]), lambda r: json_extract_string(r, '$.code')), [])"


sql_view("b_inputs", f"""
SELECT c.*, s.* EXCLUDE (asset_id), v.changed AS log_changed, f.size_bytes AS source_actual_size, f.sha256 AS source_actual_hash,
 a.size_bytes AS adobe_actual_size, a.sha256 AS adobe_actual_hash, x.size_bytes AS shutterstock_actual_size, x.sha256 AS shutterstock_actual_hash,
 {_J}(metadata_json, '$.state') AS md_state, {_J}(metadata_json, '$.completeness') AS md_completeness,
 CASE WHEN c.source = 'src14' THEN ai_passed_id - 1 ELSE ai_passed_id END AS md_vision_id,
 CASE WHEN json_valid(ai_passed_text) THEN ai_passed_text END AS ai_doc
FROM b_catalog c LEFT JOIN b_slots s USING (asset_id) LEFT JOIN b_verdict v USING (asset_id) LEFT JOIN b_files f ON f.path = c.source_path
LEFT JOIN b_files a ON a.path = {_J}(s.export_adobe_text, '$.path') LEFT JOIN b_files x ON x.path = {_J}(s.export_shutterstock_text, '$.path')""")


def _newer(a: str, b: str) -> str:
    return f"({a} IS NOT NULL AND ({b} IS NULL OR {a} > {b}))"


def _cases(name: str, rules: list[tuple[str, str, str | None]], default: tuple[str, str | None]) -> str:
    def lit(v):
        return "NULL" if v is None else v if v.startswith("(") else f"'{v}'"
    status = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in rules) + f" ELSE '{default[0]}' END AS {name}_status"
    reason = "CASE " + " ".join(f"WHEN {c} THEN {lit(r)}" for c, _, r in rules) + f" ELSE {lit(default[1])} END AS {name}_reason"
    return status + ", " + reason


def _quoted(text: str) -> str:
    return f"'{text}'"


def _member(expr: str) -> str:
    """JSON string of a SQL expression, null for null."""
    return f"'\"' || {expr} || '\"'"


def _diff(document: str, current: dict[str, str]) -> str:
    """Sorted members whose JSON text differs; a null member is a missing one. The binding writes nested members sorted but for the image."""
    names = "[" + ", ".join(f"'{k}'" for k in sorted(current)) + "]"
    values = " ".join(f"WHEN '{k}' THEN {v}" for k, v in current.items())
    stored = f"nullif(CAST(json_extract({document}, '$.inputs.' || k) AS VARCHAR), 'null')"
    image = "regexp_replace(%s, '^\\{\"variant\":\"(\\w+)\",\"quality\":(\\d+),\"format\":\"(\\w+)\"\\}$', '{\"format\":\"\\3\",\"quality\":\\2,\"variant\":\"\\1\"}')" % stored
    return f"list_filter({names}, lambda k: {image} IS DISTINCT FROM CASE k {values} END)"


def _own_sql(verify: bool) -> str:
    proof = "source_actual_hash IS DISTINCT FROM file_hash" if verify else "coalesce(log_changed, FALSE)"
    nf, np, ne = "normalize_failed_text", "normalize_passed_text", "normalize_evaluated_text"
    nfail = _newer("normalize_failed_id", "greatest(normalize_evaluated_id, normalize_passed_id)")
    gate = "md_state IN ('draft', 'auto_approved', 'human_review')"
    approved = "coalesce(md_state IN ('auto_approved', 'approved'), FALSE)"
    first = ", ".join([
        _cases("source", [("source_actual_size IS NULL", "missing", "SOURCE_MISSING"), ("file_size > 0 AND file_size <> source_actual_size", "changed", "SOURCE_CHANGED"),
                          (proof, "changed", "SOURCE_CHANGED")], ("ok", None)),
        _cases("normalize", [
            (f"{nfail} AND {_J}({nf}, '$.fingerprint') IS NULL", "stale", "NO_FINGERPRINT"),
            (f"{nfail} AND {_J}({nf}, '$.error_type') IN ('SOURCE_MISSING', 'SOURCE_CHANGED')", "stale", "SOURCE_RECHECK"),
            (f"{nfail} AND {_J}({nf}, '$.fingerprint') <> CASE WHEN {_J}({nf}, '$.stage') = 'engine' THEN fp_rep ELSE fp_facts END", "stale", "FINGERPRINT_CHANGED"),
            (nfail, "failed", f"('NORMALIZE_FAILED:' || coalesce({_J}({nf}, '$.error_type'), 'None'))"),
            ("normalize_passed_id IS NULL", "missing", "NOT_NORMALIZED"),
            (f"{_J}({np}, '$.fingerprint') IS DISTINCT FROM fp_rep OR {_J}({ne}, '$.fingerprint') IS DISTINCT FROM fp_facts", "stale", "FINGERPRINT_CHANGED")], ("current", None)),
        _cases("view", [(_newer("view_failed_id", "normalize_passed_id"), "failed", f"('VIEW_FAILED:' || {_J}(view_failed_text, '$.error_type'))"),
                        ("normalize_passed_id IS NULL", "missing", "NOT_NORMALIZED")], ("current", None)),
        _cases("qc", [("(qc_result IS NULL OR qc_result = '{}')", "missing", "NOT_CHECKED"), (f"{_J}(qc_result, '$.input_fingerprint') IS NULL", "stale", "NO_FINGERPRINT"),
                      (f"{_J}(qc_result, '$.input_fingerprint') <> fp_qc", "stale", "FINGERPRINT_CHANGED"), (f"{_J}(qc_result, '$.passed') <> 'true'", "failed", "QC_FAILED")], ("current", None)),
        _cases("vision", [(f"ai_result IS NULL AND {_newer('ai_failed_id', 'ai_passed_id')}", "failed", "VISION_FAILED"), ("ai_result IS NULL", "missing", "NOT_ANALYZED"),
                          (f"{_J}(ai_doc, '$.input_fingerprint') IS NULL", "stale", "NO_FINGERPRINT"), (f"{_J}(ai_doc, '$.provider') IS DISTINCT FROM 'local'", "stale", "UNKNOWN_PROVIDER"),
                          (f"{_J}(ai_doc, '$.input_fingerprint') <> fp_vision", "stale", "FINGERPRINT_CHANGED")], ("current", None)),
        _cases("metadata", [("md_state IS NULL", "missing", "NO_METADATA"), ("md_state = 'rejected'", "current", None),
                            ("ai_passed_id IS NULL OR md_vision_id IS DISTINCT FROM ai_passed_id", "stale", "VISION_CHANGED"),
                            (f"{gate} AND {_J}(metadata_json, '$.sources.builder_version') <> 'metadata-v1'", "stale", "BUILDER_CHANGED"),
                            (f"{gate} AND md_state <> 'draft' AND {_J}(metadata_json, '$.review_gate.policy_version') <> 'gate-v1.3'", "stale", "GATE_POLICY_CHANGED")], ("current", None)),
        _cases("readiness", [(f"NOT {approved}", "not_applicable", "METADATA_NOT_APPROVED"), (_newer("readiness_failed_id", "readiness_evaluated_id"), "failed", "READINESS_FAILED"),
                             ("readiness_evaluated_id IS NULL", "missing", "NOT_EVALUATED"), (f"{_J}(readiness_evaluated_text, '$.fingerprint') IS DISTINCT FROM fp_readiness", "stale", "FINGERPRINT_CHANGED"),
                             (f"len({_list('readiness_evaluated_text', '$.ready_for')}) = 0", "current", "READINESS_BLOCKED")], ("current", None)),
        _cases("enhancement", [("enhancement_assessed_id IS NULL", "missing", "NOT_ASSESSED"),
                               (f"{_J}(enhancement_assessed_text, '$.fingerprint') IS DISTINCT FROM fp_enh", "stale", "FINGERPRINT_CHANGED")], ("current", None)),
        f"CASE WHEN {approved} AND {_J}(readiness_evaluated_text, '$.fingerprint') = fp_readiness THEN {_list('readiness_evaluated_text', '$.ready_for')} ELSE [] END AS ready_for",
        f"CASE WHEN {approved} AND {_J}(readiness_evaluated_text, '$.fingerprint') = fp_readiness THEN list_sort(list_distinct(list_transform(list_filter(list_concat("
        "coalesce(CAST(json_extract(readiness_evaluated_text, '$.platforms.adobe.checks') AS JSON[]), []), coalesce(CAST(json_extract(readiness_evaluated_text, '$.platforms.shutterstock.checks') AS JSON[]), [])), "
        "lambda c: json_extract_string(c, '$.level') = 'blocker'), lambda c: json_extract_string(c, '$.code')))) ELSE [] END AS blockers",
        f"{_diff('qc_result', dict(rules=_quoted(fp.constant_text(fixed.QC_RULES)), view=_member('fp_view')))} AS qc_diff",
        f"{_diff('ai_doc', dict(provider=_quoted('\"local\"'), view=_member('fp_view'), **{k: _quoted(fp.constant_text(v)) for k, v in IDENTITIES['local'].items()}))} AS vision_diff",
    ])
    profile = f"coalesce({_J}(creative_advised_text, '$.profile.name'), 'industrial_stock')"
    not_sold = [("readiness_status = 'not_applicable'", "not_applicable", "METADATA_NOT_APPROVED"), ("readiness_status = 'missing'", "not_applicable", "READINESS_NOT_EVALUATED"),
                ("readiness_status = 'current' AND readiness_reason = 'READINESS_BLOCKED'", "not_applicable", "READINESS_BLOCKED")]
    creative = _cases("creative_review", [*not_sold, ("creative_advised_id IS NULL", "missing", "NOT_REVIEWED"),
        (f"{profile} NOT IN ('industrial_stock', 'architecture_stock', 'nature_stock')", "stale", "UNKNOWN_PROFILE"),
        (f"{_J}(creative_advised_text, '$.fingerprint') IS DISTINCT FROM CASE {_J}(creative_advised_text, '$.prompt_version') WHEN 'creative-v1' THEN fp_creative1 ELSE fp_creative END", "stale", "FINGERPRINT_CHANGED"),
        (f"{_J}(creative_advised_text, '$.prompt_version') IS DISTINCT FROM '{PROMPT}'", "stale", "PROMPT_CHANGED")], ("current", None))
    profiles = fp.constant_text({p["platform"]: p["version"] for p in fixed.PLATFORM_PROFILES})
    advice = ("'{\"current\":' || CASE WHEN creative_review_status = 'current' THEN 'true' ELSE 'false' END || ',\"recommendation\":' || coalesce(CASE WHEN creative_review_status = 'current' "
              "THEN '\"' || json_extract_string(creative_advised_text, '$.features.recommendation') || '\"' END, 'null') || '}'")
    ready = _member("json_extract_string(readiness_evaluated_text, '$.fingerprint')")
    diff = _diff("publication_evaluated_text", {"advice": advice, "policy_version": _quoted('"publication-v1"'), "profiles": _quoted(profiles), "readiness_fingerprint": ready, "source_sha256": _member("file_hash")})
    text = f"""'{{"advice":' || {advice} || ',"policy_version":"publication-v1","profiles":{profiles},"readiness_fingerprint":' || coalesce({ready}, 'null') || ',"source_sha256":"' || file_hash || '"}}'"""
    fresh = f"({_J}(publication_evaluated_text, '$.fingerprint') IS NOT DISTINCT FROM fp_publication)"
    publication = _cases("publication", [*not_sold, ("publication_evaluated_id IS NULL", "missing", "NOT_EVALUATED"), (f"NOT {fresh}", "stale", "FINGERPRINT_CHANGED")], ("current", None))
    return f"""
SELECT *, {publication}, CASE WHEN readiness_status NOT IN ('not_applicable', 'missing') AND NOT (readiness_status = 'current' AND coalesce(readiness_reason, '') = 'READINESS_BLOCKED')
   AND publication_evaluated_id IS NOT NULL AND {fresh} THEN {_list('publication_evaluated_text', '$.approved_for')} ELSE [] END AS approved_for
FROM (SELECT *, {diff} AS pub_diff, 'sha256:' || sha256({text}) AS fp_publication FROM (SELECT *, {creative} FROM (
  SELECT * REPLACE (CASE WHEN source_status <> 'ok' AND normalize_status <> 'missing' THEN 'stale' ELSE normalize_status END AS normalize_status,
    CASE WHEN source_status <> 'ok' AND normalize_status <> 'missing' THEN 'UPSTREAM_STALE:source' ELSE normalize_reason END AS normalize_reason)
  FROM (SELECT *, {first} FROM b_inputs))))"""


def _propagated_sql(own_view: str) -> str:
    body = f"SELECT *, CAST(NULL AS VARCHAR) AS normalize_own_status, CAST(NULL AS VARCHAR) AS normalize_own_reason FROM {own_view}"
    for name in stages.STAGES:
        deps = fixed.DEPENDS_ON[name]
        if not deps:
            continue
        bad = "coalesce(" + ", ".join(f"CASE WHEN {d}_status NOT IN ('current', 'not_applicable') THEN '{d}' END" for d in deps) + ", NULL)"
        body = (f"SELECT * EXCLUDE (bad) REPLACE (CASE WHEN bad IS NOT NULL THEN 'stale' ELSE {name}_status END AS {name}_status, "
                f"CASE WHEN bad IS NOT NULL THEN 'UPSTREAM_STALE:' || bad ELSE {name}_reason END AS {name}_reason), "
                f"CASE WHEN bad IS NOT NULL THEN {name}_status END AS {name}_own_status, CASE WHEN bad IS NOT NULL THEN {name}_reason END AS {name}_own_reason "
                f"FROM (SELECT *, CASE WHEN {name}_status NOT IN ('missing', 'not_applicable') THEN {bad} END AS bad FROM ({body}))")
    return body


def _file_sql(p: str) -> str:
    usable = (f"readiness_status = 'current' AND coalesce({_J}(readiness_evaluated_text, '$.platforms.{p}.status') = 'ready', FALSE) AND publication_status = 'current' "
              f"AND list_contains(approved_for, '{p}')")
    return (f"CASE WHEN export_{p}_id IS NULL THEN 'NOT_PREPARED' WHEN NOT ({usable}) THEN 'NOT_READY_OR_NOT_APPROVED' "
            f"WHEN {_J}(export_{p}_text, '$.inputs_fingerprint') IS DISTINCT FROM fp_export_{p} THEN 'FINGERPRINT_CHANGED' "
            f"WHEN {p}_actual_size IS DISTINCT FROM CAST({_J}(export_{p}_text, '$.size_bytes') AS BIGINT) THEN 'FILE_MISSING_OR_CHANGED' END AS {p}_file_reason")


_FILE_STATUS = ", ".join(f"CASE WHEN {p}_file_reason IS NULL THEN 'ready_for_export' WHEN {p}_file_reason = 'NOT_PREPARED' THEN 'not_prepared' ELSE 'stale' END AS {p}_file_status" for p in fixed.PLATFORMS)


def _state_sql(eff: str) -> str:
    pick = "CASE p WHEN 'adobe' THEN adobe_file_status ELSE shutterstock_file_status END"
    rules = [("md_state = 'rejected'", "rejected", "[]", None), ("source_status <> 'ok'", "source_invalid", "[source_reason]", None)]
    for name in fixed.REQUIRED_STAGES:
        if name == "readiness":
            rules.append(("readiness_status = 'not_applicable'", "processing", "['NOT_PROCESSED:metadata']", None))
        if name in fixed.FAILURE_KIND:
            rules.append((f"{name}_status = 'failed'", fixed.FAILURE_KIND[name], f"[{name}_reason]", None))
        rules.append((f"{name}_status = 'stale'", "stale", f"['STALE:{name}:' || {name}_reason]", name))
        rules.append((f"{name}_status = 'missing'", "metadata_approved" if name == "readiness" else "processing", "[]" if name == "readiness" else f"['NOT_PROCESSED:{name}']", None))
        if name == "metadata":
            rules.append(("md_state = 'human_review'", "human_review", f"CASE WHEN len({_codes('metadata_json', '$.review_gate.reasons')}) > 0 THEN {_codes('metadata_json', '$.review_gate.reasons')} ELSE ['HUMAN_REVIEW'] END", None))
            rules.append(("md_state = 'draft'", "processing", "[CASE WHEN md_completeness = 'partial' THEN 'METADATA_PARTIAL' ELSE 'METADATA_NOT_GATED' END]", None))
    rules += [("readiness_reason = 'READINESS_BLOCKED'", "blocked", "list_concat(['READINESS_BLOCKED'], blockers)", None),
              ("publication_status = 'stale'", "stale", "['STALE:publication:' || publication_reason]", "publication"),
              ("publication_status = 'current' AND len(approved_for) > 0 AND export_status = 'current'", "ready_for_export", "[]", None),
              ("publication_status = 'current' AND len(approved_for) > 0", "publication_approved", "[]", None)]
    def arms(i):
        def val(r):
            if i == 2:
                return f"CAST({r[2]} AS VARCHAR[])"
            return "NULL" if r[i] is None else f"'{r[i]}'"
        return " ".join(f"WHEN {r[0]} THEN {val(r)}" for r in rules)
    export = _cases("export", [("len(targets) = 0", "not_applicable", "PUBLICATION_NOT_APPROVED"), ("len(stale_files) > 0", "stale", "('FILE_STALE:' || array_to_string(stale_files, ','))"),
                               ("len(ready_files) = 0", "missing", "NOT_PREPARED")], ("current", None))
    return f"""
SELECT *, CASE {arms(1)} ELSE 'platform_ready' END AS state, CASE {arms(2)} ELSE CAST([] AS VARCHAR[]) END AS reasons, CASE {arms(3)} ELSE NULL END AS reprocess_from
FROM (SELECT *, {export}, CASE WHEN len(targets) > 0 THEN ready_files ELSE [] END AS export_ready FROM (
  SELECT *, list_filter(targets, lambda p: {pick} = 'stale') AS stale_files, list_filter(targets, lambda p: {pick} = 'ready_for_export') AS ready_files
  FROM (SELECT *, CASE WHEN publication_status = 'current' THEN list_filter(approved_for, lambda p: p IN ('adobe', 'shutterstock')) ELSE [] END AS targets, {_FILE_STATUS}
    FROM (SELECT *, {_file_sql('adobe')}, {_file_sql('shutterstock')} FROM {eff}))))"""


sql_view("b_own", _own_sql(False))
sql_view("b_own_verified", _own_sql(True))
sql_view("b_eff", _propagated_sql("b_own"))
sql_view("b_eff_verified", _propagated_sql("b_own_verified"))
sql_view("b_state0", _state_sql("b_eff"))
sql_view("b_state_verified", _state_sql("b_eff_verified"))
sql_view("b_state", """
SELECT *, list_concat(CASE WHEN state IN ('source_invalid', 'blocked', 'error', 'stale') OR (state = 'processing' AND starts_with(reasons[1], 'METADATA_')) THEN reasons ELSE [] END,
  list_filter(CASE WHEN state NOT IN ('rejected', 'source_invalid') THEN [CASE WHEN enhancement_status = 'stale' THEN 'STALE:enhancement:' || enhancement_reason END,
   CASE WHEN creative_review_status = 'stale' THEN 'STALE:creative_review:' || creative_review_reason END, CASE WHEN export_status = 'stale' THEN 'STALE:export:' || export_reason END] ELSE [] END, lambda x: x IS NOT NULL)) AS problems
FROM b_state0""")


def _own_query(name: str, *extra: tuple[str, str]):
    """Query of the own status of one stage, with extra (column, SQL) pairs given as joined strings."""
    cols = "".join(f", array_to_string({sql}, ',') AS {col}" for col, sql in extra)

    @query(f"stg_{name}", f"SELECT asset_id, {name}_status AS status, {name}_reason AS reason{cols} FROM b_own")
    def run(t: Tables):
        return own(t).select("asset_id", F.col(f"{name}_status").alias("status"), F.col(f"{name}_reason").alias("reason"), *[joined(F.col(c)).alias(c) for c, _ in extra])


@query("stg_source", """
SELECT asset_id, a.source_status AS fast_status, a.source_reason AS fast_reason, v.source_status AS proven_status FROM b_own a JOIN b_own_verified v USING (asset_id)""")
def stg_source(t: Tables):
    rows = inputs(t)
    fast, proven = stages.source_status(False), stages.source_status(True)
    return rows.select("asset_id", fast["source_status"].alias("fast_status"), fast["source_reason"].alias("fast_reason"), proven["source_status"].alias("proven_status"))


_own_query("normalize")
_own_query("view")
_own_query("metadata")
_own_query("readiness", ("ready_for", "ready_for"), ("blockers", "blockers"))


@query("stg_qc", "SELECT asset_id, qc_status AS status, qc_reason AS reason, CASE WHEN qc_reason = 'FINGERPRINT_CHANGED' THEN array_to_string(qc_diff, ',') END AS changed FROM b_own")
def stg_qc(t: Tables):
    return own(t).select("asset_id", F.col("qc_status").alias("status"), F.col("qc_reason").alias("reason"), joined(F.col("qc_changed")).alias("changed"))


@query("stg_publication", "SELECT asset_id, publication_status AS status, publication_reason AS reason, array_to_string(approved_for, ',') AS approved_for, CASE WHEN publication_reason = 'FINGERPRINT_CHANGED' THEN array_to_string(pub_diff, ',') END AS changed FROM b_own")
def stg_publication(t: Tables):
    return own(t).select("asset_id", F.col("publication_status").alias("status"), F.col("publication_reason").alias("reason"), joined(F.col("approved_for")).alias("approved_for"), joined(F.col("publication_changed")).alias("changed"))


@query("jsn_fingerprint", f"""
SELECT asset_id, fp_facts, fp_rep, fp_view, fp_qc, fp_enh, CASE WHEN coalesce({_J}(ai_doc, '$.provider'), 'local') = 'local' THEN fp_vision END AS fp_vision, CASE {_J}(creative_advised_text, '$.prompt_version') WHEN 'creative-v1' THEN fp_creative1 ELSE fp_creative END AS fp_creative, fp_readiness, fp_publication,
 {", ".join(f"CASE WHEN {_J}(readiness_evaluated_text, '$.platforms.{p}.status') = 'ready' THEN fp_export_{p} END AS fp_export_{p}" for p in fixed.PLATFORMS)} FROM b_own""")
def jsn_fingerprint(t: Tables):
    """The current fingerprint of every result of every asset."""
    names = ("facts", "rep", "view", "qc", "enh", "vision", "creative", "readiness", "publication", *(f"export_{p}" for p in fixed.PLATFORMS))
    return own(t).select("asset_id", *[f"fp_{n}" for n in names])


@query("stg_vision", "SELECT asset_id, vision_status AS status, vision_reason AS reason, CASE WHEN vision_reason = 'FINGERPRINT_CHANGED' THEN array_to_string(vision_diff, ',') END AS changed FROM b_own")
def stg_vision(t: Tables):
    return own(t).select("asset_id", F.col("vision_status").alias("status"), F.col("vision_reason").alias("reason"), joined(F.col("vision_changed")).alias("changed"))


@query("stg_enhancement", "SELECT asset_id, enhancement_status AS status, enhancement_reason AS reason, e.decision FROM b_own JOIN b_enhancement e USING (asset_id)")
def stg_enhancement(t: Tables):
    return own(t).select("asset_id", F.col("enhancement_status").alias("status"), F.col("enhancement_reason").alias("reason"), F.col("enhancement_decision").alias("decision"))


@query("stg_creative", "SELECT asset_id, creative_review_status AS status, creative_review_reason AS reason FROM b_own")
def stg_creative(t: Tables):
    return own(t).select("asset_id", F.col("creative_review_status").alias("status"), F.col("creative_review_reason").alias("reason"))


@query("stg_export", "SELECT asset_id, export_status AS status, export_reason AS reason, adobe_file_status AS adobe, shutterstock_file_status AS shutterstock, array_to_string(export_ready, ',') AS ready FROM b_state0")
def stg_export(t: Tables):
    rows = state_table(t)
    return rows.select("asset_id", F.col("export_status").alias("status"), F.col("export_reason").alias("reason"), F.col("adobe_file.status").alias("adobe"),
                       F.col("shutterstock_file.status").alias("shutterstock"), joined(F.col("export_ready")).alias("ready"))


_EFF = ", ".join(f"{s}_status AS {s}, {s}_reason" for s in stages.STAGES)


@query("stg_propagate", f"SELECT asset_id, {_EFF}, metadata_own_status, readiness_own_reason FROM b_eff")
def stg_propagate(t: Tables):
    rows = stages.propagate(own(t))
    return rows.select("asset_id", *[c for s in stages.STAGES for c in (F.col(f"{s}_status").alias(s), F.col(f"{s}_reason"))], "metadata_own_status", "readiness_own_reason")


@query("stg_state", "SELECT asset_id, state, array_to_string(reasons, ',') AS reasons, reprocess_from FROM b_state0")
def stg_state(t: Tables):
    return derived(t).select("asset_id", "state", joined(F.col("reasons")).alias("reasons"), "reprocess_from")


@query("stg_problems", "SELECT asset_id, state, array_to_string(problems, ',') AS problems FROM b_state")
def stg_problems(t: Tables):
    return state_table(t).select("asset_id", "state", joined(F.col("problems")).alias("problems"))


_sell = "state IN ('platform_ready', 'publication_approved', 'ready_for_export')"
_first = "coalesce(reasons[1], '')"
_meta = f"state = 'processing' AND starts_with({_first}, 'METADATA_')"
_ACTIONS = [
    (f"state = 'blocked' AND starts_with({_first}, 'NORMALIZE_FAILED')", "'normalize.get:read'"), (f"state = 'blocked' AND starts_with({_first}, 'VIEW_FAILED')", "'normalize.run:pipeline'"),
    (f"state = 'blocked' AND {_first} = 'READINESS_BLOCKED'", "'metadata.edit:pipeline,metadata.reject:review'"),
    ("state = 'error'", f"CASE WHEN {_first} = 'VISION_FAILED' THEN 'asset.process:pipeline' ELSE 'readiness.evaluate:pipeline' END"),
    ("state = 'stale'", "'asset.reprocess:pipeline:' || CASE WHEN reprocess_from = 'view' THEN 'normalize' ELSE reprocess_from END"),
    (f"state = 'processing' AND starts_with({_first}, 'NOT_PROCESSED:')", f"CASE WHEN {_first} IN ('NOT_PROCESSED:normalize', 'NOT_PROCESSED:view') THEN 'normalize.run' WHEN {_first} IN ('NOT_PROCESSED:qc', 'NOT_PROCESSED:vision') THEN 'asset.process' ELSE 'metadata.build' END || ':pipeline'"),
    (f"state = 'processing' AND {_first} = 'METADATA_PARTIAL' AND json_array_length(metadata_json, '$.edited_fields') = 0", "'metadata.build:pipeline'"),
    (_meta, "'metadata.edit:pipeline,metadata.reject:review'"),
    ("state = 'human_review'", "'metadata.edit:pipeline,metadata.rebuild:pipeline,metadata.escalate:pipeline' || CASE WHEN json_array_length(metadata_json, '$.validation.errors') = 0 THEN ',metadata.approve:review' ELSE '' END || ',metadata.reject:review'"),
    ("state = 'metadata_approved'", "'readiness.evaluate:pipeline,metadata.reject:review'"),
    (f"{_sell} AND creative_review_status <> 'current'", "'creative.review:pipeline'"), (f"{_sell} AND publication_status = 'missing'", "'publication.evaluate:pipeline'"),
    (f"{_sell} AND export_status IN ('missing', 'stale')", "'export.prepare:pipeline'"), (_sell, "'metadata.reject:review'"),
    ("state NOT IN ('rejected', 'source_invalid', 'stale') AND enhancement_status = 'stale' AND view_status = 'current'", "'enhancement.assess:pipeline'")]


@query("stg_actions", "SELECT asset_id, state, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {a} END" for c, a in _ACTIONS) + "], lambda x: x IS NOT NULL), ',') AS actions FROM b_state")
def stg_actions(t: Tables):
    return state_table(t).select("asset_id", "state", joined(F.col("actions")).alias("actions"))


sql_view("b_pipeline", f"""
SELECT s.asset_id, s.filename, s.state, s.reasons, s.problems, s.source_status, CASE WHEN coalesce(qc_result, '{{}}') = '{{}}' THEN 'pending' WHEN {_J}(qc_result, '$.passed') = 'true' THEN 'passed' ELSE 'failed' END AS qc,
 CASE WHEN ai_result IS NOT NULL THEN 'done' WHEN {_newer('ai_failed_id', 'ai_passed_id')} THEN 'failed' ELSE 'pending' END AS vision,
 coalesce(md_state, 'none') AS metadata_state, md_completeness AS completeness, coalesce(md_state IN ('auto_approved', 'approved'), FALSE) AS metadata_approved,
 CASE WHEN md_state = 'human_review' THEN {_codes('metadata_json', '$.review_gate.reasons')} ELSE [] END AS review_reasons, metadata_json, ready_for, approved_for, export_ready,
 adobe_file_status, shutterstock_file_status, export_adobe_text, export_shutterstock_text, readiness_status, publication_status, creative_review_status, fp_readiness,
 readiness_evaluated_text, creative_advised_text, publication_evaluated_text, export_adobe_id, export_shutterstock_id
FROM b_state s""")


@query("stg_pipeline_view", "SELECT asset_id, source_status AS source, qc, vision, metadata_state, completeness, metadata_approved, array_to_string(review_reasons, ',') AS review_reasons FROM b_pipeline")
def stg_pipeline_view(t: Tables):
    rows = state_table(t)
    return rows.select("asset_id", F.col("source_status").alias("source"), "qc", "vision", "metadata_state", "completeness", "metadata_approved", joined(F.col("review_reasons")).alias("review_reasons"))


@query("stg_asset_view", f"""
SELECT s.asset_id, filename, source_path, file_hash, file_size, state, array_to_string(reasons, ',') AS reasons, reprocess_from, array_to_string(ready_for, ',') AS ready_for, array_to_string(problems, ',') AS problems,
 {", ".join(f"{name}_status" for name in stages.STAGES)}, qc, vision, metadata_state, completeness, metadata_approved, array_to_string(review_reasons, ',') AS review_reasons, ai_passed_id AS vision_event_id,
 {_J}(ai_doc, '$.provider') AS provider, {_J}(ai_doc, '$.model') AS model, {_J}(ai_doc, '$.prompt_version') AS prompt_version, {_J}(metadata_json, '$.fields.title') AS title, array_to_string(acts, ',') AS actions
FROM (SELECT *, list_filter([{", ".join(f"CASE WHEN {c} THEN {a} END" for c, a in _ACTIONS)}], lambda x: x IS NOT NULL) AS acts FROM b_state) s
JOIN (SELECT asset_id, qc, vision, metadata_state, completeness, metadata_approved, review_reasons FROM b_pipeline) p USING (asset_id)""")
def stg_asset_view(t: Tables):
    """Everything about one asset in one row: file, state with its reasons, all statuses, summary, provenance, title, actions."""
    lists = {c: joined(F.col(c)).alias(c) for c in ("reasons", "ready_for", "problems", "review_reasons", "actions")}
    provenance = [F.col("ai_passed_id").alias("vision_event_id"), *[F.col(f"ai_passed.{c}").alias(c) for c in ("provider", "model", "prompt_version")]]
    return state_table(t).select("asset_id", "filename", "source_path", "file_hash", "file_size", "state", lists["reasons"], "reprocess_from", lists["ready_for"], lists["problems"], *[f"{s}_status" for s in stages.STAGES],
                                 "qc", "vision", "metadata_state", "completeness", "metadata_approved", lists["review_reasons"], *provenance, F.col("md.fields.title").alias("title"), lists["actions"])


@query("stg_current_or_last", " UNION ALL ".join(f"""
SELECT asset_id, '{s}' AS stage, {s}_status = 'current' AS is_current, CASE WHEN {s}_status = 'current' THEN {d} END AS result, CASE WHEN {s}_status <> 'current' THEN {d} END AS last_result FROM b_pipeline"""
    for s, d in (("readiness", f"{_J}(readiness_evaluated_text, '$.fingerprint')"), ("creative_review", f"{_J}(creative_advised_text, '$.features.recommendation')"),
                 ("publication", f"{_J}(publication_evaluated_text, '$.inputs.policy_version')"))))
def stg_current_or_last(t: Tables):
    rows = state_table(t).withColumn("policy", F.get_json_object("publication_evaluated.inputs", "$.policy_version"))
    shown = None
    for stage, document in (("readiness", "readiness_evaluated.fingerprint"), ("creative_review", "creative_advised.features.recommendation"), ("publication", "policy")):
        part = stages.current_or_last(rows, stage, document).withColumn("stage", F.lit(stage))
        shown = part if shown is None else shown.unionByName(part)
    return shown


@query("stg_attention_view", f"""
SELECT asset_id, array_to_string(list_transform(list_filter(CAST(json_extract(metadata_json, '$.grounding.specific_claims') AS JSON[]), lambda c: json_extract_string(c, '$.confirmed') <> 'true'), lambda c: json_extract_string(c, '$.term')), ',') AS claims,
 list_contains({_codes('metadata_json', '$.review_gate.reasons')}, 'PEOPLE_RECOGNIZABLE') OR list_contains(reasons, 'MODEL_RELEASE_REQUIRED') AS model_release_needed FROM b_pipeline WHERE state = 'human_review'""")
def stg_attention_view(t: Tables):
    return stages.attention(state_table(t)).withColumn("claims", joined(F.col("claims")))


sql_view("b_exports", " UNION ALL ".join(f"""
SELECT asset_id, state, '{p}' AS platform, {p}_file_status AS status, {_J}(export_{p}_text, '$.sha256') AS sha256, {_J}(export_{p}_text, '$.filename') AS filename, {_J}(export_{p}_text, '$.text') AS text,
 list_contains(approved_for, '{p}') AND publication_status = 'current' AS approved, export_{p}_text IS NOT NULL AS has_file, export_{p}_id AS export_event_id FROM b_pipeline""" for p in fixed.PLATFORMS))


@query("stg_state_lists", f"""
SELECT e.asset_id, e.state, e.platform, e.status, c.batch, CAST(NULL AS VARCHAR) AS detail FROM b_exports e LEFT JOIN b_collected c ON c.asset_id = e.asset_id AND c.platform = e.platform AND c.sha256 = e.sha256 AND e.status = 'ready_for_export'
WHERE e.state IN ('publication_approved', 'ready_for_export') AND approved
UNION ALL SELECT asset_id, state, NULL, CASE WHEN list_contains(reasons, 'MODEL_RELEASE_REQUIRED') THEN 'attestable' ELSE 'blocked' END, NULL, array_to_string(reasons, ',') FROM b_pipeline WHERE state = 'blocked'
UNION ALL SELECT asset_id, state, NULL, substr({_J}(metadata_json, '$.review.decided_at'), 1, 10), NULL, {_J}(metadata_json, '$.review.reason') FROM b_pipeline WHERE state = 'rejected'""")
def stg_state_lists(t: Tables):
    return recompute.state_lists(state_table(t), log.collected(t.b_events))


# --- recompute -------------------------------------------------------------------------------

def _plan_sql(state_view: str) -> str:
    """Steps of every asset from the stage its state suggests, by unrolled chains."""
    selects = []
    for start, chain in fixed.RERUN_CHAIN.items():
        ok = {u: "('current', 'not_applicable')" if u == "readiness" and start in ("creative_review", "publication") else "('current')" for u in fixed.RERUN_NEEDS[start]}
        guard = " AND ".join(f"{u}_status IN {v}" for u, v in ok.items()) or "TRUE"
        cond = f"reprocess_from = '{start}' AND state NOT IN ('rejected', 'source_invalid') AND {guard}"
        body, prev = f"SELECT *, FALSE AS stopped FROM {state_view} WHERE {cond}", []
        for pos, name in enumerate(chain):
            rerun = [d for d in fixed.DEPENDS_ON[name] if d in prev]
            dep = "coalesce(" + ", ".join([f"CASE WHEN run_{d} THEN '{d}' END" for d in rerun] + ["NULL"]) + ")"
            policy = f"CASE WHEN md_state IN ('approved', 'rejected') THEN 'HUMAN_DECISION' WHEN json_array_length(metadata_json, '$.edited_fields') > 0 THEN 'HUMAN_EDITS' END" if name == "metadata" else "NULL"
            skip_na = f"{name}_status = 'not_applicable'" + (" AND NOT run_metadata" if "metadata" in prev else "") if name in ("readiness", "creative_review", "publication") else "FALSE"
            meta_first = "run_metadata" if name == "readiness" and "metadata" in prev else "FALSE"
            action = (f"CASE WHEN stopped THEN NULL WHEN {skip_na} THEN 'skip' WHEN {meta_first} THEN 'run' WHEN {name}_status = 'current' AND {dep} IS NULL THEN 'skip' "
                      f"WHEN {policy} IS NOT NULL THEN 'stop' ELSE '{'derive' if name == 'view' else 'run'}' END")
            why = (f"CASE WHEN stopped THEN NULL WHEN {skip_na} THEN 'not_applicable:' || {name}_reason WHEN {meta_first} THEN 'UPSTREAM_RERUN:metadata (if metadata stays approved)' "
                   f"WHEN {name}_status = 'current' AND {dep} IS NULL THEN 'current' WHEN {policy} IS NOT NULL THEN {policy} WHEN {name}_status <> 'current' THEN {name}_reason ELSE 'UPSTREAM_RERUN:' || {dep} END")
            body = (f"SELECT * EXCLUDE (stopped), coalesce(act_{name} IN ('run', 'derive'), FALSE) AS run_{name}, stopped OR coalesce(act_{name} = 'stop', FALSE) AS stopped "
                    f"FROM (SELECT *, {action} AS act_{name}, {why} AS why_{name} FROM ({body}))")
            prev.append(name)
        selects += [f"SELECT asset_id, '{start}' AS start, {pos} AS pos, '{name}' AS stage, act_{name} AS action, why_{name} AS why FROM ({body}) WHERE act_{name} IS NOT NULL" for pos, name in enumerate(chain)]
    return " UNION ALL ".join(selects)


_NEEDS_BAD = "CASE reprocess_from " + " ".join(
    f"WHEN '{s}' THEN coalesce(" + ", ".join([f"CASE WHEN {u}_status NOT IN ({chr(39)}current{chr(39)}{', ' + chr(39) + 'not_applicable' + chr(39) if u == 'readiness' and s in ('creative_review', 'publication') else ''}) THEN '{u}' END" for u in fixed.RERUN_NEEDS[s]] + ["NULL"]) + ")"
    for s in fixed.RERUN_CHAIN) + " END"
sql_view("b_refusals", f"""
SELECT asset_id, state, reprocess_from, CASE WHEN state = 'rejected' THEN 'REJECTED' WHEN state = 'source_invalid' THEN 'SOURCE_INVALID' WHEN reprocess_from IS NULL THEN 'NOTHING_STALE'
 WHEN reprocess_from = 'view' THEN 'NOT_CONNECTED' WHEN {_NEEDS_BAD} IS NOT NULL THEN 'UPSTREAM_NOT_CURRENT:' || ({_NEEDS_BAD}) END AS refused FROM b_state_verified""")
sql_view("b_plan", _plan_sql("b_state_verified"))


@query("rep_plan", "SELECT asset_id, start, pos, stage, action, why FROM b_plan UNION ALL SELECT asset_id, reprocess_from, -1, NULL, 'refused', refused FROM b_refusals WHERE refused IS NOT NULL")
def rep_plan(t: Tables):
    return recompute.plan(state_table(t, verify=True))


@query("rep_policy", f"""
SELECT asset_id, CASE WHEN {_J}(metadata_json, '$.state') IN ('approved', 'rejected') THEN 'HUMAN_DECISION' WHEN json_array_length(metadata_json, '$.edited_fields') > 0 THEN 'HUMAN_EDITS' END AS policy FROM b_catalog""")
def rep_policy(t: Tables):
    return stages.with_documents(t.b_catalog).select("asset_id", recompute.metadata_policy().alias("policy"))


@query("rep_cheapest", """
SELECT asset_id, coalesce(metadata_own_reason, metadata_reason) AS reason, CASE WHEN metadata_status = 'stale' AND coalesce(metadata_own_reason, metadata_reason) = 'GATE_POLICY_CHANGED' THEN 'gate'
 WHEN metadata_status = 'stale' AND coalesce(metadata_own_reason, metadata_reason) = 'BUILDER_CHANGED' THEN 'rebuild' ELSE 'build' END AS action FROM b_eff WHERE metadata_status <> 'current'""")
def rep_cheapest(t: Tables):
    rows = state_table(t).filter(F.col("metadata_status") != "current")
    return rows.select("asset_id", recompute.metadata_reason().alias("reason"), recompute.cheapest_repair().alias("action"))
