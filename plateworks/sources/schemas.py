"""Explicit schemas of the catalogue, the log and the documents (DDL)."""

ASSETS = ("asset_id BIGINT, filename STRING, source_path STRING, file_hash STRING, extension STRING, width INT, height INT, "
          "file_size BIGINT, status STRING, qc_result STRING, ai_result STRING, metadata_json STRING, "
          "rejection_reason STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ")
EVENTS = "id BIGINT, asset_id BIGINT, stage STRING, status STRING, message STRING, created_at TIMESTAMP_NTZ"

VISION = ("analysis_version STRING, description STRING, title STRING, keywords ARRAY<STRING>, categories ARRAY<STRING>, "
          "subject STRING, commercial_context STRING, technical_subjects ARRAY<STRING>, "
          "people STRUCT<present BOOLEAN, count INT>, brands ARRAY<STRING>, logos ARRAY<STRING>, "
          "text_visible ARRAY<STRING>, editorial_risk ARRAY<STRING>, ai_generated BOOLEAN, confidence DOUBLE")
ADVICE = ("decision STRING, reasons ARRAY<STRUCT<reason STRING, detail STRING>>, operations ARRAY<STRING>, confidence DOUBLE")
CREATIVE = ("composition STRING, demand STRING, uniqueness STRING, commercial_use_cases ARRAY<STRING>, recommendation STRING")
QC = ("passed BOOLEAN, errors ARRAY<STRING>, warnings ARRAY<STRING>, edge_border ARRAY<STRUCT<side STRING, width INT>>, "
      "input_fingerprint STRING, inputs STRING")
METADATA = ("state STRING, completeness STRING, fields STRUCT<title STRING, description STRING, keywords ARRAY<STRING>>, "
            "edited_fields ARRAY<STRING>, review STRUCT<decided_at STRING, reason STRING, allow_partial BOOLEAN>, "
            "sources STRUCT<vision STRUCT<event_id BIGINT>, builder_version STRING>, "
            "grounding STRUCT<specific_claims ARRAY<STRUCT<term STRING, field STRING, reason STRING, confirmed BOOLEAN>>>, "
            "validation STRUCT<errors ARRAY<STRUCT<code STRING>>, warnings ARRAY<STRUCT<code STRING>>>, "
            "review_gate STRUCT<policy_version STRING, reasons ARRAY<STRUCT<code STRING, detail STRING>>, "
            "notes ARRAY<STRUCT<code STRING>>, escalation STRUCT<reason STRING>>")

# typed view of the latest message per slot of the log
CHECKS = "ARRAY<STRUCT<code STRING, level STRING>>"
MESSAGES = {
    "normalize_evaluated": "fingerprint STRING, facts STRUCT<container STRING, color_kind STRING, motion_video BOOLEAN>",
    "normalize_passed": "fingerprint STRING, representation STRING, derivative STRUCT<path STRING, sha256 STRING>",
    "normalize_failed": "stage STRING, error_type STRING, fingerprint STRING",
    "view_failed": "error_type STRING",
    "ai_passed": ("provider STRING, model STRING, prompt_version STRING, analyzed_at STRING, input_fingerprint STRING, "
                  "inputs STRING"),
    "enhancement_assessed": ("fingerprint STRING, decision STRING, disputed BOOLEAN, reasons ARRAY<STRUCT<reason STRING>>, "
                             "notes ARRAY<STRUCT<code STRING>>"),
    "enhancement_advised": f"assessment_event_id BIGINT, advice STRUCT<{ADVICE}>",
    "enhancement_failed": "stage STRING, error_type STRING, fingerprint STRING",
    "readiness_evaluated": ("fingerprint STRING, ready_for ARRAY<STRING>, "
                            f"platforms MAP<STRING, STRUCT<profile STRING, status STRING, checks {CHECKS}, categories ARRAY<STRING>, export_plan STRUCT<title STRING, description STRING, keywords ARRAY<STRING>>>>"),
    "creative_advised": ("fingerprint STRING, profile STRUCT<name STRING, selection STRUCT<mode STRING>>, "
                         f"prompt_version STRING, features STRUCT<{CREATIVE}>"),
    "publication_evaluated": "fingerprint STRING, approved_for ARRAY<STRING>, inputs STRING",
    **{f"export_{p}": ("path STRING, filename STRING, text STRING, sha256 STRING, size_bytes BIGINT, inputs_fingerprint STRING")
       for p in ("adobe", "shutterstock")},
    **{f"export_failed_{p}": "code STRING, error STRING" for p in ("adobe", "shutterstock")},
    "attested": "kind STRING, note STRING, file_hash STRING",
}
