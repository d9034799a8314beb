"""Views that shape the driver's tables like a media catalogue, once for Spark and once for DuckDB.

Both sides come from the same SQL text: the dialects differ only in the few names listed in
``_DIALECT``. Every view keeps all rows and whole texts of its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import documents as doc
from plateworks.functions import fingerprints as fp
from plateworks.session import materialize

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")

_DIALECT = {
    "spark": {"SHA": "sha2({0}, 256)", "JSON": "get_json_object({0}, '{1}')", "LINES": "split({0}, '\\n')",
              "WORDS": "split({0}, ' ')", "ITEM": "element_at({0}, {1})", "ARR": "array({0})",
              "NOARR": "cast(array() as array<string>)", "LPAD": "lpad({0}, greatest({1}, length({0})), '0')", "LAST": "element_at({0}, -1)"},
    "duckdb": {"SHA": "sha256({0})", "JSON": "json_extract_string({0}, '{1}')", "LINES": "string_split({0}, chr(10))",
               "WORDS": "string_split({0}, ' ')", "ITEM": "({0})[{1}]", "ARR": "[{0}]",
               "NOARR": "CAST([] AS VARCHAR[])", "LPAD": "lpad({0}, CAST(greatest({1}, length({0})) AS INT), '0')", "LAST": "({0})[-1]"},
}


def _render(template: str, dialect: str) -> str:
    names = _DIALECT[dialect]

    def call(match: re.Match) -> str:
        name, rest = match.group(1), match.group(2)
        return names[name].format(*[_render(a.strip(), dialect) for a in _split_args(rest)]) if rest else names[name]

    pattern = re.compile(r"@(" + "|".join(names) + r")(?:<((?:[^<>]|<[^<>]*>)*)>)?")
    return pattern.sub(call, template)


def _split_args(text: str) -> list[str]:
    return re.split(r"(?<!\|)\|(?!\|)", text)  # one bar; two are the concatenation of SQL


# --- the log ---------------------------------------------------------------------------------
# (event_type, k below, stage, status): every stage/status pair of the log gets a share of the rows.
_PAIRS = (
    ("view", 35, "NORMALIZE", "EVALUATED"), ("view", 78, "NORMALIZE", "PASSED"), ("view", 84, "NORMALIZE", "FAILED"),
    ("view", 90, "VIEW", "FAILED"), ("view", 94, "SOURCE", "INVALID"), ("view", 100, "SOURCE", "NORMALIZED"),
    ("click", 40, "QC", "PASSED"), ("click", 50, "QC", "FAILED"), ("click", 80, "ENHANCEMENT", "ASSESSED"),
    ("click", 92, "ENHANCEMENT", "ADVISED"), ("click", 100, "ENHANCEMENT", "FAILED"),
    ("signup", 50, "AI", "PASSED"), ("signup", 60, "AI", "FAILED"), ("signup", 85, "METADATA_AI", "PASSED"),
    ("signup", 95, "METADATA_AI", "FAILED"), ("signup", 100, "INGEST", "DONE"),
    ("purchase", 10, "METADATA", "DRAFTED"), ("purchase", 28, "METADATA", "GATED"), ("purchase", 32, "METADATA", "EDITED"),
    ("purchase", 38, "METADATA", "APPROVED"), ("purchase", 42, "METADATA", "REJECTED"), ("purchase", 45, "METADATA", "ESCALATED"),
    ("purchase", 72, "READINESS", "EVALUATED"), ("purchase", 75, "READINESS", "FAILED"), ("purchase", 100, "PUBLICATION", "EVALUATED"),
    ("error", 12, "NOTIFY", "SENT"), ("error", 40, "CREATIVE_REVIEW", "ADVISED"), ("error", 45, "CREATIVE_REVIEW", "FAILED"),
    ("error", 70, "DERIVATIVE", "CREATED"), ("error", 78, "EXPORT", "FAILED"), ("error", 88, "OUTBOX", "COLLECTED"),
    ("error", 94, "HUMAN", "PEOPLE_ATTESTED"), ("error", 100, "REPROCESS", "DONE"),
)


def _pair_case() -> str:
    """Stage/status of an event: first by type, then by the first k bound above the value."""
    kinds = dict.fromkeys(p[0] for p in _PAIRS)
    arms = {kind: " ".join(f"WHEN k < {p[1]} THEN '{p[2]}/{p[3]}'" for p in _PAIRS if p[0] == kind) for kind in kinds}
    return "CASE event_type " + " ".join(f"WHEN '{kind}' THEN CASE {a} END" for kind, a in arms.items()) + " END"


def _text(expr: str) -> str:
    """JSON string of a SQL expression without characters to escape; null is null."""
    return f"coalesce('\"' || {expr} || '\"', 'null')"


def _plain(expr: str) -> str:
    """JSON number, truth value or document of a SQL expression."""
    return f"coalesce(CAST({expr} AS {{STR}}), 'null')"


def _lit(value: str) -> str:
    return f"'\"{value}\"'"


def _json(value) -> str:
    return f"'{fp.constant_text(value)}'"


def _fp(**parts: str) -> str:
    """SQL twin of ``fingerprints.of``: every part is an expression that gives JSON text."""
    body = " || ".join(f"'{',' if i else ''}\"{k}\":' || {parts[k]}" for i, k in enumerate(sorted(parts)))
    return f"('sha256:' || @SHA<'{{' || {body} || '}}'>)"


#: What the answers of the vision model depend on besides the view.
IDENTITIES = {"local": {"model": "vision-8b", "prompt_version": "vision-v3", "image": {"variant": "preview", "format": "jpeg", "quality": 90}, "params": {"temperature": None, "max_tokens": None}}}
_IDENTITY = IDENTITIES["local"]
_PROFILES = {p["platform"]: p["version"] for p in fixed.PLATFORM_PROFILES}
_READY_INPUTS = dict(
    completeness=_text("completeness"), facts_event_id=_plain("facts_event_id"), fields="coalesce(fields, 'null')", file_hash=_text("file_hash"), profiles=_json(sorted(_PROFILES.values())),
    qc_passed=_plain("coalesce(qc_passed, FALSE)"), readiness_version=_lit(fixed.READINESS_VERSION), source_event_id=_plain("source_event_id"), state=_text("md_state"), vision_event_id=_plain("vision_event_id"))
# (columns by level: each level reads the one before)
_PRINTS = (
    (("fp_facts", _fp(source=_text("file_hash"), version=_lit(fixed.FACTS_VERSION))),
     ("fp_rep", _fp(params=_lit(doc.NORMALIZER_PARAMS_DIGEST), source=_text("file_hash"), version=_lit(fixed.NORMALIZER_VERSION))),
     ("attestation", "CASE WHEN attested_k < 92 AND attested_value >= 10 THEN '{\"event_id\":' || attested_id || ',\"kind\":\"' || CASE WHEN attested_k < 90 THEN 'not_identifiable' ELSE 'release_on_file' END || '\"}' END")),
    (("fp_view", _fp(normalizer=_text("fp_rep"), view=_lit(fixed.VIEW_VERSION))),
     ("fp_unattested", _fp(**_READY_INPUTS)), ("fp_attested", _fp(people_attestation="attestation", **_READY_INPUTS))),
    (("fp_qc", _fp(rules=_json(fixed.QC_RULES), view=_text("fp_view"))),
     ("fp_enh", _fp(file_hash=_text("file_hash"), rules_version=_lit(fixed.ENHANCEMENT_RULES_VERSION), view=_text("fp_view"))),
     ("fp_vision", _fp(provider=_lit("local"), view=_text("fp_view"), **{k: _json(v) for k, v in _IDENTITY.items()})),
     *[(name, _fp(file_hash=_text("file_hash"), prompt_version=_lit(prompt), view=_text("fp_view"), vision="coalesce('\"' || replace(ai_result, '\"', chr(92) || '\"') || '\"', 'null')")) for name, prompt in (("fp_creative", "creative-v2"), ("fp_creative1", "creative-v1"))],
     ("fp_readiness", "CASE WHEN attestation IS NULL THEN fp_unattested ELSE fp_attested END")),
    (("ready_fp", "CASE WHEN ready_value < 2 THEN NULL WHEN ready_value < 4 THEN 'sha256:older' WHEN ready_value IS NOT NULL THEN fp_readiness END"),),
    tuple((f"fp_export_{p['platform']}", _fp(
        export_version=_lit(fixed.EXPORT_VERSION), normalizer_version=_lit(fixed.NORMALIZER_VERSION), profile=_json(p), readiness_fingerprint=_text("ready_fp"), view=_text("fp_view"),
        snapshot={"title": "'{\"keywords\":[\"frame\",\"take ' || ready_k || '\"],\"title\":\"Frame ' || asset_id || '\"}'",
                  "description": "'{\"description\":\"Frame ' || asset_id || ' at work\",\"keywords\":[\"frame\",\"take ' || ready_k || '\"]}'"}[p["text_field"]])) for p in fixed.EXPORT_PROFILES),
)


def _cols(columns) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns)


def _with_prints(inner: str) -> str:
    for level in _PRINTS:
        inner = f"SELECT *, {_cols(level)} FROM ({inner})"
    return inner


def _stored(current: str) -> str:
    """A stored fingerprint: mostly the current one, sometimes an older one."""
    return f"CASE WHEN value < 4 THEN 'sha256:older' ELSE {current} END"


def _json_fp(current: str) -> str:
    """JSON member with the stored fingerprint; left out for the smallest values."""
    return f"CASE WHEN value < 2 THEN '' ELSE ',\"fingerprint\":\"' || ({_stored(current)}) || '\"' END"


_PLATFORM = "CASE WHEN value < 35 THEN 'adobe' ELSE 'shutterstock' END"
_ADOBE, _OLDER = "'adobe'", "'sha256:older'"
_PARAMS = fp.constant_text(_IDENTITY["params"])
_READY = ("CASE WHEN k >= 70 THEN '[]' WHEN value < 20 THEN '[\"adobe\"]' WHEN value < 30 THEN '[\"shutterstock\"]' "
          "ELSE '[\"adobe\",\"shutterstock\"]' END")


def _platform_json(name: str, version: str) -> str:
    ready = f"(k < 70 AND ({'value < 20 OR value >= 30' if name == 'adobe' else 'value >= 20'}))"
    plan = "',\"export_plan\":{\"title\":\"Frame ' || asset_id || '\",\"description\":\"Frame ' || asset_id || ' at work\",\"keywords\":[\"frame\",\"take ' || k || '\"]}'"
    return (f"'\"{name}\":{{\"profile\":\"{version}\",\"status\":\"' || CASE WHEN {ready} THEN 'ready' ELSE 'blocked' END || "
            f"'\",\"checks\":[' || CASE WHEN {ready} THEN '{{\"code\":\"TITLE_LONG\",\"level\":\"warning\"}}' "
            f"WHEN k > 70 THEN '{{\"code\":\"MODEL_RELEASE_REQUIRED\",\"level\":\"blocker\"}},{{\"code\":\"EDITORIAL_ONLY\",\"level\":\"blocker\"}}' "
            f"ELSE '{{\"code\":\"QC_NOT_PASSED\",\"level\":\"blocker\"}}' END || '],\"categories\":[\"Industry\"]' || CASE WHEN {ready} THEN {plan} ELSE '' END || '}}'")


_MESSAGE = f"""
CASE pair
 WHEN 'INGEST/DONE' THEN 'Registered JPEG ' || k || 'x' || k
 WHEN 'NORMALIZE/EVALUATED' THEN '{{"k":' || k || {_json_fp('fp_facts')} || ',"facts":{{"container":"' || CASE WHEN k < 20 THEN 'JPEG' WHEN k < 30 THEN 'PNG' ELSE 'TIFF' END || '","color_kind":"' || CASE WHEN k < 25 THEN 'srgb' ELSE 'undeclared' END || '","motion_video":' || CASE WHEN k > 30 THEN 'true' ELSE 'false' END || '}}}}'
 WHEN 'NORMALIZE/PASSED' THEN '{{"k":' || k || {_json_fp('fp_rep')} || ',"representation":"' || CASE WHEN k < 70 THEN 'source"' ELSE 'derivative","derivative":{{"path":"internal/' || asset_id || '.png","sha256":"' || @SHA<'internal-' || asset_id> || '"}}' END || '}}'
 WHEN 'NORMALIZE/FAILED' THEN '{{"stage":"' || CASE WHEN k < 81 THEN 'engine' ELSE 'facts' END || '","error_type":"' || CASE WHEN k < 79 THEN 'SOURCE_MISSING' WHEN k < 82 THEN 'MISSING_CODEC' ELSE 'DECODE_ERROR' END || '","error":"cannot read"' || CASE WHEN k < 81 THEN {_json_fp('fp_rep')} ELSE {_json_fp('fp_facts')} END || '}}'
 WHEN 'VIEW/FAILED' THEN '{{"error_type":"' || CASE WHEN k < 87 THEN 'DECODE_ERROR' ELSE 'NORMALIZE_STALE' END || '"}}'
 WHEN 'SOURCE/INVALID' THEN '{{"reason":"SOURCE_CHANGED"}}'
 WHEN 'SOURCE/NORMALIZED' THEN '{{"old":"a","new":"b","actor":"human"}}'
 WHEN 'QC/PASSED' THEN '{{"passed":true,"actor":"workflow:ingest"}}'
 WHEN 'QC/FAILED' THEN '{{"passed":false}}'
 WHEN 'ENHANCEMENT/ASSESSED' THEN '{{"k":' || k || {_json_fp('fp_enh')} || ',"decision":' || CASE WHEN k < 60 THEN '"enhancement_not_needed"' WHEN k < 66 THEN '"enhancement_recommended"' WHEN k < 70 THEN '"enhancement_risky"' ELSE 'null' END || ',"disputed":' || CASE WHEN k >= 70 THEN 'true' ELSE 'false' END || ',"reasons":[' || CASE WHEN k < 60 THEN '' WHEN k < 70 THEN '{{"reason":"noise","level":"issue"}}' ELSE '{{"reason":"sharpness","level":"borderline"}},{{"reason":"resolution","level":"borderline"}}' END || '],"notes":[' || CASE WHEN value < 20 THEN '{{"code":"ISOLATED_SUBJECT"}}' ELSE '' END || ']}}'
 WHEN 'ENHANCEMENT/ADVISED' THEN '{{"assessment_event_id":' || id || ',"advice":{{"decision":"' || CASE WHEN k < 86 THEN 'enhancement_not_needed' ELSE 'enhancement_recommended' END || '","reasons":[{{"reason":"sharpness","detail":"soft"}}],"operations":[],"confidence":0.' || @LPAD<CAST(k AS {{STR}})|2> || '}}}}'
 WHEN 'ENHANCEMENT/FAILED' THEN '{{"stage":"' || CASE WHEN k < 96 THEN 'rules' ELSE 'advisor' END || '","error_type":"' || CASE WHEN value < 30 THEN 'TimeoutError' ELSE 'ConnectionError' END || '"' || {_json_fp('fp_enh')} || '}}'
 WHEN 'AI/PASSED' THEN CASE WHEN k < 4 THEN 'Vision analysis saved' ELSE '{{"provider":"' || CASE WHEN k < 47 THEN 'local' ELSE 'remote' END || '","model":"vision-8b","prompt_version":"vision-v3","analyzed_at":"2024-01-01T00:00:00+00:00","duration_s":' || value || CASE WHEN value < 2 THEN '' ELSE ',"input_fingerprint":"' || ({_stored('fp_vision')}) || '"' END || ',"inputs":{{"view":"' || fp_view || '","provider":"local","model":"' || CASE WHEN value < 4 THEN 'vision-4b' ELSE 'vision-8b' END || '","prompt_version":"vision-v3","params":{_PARAMS},"image":{{"variant":"preview","quality":' || CASE WHEN value < 3 THEN 80 ELSE 90 END || ',"format":"jpeg"}}}}}}' END
 WHEN 'AI/FAILED' THEN '{{"provider":"local","duration_s":' || value || CASE WHEN k < 53 THEN '' WHEN k < 57 THEN ',"error_type":"ConnectionError"' ELSE ',"error_type":"AIResponseError"' END || ',"error":"failed at ' || k || '"}}'
 WHEN 'METADATA_AI/PASSED' THEN '{{"provider":"local","model":"text-4b","duration_s":' || value || '}}'
 WHEN 'METADATA_AI/FAILED' THEN '{{"provider":"local"' || CASE WHEN k < 90 THEN ',"error_type":"TimeoutError"' ELSE '' END || ',"error":"no answer"}}'
 WHEN 'METADATA/GATED' THEN '{{"decision":"' || CASE WHEN value < 30 THEN 'human_review' WHEN value < 60 THEN 'auto_approved' ELSE 'deferred' END || '","state_before":"' || CASE WHEN k < 20 THEN 'draft' ELSE 'human_review' END || '","reasons":[' || CASE WHEN value < 30 THEN '"TRADEMARK"' ELSE '' END || '],"notes":[],"trigger":"build"}}'
 WHEN 'METADATA/REJECTED' THEN '{{"reason":"not sharp enough","state_before":"human_review"}}'
 WHEN 'METADATA/ESCALATED' THEN '{{"reason":"second look","state_before":"draft"}}'
 WHEN 'READINESS/EVALUATED' THEN '{{"k":' || k || {_json_fp('fp_readiness')} || ',"ready_for":' || {_READY} || ',"platforms":{{' || {_platform_json('adobe', 'adobe-2026-09')} || ',' || {_platform_json('shutterstock', 'shutterstock-2026-09')} || '}}}}'
 WHEN 'READINESS/FAILED' THEN '{{"error_type":"OSError","error":"read"}}'
 WHEN 'CREATIVE_REVIEW/ADVISED' THEN '{{"k":' || k || {_json_fp('CASE WHEN value < 6 THEN fp_creative1 ELSE fp_creative END')} || ',"profile":{{"name":"' || CASE WHEN k < 36 THEN 'industrial_stock' WHEN k < 38 THEN 'nature_stock' ELSE 'travel_stock' END || '","selection":{{"mode":"' || CASE WHEN k < 20 THEN 'auto' WHEN k < 30 THEN 'explicit' ELSE 'default' END || '"}}}},"prompt_version":"' || CASE WHEN value < 6 THEN 'creative-v1' ELSE 'creative-v2' END || '","features":{{"composition":"' || CASE WHEN value < 30 THEN 'good' WHEN value < 60 THEN 'acceptable' ELSE 'weak' END || '","demand":"' || CASE WHEN k < 20 THEN 'high' WHEN k < 30 THEN 'medium' ELSE 'low' END || '","uniqueness":"' || CASE WHEN k < 18 THEN 'medium' WHEN k < 28 THEN 'high' ELSE 'low' END || '","commercial_use_cases":[' || CASE WHEN value < 20 THEN '' WHEN value < 40 THEN '"manual"' ELSE '"manual","report","web"' END || '],"recommendation":"' || CASE WHEN k < 36 THEN 'proceed' WHEN k < 38 THEN 'attention' ELSE 'skip_suggested' END || '"}}}}'
 WHEN 'CREATIVE_REVIEW/FAILED' THEN '{{"error_type":"TimeoutError"}}'
 WHEN 'PUBLICATION/EVALUATED' THEN '{{"policy_version":"publication-v1","approved_for":' || CASE WHEN k < 78 THEN '[]' WHEN value < 20 THEN '["adobe"]' ELSE '["adobe","shutterstock"]' END || ',"fingerprint":"sha256:' || @SHA<pub_head || pub_tail> || '","inputs":' || pub_head || ',"readiness_event_id":' || id || pub_tail || '}}'
 WHEN 'DERIVATIVE/CREATED' THEN '{{"purpose":"' || CASE WHEN k < 68 THEN 'export' ELSE 'internal' END || '","platform":"' || {_PLATFORM} || '","path":"export/' || {_PLATFORM} || '/' || asset_id || '.jpg","filename":"frame_' || asset_id || '.jpg","text":"frame number ' || k || '","sha256":"' || @SHA<'export-' || asset_id> || '","size_bytes":' || (100 + asset_id) || CASE WHEN value < 2 THEN '' ELSE ',"inputs_fingerprint":"' || ({_stored(f'CASE WHEN {_PLATFORM} = {_ADOBE} THEN coalesce(fp_export_adobe, {_OLDER}) ELSE coalesce(fp_export_shutterstock, {_OLDER}) END')}) || '"' END || '}}'
 WHEN 'EXPORT/FAILED' THEN '{{"platform":"' || {_PLATFORM} || '","code":"' || CASE WHEN k < 74 THEN 'NOT_READY' ELSE 'STALE' END || '","error":"refused"}}'
 WHEN 'OUTBOX/COLLECTED' THEN '{{"platform":"' || {_PLATFORM} || '","batch":' || (k - 77) || ',"folder":"publish/' || {_PLATFORM} || '/' || @LPAD<CAST(k - 77 AS {{STR}})|3> || '_2024-02-01","filename":"frame_' || asset_id || '.jpg","sha256":"' || CASE WHEN value < 50 THEN @SHA<'export-' || asset_id> ELSE 'other' END || '"}}'
 WHEN 'HUMAN/PEOPLE_ATTESTED' THEN '{{"kind":"' || CASE WHEN k < 90 THEN 'not_identifiable' WHEN k < 92 THEN 'release_on_file' ELSE 'none' END || '","note":"n","file_hash":"' || CASE WHEN value < 10 THEN 'other' ELSE file_hash END || '"}}'
 WHEN 'NOTIFY/SENT' THEN '{{"channel":"test","kind":"' || CASE WHEN k < 6 THEN 'retry_exhausted' ELSE 'daily_digest' END || '","severity":"warning","title":"notice","key":"' || CASE WHEN k < 6 THEN 'AI:' || k ELSE '2024-01-' || @LPAD<CAST(k AS {{STR}})|2> END || '"}}'
 WHEN 'REPROCESS/DONE' THEN '{{"reprocess_from":"qc","outcome":"' || CASE WHEN k < 97 THEN 'REPROCESSED' ELSE '' END || '","reason":' || CASE WHEN k < 96 THEN '"requested"' ELSE 'null' END || '}}'
 ELSE '{{"k":' || k || '}}'
END
"""

# what publication decisions name as their inputs: some an older policy, some an older profile
_PUB_HEAD = """'{"advice":{"current":' || CASE WHEN k < 96 THEN 'true,"recommendation":"proceed"' ELSE 'false,"recommendation":null' END || '},"policy_version":"' || CASE WHEN value < 4 THEN 'publication-v0' ELSE 'publication-v1' END
 || '","profiles":{"adobe":"' || CASE WHEN value >= 4 AND value < 8 THEN 'adobe-2026-03' ELSE 'adobe-2026-09' END || '","shutterstock":"shutterstock-2026-09"}'"""
_PUB_TAIL = """',"readiness_fingerprint":' || coalesce('"' || ready_fp || '"', 'null') || ',"source_sha256":"' || file_hash || '"}'"""

_RAW_EVENTS = f"""SELECT *, {_pair_case()} AS pair FROM (SELECT event_id AS id, user_id AS asset_id, ts AS created_at, event_type, value, CAST(@JSON<props|$.k> AS INT) AS k FROM events)"""

_EVENTS = f"""
SELECT id, asset_id, split_part(pair, '/', 1) AS stage, split_part(pair, '/', 2) AS status, {_MESSAGE} AS message, created_at, value, k
FROM (SELECT *, {_PUB_HEAD} AS pub_head, {_PUB_TAIL} AS pub_tail FROM ({_RAW_EVENTS}) JOIN b_prints USING (asset_id))
"""

# --- catalogue, files ------------------------------------------------------------------------
# (state of the metadata document by label and language; other members by source)
_MD_STATE = ("CASE WHEN toxic = 1 THEN 'human_review' WHEN quality = 0 THEN 'rejected' WHEN quality = 1 THEN 'approved' "
             "WHEN lang = 'en' THEN 'auto_approved' WHEN lang = 'de' THEN 'draft' WHEN lang = 'fr' THEN 'human_review' END")

_MD_FIELDS = "CASE WHEN md_state IS NOT NULL THEN '{\"title\":\"' || filename || '\"}' END"
_ASSETS = f"""
  SELECT *, CASE WHEN md_state IS NOT NULL THEN CASE WHEN source = 'src2' THEN 'partial' ELSE 'full' END END AS completeness, {_MD_FIELDS} AS fields,
    NOT (lang = 'es' AND n_chars < 2000) AND NOT (lang = 'de' AND source = 'src7') AND n_chars >= 150 AS qc_passed,
    CASE WHEN n_chars BETWEEN 300 AND 400 THEN NULL ELSE '{{"analysis_version":"1.0","confidence":0.5}}' END AS ai_result
  FROM (SELECT doc_id AS asset_id, source || '/' || doc_id || '.jpg' AS filename, n_chars AS file_size, lang, source, n_chars, {_MD_STATE} AS md_state FROM documents LEFT JOIN labels USING (doc_id))"""

# What the services knew of an asset when they wrote their results: newest events, metadata, and the fingerprints of these.
_CONTEXT = f"""
SELECT asset_id, max(CASE WHEN pair = 'NORMALIZE/EVALUATED' THEN id END) AS facts_event_id, max(CASE WHEN pair = 'SOURCE/INVALID' THEN id END) AS source_event_id, max(CASE WHEN pair = 'AI/PASSED' THEN id END) AS ai_event_id,
  max(CASE WHEN pair = 'HUMAN/PEOPLE_ATTESTED' THEN id END) AS attested_id, max_by(k, CASE WHEN pair = 'HUMAN/PEOPLE_ATTESTED' THEN id END) AS attested_k, max_by(value, CASE WHEN pair = 'HUMAN/PEOPLE_ATTESTED' THEN id END) AS attested_value,
  max_by(k, CASE WHEN pair = 'READINESS/EVALUATED' THEN id END) AS ready_k, max_by(value, CASE WHEN pair = 'READINESS/EVALUATED' THEN id END) AS ready_value
FROM ({_RAW_EVENTS}) GROUP BY asset_id
"""
_PRINTS_VIEW = _with_prints(f"""
  SELECT asset_id, @SHA<'asset-' || asset_id> AS file_hash, facts_event_id, source_event_id, attested_id, attested_k, attested_value, ready_k, ready_value, md_state, completeness, fields, qc_passed, ai_result,
    CASE WHEN md_state IS NULL THEN NULL WHEN source = 'src14' THEN ai_event_id - 1 ELSE ai_event_id END AS vision_event_id
  FROM ({_ASSETS}) FULL JOIN b_context USING (asset_id)""")

_CATALOG = f"""
SELECT asset_id, file_hash, filename, 'incoming/' || filename AS source_path, file_size, fp_facts, fp_rep, fp_view, fp_qc, fp_enh, fp_vision,
       fp_readiness, fp_creative, fp_creative1, fp_export_adobe, fp_export_shutterstock, source, lang,
  CASE WHEN lang = 'es' AND n_chars < 2000 THEN NULL WHEN lang = 'de' AND source = 'src7' THEN '{{}}' ELSE
    '{{"passed":' || CASE WHEN n_chars < 150 THEN 'false' ELSE 'true' END ||
    ',"errors":[' || CASE WHEN n_chars < 150 THEN '"FILE_TOO_SMALL","VIEW_UNAVAILABLE: DECODE_ERROR"' ELSE '' END ||
    '],"warnings":[' || CASE WHEN source = 'src9' THEN '"EDGE_BORDER"' WHEN n_chars < 1000 THEN '"RESOLUTION_BELOW_RECOMMENDED"' ELSE '' END || ']' ||
    CASE WHEN source = 'src9' THEN ',"edge_border":[{{"side":"top","width":11}},{{"side":"left","width":4}}]' ELSE '' END ||
    CASE WHEN source = 'src3' THEN '' WHEN source IN ('src5', 'src6') THEN ',"input_fingerprint":"sha256:older"' ELSE ',"input_fingerprint":"' || fp_qc || '"' END ||
    ',"inputs":{{"view":"' || CASE WHEN lang = 'en' THEN fp_view ELSE 'sha256:older' END || '","rules":' || CASE WHEN source = 'src6' THEN replace({_json(fixed.QC_RULES)}, '"edge_dark":25', '"edge_dark":20') ELSE {_json(fixed.QC_RULES)} END || '}}}}' END AS qc_result,
  ai_result,
  CASE WHEN md_state IS NULL THEN NULL ELSE
    '{{"state":"' || md_state || '","completeness":"' || CASE WHEN source = 'src2' THEN 'partial' ELSE 'full' END ||
    '","fields":' || fields || ',"edited_fields":[' || CASE WHEN source = 'src13' THEN '"title"' ELSE '' END ||
    '],"review":{{"reason":' || CASE WHEN md_state = 'rejected' THEN '"duplicate of a better frame","decided_at":"2024-01-15T10:00:00+00:00"' ELSE 'null' END ||
    '}},"sources":{{"builder_version":"' || CASE WHEN source = 'src11' THEN 'metadata-v0' ELSE 'metadata-v1' END ||
    '"}},"grounding":{{"specific_claims":[{{"term":"Alpha","confirmed":true}}' || CASE WHEN lang = 'fr' THEN ',{{"term":"Beta","confirmed":false}}' ELSE '' END ||
    ']}},"validation":{{"errors":[' || CASE WHEN lang = 'fr' THEN '{{"code":"UNCONFIRMED_CLAIM"}}' WHEN source = 'src4' THEN '{{"code":"TITLE_TOO_LONG"}}' ELSE '' END ||
    '],"warnings":[' || CASE WHEN n_chars > 3000 THEN '{{"code":"TITLE_LONG"}}' ELSE '' END ||
    ']}},"review_gate":{{"policy_version":"' || CASE WHEN source = 'src12' THEN 'gate-v1.2' ELSE 'gate-v1.3' END || '","reasons":[' ||
    CASE WHEN md_state = 'human_review' AND lang = 'fr' THEN '{{"code":"PEOPLE_RECOGNIZABLE","detail":"face"}},{{"code":"EDITORIAL_RISK","detail":"news"}}'
         WHEN md_state = 'human_review' AND lang = 'en' THEN '{{"code":"TRADEMARK","detail":"x"}}' ELSE '' END ||
    '],"notes":[' || CASE WHEN lang = 'en' THEN '{{"code":"TEXT_DESCRIPTIVE"}}' ELSE '' END || ']' || CASE WHEN source = 'src6' THEN ',"text_items":[{{"text":"text-4b"}},{{"text":"Enhancement_Not"}},{{"text":"SRC6"}}]' ELSE '' END ||
    CASE WHEN source = 'src10' THEN ',"escalation":{{"reason":"second look"}}' WHEN source = 'src9' AND lang = 'de' THEN ',"escalation":{{"reason":"EDGE_BORDER: earlier"}}' ELSE '' END ||
    '}}}}' END AS metadata_json
FROM ({_ASSETS}) JOIN (SELECT asset_id, file_hash, fp_facts, fp_rep, fp_view, fp_qc, fp_enh, fp_vision, fp_readiness, fp_creative, fp_creative1, fp_export_adobe, fp_export_shutterstock FROM b_prints) USING (asset_id)"""

_LISTING = """
SELECT CASE WHEN lang = 'de' AND n_chars > 5000 THEN 'moved/' ELSE 'incoming/' END || source || '/' || doc_id || '.jpg' AS path,
       CASE WHEN lang = 'es' AND n_chars > 3000 THEN n_chars + 1 ELSE n_chars END AS size_bytes,
       CASE WHEN lang = 'fr' AND n_chars > 3000 THEN @SHA<'edited-' || doc_id> ELSE @SHA<'asset-' || doc_id> END AS sha256
FROM documents
UNION ALL
SELECT 'internal/' || doc_id || '.png', n_chars * 2, CASE WHEN lang = 'fr' THEN @SHA<'edited-' || doc_id> ELSE @SHA<'internal-' || doc_id> END
FROM documents WHERE lang <> 'es'
UNION ALL
SELECT 'export/adobe/' || doc_id || '.jpg', 100 + doc_id + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END,
       CASE WHEN lang = 'fr' THEN @SHA<'edited-' || doc_id> ELSE @SHA<'export-' || doc_id> END
FROM documents WHERE lang <> 'es'
UNION ALL
SELECT 'export/shutterstock/' || doc_id || '.jpg', 100 + doc_id, @SHA<'export-' || doc_id>
FROM documents WHERE lang <> 'es'
"""

# content-addressed registration: labelled documents are the registry, all documents arrive
_REGISTRY = """
SELECT doc_id AS id, source || '/' || doc_id || '.' || lang AS filename,
       'incoming' || CASE WHEN lang = 'en' THEN '\\\\' ELSE '/' END || source || '/' || doc_id || '.' || lang AS source_path,
       @SHA<text> AS file_hash, '.' || lang AS extension, n_chars AS file_size
FROM documents JOIN labels USING (doc_id)
"""
_ARRIVALS = """
SELECT 'incoming/' || source || '/' || doc_id || '.' || lang AS path, '.' || lang AS extension, @SHA<text> AS file_hash,
       n_chars AS file_size, doc_id, lang
FROM documents
"""

# --- documents of the rules ------------------------------------------------------------------
# What a vision model would say, by source and language: the whole text as description, its lines as visible text.
_SUBJECTS = (
    "industrial control panel with cables", "worker with gloves near machinery", "portrait of an engineer",
    "children on a playground", "facade of a residential building", "forest landscape with trees",
    "passport and identity card on a table", "company logo on a wall", "hand tool on a bench", "elevator shaft wiring",
    "person from behind, face not visible", "texture of rusty metal surface", "car on a highway", "robot arm at a factory",
    "smartphone and computer device", "snow mountain at sunset", "woman smiling at the office", "concrete background pattern",
    "electrician silhouette in a shaft", "flowers in a garden",
)
_SUBJECT_CASE = "CASE source " + " ".join(f"WHEN 'src{i}' THEN '{s}'" for i, s in enumerate(_SUBJECTS)) + " ELSE source END"

_VISION = f"""
SELECT asset_id, subject, title, text AS description, 'use in ' || lang AS commercial_context,
       @ARR<source> AS technical_subjects, @WORDS<subject> AS keywords,
       CASE WHEN lang = 'en' THEN @ARR<'Industrial'> WHEN lang = 'fr' THEN @ARR<'Nature'|'Parks'> ELSE @NOARR END AS categories,
       COALESCE(toxic, 0) = 1 AS people_present, CAST(COALESCE(quality, 0) AS INT) AS people_count,
       CASE WHEN lang = 'en' THEN @ARR<first_word> ELSE @NOARR END AS brands,
       CASE WHEN lang = 'de' THEN @ARR<last_word> WHEN lang = 'es' THEN @ARR<''> ELSE @NOARR END AS logos,
       text_lines AS text_visible,
       CASE WHEN toxic = 1 AND lang <> 'en' THEN @ARR<'newsworthy event'> ELSE @NOARR END AS editorial_risk,
       COALESCE(quality = 0, FALSE) AS ai_generated, text, lang, quality, toxic
FROM (
  SELECT doc_id AS asset_id, text, lang, source, quality, toxic, {_SUBJECT_CASE} AS subject,
         @ITEM<@LINES<text>|1> AS title, @ITEM<@WORDS<text>|1> AS first_word, @LAST<@WORDS<text>> AS last_word,
         @LINES<text> AS text_lines
  FROM documents LEFT JOIN labels USING (doc_id))
"""

# A metadata document: whole text as description, its first line as title, its lines as raw keywords.
_METADATA = """
SELECT asset_id, text AS description, title, text_visible AS raw_keywords, lang, quality, toxic,
       CASE WHEN quality IS NULL THEN 'draft' WHEN toxic = 1 THEN 'human_review' WHEN quality = 0 THEN 'rejected'
            WHEN lang = 'en' THEN 'approved' ELSE 'auto_approved' END AS state,
       CASE WHEN lang = 'es' THEN 'partial' ELSE 'full' END AS completeness
FROM b_vision
"""

_FACTS = """
SELECT p_partkey AS asset_id, p_size * 1000 AS width, CASE WHEN p_type = 'SMALL' THEN 500 ELSE 1000 END + p_size * 60 AS height,
       CAST(round((p_retailprice - 900) * 1000000) AS BIGINT) AS file_size,
       CASE p_type WHEN 'SMALL' THEN 'PNG' WHEN 'STANDARD' THEN 'TIFF' WHEN 'MEDIUM' THEN 'AVIF' WHEN 'PROMO' THEN 'HEIF'
            WHEN 'LARGE' THEN 'GIF' ELSE 'JPEG' END AS container,
       CASE p_type WHEN 'STANDARD' THEN 'TIFF' WHEN 'SMALL' THEN 'PNG' ELSE 'JPEG' END AS format,
       CASE WHEN p_size < 30 THEN 'srgb' WHEN p_size < 40 THEN 'other' ELSE 'undeclared' END AS color_kind,
       p_size < 45 AS color_declared, CASE WHEN p_size > 35 THEN NULL ELSE 'icc-' || p_brand END AS icc_sha256,
       CASE WHEN p_size > 33 THEN NULL ELSE 'RGB' END AS icc_color_space, p_brand AS color_source,
       CASE WHEN p_brand = 'Brand#7' THEN 'CMYK' WHEN p_brand = 'Brand#8' THEN 'L' ELSE 'RGB' END AS color_mode,
       CASE WHEN p_brand = 'Brand#3' THEN 'pq' WHEN p_brand = 'Brand#4' THEN 'hlg' WHEN p_brand = 'Brand#5' THEN 'gain_map' ELSE NULL END AS hdr,
       CASE WHEN p_brand = 'Brand#9' THEN 2 ELSE 1 END AS frames_readable, 1 AS frames_declared,
       CASE WHEN p_brand = 'Brand#10' THEN 16 WHEN p_brand = 'Brand#11' THEN 10 ELSE 8 END AS bit_depth,
       p_brand = 'Brand#12' AS has_alpha, CASE WHEN p_size < 4 THEN NULL ELSE p_size * 2 END AS jpeg_quality,
       CASE WHEN p_size < 3 THEN 6 ELSE 1 END AS orientation, p_brand = 'Brand#1' AS motion_video, p_brand = 'Brand#2' AS c2pa,
       p_name AS software, p_size <> 9 AS qc_passed, CASE WHEN p_size = 8 THEN 'changed' ELSE 'ok' END AS source_status,
       p_size <> 7 AS unchanged, CASE WHEN p_size = 6 THEN 'png' ELSE 'jpg' END AS declared_extension
FROM part
"""

# exports joined to collection state: one row per order line
_BATCHES = """
SELECT o_orderkey AS asset_id, CASE l_returnflag WHEN 'A' THEN 'adobe' ELSE 'shutterstock' END AS platform,
       CAST(l_linenumber AS BIGINT) AS batch, CAST(l_partkey AS VARCHAR_T) AS sha256, o_orderkey * 10 + l_linenumber AS id,
       o_orderstatus, l_linestatus, l_returnflag, l_quantity, l_extendedprice, l_partkey, l_suppkey, o_orderpriority
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
"""

VIEWS = {
    "b_context": _CONTEXT, "b_prints": _PRINTS_VIEW, "b_events": _EVENTS, "b_catalog": _CATALOG, "b_files": _LISTING, "b_registry": _REGISTRY, "b_arrivals": _ARRIVALS,
    "b_vision": _VISION, "b_metadata": _METADATA, "b_facts": _FACTS, "b_batches": _BATCHES,
}
# further views that exist only on the SQL side (results of earlier operators, written by query modules)
SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, body: str) -> None:
    SQL_VIEWS[name] = body


def _duck(body: str) -> str:
    return _render(body.replace("{STR}", "VARCHAR"), "duckdb").replace("VARCHAR_T", "VARCHAR").replace("'\\\\'", "'\\'")


def _mentions(name: str, text: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def sql_with(body: str) -> str:
    """Prepends the CTEs a SQL text needs, in dependency order."""
    known = {**{k: _duck(v) for k, v in VIEWS.items()}, **SQL_VIEWS}
    ordered: list[str] = []

    def add(text: str) -> None:
        for name, view in known.items():
            if name not in ordered and _mentions(name, text):
                add(view)
                if name not in ordered:
                    ordered.append(name)

    add(body)
    if not ordered:
        return body
    ctes = ", ".join(f"{name} AS MATERIALIZED ({known[name]})" for name in ordered)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes}, {stripped[5:]}"
    return f"WITH {ctes} {stripped}"


_STORED = {"b_events": ("stage",), "b_catalog": ()}
_TEXT_TABLES = ("documents", "conversations", "pages")
_TABLES: dict[tuple, DataFrame] = {}


class Tables:
    """Driver tables and binding views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A driver table, read as it lies. The text tables of the test data are files of one row group, which one task
        reads; a session may ask for them to be dealt out with ``plateworks.text.partitions``."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        parts = self.spark.conf.get("plateworks.text.partitions", None) if name in _TEXT_TABLES else None
        return df.repartition(int(parts)) if parts else df

    def version(self, name: str) -> tuple:
        """Newest change and size of the files below a view; another value means that a stored copy is stale."""
        body = VIEWS.get(name)
        if body is None:
            return self._files(f"{self.folder}/{name}.parquet")
        below = [n for n in (*DRIVER_TABLES, *VIEWS) if n != name and re.search(rf"(FROM|JOIN)\s+{n}\b", body)]
        return tuple(self.version(n) for n in below)

    def _files(self, path: str) -> tuple:
        """Newest change, size and number of the files below a path, as the file system lists them: no job, no read."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found, newest, size, count = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listFiles(top, True), 0, 0, 0
        while found.hasNext():
            status = found.next()
            newest, size, count = max(newest, status.getModificationTime()), size + status.getLen(), count + 1
        return newest, size, count

    def view(self, name: str) -> DataFrame:
        """A binding view; the log and the catalogue are written once per application, folder and version of its files, the
        log partitioned by stage, because a catalogue keeps them as tables that every report reads."""
        if name not in _STORED:
            return self.compose(name)
        key = (self.spark.sparkContext.applicationId, self.folder, name, self.version(name))
        if key not in _TABLES:
            _TABLES[key] = materialize(self.compose(name), name, _STORED[name])
        return _TABLES[key]

    def compose(self, name: str, **given: DataFrame) -> DataFrame:
        """A view over the driver's tables, some of which may be given (for example as streams)."""
        body = _render(VIEWS[name].replace("{STR}", "STRING"), "spark").replace("VARCHAR_T", "STRING")
        # name every input relation as a parameter so Spark binds DataFrames without global temp views
        inputs = {t: given[t] if t in given else self.table(t) for t in DRIVER_TABLES if re.search(rf"(FROM|JOIN)\s+{t}\b", body)}
        inputs |= {v: self.view(v) for v in VIEWS if v != name and re.search(rf"(FROM|JOIN)\s+{v}\b", body)}
        body = body.replace("{", "{{").replace("}", "}}")
        for table in inputs:
            body = re.sub(rf"(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", body)
        return self.spark.sql(body, **inputs)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("b_"):
            return self.view(name)
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)
