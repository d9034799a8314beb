"""Queries of registration, documents and integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import documents as doc
from plateworks.functions import fingerprints as fp
from plateworks.functions.arrays import joined
from plateworks.operators import documents, ingest, integrity, log
from plateworks.operators.eventstore import EventStore
from plateworks.plans import bindings
from plateworks.plans.bindings import Tables
from plateworks.plans.registry import query
from plateworks.plans.stage_queries import state_table
from plateworks.session import materialize, shared_checkpoint_dir
from plateworks.sources import sinks

_J = "json_extract_string"
_EXT = (".en", ".de", ".fr")  # suffixes of the binding that count as supported


@query("src_scan_files", "SELECT path, size_bytes FROM b_files WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|tif|tiff|avif)$')")
def src_scan_files(t: Tables):
    return ingest.supported(t.b_files).select("path", "size_bytes")


@query("src_content_hash", "SELECT page_id, url, sha256(html) AS sha256 FROM pages")
def src_content_hash(t: Tables):
    return ingest.content_hash(t.pages, "html").select("page_id", "url", "sha256")


def store_folder(t: Tables) -> str:
    return f"{shared_checkpoint_dir(t.spark)}/plateworks/store-{uuid.uuid4().hex}"


def _arrivals(t: Tables):
    return t.b_arrivals.withColumn("decodable", F.col("file_size") >= 100)


@query("src_register_dedup", """
WITH c AS (SELECT *, file_size >= 100 AS decodable, CASE WHEN extension NOT IN ('.en', '.de', '.fr') THEN 'UNSUPPORTED' END AS refused FROM b_arrivals),
firsts AS (SELECT file_hash, min(path) FILTER (WHERE decodable) AS path FROM c WHERE refused IS NULL AND file_hash NOT IN (SELECT file_hash FROM b_registry) GROUP BY file_hash),
fresh AS (SELECT path, row_number() OVER (ORDER BY path) + (SELECT max(id) FROM b_registry) AS asset_id FROM firsts WHERE path IS NOT NULL)
SELECT path, file_hash, asset_id, CASE WHEN refused IS NOT NULL THEN refused WHEN asset_id IS NOT NULL THEN 'REGISTERED' WHEN NOT decodable THEN 'UNDECODABLE' ELSE 'DUPLICATE' END AS outcome
FROM c LEFT JOIN fresh USING (path)""")
def src_register_dedup(t: Tables):
    return ingest.register(_arrivals(t), t.b_registry, _EXT)


@query("src_incoming_pending", """
SELECT a.path, a.file_hash, d.id AS duplicate_of FROM b_arrivals a LEFT JOIN (SELECT file_hash, max(id) AS id FROM b_registry GROUP BY file_hash) d USING (file_hash)
WHERE a.path NOT IN (SELECT replace(source_path, '\\', '/') FROM b_registry)""")
def src_incoming_pending(t: Tables):
    return ingest.pending(t.b_arrivals, t.b_registry).select("path", "file_hash", "duplicate_of")


@query("src_batch_classify", """
SELECT a.path, p.id AS by_path, h.id AS by_hash, CASE WHEN p.id IS NOT NULL THEN 'already_registered' WHEN h.id IS NOT NULL THEN 'duplicate_content' ELSE 'new' END AS kind
FROM b_arrivals a LEFT JOIN (SELECT source_path, max(id) AS id FROM b_registry GROUP BY 1) p ON p.source_path = a.path
LEFT JOIN (SELECT file_hash, max(id) AS id FROM b_registry GROUP BY 1) h ON h.file_hash = a.file_hash""")
def src_batch_classify(t: Tables):
    return ingest.classify(t.b_arrivals, t.b_registry).select("path", "by_path", "by_hash", "kind")


@query("src_path_normalize", "SELECT id, source_path AS old, replace(source_path, '\\', '/') AS new FROM b_registry WHERE contains(source_path, '\\')")
def src_path_normalize(t: Tables):
    return ingest.path_changes(t.b_registry).select("id", "old", "new")


@query("src_container_magic", "SELECT asset_id, CASE WHEN container <> 'GIF' THEN container END AS container FROM b_facts")
def src_container_magic(t: Tables):
    heads = {"JPEG": "FFD8FFE0", "PNG": "89504E470D0A1A0A", "TIFF": "49492A00", "AVIF": "000000186674797061766966", "HEIF": "000000186674797068656963"}
    content = F.unhex(F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])[F.col("container")])
    return t.b_facts.select("asset_id", ingest.container(F.concat(F.coalesce(content, F.lit(b"GIF89a")), F.encode("software", "UTF-8"))).alias("container"))


@query("src_extension_mismatch", """
SELECT asset_id, declared_extension, container FROM b_facts WHERE container IS DISTINCT FROM CASE declared_extension WHEN 'jpg' THEN 'JPEG' WHEN 'png' THEN 'PNG' END""")
def src_extension_mismatch(t: Tables):
    declared = ingest.extension_container(F.concat(F.lit("."), "declared_extension"))
    return t.b_facts.filter(~declared.eqNullSafe(F.col("container"))).select("asset_id", "declared_extension", "container")


@query("src_unreadable_class", """
SELECT c.asset_id, CASE WHEN f.sha256 IS NULL THEN 'SOURCE_MISSING' WHEN f.sha256 <> c.file_hash THEN 'SOURCE_CHANGED' WHEN x.jpeg_quality IS NOT NULL THEN NULL WHEN x.container = 'HEIF' THEN 'MISSING_CODEC'
 WHEN x.container <> 'GIF' THEN 'DECODE_ERROR' ELSE 'UNSUPPORTED_FORMAT' END AS code FROM b_catalog c LEFT JOIN b_facts x USING (asset_id) LEFT JOIN b_files f ON f.path = c.source_path""")
def src_unreadable_class(t: Tables):
    facts = t.b_facts.select("asset_id", F.nullif("container", F.lit("GIF")).alias("container"), F.col("jpeg_quality").isNotNull().alias("decodable"))
    files = t.b_files.select(F.col("path").alias("source_path"), F.col("sha256").alias("actual_hash"))
    rows = t.b_catalog.select("asset_id", "file_hash", "source_path").join(facts, "asset_id", "left").join(files, "source_path", "left")
    return ingest.unreadable(rows).select("asset_id", "code")


@query("src_id_filter", "SELECT asset_id, filename FROM b_catalog WHERE asset_id >= 1 AND asset_id IN (SELECT doc_id FROM labels)")
def src_id_filter(t: Tables):
    return ingest.restrict(t.b_catalog, 1, ids=t.labels.withColumnRenamed("doc_id", "asset_id")).select("asset_id", "filename")


@query("src_user_set", """
SELECT id AS asset_id, NULL AS path FROM b_registry WHERE file_hash IN (SELECT file_hash FROM b_arrivals)
UNION ALL SELECT NULL, path FROM b_arrivals WHERE file_hash NOT IN (SELECT file_hash FROM b_registry)""")
def src_user_set(t: Tables):
    return ingest.user_set(t.b_registry, t.b_arrivals)


@query("src_event_append", """
SELECT row_number() OVER (ORDER BY r.id) + (SELECT max(id) FROM b_events) AS id, r.id AS asset_id, 'SOURCE' AS stage, 'NORMALIZED' AS status, replace(source_path, '\\', '/') AS new_path
FROM b_registry r WHERE contains(source_path, '\\')""")
def src_event_append(t: Tables):
    """The events of the normalised paths, appended in one commit; the second append of the same key adds nothing."""
    new = ingest.path_changes(t.b_registry).select(F.col("id").alias("asset_id"), F.lit("SOURCE").alias("stage"), F.lit("NORMALIZED").alias("status"), "message")
    store = EventStore(t.spark, store_folder(t), t.b_events)
    for _ in range(2):
        store.append("paths", new, ("asset_id",))
    return store.appended().select("id", "asset_id", "stage", "status", F.get_json_object("message", "$.new").alias("new_path"))


@query("src_actor_stamp", r"""
SELECT id, CASE WHEN NOT json_valid(message) THEN message WHEN json_extract_string(message, '$.actor') IS NOT NULL THEN regexp_replace(message, '"actor":"[^"]*"', '"actor":"agent:planner"')
 ELSE message[1:-2] || ',"actor":"agent:planner"}' END AS message FROM b_events""")
def src_actor_stamp(t: Tables):
    return t.b_events.select("id", ingest.stamp_actor(F.col("message"), "agent:planner").alias("message"))


@query("src_manifest_sink", """
SELECT platform, batch, count(*) AS files, sum(CAST(l_quantity AS BIGINT))::BIGINT AS words, count(DISTINCT sha256) AS contents FROM b_batches GROUP BY platform, batch""")
def src_manifest_sink(t: Tables):
    rows = t.b_batches.select("platform", "batch", "asset_id", F.concat(F.lit("f_"), "sha256", F.lit(".jpg")).alias("filename"), F.col("o_orderpriority").alias("text"),
                              F.col("l_quantity").cast("bigint").alias("words"), "sha256")
    read = sinks.write_manifest(rows, "manifest")
    return read.groupBy("platform", "batch").agg(F.count("*").alias("files"), F.sum("words").alias("words"), F.countDistinct("sha256").alias("contents"))


@query("src_jsonl_sink", "SELECT extension, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM b_arrivals GROUP BY extension")
def src_jsonl_sink(t: Tables):
    read = sinks.write_jsonl(t.b_arrivals.select("path", "extension", "file_hash", "file_size"), "arrivals")
    return read.groupBy("extension").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


# --- documents -------------------------------------------------------------------------------

@query("jsn_tolerant_parse", f"SELECT id, json_valid(message) AS parsed, CASE WHEN json_valid(message) THEN {_J}(message, '$.fingerprint') END AS fingerprint FROM b_events")
def jsn_tolerant_parse(t: Tables):
    document = doc.decode(F.col("message"), "fingerprint STRING")
    return t.b_events.select("id", document.isNotNull().alias("parsed"), document["fingerprint"].alias("fingerprint"))


@query("jsn_parse_or_text", f"SELECT id, CASE WHEN json_valid(message) THEN {_J}(message, '$.provider') END AS provider, CASE WHEN NOT json_valid(message) THEN message END AS text FROM b_events")
def jsn_parse_or_text(t: Tables):
    is_doc = doc.is_json(F.col("message"))
    return t.b_events.select("id", F.when(is_doc, F.get_json_object("message", "$.provider")).alias("provider"), F.when(~is_doc, F.col("message")).alias("text"))


@query("jsn_strip_key", """
SELECT id, array_to_string(list_sort(list_filter(json_keys(CASE WHEN json_valid(message) THEN message END), lambda k: k <> 'actor')), ',') AS members FROM b_events""")
def jsn_strip_key(t: Tables):
    kept = F.map_filter(F.from_json("message", "map<string,string>"), lambda k, v: k != "actor")
    members = joined(F.array_sort(F.map_keys(kept)))
    return t.b_events.select("id", F.when(doc.is_json_object(F.col("message")), members).alias("members"))


@query("jsn_path_filter", f"SELECT id, asset_id, {_J}(message, '$.kind') AS kind, {_J}(message, '$.key') AS key FROM b_events WHERE stage = 'NOTIFY' AND status = 'SENT' AND json_valid(message) AND {_J}(message, '$.kind') = 'retry_exhausted'")
def jsn_path_filter(t: Tables):
    m = F.col("message")
    rows = t.b_events.filter((F.col("stage") == "NOTIFY") & (F.col("status") == "SENT") & doc.is_json(m) & (doc.field(m, "$.kind") == "retry_exhausted"))
    return rows.select("id", "asset_id", doc.field(m, "$.kind").alias("kind"), doc.field(m, "$.key").alias("key"))


_DECISION = {"advice": {"current": True, "recommendation": "proceed"}, "policy_version": fixed.PUBLICATION_POLICY_VERSION, "profiles": {p["platform"]: p["version"] for p in fixed.PLATFORM_PROFILES}}


@query("jsn_changed_keys", f"""
SELECT id, array_to_string(list_filter(['advice', 'policy_version', 'profiles', 'readiness_fingerprint', 'source_sha256'], lambda k: nullif(CAST(json_extract(message, '$.inputs.' || k) AS VARCHAR), 'null')
 IS DISTINCT FROM CASE k {" ".join(f"WHEN '{k}' THEN '{fp.constant_text(v)}'" for k, v in _DECISION.items())} END), ',') AS changed FROM b_events WHERE stage = 'PUBLICATION'""")
def jsn_changed_keys(t: Tables):
    """Inputs of stored decisions that differ, at any depth, from one set of inputs; the event id is ignored."""
    stored = F.get_json_object("message", "$.inputs")
    changed = fp.changed_members(stored, F.lit(fp.constant_text(_DECISION)), fp.PUBLICATION_IGNORED)
    return t.b_events.filter("stage = 'PUBLICATION'").select("id", joined(changed).alias("changed"))


# a model answer per part: some are cut off, some break a type or a range
_ANSWER = """CASE WHEN p_size = 13 THEN '{"title":"' || p_name ELSE '{"title":"' || p_name || '","people":{"present":' || CASE WHEN p_size = 14 THEN '"maybe"' ELSE 'true' END || ',"count":' || CAST(p_size - 3 AS STRING_T)
 || '},"keywords":' || CASE WHEN p_size = 15 THEN '"one"' ELSE '["' || p_type || '"]' END || ',"confidence":' || CASE WHEN p_size > 45 THEN '1.2' ELSE '0.5' END || '}' END"""


@query("jsn_strict_decode", f"""
SELECT asset_id, CASE WHEN p_size = 13 THEN 'NOT_JSON' WHEN p_size = 15 THEN 'TYPE:keywords' WHEN p_size = 14 THEN 'TYPE:people.present' WHEN p_size < 3 THEN 'RANGE:people.count' WHEN p_size > 45 THEN 'RANGE:confidence' END AS error,
 CASE WHEN p_size NOT IN (13, 14, 15) AND p_size BETWEEN 3 AND 45 THEN p_name END AS title, CASE WHEN p_size IN (13, 14, 15) OR p_size NOT BETWEEN 3 AND 45 THEN substr(raw, 1, 4000) END AS raw_output
FROM (SELECT p_partkey AS asset_id, *, {_ANSWER.replace('STRING_T', 'VARCHAR')} AS raw FROM part)""")
def jsn_strict_decode(t: Tables):
    answers = t.part.select(F.col("p_partkey").alias("asset_id"), F.expr(_ANSWER.replace("STRING_T", "STRING")).alias("raw"))
    return documents.strict_decode(answers).select("asset_id", "error", "answer.title", "raw_output")


@query("jsn_advice_consistency", """
SELECT p_partkey AS asset_id, CASE WHEN p_type <> 'ECONOMY' AND p_size < 5 THEN 'REASON_REQUIRED' WHEN p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#1', 'Brand#2') THEN 'DETAIL_REQUIRED'
 WHEN p_size > 30 AND p_type <> 'SMALL' THEN 'OPERATIONS_NOT_ALLOWED' END AS violation FROM part""")
def jsn_advice_consistency(t: Tables):
    reason = F.struct(F.when(F.col("p_brand").isin("Brand#1", "Brand#2") & (F.col("p_size") <= 20), "other").otherwise("noise").alias("reason"), F.lit(" ").alias("detail"))
    advice = F.struct(
        F.when(F.col("p_type") == "ECONOMY", "enhancement_not_needed").when(F.col("p_type") == "SMALL", "enhancement_recommended").otherwise("enhancement_risky").alias("decision"),
        F.when(F.col("p_size") >= 5, F.array(reason)).otherwise(F.array().cast("array<struct<reason:string,detail:string>>")).alias("reasons"),
        F.when(F.col("p_size") > 30, F.array(F.lit("sharpen"))).otherwise(F.array().cast("array<string>")).alias("operations"))
    return t.part.select(F.col("p_partkey").alias("asset_id"), documents.advice_violation(advice).alias("violation"))


# --- integrity -------------------------------------------------------------------------------

@query("jn_result_without_event", """
SELECT asset_id, c AS check FROM (SELECT asset_id, unnest(list_filter([CASE WHEN ingest_done_id IS NULL THEN 'INGEST/DONE' END, CASE WHEN qc_result IS NOT NULL AND qc_id IS NULL THEN 'QC' END,
 CASE WHEN ai_result IS NOT NULL AND ai_passed_id IS NULL THEN 'AI/PASSED' END, CASE WHEN metadata_json IS NOT NULL AND metadata_id IS NULL THEN 'METADATA' END], lambda x: x IS NOT NULL)) AS c
FROM b_catalog LEFT JOIN b_slots USING (asset_id))""")
def jn_result_without_event(t: Tables):
    return integrity.result_without_event(t.b_catalog, t.b_events)


@query("jn_event_without_result", """
SELECT asset_id, 'AI/PASSED' AS check FROM b_catalog JOIN b_slots USING (asset_id) WHERE ai_result IS NULL AND ai_passed_id IS NOT NULL
UNION ALL SELECT asset_id, 'METADATA_AI/PASSED' FROM b_catalog JOIN b_slots USING (asset_id) WHERE metadata_json IS NULL AND metadata_ai_passed_id IS NOT NULL""")
def jn_event_without_result(t: Tables):
    return integrity.event_without_result(t.b_catalog, t.b_events)


@query("jn_orphan_events", "SELECT DISTINCT asset_id FROM b_events WHERE asset_id NOT IN (SELECT doc_id FROM labels)")
def jn_orphan_events(t: Tables):
    return integrity.orphan_events(t.labels.select(F.col("doc_id").alias("asset_id")), t.b_events)


@query("jn_derivative_check", f"""
SELECT asset_id, {_J}(normalize_passed_text, '$.derivative.path') AS path FROM b_slots LEFT JOIN b_files f ON f.path = {_J}(normalize_passed_text, '$.derivative.path')
WHERE {_J}(normalize_passed_text, '$.derivative.path') IS NOT NULL AND (f.sha256 IS NULL OR f.sha256 <> {_J}(normalize_passed_text, '$.derivative.sha256'))""")
def jn_derivative_check(t: Tables):
    return integrity.derivative_problems(t.b_events, t.b_files)


@query("jn_export_check", " UNION ALL ".join(f"""
SELECT s.asset_id, '{p}' AS platform FROM b_slots s LEFT JOIN b_catalog c USING (asset_id) LEFT JOIN b_files f ON f.path = {_J}(export_{p}_text, '$.path')
WHERE {_J}(export_{p}_text, '$.path') IS NOT NULL AND ((f.sha256 IS NULL AND coalesce({_J}(metadata_json, '$.state'), '') <> 'rejected') OR f.sha256 <> {_J}(export_{p}_text, '$.sha256'))""" for p in fixed.PLATFORMS))
def jn_export_check(t: Tables):
    return integrity.export_problems(t.b_catalog, t.b_events, t.b_files)


@query("jn_orphan_files", f"""
SELECT path FROM b_files WHERE (starts_with(path, 'internal/') OR starts_with(path, 'export/')) AND path NOT IN (
 SELECT p FROM (SELECT CASE WHEN stage = 'NORMALIZE' THEN {_J}(message, '$.derivative.path') ELSE {_J}(message, '$.path') END AS p FROM b_events
 WHERE (stage = 'NORMALIZE' AND status = 'PASSED') OR (stage = 'DERIVATIVE' AND status = 'CREATED')) WHERE p IS NOT NULL)""")
def jn_orphan_files(t: Tables):
    return integrity.orphan_files(t.b_events, t.b_files)


bindings.sql_view("b_pending", f"""
SELECT e.asset_id, e.platform, e.sha256, e.filename, e.text, e.export_event_id, CASE WHEN e.status <> 'ready_for_export' AND state = 'rejected' THEN NULL WHEN e.status <> 'ready_for_export' THEN 'skipped: export ' || e.status
 WHEN c.asset_id IS NOT NULL THEN 'already collected' WHEN f.sha256 IS NULL OR f.sha256 <> e.sha256 THEN 'skipped: export file missing or changed' ELSE 'collect' END AS outcome
FROM b_exports e LEFT JOIN b_collected c ON c.asset_id = e.asset_id AND c.platform = e.platform AND c.sha256 = e.sha256 LEFT JOIN b_files f ON f.path = 'export/' || e.platform || '/' || e.asset_id || '.jpg' WHERE has_file""")


def exports(t: Tables):
    """Export files of every asset and platform in long form, from the state table."""
    files = F.array(*[F.struct(F.lit(p).alias("platform"), F.col(f"{p}_file.status").alias("status"), F.col(f"export_{p}.sha256").alias("sha256"), F.col(f"export_{p}.path").alias("path"),
                               F.col(f"export_{p}.filename").alias("filename"), F.col(f"export_{p}.text").alias("text"), F.col(f"export_{p}").isNotNull().alias("has_file"), F.col(f"export_{p}_id").alias("export_event_id")) for p in fixed.PLATFORMS])
    return state_table(t).select("asset_id", "state", F.inline(files))


@query("jn_batch_pending", "SELECT asset_id, platform, outcome FROM b_pending WHERE outcome IS NOT NULL")
def jn_batch_pending(t: Tables):
    return integrity.batch_pending(exports(t), log.collected(t.b_events), t.b_files).select("asset_id", "platform", "outcome")
