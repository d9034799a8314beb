"""Queries of readiness, publication, normalisation, export, creative advice and attestations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import text as tx
from plateworks.functions.arrays import joined, with_once
from plateworks.operators import creative, exporting, gate, ingest, integrity, log, readiness, stages, statistics
from plateworks.operators.eventstore import EventStore
from plateworks.plans import sqltext as st
from plateworks.plans.bindings import Tables, sql_view
from plateworks.plans.registry import query
from plateworks.plans.source_queries import exports, store_folder
from plateworks.plans.stage_queries import IDENTITIES, PROMPT, inputs, state_table
from plateworks.plans.text_queries import fields, vision

_J = "json_extract_string"
ADOBE, SHUTTERSTOCK = fixed.PLATFORM_PROFILES
_ATTEST = "CASE WHEN lang = 'en' THEN 'not_identifiable' WHEN lang = 'fr' THEN 'release_on_file' END"


def subjects(t: Tables):
    """Assets with vision answer, document fields, file facts and attestation. Parts lend the file facts; an asset without a part has none
    (its size counts as 0, as for a file that was never measured)."""
    lines = vision(t).select("asset_id", F.col("text_visible").alias("lines"))
    rows = fields(t).join(lines, "asset_id").withColumn("text_visible", F.col("lines")).drop("lines")
    facts = t.b_facts.select("asset_id", "width", "height", "file_size", "format", "color_kind", "color_declared", "qc_passed", "source_status")
    measured = {c: F.coalesce(c, F.lit(0)) for c in ("width", "height", "file_size")} | {"qc_passed": F.coalesce("qc_passed", F.lit(True)), "source_status": F.coalesce("source_status", F.lit("ok"))}
    return rows.join(facts, "asset_id", "left").withColumns(measured).withColumn("attestation", F.expr(_ATTEST))


# --- brands, categories ----------------------------------------------------------------------

_MAIN = st.fold("subject || ' . ' || title")
sql_view("b_brand_list", f"""
WITH src AS (SELECT asset_id, 0 AS k, generate_subscripts(brands, 1) AS p, unnest(brands) AS raw, 'brand' AS source FROM b_vision UNION ALL SELECT asset_id, 1, generate_subscripts(logos, 1), unnest(logos), 'logo' FROM b_vision
 UNION ALL SELECT asset_id, 2, pos, line, 'text:' || rule FROM b_items WHERE category = 'brand_or_legal'),
f AS (SELECT *, {st.norm('raw')} AS term, {st.fold('raw')} AS folded FROM src),
u AS (SELECT *, row_number() OVER (PARTITION BY asset_id, folded ORDER BY k, p) AS rn FROM f WHERE folded <> ''),
v AS (SELECT asset_id, {_MAIN} AS main, {st.has(st.fold('subject'), fixed.DOMINANCE_WORDS)} AS dominant FROM b_vision)
SELECT asset_id, k, p, term, folded, source, CASE WHEN dominant OR {st.contains('main', 'folded')} THEN 'dominant' WHEN source IN ('brand', 'logo') THEN 'component_brand' ELSE 'incidental_marking' END AS prominence FROM u JOIN v USING (asset_id) WHERE rn = 1""")


def _branded(t: Tables):
    return vision(t).withColumn("text_items", gate.text_items()).withColumn("brand_list", readiness.brand_presence())


@query("rdy_brands", "SELECT asset_id, term, source, prominence FROM b_brand_list")
def rdy_brands(t: Tables):
    # the outer form keeps Spark from testing the list once more below the projection that computes it
    return _branded(t).select("asset_id", F.inline_outer("brand_list")).filter(F.col("term").isNotNull())


@query("win_brand_first", "SELECT asset_id, count(*) AS brands, count(*) FILTER (WHERE source NOT IN ('brand', 'logo')) AS from_text FROM b_brand_list GROUP BY asset_id")
def win_brand_first(t: Tables):
    listed = vision(t).withColumn("text_items", gate.text_items())
    rows = with_once(listed, "brand_list", readiness.brand_presence()).filter(F.size("brand_list") > 0)
    return rows.select("asset_id", F.size("brand_list").cast("bigint").alias("brands"), F.size(F.filter("brand_list", lambda b: ~b["source"].isin("brand", "logo"))).cast("bigint").alias("from_text"))


sql_view("b_brand_hits", f"""
SELECT asset_id, list(term ORDER BY k, p) AS hits FROM b_brand_list JOIN (SELECT asset_id, {st.fold("concat_ws(' . ', f_title, f_description, array_to_string(f_keywords, ' . '))")} AS doc FROM b_fields) USING (asset_id) WHERE {st.contains('doc', 'folded')} GROUP BY asset_id""")


@query("rdy_brands_in_metadata", "SELECT asset_id, array_to_string(hits, '|') AS hits FROM b_brand_hits")
def rdy_brands_in_metadata(t: Tables):
    docs = fields(t).select("asset_id", "f_title", "f_description", "f_keywords")
    rows = with_once(_branded(t).select("asset_id", "brand_list").join(docs, "asset_id"), "hits", readiness.brands_in_metadata())
    return rows.filter(F.size("hits") > 0).select("asset_id", joined(F.col("hits"), "|").alias("hits"))


_CAT_MAIN = st.fold("concat_ws(' . ', subject, title, array_to_string(technical_subjects, ' . '), array_to_string(categories, ' . '))")
_KW = [f"coalesce(list_sum(list_transform(hits, lambda k: {st.count('k', terms)})), 0)" for *_, terms in fixed.CATEGORY_RULES]
sql_view("b_categories", f"""
WITH m AS MATERIALIZED (SELECT asset_id, {_CAT_MAIN} AS main, list_filter(list_transform(f_keywords, lambda k: {st.fold('k')}), lambda k: {st.has('k', readiness._ALL_TERMS)}) AS hits FROM b_fields)
SELECT asset_id, grp, score, ord, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, ord) AS rank, first_value(score) OVER (PARTITION BY asset_id ORDER BY score DESC, ord) AS best FROM (
SELECT asset_id, unnest([{', '.join(f"'{g}'" for g, *_ in fixed.CATEGORY_RULES)}]) AS grp, unnest([{', '.join(f'CAST(3 * {st.count("main", terms)} + {kw} AS BIGINT)' for (*_, terms), kw in zip(fixed.CATEGORY_RULES, _KW))}]) AS score, unnest(range(7)) AS ord FROM m) WHERE score > 0""")


def _scored(t: Tables):
    return with_once(fields(t), "scores", readiness.category_scores()).select("asset_id", "scores")


@query("rdy_category_score", "SELECT asset_id, grp AS category_group, score FROM b_categories")
def rdy_category_score(t: Tables):
    return _scored(t).select("asset_id", F.explode_outer("scores").alias("s")).filter("s IS NOT NULL").select("asset_id", F.col("s.group").alias("category_group"), F.col("s.score").cast("bigint").alias("score"))


@query("win_category_rank", "SELECT asset_id, rank, grp AS category_group FROM b_categories")
def win_category_rank(t: Tables):
    return _scored(t).select("asset_id", F.posexplode_outer("scores").alias("pos", "s")).filter("s IS NOT NULL").select("asset_id", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("s.group").alias("category_group"))


def _cat_names(i: int) -> str:
    return "CASE grp " + " ".join(f"WHEN '{r[0]}' THEN '{r[i]}'" for r in fixed.CATEGORY_RULES) + " END"


sql_view("b_category_map", f"""
SELECT asset_id, max({_cat_names(1)}) FILTER (WHERE rank = 1) AS adobe, array_to_string(list({_cat_names(2)} ORDER BY rank) FILTER (WHERE rank = 1 OR (rank = 2 AND score >= 2 AND score >= best * 0.25)), ',') AS shutterstock FROM b_categories GROUP BY asset_id""")


@query("rdy_category_map", "SELECT f.asset_id, coalesce(m.adobe, '') AS adobe, coalesce(m.shutterstock, '') AS shutterstock FROM b_fields f LEFT JOIN b_category_map m USING (asset_id)")
def rdy_category_map(t: Tables):
    rows = _scored(t)
    return rows.select("asset_id", joined(readiness.map_categories(ADOBE, F.col("scores"))).alias("adobe"), joined(readiness.map_categories(SHUTTERSTOCK, F.col("scores"))).alias("shutterstock"))


@query("win_category_share", "SELECT asset_id, grp AS category_group, score, best FROM b_categories WHERE rank = 2 AND score >= 2 AND score >= best * 0.25")
def win_category_share(t: Tables):
    second = F.get("scores", 1)
    rows = _scored(t).filter(F.size(readiness.map_categories(SHUTTERSTOCK, F.col("scores"))) == 2)
    return rows.select("asset_id", second["group"].alias("category_group"), second["score"].cast("bigint").alias("score"), F.get("scores", 0)["score"].cast("bigint").alias("best"))


# --- checks ----------------------------------------------------------------------------------

def _codes(*rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{code}:{level}' END" for c, code, level in rules) + "], lambda x: x IS NOT NULL)"


def _file_sql(p: dict) -> str:
    mp = "width * height / 1000000.0"
    formats = ", ".join(f"'{x}'" for x in p["formats"])
    return _codes(("source_status IS DISTINCT FROM 'ok'", "SOURCE_NOT_OK", "blocker"), ("NOT coalesce(qc_passed, FALSE)", "QC_NOT_PASSED", "blocker"), (f"{mp} < {p['min_mp']}", "RESOLUTION_TOO_LOW", "blocker"),
                  (f"{mp} > {p['max_mp']}" if p["max_mp"] else "FALSE", "RESOLUTION_TOO_HIGH", "derivative"), (f"format IS NULL OR format NOT IN ({formats})", "FORMAT_CONVERSION", "derivative"),
                  ("color_kind IS NULL", "SOURCE_FACTS_MISSING", "blocker"), ("color_kind IS NOT NULL AND NOT coalesce(color_declared, FALSE)", "COLOR_SPACE_UNDECLARED", "blocker"), ("color_declared AND color_kind <> 'srgb'", "COLOR_PROFILE_CONVERSION", "derivative"), (f"file_size > {p['max_file_size']}", "FILE_TOO_LARGE", "derivative"))


def _checks(checks):
    return joined(F.transform(checks, lambda c: F.concat_ws(":", c["code"], c["level"])))


@query("rdy_file_checks", f"SELECT asset_id, array_to_string({_file_sql(ADOBE)}, ',') AS adobe, array_to_string({_file_sql(SHUTTERSTOCK)}, ',') AS shutterstock FROM b_facts")
def rdy_file_checks(t: Tables):
    return t.b_facts.select("asset_id", *[_checks(readiness.file_checks(p)).alias(p["platform"]) for p in fixed.PLATFORM_PROFILES])


@query("jn_platform_cross", " UNION ALL ".join(f"SELECT asset_id, '{p['platform']}' AS platform, '{p['version']}' AS profile FROM b_catalog" for p in fixed.PLATFORM_PROFILES))
def jn_platform_cross(t: Tables):
    profiles = F.array(*[F.struct(F.lit(p["platform"]).alias("platform"), F.lit(p["version"]).alias("profile")) for p in fixed.PLATFORM_PROFILES])
    return t.b_catalog.select("asset_id", F.inline(profiles))


def _meta_sql(p: dict) -> str:
    text = "CASE WHEN f_description <> '' THEN f_description ELSE f_title END" if p["text_field"] == "description" else "f_title"
    words = f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"
    cat = "adobe_cat IS NULL" if p["platform"] == "adobe" else "shutter_cat IS NULL"
    rules = [("completeness = 'partial'", "METADATA_PARTIAL", "blocker"), (f"({text}) = ''", "TEXT_EMPTY", "blocker"), (f"len({text}) > {p['text_max']}", "TEXT_TOO_LONG", "blocker")]
    if p["text_recommended"]:
        rules.append((f"len({text}) <= {p['text_max']} AND len({text}) > {p['text_recommended']}", "TITLE_LONG", "warning"))
    if p["text_min_words"]:
        rules.append((f"({text}) <> '' AND {words} < {p['text_min_words']}", "DESCRIPTION_NOT_SENTENCE", "warning"))
    return _codes(*rules, (f"len(f_keywords) < {p['keywords_min']}", "KEYWORDS_TOO_FEW", "blocker"), (f"len(f_keywords) > {p['keywords_max']}", "KEYWORDS_TOO_MANY", "blocker"), ("hits IS NOT NULL", "TRADEMARK_IN_METADATA", "blocker"),
                  (cat, "CATEGORY_UNMAPPED", "blocker" if p["category_required"] else "warning"))


_RIGHTS = _codes(("level = 'recognizable' AND attested", "PEOPLE_ATTESTED", "info"), ("level = 'recognizable' AND NOT attested", "MODEL_RELEASE_REQUIRED", "blocker"), ("level IN ('partial', 'unclear')", "PEOPLE_NOT_RECOGNIZABLE", "warning"),
                 ("n_dominant > 0", "DOMINANT_BRAND", "blocker"), ("n_component > 0", "COMPONENT_BRAND", "warning"), ("n_incidental > 0", "INCIDENTAL_MARKING", "info"), ("len(terms) > 0", "PERSONAL_DOCUMENT", "blocker"),
                 ("len(editorial_risk) > 0", "EDITORIAL_ONLY", "blocker"), ("ai_generated", "AI_GENERATED", "blocker"))
sql_view("b_subjects", f"""
SELECT f.*, coalesce(x.width, 0) AS width, coalesce(x.height, 0) AS height, coalesce(x.file_size, 0) AS file_size, x.format, x.color_kind, x.color_declared, coalesce(x.qc_passed, TRUE) AS qc_passed, coalesce(x.source_status, 'ok') AS source_status, h.hits, m.adobe AS adobe_cat, m.shutterstock AS shutter_cat, p.level, d.terms,
 coalesce({_ATTEST} IN ('not_identifiable', 'release_on_file'), FALSE) AND NOT coalesce(starts_with(p.markers[1], 'child:'), FALSE) AS attested, coalesce(b.n_dominant, 0) AS n_dominant, coalesce(b.n_component, 0) AS n_component, coalesce(b.n_incidental, 0) AS n_incidental
FROM b_fields f LEFT JOIN b_facts x USING (asset_id) LEFT JOIN b_brand_hits h USING (asset_id) LEFT JOIN b_category_map m USING (asset_id) JOIN b_people p USING (asset_id) JOIN b_documents d USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) FILTER (WHERE prominence = 'dominant') AS n_dominant, count(*) FILTER (WHERE prominence = 'component_brand') AS n_component, count(*) FILTER (WHERE prominence = 'incidental_marking') AS n_incidental FROM b_brand_list GROUP BY 1) b USING (asset_id)""")


@query("rdy_metadata_checks", f"SELECT asset_id, array_to_string({_meta_sql(ADOBE)}, ',') AS adobe, array_to_string({_meta_sql(SHUTTERSTOCK)}, ',') AS shutterstock FROM b_subjects")
def rdy_metadata_checks(t: Tables):
    rows = readiness.prepare(subjects(t))
    return rows.select("asset_id", *[_checks(readiness.metadata_checks(p, readiness.map_categories(p, F.col("scores")))).alias(p["platform"]) for p in fixed.PLATFORM_PROFILES])


@query("rdy_rights_checks", f"SELECT asset_id, array_to_string({_RIGHTS}, ',') AS checks FROM b_subjects")
def rdy_rights_checks(t: Tables):
    return readiness.prepare(subjects(t)).select("asset_id", _checks(readiness.rights_checks()).alias("checks"))


sql_view("b_readiness", " UNION ALL ".join(f"""
SELECT asset_id, '{p['platform']}' AS platform, '{p['version']}' AS profile, lang, CASE WHEN state NOT IN ('auto_approved', 'approved') THEN 'not_evaluated' WHEN len(list_filter(checks, lambda c: ends_with(c, ':blocker'))) > 0 THEN 'blocked' ELSE 'ready' END AS status,
 CASE WHEN state NOT IN ('auto_approved', 'approved') THEN ['METADATA_NOT_READY:blocker'] ELSE checks END AS checks FROM (SELECT *, list_concat({_file_sql(p)}, list_concat({_meta_sql(p)}, {_RIGHTS})) AS checks FROM b_subjects)""" for p in fixed.PLATFORM_PROFILES))


@query("rdy_evaluate", "SELECT asset_id, platform, profile, status, array_to_string(checks, ',') AS checks FROM b_readiness")
def rdy_evaluate(t: Tables):
    return readiness.evaluate(readiness.prepare(subjects(t))).select("asset_id", "platform", "profile", "status", _checks(F.col("checks")).alias("checks"))


@query("pub_decide", """
SELECT asset_id, platform, profile, CASE WHEN status = 'ready' THEN 'approved' ELSE 'blocked' END AS status, CASE WHEN status = 'ready' THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(list_filter(checks, lambda c: ends_with(c, ':blocker')), lambda c: split_part(c, ':', 1)))), ',') END AS reasons,
 CASE WHEN status <> 'ready' THEN '' WHEN lang = 'en' THEN 'ADVISOR_ATTENTION' WHEN lang = 'fr' THEN '' ELSE 'NO_CURRENT_ADVICE' END AS notes FROM b_readiness""")
def pub_decide(t: Tables):
    results = readiness.evaluate(readiness.prepare(subjects(t)))
    advice = t.documents.select(F.col("doc_id").alias("asset_id"), F.when(F.col("lang") == "en", "attention").when(F.col("lang") == "fr", "proceed").alias("advice"))
    return readiness.publication(results.join(advice, "asset_id")).withColumns({"reasons": joined(F.col("reasons")), "notes": joined(F.col("notes"))})


_UPSTREAM = "coalesce(" + ", ".join(f"CASE WHEN {s}_status <> 'current' THEN '{s}' END" for s in fixed.REQUIRED_STAGES) + ", NULL)"


@query("pub_refuse", f"""
SELECT asset_id, CASE WHEN state IN ('rejected', 'source_invalid') THEN upper(state) WHEN publication_status = 'not_applicable' THEN 'PUBLICATION_NOT_APPLICABLE' WHEN {_UPSTREAM} IS NOT NULL THEN 'UPSTREAM_NOT_CURRENT:' || {_UPSTREAM} END AS refusal FROM b_state_verified""")
def pub_refuse(t: Tables):
    return state_table(t, verify=True).select("asset_id", readiness.publication_refusal().alias("refusal"))


@query("rdy_current", " UNION ALL ".join(f"""SELECT asset_id, '{p}' AS platform, CASE WHEN readiness_evaluated_id IS NULL THEN 'not_evaluated' WHEN {_J}(readiness_evaluated_text, '$.fingerprint') IS DISTINCT FROM fp_readiness THEN 'stale'
 ELSE {_J}(readiness_evaluated_text, '$.platforms.{p}.status') END AS status FROM b_inputs""" for p in fixed.PLATFORMS))
def rdy_current(t: Tables):
    rows = stages.with_fingerprints(inputs(t), IDENTITIES, PROMPT)
    return rows.select("asset_id", F.inline_outer(F.array(*[F.struct(F.lit(p).alias("platform"), readiness.current_status(F.col("readiness_evaluated"), F.col("fp_readiness"), p).alias("status")) for p in fixed.PLATFORMS])))


@query("rdy_facts", f"""
SELECT asset_id, {_J}(normalize_evaluated_text, '$.facts.container') AS format, file_size, {_J}(normalize_evaluated_text, '$.facts.color_kind') AS color_kind, coalesce({_J}(qc_result, '$.passed') = 'true', FALSE) AS qc_passed,
 normalize_evaluated_id AS facts_event_id, source_invalid_id AS source_event_id FROM b_catalog LEFT JOIN b_slots USING (asset_id)""")
def rdy_facts(t: Tables):
    slots = log.latest_slots(t.b_events, ("normalize_evaluated", "source_invalid"), ("normalize_evaluated",))
    return readiness.file_facts(stages.with_documents(t.b_catalog).join(slots, "asset_id", "left"))


# --- normalisation ---------------------------------------------------------------------------

sql_view("b_norm", """
SELECT asset_id, refusal, CASE WHEN refusal IS NULL THEN CASE WHEN container IN ('AVIF', 'HEIF') THEN 'derivative' ELSE 'source' END END AS representation FROM (SELECT *, CASE WHEN container NOT IN ('JPEG', 'PNG', 'TIFF', 'AVIF', 'HEIF') THEN 'UNSUPPORTED_FORMAT'
 WHEN container = 'HEIF' THEN 'MISSING_CODEC' WHEN hdr IN ('pq', 'hlg') THEN 'UNSUPPORTED_HDR' WHEN color_mode = 'CMYK' AND NOT color_declared THEN 'COLOR_SPACE_UNDECLARED' WHEN color_declared AND color_kind <> 'srgb' AND (icc_sha256 IS NULL OR icc_color_space IS NULL) THEN 'COLOR_CONVERSION_UNSUPPORTED'
 WHEN frames_readable > 1 AND container <> 'JPEG' THEN 'MULTI_FRAME_UNSUPPORTED' WHEN container = 'AVIF' AND bit_depth <> 8 THEN 'UNSUPPORTED_BIT_DEPTH' END AS refusal FROM b_facts)""")


@query("norm_plan", "SELECT asset_id, representation, refusal FROM b_norm")
def norm_plan(t: Tables):
    return t.b_facts.select("asset_id", readiness.normalize_plan().alias("p")).select("asset_id", "p.representation", "p.refusal")


@query("norm_color_invariant", """
SELECT asset_id, CASE WHEN converted AND icc IS NOT DISTINCT FROM icc_sha256 THEN 'CONVERTED_WITH_SOURCE_ICC' WHEN converted AND space = color_kind THEN 'CONVERTED_WITHOUT_SPACE' WHEN NOT converted AND icc IS DISTINCT FROM icc_sha256 THEN 'SOURCE_ICC_LOST' WHEN NOT converted AND space <> color_kind THEN 'SPACE_CHANGED' END AS violation
FROM (SELECT *, has_alpha AS converted, CASE WHEN c2pa THEN 'other-icc' ELSE icc_sha256 END AS icc, CASE WHEN motion_video THEN 'srgb' ELSE color_kind END AS space FROM b_facts)""")
def norm_color_invariant(t: Tables):
    icc = F.when(F.col("c2pa"), "other-icc").otherwise(F.col("icc_sha256"))
    space = F.when(F.col("motion_video"), "srgb").otherwise(F.col("color_kind"))
    return t.b_facts.select("asset_id", readiness.color_violation(F.col("has_alpha"), icc, F.col("icc_sha256"), space, F.col("color_kind")).alias("violation"))


@query("agg_dryrun_profile", """
SELECT dimension, key, count(*) AS n FROM (SELECT unnest(['representation', 'refusal', 'color']) AS dimension, unnest([representation, refusal, CASE WHEN NOT color_declared THEN 'COLOR_SPACE_UNDECLARED' WHEN color_kind <> 'srgb' THEN 'COLOR_PROFILE_CONVERSION' ELSE '-' END]) AS key FROM b_norm JOIN b_facts USING (asset_id)) GROUP BY ALL""")
def agg_dryrun_profile(t: Tables):
    rows = t.b_facts.withColumns({"plan": readiness.normalize_plan(), "verdict": readiness.color_verdict()})
    return statistics.frequencies(rows, representation=F.col("plan.representation"), refusal=F.col("plan.refusal"), color=F.col("verdict"))


# --- export ----------------------------------------------------------------------------------

def _snap_sql(p: dict) -> tuple[str, str]:
    text, field = f"f_{p['text_field']}", p["text_field"].upper()
    refusal = f"CASE WHEN trim({text}) = '' THEN '{field}_EMPTY' WHEN len({text}) > {p['title_max']} THEN '{field}_TOO_LONG_FOR_PROFILE' WHEN len(f_keywords) NOT BETWEEN {p['keywords_min']} AND {p['keywords_max']} THEN 'KEYWORDS_OUT_OF_RANGE' END"
    rules = [(f"len({text}) > {p['title_recommended']}", p["long_code"])] + ([(f"contains({text}, ',')", f"{field}_HAS_COMMA")] if p["comma_warning"] else [])
    if p["text_min_words"]:
        rules.append((f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) < {p['text_min_words']}", f"{field}_SHORT"))
    return refusal, "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in rules) + "], lambda x: x IS NOT NULL), ',')"


@query("exp_snapshot_checks", " UNION ALL ".join(f"SELECT asset_id, '{p['platform']}' AS platform, {_snap_sql(p)[0]} AS refusal, CASE WHEN ({_snap_sql(p)[0]}) IS NULL THEN {_snap_sql(p)[1]} END AS warnings FROM b_fields" for p in fixed.EXPORT_PROFILES))
def exp_snapshot_checks(t: Tables):
    def result(p):
        refusal, warnings = exporting.snapshot_checks(p, F.col(f"f_{p['text_field']}"), F.col("f_keywords"))
        return F.struct(F.lit(p["platform"]).alias("platform"), refusal.alias("refusal"), joined(warnings).alias("warnings"))
    return fields(t).select("asset_id", F.inline_outer(F.array(*[result(p) for p in fixed.EXPORT_PROFILES])))


def _refusal_sql(p: str) -> str:
    return (f"CASE WHEN source_status <> 'ok' THEN 'SOURCE_CHANGED' WHEN readiness_status = 'stale' OR publication_status = 'stale' THEN 'STALE' WHEN readiness_status <> 'current' OR NOT list_contains(ready_for, '{p}') THEN 'NOT_READY:readiness' "
            f"WHEN publication_status <> 'current' OR NOT list_contains(approved_for, '{p}') THEN 'NOT_READY:publication' WHEN NOT coalesce({_J}(readiness_evaluated_text, '$.platforms.{p}.status') = 'ready', FALSE) THEN 'NOT_READY:plan' END")


@query("exp_input_checks", " UNION ALL ".join(f"SELECT asset_id, '{p}' AS platform, {_refusal_sql(p)} AS refusal FROM b_state_verified" for p in fixed.PLATFORMS))
def exp_input_checks(t: Tables):
    return state_table(t, verify=True).select("asset_id", F.inline_outer(F.array(*[F.struct(F.lit(p).alias("platform"), exporting.input_refusal(p).alias("refusal")) for p in fixed.PLATFORMS])))


@query("exp_fit_size", """
SELECT asset_id, CASE WHEN mp < 4 THEN 'RESOLUTION_TOO_LOW' END AS refusal, CASE WHEN mp < 4 THEN NULL WHEN mp > 100 THEN CAST(floor(w * sqrt(100000000 / (w * h))) AS BIGINT) ELSE CAST(w AS BIGINT) END AS width,
 CASE WHEN mp < 4 THEN NULL WHEN mp > 100 THEN CAST(floor(h * sqrt(100000000 / (w * h))) AS BIGINT) ELSE CAST(h AS BIGINT) END AS height, mp > 100 AS downscaled FROM (SELECT asset_id, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h, CAST(width AS DOUBLE) * height / 1000000 AS mp FROM b_facts)""")
def exp_fit_size(t: Tables):
    return t.b_facts.select("asset_id", exporting.fit_size(fixed.EXPORT_PROFILES[0], F.col("width"), F.col("height")).alias("s")).select("asset_id", "s.refusal", "s.width", "s.height", "s.downscaled")


@query("exp_status", " UNION ALL ".join(f"""SELECT asset_id, '{p}' AS platform, {p}_file_status AS status, {p}_file_reason AS reason, CASE WHEN export_failed_{p}_id IS NOT NULL AND (export_{p}_id IS NULL OR export_failed_{p}_id > export_{p}_id) THEN {_J}(export_failed_{p}_text, '$.code') END AS last_failure FROM b_state0""" for p in fixed.PLATFORMS))
def exp_status(t: Tables):
    return state_table(t).select("asset_id", F.inline_outer(F.array(*[F.struct(F.lit(p).alias("platform"), F.col(f"{p}_file.status").alias("status"), F.col(f"{p}_file.reason").alias("reason"), exporting.last_failure(p).alias("last_failure")) for p in fixed.PLATFORMS])))


_FOLDER = "'publish/' || platform || '/' || lpad(CAST(batch AS VARCHAR), CAST(greatest(3, length(CAST(batch AS VARCHAR))) AS INT), '0') || '_2024-03-01'"
_PROFILES = "CASE platform " + " ".join(f"WHEN '{p['platform']}' THEN '{p['version']}'" for p in fixed.PLATFORM_PROFILES) + " END"
sql_view("b_taken", f"""
SELECT platform, batch, {_FOLDER} AS folder, asset_id, filename, text, sha256, export_event_id, row_number() OVER (ORDER BY platform, asset_id) + (SELECT max(id) FROM b_events) AS event_id
FROM (SELECT p.*, coalesce(n.batch, 1) AS batch FROM b_pending p LEFT JOIN (SELECT platform, max(batch) + 1 AS batch FROM b_collected GROUP BY platform) n USING (platform) WHERE outcome = 'collect')""")
_DAY = "2024-03-01"


def _collected(t: Tables) -> EventStore:
    """A store that continues the log of the binding, with one collection in it; the same key a second time changes nothing."""
    store = EventStore(t.spark, store_folder(t), t.b_events)
    for _ in range(2):
        exporting.collect_into(store, f"collect {_DAY}", exports(t), t.b_files, _DAY)
    return store


@query("exp_collect", "SELECT platform, batch, folder, asset_id, filename, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, sha256, export_event_id FROM b_taken")
def exp_collect(t: Tables):
    """The manifest rows of the commit."""
    return _collected(t).result(f"collect {_DAY}", "manifest")


@query("exp_collect_outcome", f"""
SELECT platform, 'COLLECTED' AS outcome, asset_id, event_id, batch, folder, '{{"platform":"' || platform || '","profile":"' || {_PROFILES} || '","batch":' || batch || ',"folder":"' || folder || '","filename":"' || filename || '","sha256":"' || sha256 || '","export_event_id":' || export_event_id || '}}' AS message, CAST(NULL AS VARCHAR) AS reason FROM b_taken
UNION ALL SELECT platform, 'SKIPPED', asset_id, NULL, NULL, NULL, NULL, outcome[10:] FROM b_pending WHERE outcome LIKE 'skipped: %'
UNION ALL SELECT platform, 'NOTHING_TO_COLLECT', NULL, NULL, NULL, NULL, NULL, NULL FROM (VALUES {', '.join(f"('{p}')" for p in fixed.PLATFORMS)}) v(platform) WHERE platform NOT IN (SELECT platform FROM b_taken)""")
def exp_collect_outcome(t: Tables):
    """Outcomes of the commit, with the events that it appended to the log."""
    store = _collected(t)
    events = store.appended().select(F.get_json_object("message", "$.platform").alias("platform"), "asset_id", F.col("id").alias("event_id"), "message")
    return store.result(f"collect {_DAY}", "outcomes").join(events, ["platform", "asset_id"], "left").select("platform", "outcome", "asset_id", "event_id", "batch", "folder", "message", "reason")


@query("exp_collect_all", " UNION ALL ".join(f"""
SELECT '{p}' AS platform, asset_id, CASE WHEN refusal IS NULL THEN 'prepare' ELSE 'refused' END AS action, refusal AS detail FROM (SELECT *, {_refusal_sql(p)} AS refusal FROM b_state)
 WHERE state IN ('publication_approved', 'ready_for_export') AND list_contains(approved_for, '{p}') AND {p}_file_status <> 'ready_for_export'""" for p in fixed.PLATFORMS) + f"""
UNION ALL SELECT platform, asset_id, 'collect', folder FROM b_taken
UNION ALL SELECT platform, NULL, 'outcome', CASE WHEN platform IN (SELECT platform FROM b_taken) THEN 'COLLECTED' ELSE 'NOTHING_TO_COLLECT' END FROM (VALUES {', '.join(f"('{p}')" for p in fixed.PLATFORMS)}) v(platform)""")
def exp_collect_all(t: Tables):
    store = EventStore(t.spark, store_folder(t), t.b_events)
    return exporting.collect_all(store, f"collect {_DAY}", state_table(t), exports(t), t.b_files, _DAY)


# --- creative, attestation -------------------------------------------------------------------

@query("crv_score", "SELECT asset_id, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS potential FROM b_creative")
def crv_score(t: Tables):
    slots = log.latest_slots(t.b_events, ("creative_advised",), ("creative_advised",))
    return creative.summary(slots).filter("score IS NOT NULL").select("asset_id", "score", "potential")


@query("crv_summary", "SELECT asset_id, score IS NOT NULL AS reviewed, profile, score, recommendation FROM b_catalog LEFT JOIN b_creative USING (asset_id)")
def crv_summary(t: Tables):
    slots = log.latest_slots(t.b_events, ("creative_advised",), ("creative_advised",))
    return creative.summary(t.b_catalog.select("asset_id").join(slots, "asset_id", "left")).select("asset_id", "reviewed", "profile", "score", "recommendation")


_ROUTE_MAIN, _ROUTE_WORDS = st.fold("subject || ' . ' || title"), st.fold("array_to_string(list_concat(keywords, text_visible), ' . ')")
sql_view("b_routes", "SELECT asset_id, " + ", ".join(f"CAST(3 * {st.count('main', terms)} + {st.count('words', terms)} AS BIGINT) AS {name}" for name, terms in fixed.ROUTE_TERMS.items()) + f" FROM (SELECT asset_id, {_ROUTE_MAIN} AS main, {_ROUTE_WORDS} AS words FROM b_vision)")


def _routes(t: Tables):
    return vision(t).select("asset_id", *[s.alias(n) for n, s in creative.profile_scores(F.col("subject"), F.col("title"), F.concat("keywords", "text_visible")).items()])


@query("crv_route", "SELECT * FROM b_routes")
def crv_route(t: Tables):
    return _routes(t)


@query("win_profile_best", """
SELECT asset_id, CASE WHEN greatest(industrial_stock, architecture_stock, nature_stock) = 0 OR industrial_stock >= greatest(architecture_stock, nature_stock) THEN 'industrial_stock' WHEN architecture_stock >= nature_stock THEN 'architecture_stock' ELSE 'nature_stock' END AS profile FROM b_routes""")
def win_profile_best(t: Tables):
    return _routes(t).select("asset_id", creative.best_profile({n: F.col(n) for n in fixed.ROUTE_TERMS}).alias("profile"))


@query("crv_refuse", f"""
SELECT s.asset_id, CASE WHEN s.ai_result IS NULL THEN 'VISION_MISSING' WHEN len(terms) > 0 THEN 'PERSONAL_DOCUMENT' WHEN creative_review_status = 'not_applicable' THEN 'CREATIVE_NOT_APPLICABLE' WHEN {_UPSTREAM} IS NOT NULL THEN 'UPSTREAM_NOT_CURRENT:' || {_UPSTREAM} END AS refusal
FROM b_state0 s JOIN b_documents USING (asset_id)""")
def crv_refuse(t: Tables):
    documents = vision(t).select("asset_id", (F.size(gate.document_terms()) > 0).alias("is_document"))
    return state_table(t).join(documents, "asset_id").select("asset_id", creative.refusal(F.col("is_document")).alias("refusal"))


@query("crv_prev_profile", f"SELECT asset_id, CASE {_J}(m, '$.profile.selection.mode') WHEN 'auto' THEN 'auto' WHEN 'explicit' THEN profile END AS profile FROM b_creative")
def crv_prev_profile(t: Tables):
    slots = log.latest_slots(t.b_events, ("creative_advised",), ("creative_advised",)).filter("creative_advised_id IS NOT NULL")
    return slots.select("asset_id", creative.previous_profile(F.col("creative_advised")).alias("profile"))


@query("att_attest", f"""
SELECT e.id, e.asset_id, CASE WHEN k = 92 THEN 'INVALID_KIND' WHEN {_J}(message, '$.kind') = 'release_on_file' AND value < 30 THEN 'NOTE_REQUIRED' WHEN c.asset_id IS NULL THEN 'ASSET_NOT_FOUND' WHEN f.sha256 IS DISTINCT FROM c.file_hash THEN 'SOURCE_INVALID' ELSE 'ATTESTED' END AS outcome
FROM b_events e LEFT JOIN b_catalog c USING (asset_id) LEFT JOIN b_files f ON f.path = c.source_path WHERE stage = 'HUMAN'""")
def att_attest(t: Tables):
    message = F.col("message")
    commands = t.b_events.filter("stage = 'HUMAN'").select(
        "id", "asset_id", F.when(F.col("k") == 92, "other").otherwise(F.get_json_object(message, "$.kind")).alias("kind"), F.when(F.col("value") >= 30, F.get_json_object(message, "$.note")).alias("note"))
    files = t.b_files.select(F.col("path").alias("source_path"), F.col("sha256").alias("actual_hash"))
    rows = ingest.looked_up(commands, t.b_catalog.select("asset_id", "file_hash", "source_path").join(files, "source_path", "left"), "asset_id", "id")
    return rows.select("id", "asset_id", readiness.attest(F.col("kind"), F.col("note"), F.col("file_hash").isNotNull(), F.col("actual_hash"), F.col("file_hash")).alias("outcome"))


@query("jn_term_match", "SELECT doc_id, array_to_string(" + st.found(st.fold("text"), ("apache license", "mit license", "gnu general public license", "licensed", "the", "de la", *fixed.LEGAL_WORDS)) + ", ',') AS terms FROM documents")
def jn_term_match(t: Tables):
    terms = ("apache license", "mit license", "gnu general public license", "licensed", "the", "de la", *fixed.LEGAL_WORDS)
    return tx.stabilize(t.documents, "text").select("doc_id", joined(tx.found_terms(tx.fold(F.col("text")), terms)).alias("terms"))
