"""Readiness per sales platform, publication decisions, normalisation plans, attestations.

Rows are assets with vision columns, ``f_*`` fields and file facts; platforms are a fixed two-row list that is
unrolled into the row, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import text as tx
from plateworks.functions.arrays import compact, empty_strings, first_match, first_of_each, flag, let, n, or_empty
from plateworks.operators import gate

BLOCKER, DERIVATIVE, WARNING, INFO = "blocker", "derivative", "warning", "info"


def check(condition: Column, code: str, level: str | Column, message: Column | str = "") -> Column:
    value = F.struct(F.lit(code).alias("code"), (level if isinstance(level, Column) else F.lit(level)).alias("level"),
                     (message if isinstance(message, Column) else F.lit(message)).alias("message"))
    return F.when(condition, value)


# --- brands and categories -------------------------------------------------------------------

def brand_presence() -> Column:
    """array<struct<term, source, prominence>>: named brands, logos and brand texts, first source wins."""
    def named(column: str, source: str) -> Column:
        return F.transform(column, lambda x: F.struct(tx.tidy(x).alias("term"), F.lit(source).alias("source")))
    texts = F.transform(F.filter("text_items", lambda i: i["category"] == "brand_or_legal"),
                        lambda i: F.struct(i["text"].alias("term"), F.concat(F.lit("text:"), i["rule"]).alias("source")))
    terms = F.concat(named("brands", "brand"), named("logos", "logo"), texts)
    folded = F.filter(F.transform(terms, lambda x: F.struct(x["term"].alias("term"), x["source"].alias("source"), tx.fold_stable(x["term"]).alias("folded"))), lambda x: x["folded"] != "")
    main = tx.fold(F.concat_ws(" . ", "subject", "title"))
    is_subject = tx.has_any(tx.fold(F.col("subject")), fixed.DOMINANCE_WORDS)

    def rated(s: Column) -> Column:
        def rate(x: Column) -> Column:
            level = F.when(s["dominant"] | tx.contains_term(s["main"], x["folded"]), "dominant").when(x["source"].isin("brand", "logo"), "component_brand").otherwise("incidental_marking")
            return F.struct(x["term"].alias("term"), x["source"].alias("source"), level.alias("prominence"))
        return F.transform(s["terms"], rate)

    return let(F.struct(first_of_each(folded, lambda x: x["folded"]).alias("terms"), main.alias("main"), is_subject.alias("dominant")), rated)


def brands_in_metadata() -> Column:
    """Terms of ``brand_list`` that occur in title, description or keywords."""
    text = tx.fold(F.concat_ws(" . ", "f_title", "f_description", "f_keywords"))
    return let(text, lambda t: F.transform(F.filter("brand_list", lambda b: tx.contains_term(t, tx.fold_stable(b["term"]))), lambda b: b["term"]))


_ALL_TERMS = tuple(dict.fromkeys(term for *_, terms in fixed.CATEGORY_RULES for term in terms))


def category_scores() -> Column:
    """array<struct<group, score, order>> with a positive score, best first (score, then declared order).

    Keywords are narrowed to the few that hold any category term before terms are counted one by one.
    """
    main = tx.fold(F.concat_ws(" . ", "subject", "title", "technical_subjects", "categories"))
    folded = F.transform("f_keywords", tx.fold)
    hits = F.when(tx.may_hold(tx.fold(F.concat_ws(" . ", "f_keywords")), _ALL_TERMS), F.filter(folded, lambda k: tx.may_hold(k, _ALL_TERMS))).otherwise(empty_strings())

    def scored(s: Column) -> Column:
        groups = []
        for order, (group, _, _, terms) in enumerate(fixed.CATEGORY_RULES):
            in_keywords = F.aggregate(F.transform(s["hits"], _counter(terms)), F.lit(0), lambda acc, x: acc + x)
            groups.append(F.struct(F.lit(group).alias("group"), (3 * tx.count_terms(s["main"], terms) + in_keywords).alias("score"), F.lit(order).alias("order")))
        return F.array(*groups)

    positive = F.filter(let(F.struct(main.alias("main"), hits.alias("hits")), scored), lambda g: g["score"] > 0)
    ranked = F.array_sort(F.transform(positive, lambda g: F.struct((-g["score"]).alias("worst"), g["order"].alias("order"), g["group"].alias("group"))))
    return F.transform(ranked, lambda g: F.struct(g["group"].alias("group"), (-g["worst"]).alias("score"), g["order"].alias("order")))


def _counter(terms: tuple[str, ...]):
    return lambda keyword: tx.count_terms(keyword, terms)


def map_categories(profile: dict, scores: Column) -> Column:
    """Best category names of a platform; the second one only if it is substantial."""
    column = 1 if profile["platform"] == "adobe" else 2
    name = F.create_map(*[F.lit(x) for rule in fixed.CATEGORY_RULES for x in (rule[0], rule[column])])
    first, second = F.get(scores, 0), F.get(scores, 1)
    substantial = (second["score"] >= fixed.SECOND_CATEGORY_MIN_SCORE) & (second["score"] >= first["score"] * fixed.SECOND_CATEGORY_MIN_SHARE)
    wanted = [first["group"]] + ([F.when(substantial, second["group"])] if profile["max_categories"] > 1 else [])
    return F.filter(F.array(*[name[g] for g in wanted]), lambda x: x.isNotNull())


# --- checks ----------------------------------------------------------------------------------

def _number(value: float) -> str:
    return f"{value:g}"


def file_checks(profile: dict) -> Column:
    megapixels = F.col("width").cast("double") * F.col("height") / 1_000_000
    no_facts = F.col("color_kind").isNull()
    declared = F.coalesce("color_declared", F.lit(False))
    high = megapixels > profile["max_mp"] if profile["max_mp"] else F.lit(False)
    return compact(
        check(~F.col("source_status").eqNullSafe(F.lit("ok")), "SOURCE_NOT_OK", BLOCKER, F.concat(F.lit("source is "), "source_status")),
        check(~F.coalesce("qc_passed", F.lit(False)), "QC_NOT_PASSED", BLOCKER),
        check(megapixels < profile["min_mp"], "RESOLUTION_TOO_LOW", BLOCKER, F.concat(F.format_number(megapixels, 1), F.lit(f" MP < {_number(profile['min_mp'])} MP"))),
        check(high, "RESOLUTION_TOO_HIGH", DERIVATIVE, F.concat(F.format_number(megapixels, 1), F.lit(f" MP > {_number(profile['max_mp'] or 0)} MP"))),
        check(~F.coalesce(F.col("format").isin(*profile["formats"]), F.lit(False)), "FORMAT_CONVERSION", DERIVATIVE, F.coalesce("format", F.lit("None"))),
        check(no_facts, "SOURCE_FACTS_MISSING", BLOCKER), check(~no_facts & ~declared, "COLOR_SPACE_UNDECLARED", BLOCKER, F.col("color_kind")),
        check(declared & (F.col("color_kind") != profile["color_space"]), "COLOR_PROFILE_CONVERSION", DERIVATIVE, F.col("color_kind")),
        check(F.col("file_size") > profile["max_file_size"], "FILE_TOO_LARGE", DERIVATIVE, F.col("file_size").cast("string")))


def file_operations(profile: dict) -> Column:
    """Operations on a derived file that lift the derivative-level checks."""
    codes = F.transform(file_checks(profile), lambda c: c["code"])
    ops = (("RESOLUTION_TOO_HIGH", f"downscale_to_mp:{_number(profile['max_mp'] or 0)}"), ("FORMAT_CONVERSION", "to_jpeg"),
           ("COLOR_PROFILE_CONVERSION", f"to_{profile['color_space']}"), ("FILE_TOO_LARGE", f"fit_file_size:{profile['max_file_size']}"))
    return compact(*[flag(F.array_contains(codes, code), op) for code, op in ops])


def platform_text(profile: dict) -> Column:
    if profile["text_field"] == "description":
        return F.when(F.coalesce("f_description", F.lit("")) != "", F.col("f_description")).otherwise(F.coalesce("f_title", F.lit("")))
    return F.coalesce("f_title", F.lit(""))


def metadata_checks(profile: dict, categories: Column) -> Column:
    text, count = platform_text(profile), F.size("f_keywords")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    length = F.concat(F.length(text).cast("string"), F.lit(" characters"))
    too_long = F.length(text) > profile["text_max"]
    rules = [
        check(F.col("completeness") == "partial", "METADATA_PARTIAL", BLOCKER), check(text == "", "TEXT_EMPTY", BLOCKER, profile["text_field"]), check(too_long, "TEXT_TOO_LONG", BLOCKER, length)]
    if profile["text_recommended"]:
        rules.append(check(~too_long & (F.length(text) > profile["text_recommended"]), "TITLE_LONG", WARNING, length))
    if profile["text_min_words"]:
        rules.append(check((text != "") & (words < profile["text_min_words"]), "DESCRIPTION_NOT_SENTENCE", WARNING))
    kept = F.concat(count.cast("string"), F.lit(" keywords"))
    return compact(*rules, check(count < profile["keywords_min"], "KEYWORDS_TOO_FEW", BLOCKER, kept), check(count > profile["keywords_max"], "KEYWORDS_TOO_MANY", BLOCKER, kept),
                   check(F.size("brand_hits") > 0, "TRADEMARK_IN_METADATA", BLOCKER, F.array_join("brand_hits", ", ")),
                   check(F.size(categories) == 0, "CATEGORY_UNMAPPED", BLOCKER if profile["category_required"] else WARNING))


def rights_checks() -> Column:
    """People, brands, documents, editorial and AI content; an attestation lifts the release for adults only."""
    recognizable = F.col("people_level") == "recognizable"
    children = F.exists("people_markers", lambda m: m.startswith("child:"))
    attested = F.coalesce(F.col("attestation").isin(*fixed.LIFTING_ATTESTATIONS), F.lit(False)) & ~children
    markers = F.array_join("people_markers", ", ")

    def brands(prominence: str) -> Column:
        return F.transform(F.filter("brand_list", lambda b: b["prominence"] == prominence), lambda b: b["term"])

    def brand_check(prominence: str, code: str, level: str) -> Column:
        return check(F.size(brands(prominence)) > 0, code, level, F.array_join(brands(prominence), ", "))

    return compact(
        check(recognizable & attested, "PEOPLE_ATTESTED", INFO, F.concat_ws(": ", F.lit("people"), "attestation")),
        check(recognizable & ~attested, "MODEL_RELEASE_REQUIRED", BLOCKER, markers), check(F.col("people_level").isin("partial", "unclear"), "PEOPLE_NOT_RECOGNIZABLE", WARNING, F.col("people_level")),
        brand_check("dominant", "DOMINANT_BRAND", BLOCKER), brand_check("component_brand", "COMPONENT_BRAND", WARNING), brand_check("incidental_marking", "INCIDENTAL_MARKING", INFO),
        check(F.size("document_terms") > 0, "PERSONAL_DOCUMENT", BLOCKER, F.array_join("document_terms", ", ")),
        check(F.size("editorial_risk") > 0, "EDITORIAL_ONLY", BLOCKER, F.array_join("editorial_risk", ", ")), check(F.col("ai_generated"), "AI_GENERATED", BLOCKER))


# --- evaluation ------------------------------------------------------------------------------

def prepare(rows: DataFrame) -> DataFrame:
    """Everything the checks of both platforms share, computed once per asset."""
    rows = gate.with_people(rows).withColumns({"text_items": gate.text_items(), "document_terms": gate.document_terms(), "scores": category_scores()})
    return rows.withColumn("brand_list", brand_presence()).withColumn("brand_hits", brands_in_metadata()).drop("text_items")


def evaluate(prepared: DataFrame) -> DataFrame:
    """One row per asset and platform: status, checks, categories, operations, ready_for of the asset."""
    allowed = F.coalesce(F.col("state").isin(*fixed.APPROVED_METADATA_STATES), F.lit(False))
    rows = prepared.withColumn("rights", rights_checks())
    results = {}
    for profile in fixed.PLATFORM_PROFILES:
        categories = map_categories(profile, F.col("scores"))
        checks = F.concat(file_checks(profile), metadata_checks(profile, categories), F.col("rights"))
        not_ready = F.array(F.struct(F.lit("METADATA_NOT_READY").alias("code"), F.lit(BLOCKER).alias("level"), F.concat(F.lit("metadata state is "), F.coalesce("state", F.lit("none"))).alias("message")))
        results[profile["platform"]] = F.struct(
            F.lit(profile["platform"]).alias("platform"), F.lit(profile["version"]).alias("profile"), F.when(allowed, checks).otherwise(not_ready).alias("checks"), categories.alias("categories"),
            file_operations(profile).alias("operations"), platform_text(profile).alias("text"))
    rows = rows.withColumn("result", F.explode_outer(F.array(*results.values())))
    blocked = F.exists("result.checks", lambda c: c["level"] == BLOCKER)
    status = first_match([(~allowed, "not_evaluated"), (blocked, "blocked")], "ready")
    return rows.select("asset_id", "result.platform", "result.profile", status.alias("status"), "result.checks",
                       F.when(status == "ready", F.struct("result.text", F.col("f_keywords").alias("keywords"), "result.categories", "result.operations")).alias("plan"))


def current_status(done: Column, current_fingerprint: Column, platform: str) -> Column:
    """Shown status of a stored result: stale once its inputs changed."""
    return first_match([(done.isNull(), "not_evaluated"), (~done["fingerprint"].eqNullSafe(current_fingerprint), "stale")], done["platforms"][platform]["status"])


def publication(results: DataFrame) -> DataFrame:
    """results(asset_id, platform, profile, status, checks, advice) -> approved / blocked with reasons and notes."""
    ready = F.col("status") == "ready"
    blockers = F.array_sort(F.array_distinct(F.transform(F.filter("checks", lambda c: c["level"] == BLOCKER), lambda c: c["code"])))
    reasons = F.when(ready, empty_strings()).when(F.size(or_empty(blockers)) > 0, blockers).otherwise(F.array(F.concat(F.lit("READINESS_"), F.upper(F.coalesce("status", F.lit("NONE"))))))
    note = first_match([(F.col("advice") == k, v) for k, v in fixed.ADVICE_NOTES.items()], F.lit(None).cast("string"))
    notes = F.when(ready, compact(note, flag(F.col("advice").isNull(), "NO_CURRENT_ADVICE"))).otherwise(empty_strings())
    return results.select("asset_id", "platform", "profile", F.when(ready, "approved").otherwise("blocked").alias("status"), reasons.alias("reasons"), notes.alias("notes"))


def publication_refusal() -> Column:
    """Refusal before deciding, from the state columns; null when a decision may be taken."""
    upstream = F.coalesce(*[flag(F.col(f"{s}_status") != "current", s) for s in fixed.REQUIRED_STAGES], F.lit(None).cast("string"))
    return first_match([(F.col("state").isin("rejected", "source_invalid"), F.upper("state")), (F.col("publication_status") == "not_applicable", "PUBLICATION_NOT_APPLICABLE"),
                        (upstream.isNotNull(), F.concat(F.lit("UPSTREAM_NOT_CURRENT:"), upstream))], F.lit(None).cast("string"))


def file_facts(rows: DataFrame) -> DataFrame:
    """Facts of the newest facts event, else the catalogue's columns with unknown colour."""
    facts = F.col("normalize_evaluated.facts")
    return rows.select("asset_id", facts["container"].alias("format"), F.coalesce("file_size", F.lit(0)).alias("file_size"), facts["color_kind"].alias("color_kind"),
                       F.coalesce(F.col("qc_doc.passed"), F.lit(False)).alias("qc_passed"), F.col("normalize_evaluated_id").alias("facts_event_id"), F.col("source_invalid_id").alias("source_event_id"))


# --- normalisation plan, attestation ---------------------------------------------------------

def normalize_plan() -> Column:
    """struct<representation, refusal> from source facts, first matching refusal wins."""
    container, declared = F.col("container"), F.coalesce("color_declared", F.lit(False))
    derived = container.isin(*fixed.DERIVED_CONTAINERS)
    foreign = declared & (F.col("color_kind") != "srgb")
    refusal = first_match([
        (~F.coalesce(container.isin(*fixed.PASS_THROUGH_CONTAINERS, *fixed.DERIVED_CONTAINERS), F.lit(False)), "UNSUPPORTED_FORMAT"),
        (~container.isin(*fixed.DECODABLE_CONTAINERS), "MISSING_CODEC"), (F.col("hdr").isin("pq", "hlg"), "UNSUPPORTED_HDR"),
        ((F.col("color_mode") == "CMYK") & ~declared, "COLOR_SPACE_UNDECLARED"),
        (foreign & (F.col("icc_sha256").isNull() | F.col("icc_color_space").isNull()), "COLOR_CONVERSION_UNSUPPORTED"),
        ((F.col("frames_readable") > 1) & (container != "JPEG"), "MULTI_FRAME_UNSUPPORTED"),
        (derived & F.col("bit_depth").isNotNull() & (F.col("bit_depth") != 8), "UNSUPPORTED_BIT_DEPTH")], F.lit(None).cast("string"))
    return F.struct(F.when(refusal.isNull(), F.when(derived, "derivative").otherwise("source")).alias("representation"), refusal.alias("refusal"))


def color_violation(converted: Column, icc: Column, source_icc: Column, space: Column, source_space: Column) -> Column:
    """Converted pixels must not carry the source profile; unconverted ones must."""
    return first_match([(converted & icc.eqNullSafe(source_icc), "CONVERTED_WITH_SOURCE_ICC"), (converted & (space == source_space), "CONVERTED_WITHOUT_SPACE"),
                        (~converted & ~icc.eqNullSafe(source_icc), "SOURCE_ICC_LOST"), (~converted & (space != source_space), "SPACE_CHANGED")], F.lit(None).cast("string"))


def color_verdict() -> Column:
    """Colour check of the first platform as a dry run shows it."""
    codes = F.filter(F.transform(file_checks(fixed.PLATFORM_PROFILES[0]), lambda c: c["code"]), lambda c: c.startswith("COLOR"))
    return F.coalesce(F.get(codes, 0), F.lit("-"))


def attest(kind: Column, note: Column, known: Column, actual_hash: Column, file_hash: Column) -> Column:
    """Outcome of an attestation command."""
    return first_match([(~F.coalesce(kind.isin(*fixed.ATTESTATION_KINDS), F.lit(False)), "INVALID_KIND"),
                        ((kind == "release_on_file") & (F.trim(F.coalesce(note, F.lit(""))) == ""), "NOTE_REQUIRED"), (~known, "ASSET_NOT_FOUND"),
                        (~actual_hash.eqNullSafe(file_hash), "SOURCE_INVALID")], "ATTESTED")
