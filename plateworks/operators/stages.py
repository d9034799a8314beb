"""Stage statuses, inheritance of staleness, final state, problems and suggested actions.

Everything is a chain of narrow projections over one row per asset (``stage_inputs``): the log is
scanned and shuffled once, the file listing is joined once, and the rest stays in the same stage.
Each stage has two columns, ``<stage>_status`` and ``<stage>_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import documents as doc
from plateworks.functions import fingerprints as fp
from plateworks.functions.arrays import codes, compact, empty_strings, first_match, flag, or_empty, sorted_distinct, strings
from plateworks.operators import log
from plateworks.sources import schemas

CURRENT, STALE, MISSING, FAILED, NOT_APPLICABLE = "current", "stale", "missing", "failed", "not_applicable"
STATE_SLOTS = tuple(s for s in log.SLOTS if s not in ("ingest_done", "metadata", "metadata_ai_passed"))


# --- inputs ----------------------------------------------------------------------------------

def with_documents(assets: DataFrame) -> DataFrame:
    """Decodes the JSON columns of the catalogue once into typed documents. An empty QC document is no result."""
    return (assets.withColumn("qc_doc", F.when(~F.col("qc_result").rlike(r"^\s*\{\s*\}\s*$"), doc.decode(F.col("qc_result"), schemas.QC)))
            .withColumn("md", doc.decode(F.col("metadata_json"), schemas.METADATA)))


def with_files(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """Looks up the source and both export files of every asset in a listing with one join.

    Wanted paths are exploded to long form, joined on the path and folded back per asset (three rows
    each), instead of one shuffle of the catalogue per kind of file.
    """
    paths = {"source": F.replace(F.col("source_path"), F.lit("\\"), F.lit("/")),
             "adobe": F.col("export_adobe.path"), "shutterstock": F.col("export_shutterstock.path")}
    wanted = assets.select("asset_id", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), path.alias("path")) for kind, path in paths.items()])).alias("w")) \
        .select("asset_id", "w.kind", "w.path").filter(F.col("path").isNotNull())
    found = wanted.join(listing, "path").groupBy("asset_id").agg(*[
        F.max(F.when(F.col("kind") == kind, F.col(column))).alias(f"{kind}_{name}")
        for kind in paths for column, name in (("size_bytes", "actual_size"), ("sha256", "actual_hash"))])
    return assets.join(found, "asset_id", "left")


def stage_inputs(assets: DataFrame, events: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per asset with everything the stage rules read."""
    slots = log.latest_slots(events, STATE_SLOTS, [s for s in STATE_SLOTS if s in schemas.MESSAGES])
    verdict = log.log_verdict(events).select("asset_id", F.col("changed").alias("log_changed"))
    return with_files(with_documents(assets).join(slots, "asset_id", "left").join(verdict, "asset_id", "left"), listing)


# --- fingerprints ----------------------------------------------------------------------------

def in_force() -> Column:
    """The attestation of people that applies to the file as it is now (kind, event_id), or null."""
    attested = _col("attested")
    lifts = attested["kind"].isin(*fixed.LIFTING_ATTESTATIONS) & (attested["file_hash"] == _col("file_hash"))
    return F.when(lifts, F.struct(_col("attested_id").alias("event_id"), attested["kind"].alias("kind")))


def with_fingerprints(rows: DataFrame, identities: dict[str, dict], prompt_version: str) -> DataFrame:
    """Adds the current fingerprint of every result, computed from its inputs in ``stage_inputs``.

    ``identities``: provider -> what its answers depend on besides the view; an unknown provider has no fingerprint. A creative result is held
    against the prompt that it names. Exports have one only where the stored readiness result plans them.
    """
    h, md, qc_doc = _col("file_hash"), _col("md"), _col("qc_doc")
    rows = rows.withColumns({"fp_facts": fp.of(fp.facts(h)), "fp_rep": fp.of(fp.representation(h))}).withColumn("fp_view", fp.of(fp.view(_col("fp_rep"))))
    provider = F.coalesce(_col("ai_passed.provider"), F.lit(next(iter(identities), None)))
    prompt = F.coalesce(_col("creative_advised.prompt_version"), F.lit(prompt_version))
    rows = rows.withColumns({
        "fp_qc": fp.of(fp.qc(_col("fp_view"))), "fp_enh": fp.of(fp.enhancement(h, _col("fp_view"))),
        "fp_vision": first_match([(provider == p, fp.of(fp.vision(_col("fp_view"), p, parts))) for p, parts in identities.items()], F.lit(None).cast("string")),
        "fp_creative": fp.of(fp.creative(h, _col("ai_result"), prompt, _col("fp_view"))),
        "fp_readiness": fp.readiness(h, _col("normalize_evaluated_id"), _col("source_invalid_id"), F.coalesce(qc_doc["passed"], F.lit(False)), md["state"], md["completeness"],
                                     F.get_json_object("metadata_json", "$.fields"), md["sources"]["vision"]["event_id"], in_force())})
    return rows.withColumns({f"fp_export_{p['platform']}": export_fingerprint(p) for p in fixed.EXPORT_PROFILES})


def export_fingerprint(profile: dict) -> Column:
    platform = _col("readiness_evaluated.platforms")[profile["platform"]]
    plan = platform["export_plan"]
    planned = (platform["status"] == "ready") & plan.isNotNull()
    return F.when(planned, fp.of(fp.export(profile, _col("readiness_evaluated.fingerprint"), _col("fp_view"), plan[profile["text_field"]], plan["keywords"])))


# --- own status per stage --------------------------------------------------------------------

def _status(name: str, rules: list[tuple[Column, str, Column | str | None]], default: tuple[str, str | None]) -> dict[str, Column]:
    """Ordered (condition, status, reason) rules -> the two columns of a stage."""
    return {f"{name}_status": first_match([(c, s) for c, s, _ in rules], default[0]),
            f"{name}_reason": first_match([(c, r if isinstance(r, Column) else F.lit(r)) for c, _, r in rules], F.lit(default[1]).cast("string"))}


def _col(name: str) -> Column:
    return F.col(name)


def source_status(verify: bool = False) -> dict[str, Column]:
    """Fast checks can only refute a source; with ``verify`` the content hash alone decides."""
    rules = [(_col("source_actual_size").isNull(), MISSING, "SOURCE_MISSING"),
             (_col("file_size").isNotNull() & (_col("file_size") > 0) & (_col("file_size") != _col("source_actual_size")), "changed", "SOURCE_CHANGED")]
    if verify:
        rules.append((~_col("source_actual_hash").eqNullSafe(_col("file_hash")), "changed", "SOURCE_CHANGED"))
    else:
        rules.append((F.coalesce(_col("log_changed"), F.lit(False)), "changed", "SOURCE_CHANGED"))
    return _status("source", rules, ("ok", None))


def normalize_status() -> dict[str, Column]:
    failed, passed, evaluated = _col("normalize_failed"), _col("normalize_passed"), _col("normalize_evaluated")
    is_failure = log.newer(_col("normalize_failed_id"), F.greatest("normalize_evaluated_id", "normalize_passed_id"))
    expected = F.when(failed["stage"] == "engine", _col("fp_rep")).otherwise(_col("fp_facts"))
    stored = failed["fingerprint"]
    return _status("normalize", [
        (is_failure & stored.isNull(), STALE, "NO_FINGERPRINT"),
        (is_failure & failed["error_type"].isin(*fixed.SOURCE_NEGATIVE_CODES), STALE, "SOURCE_RECHECK"),
        (is_failure & (stored != expected), STALE, "FINGERPRINT_CHANGED"),
        (is_failure, FAILED, F.concat(F.lit("NORMALIZE_FAILED:"), F.coalesce(failed["error_type"], F.lit("None")))),
        (_col("normalize_passed_id").isNull(), MISSING, "NOT_NORMALIZED"),
        (~passed["fingerprint"].eqNullSafe(_col("fp_rep")) | ~evaluated["fingerprint"].eqNullSafe(_col("fp_facts")), STALE, "FINGERPRINT_CHANGED"),
    ], (CURRENT, None))


def view_status() -> dict[str, Column]:
    code = F.coalesce(_col("view_failed.error_type"), F.lit("None"))
    return _status("view", [
        (log.newer(_col("view_failed_id"), _col("normalize_passed_id")), FAILED, F.concat(F.lit("VIEW_FAILED:"), code)),
        (_col("normalize_passed_id").isNull(), MISSING, "NOT_NORMALIZED"),
    ], (CURRENT, None))


def qc_status() -> dict[str, Column]:
    qc = _col("qc_doc")
    changed = qc["input_fingerprint"].isNotNull() & (qc["input_fingerprint"] != _col("fp_qc"))
    return _status("qc", [
        (qc.isNull(), MISSING, "NOT_CHECKED"),
        (qc["input_fingerprint"].isNull(), STALE, "NO_FINGERPRINT"),
        (changed, STALE, "FINGERPRINT_CHANGED"),
        (~F.coalesce(qc["passed"], F.lit(False)), FAILED, "QC_FAILED"),
    ], (CURRENT, None)) | {"qc_changed": F.when(changed, fp.changed_members(qc["inputs"], fp.document(fp.qc(_col("fp_view")))))}


def vision_status(identities: dict[str, dict]) -> dict[str, Column]:
    """``identities``: provider -> what its answers depend on besides the view; others are unknown."""
    passed, has = _col("ai_passed"), _col("ai_result").isNotNull()
    stored = passed["input_fingerprint"]
    changed = has & stored.isNotNull() & passed["provider"].isin(*identities) & (stored != _col("fp_vision"))
    current = first_match([(passed["provider"] == p, fp.document(fp.vision(_col("fp_view"), p, parts))) for p, parts in identities.items()], F.lit(None).cast("string"))
    return _status("vision", [
        (~has & log.newer(_col("ai_failed_id"), _col("ai_passed_id")), FAILED, "VISION_FAILED"),
        (~has, MISSING, "NOT_ANALYZED"),
        (stored.isNull(), STALE, "NO_FINGERPRINT"),
        (~F.coalesce(passed["provider"].isin(*identities), F.lit(False)), STALE, "UNKNOWN_PROVIDER"),
        (stored != _col("fp_vision"), STALE, "FINGERPRINT_CHANGED"),
    ], (CURRENT, None)) | {"vision_changed": F.when(changed, fp.changed_members(passed["inputs"], current))}


def metadata_status() -> dict[str, Column]:
    md = _col("md")
    gateable = md["state"].isin(*fixed.GATEABLE_STATES)
    return _status("metadata", [
        (md.isNull(), MISSING, "NO_METADATA"),
        (md["state"] == "rejected", CURRENT, None),
        (_col("ai_passed_id").isNull() | ~md["sources"]["vision"]["event_id"].eqNullSafe(_col("ai_passed_id")), STALE, "VISION_CHANGED"),
        (gateable & ~md["sources"]["builder_version"].eqNullSafe(F.lit(fixed.BUILDER_VERSION)), STALE, "BUILDER_CHANGED"),
        (gateable & (md["state"] != "draft") & ~md["review_gate"]["policy_version"].eqNullSafe(F.lit(fixed.GATE_POLICY_VERSION)), STALE, "GATE_POLICY_CHANGED"),
    ], (CURRENT, None))


def readiness_status() -> dict[str, Column]:
    done = _col("readiness_evaluated")
    approved = F.coalesce(_col("md.state").isin(*fixed.APPROVED_METADATA_STATES), F.lit(False))
    fresh = done["fingerprint"].eqNullSafe(_col("fp_readiness"))
    checks = F.flatten(F.transform(F.map_values(done["platforms"]), lambda p: p["checks"]))
    blockers = sorted_distinct(F.transform(F.filter(checks, lambda c: c["level"] == "blocker"), lambda c: c["code"]))
    return _status("readiness", [
        (~approved, NOT_APPLICABLE, "METADATA_NOT_APPROVED"),
        (log.newer(_col("readiness_failed_id"), _col("readiness_evaluated_id")), FAILED, "READINESS_FAILED"),
        (done.isNull(), MISSING, "NOT_EVALUATED"),
        (~fresh, STALE, "FINGERPRINT_CHANGED"),
        (F.size(or_empty(done["ready_for"])) == 0, CURRENT, "READINESS_BLOCKED"),
    ], (CURRENT, None)) | {"ready_for": F.when(approved & fresh, or_empty(done["ready_for"])).otherwise(empty_strings()),
                           "blockers": F.when(approved & fresh, or_empty(blockers)).otherwise(empty_strings())}


def enhancement_status() -> dict[str, Column]:
    assessed = _col("enhancement_assessed")
    return _status("enhancement", [
        (assessed.isNull(), MISSING, "NOT_ASSESSED"),
        (~assessed["fingerprint"].eqNullSafe(_col("fp_enh")), STALE, "FINGERPRINT_CHANGED"),
    ], (CURRENT, None)) | {"enhancement_decision": F.when(assessed.isNotNull(), log.effective_decision())}


def creative_status(prompt_version: str) -> dict[str, Column]:
    """Own status first, then applicability, which the readiness status decides."""
    advised = _col("creative_advised")
    profile = F.coalesce(advised["profile"]["name"], F.lit(fixed.DEFAULT_CREATIVE_PROFILE))
    return _status("creative_review", [
        (_col("readiness_status") == NOT_APPLICABLE, NOT_APPLICABLE, "METADATA_NOT_APPROVED"),
        (_col("readiness_status") == MISSING, NOT_APPLICABLE, "READINESS_NOT_EVALUATED"),
        ((_col("readiness_status") == CURRENT) & _col("readiness_reason").eqNullSafe(F.lit("READINESS_BLOCKED")), NOT_APPLICABLE, "READINESS_BLOCKED"),
        (_col("creative_advised_id").isNull(), MISSING, "NOT_REVIEWED"),
        (~profile.isin(*fixed.ROUTE_TERMS), STALE, "UNKNOWN_PROFILE"),
        (~advised["fingerprint"].eqNullSafe(_col("fp_creative")), STALE, "FINGERPRINT_CHANGED"),
        (~advised["prompt_version"].eqNullSafe(F.lit(prompt_version)), STALE, "PROMPT_CHANGED"),
    ], (CURRENT, None))


def publication_inputs() -> fp.Parts:
    """What a publication decision depends on."""
    return fp.publication(_col("file_hash"), _col("readiness_evaluated.fingerprint"), _col("creative_review_status") == CURRENT, _col("creative_advised.features.recommendation"))


def publication_status() -> dict[str, Column]:
    """A decision is stale when its fingerprint differs; which inputs did, at any depth, is reported beside it."""
    done = _col("publication_evaluated")
    applicable = ~((_col("readiness_status").isin(NOT_APPLICABLE, MISSING)) | (
        (_col("readiness_status") == CURRENT) & _col("readiness_reason").eqNullSafe(F.lit("READINESS_BLOCKED"))))
    fresh = done["fingerprint"].eqNullSafe(_col("fp_publication"))
    stale = applicable & done.isNotNull() & ~fresh
    return _status("publication", [
        (_col("readiness_status") == NOT_APPLICABLE, NOT_APPLICABLE, "METADATA_NOT_APPROVED"),
        (_col("readiness_status") == MISSING, NOT_APPLICABLE, "READINESS_NOT_EVALUATED"),
        (~applicable, NOT_APPLICABLE, "READINESS_BLOCKED"),
        (done.isNull(), MISSING, "NOT_EVALUATED"),
        (~fresh, STALE, "FINGERPRINT_CHANGED"),
    ], (CURRENT, None)) | {
        "publication_changed": F.when(stale, fp.changed_members(done["inputs"], fp.document(publication_inputs()), fp.PUBLICATION_IGNORED)),
        "approved_for": F.when(applicable & done.isNotNull() & fresh, or_empty(done["approved_for"])).otherwise(empty_strings())}


def own_statuses(inputs: DataFrame, identities: dict[str, dict], prompt_version: str, verify: bool = False) -> DataFrame:
    """Statuses before inheritance; a bad source makes normalisation stale."""
    rows = with_fingerprints(inputs, identities, prompt_version).withColumns(source_status(verify) | normalize_status() | view_status() | qc_status()
                              | vision_status(identities) | metadata_status() | readiness_status() | enhancement_status())
    overridden = (F.col("source_status") != "ok") & (F.col("normalize_status") != MISSING)
    rows = rows.withColumns({"normalize_reason": F.when(overridden, "UPSTREAM_STALE:source").otherwise(F.col("normalize_reason")),
                             "normalize_status": F.when(overridden, STALE).otherwise(F.col("normalize_status"))})
    return rows.withColumns(creative_status(prompt_version)).withColumn("fp_publication", fp.of(publication_inputs())).withColumns(publication_status())


# --- inheritance, export, state --------------------------------------------------------------

STAGES = (*fixed.REQUIRED_STAGES, *fixed.ADVISORY_STAGES, "publication")


def propagate(rows: DataFrame) -> DataFrame:
    """A result below a stage that is neither current nor not applicable is stale too (graph order)."""
    for name in STAGES:
        deps = fixed.DEPENDS_ON[name]
        if not deps:
            rows = rows.withColumns({f"{name}_own_status": F.lit(None).cast("string"), f"{name}_own_reason": F.lit(None).cast("string")})
            continue
        status, reason = F.col(f"{name}_status"), F.col(f"{name}_reason")
        bad = F.coalesce(*[flag(~F.col(f"{d}_status").isin(CURRENT, NOT_APPLICABLE), d) for d in deps])
        rows = rows.withColumn("bad_dependency", F.when(~status.isin(MISSING, NOT_APPLICABLE), bad))
        inherits = F.col("bad_dependency").isNotNull()
        rows = rows.withColumns({
            f"{name}_own_status": F.when(inherits, status), f"{name}_own_reason": F.when(inherits, reason),
            f"{name}_status": F.when(inherits, STALE).otherwise(status),
            f"{name}_reason": F.when(inherits, F.concat(F.lit("UPSTREAM_STALE:"), F.col("bad_dependency"))).otherwise(reason)})
    return rows.drop("bad_dependency")


def export_file_status(platform: str) -> Column:
    """ready_for_export / stale / not_prepared and the reason, for the file of one platform."""
    file = F.col(f"export_{platform}")
    result = F.col("readiness_evaluated.platforms")[platform]
    plan_ready = F.coalesce((result["status"] == "ready") & result["export_plan"].isNotNull(), F.lit(False))
    usable = (F.col("readiness_status") == CURRENT) & plan_ready & (F.col("publication_status") == CURRENT) \
        & F.array_contains("approved_for", platform)
    reason = first_match([
        (F.col(f"export_{platform}_id").isNull(), "NOT_PREPARED"),
        (~usable, "NOT_READY_OR_NOT_APPROVED"),
        (~file["inputs_fingerprint"].eqNullSafe(F.col(f"fp_export_{platform}")), "FINGERPRINT_CHANGED"),
        (~F.col(f"{platform}_actual_size").eqNullSafe(file["size_bytes"]), "FILE_MISSING_OR_CHANGED"),
    ], F.lit(None).cast("string"))
    status = F.when(reason.isNull(), "ready_for_export").when(reason == "NOT_PREPARED", "not_prepared").otherwise("stale")
    return F.struct(status.alias("status"), reason.alias("reason"))


def with_export(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({f"{p}_file": export_file_status(p) for p in fixed.PLATFORMS})
    approved = F.when(F.col("publication_status") == CURRENT, F.col("approved_for")).otherwise(empty_strings())
    targets = F.filter(approved, lambda p: p.isin(*fixed.PLATFORMS))

    def with_status(status: str) -> Column:
        return F.filter(targets, lambda p: first_match([(p == name, F.col(f"{name}_file.status")) for name in fixed.PLATFORMS]) == status)

    stale, ready = with_status("stale"), with_status("ready_for_export")
    return rows.withColumns(_status("export", [
        (F.size(targets) == 0, NOT_APPLICABLE, "PUBLICATION_NOT_APPROVED"),
        (F.size(stale) > 0, STALE, F.concat(F.lit("FILE_STALE:"), F.array_join(stale, ","))),
        (F.size(ready) == 0, MISSING, "NOT_PREPARED"),
    ], (CURRENT, None)) | {"export_ready": F.when(F.size(targets) > 0, ready).otherwise(empty_strings())})


def with_state(rows: DataFrame) -> DataFrame:
    """First decisive stage -> state, reasons, reprocess_from."""
    md = F.col("md")
    rules: list[tuple[Column, str, Column, str | None]] = [
        (md["state"].eqNullSafe(F.lit("rejected")), "rejected", empty_strings(), None),
        (F.col("source_status") != "ok", "source_invalid", F.array("source_reason"), None)]
    for name in fixed.REQUIRED_STAGES:
        status, reason = F.col(f"{name}_status"), F.col(f"{name}_reason")
        if name == "readiness":
            rules.append((status == NOT_APPLICABLE, "processing", strings(["NOT_PROCESSED:metadata"]), None))
        if name in fixed.FAILURE_KIND:
            rules.append((status == FAILED, fixed.FAILURE_KIND[name], F.array(reason), None))
        rules.append((status == STALE, "stale", F.array(F.concat(F.lit(f"STALE:{name}:"), reason)), name))
        rules.append((status == MISSING, *(("metadata_approved", empty_strings()) if name == "readiness" else
                                           ("processing", strings([f"NOT_PROCESSED:{name}"]))), None))
        if name == "metadata":
            review = or_empty(F.transform(md["review_gate"]["reasons"], lambda r: r["code"]))
            rules.append((md["state"] == "human_review", "human_review", F.when(F.size(review) > 0, review).otherwise(strings(["HUMAN_REVIEW"])), None))
            rules.append((md["state"] == "draft", "processing", F.array(F.when(md["completeness"] == "partial", "METADATA_PARTIAL").otherwise("METADATA_NOT_GATED")), None))
    rules += [
        (F.col("readiness_reason").eqNullSafe(F.lit("READINESS_BLOCKED")), "blocked", F.concat(strings(["READINESS_BLOCKED"]), "blockers"), None),
        (F.col("publication_status") == STALE, "stale", F.array(F.concat(F.lit("STALE:publication:"), F.col("publication_reason"))), "publication"),
        ((F.col("publication_status") == CURRENT) & (F.size("approved_for") > 0) & (F.col("export_status") == CURRENT), "ready_for_export", empty_strings(), None),
        ((F.col("publication_status") == CURRENT) & (F.size("approved_for") > 0), "publication_approved", empty_strings(), None),
    ]
    return rows.withColumns({
        "state": first_match([(c, s) for c, s, _, _ in rules], "platform_ready"),
        "reasons": first_match([(c, r) for c, _, r, _ in rules], empty_strings()),
        "reprocess_from": first_match([(c, F.lit(f).cast("string")) for c, _, _, f in rules], F.lit(None).cast("string"))})


def with_problems(rows: DataFrame) -> DataFrame:
    """Problem codes of the state plus stale advice and stale export files."""
    state, reasons = F.col("state"), F.col("reasons")
    of_state = F.when(state.isin("source_invalid", "blocked", "error", "stale")
                      | ((state == "processing") & F.get(reasons, 0).startswith("METADATA_")), reasons).otherwise(empty_strings())
    advice = compact(*[flag(~state.isin("rejected", "source_invalid") & (F.col(f"{s}_status") == STALE),
                            F.concat(F.lit(f"STALE:{s}:"), F.col(f"{s}_reason"))) for s in (*fixed.ADVISORY_STAGES, "export")])
    return rows.withColumn("problems", F.concat(of_state, advice))


# state or stage -> operation:access[:parameter] (fixed values)
_RERUN = {"normalize": "normalize", "view": "normalize", "qc": "qc", "vision": "vision", "metadata": "metadata",
          "readiness": "readiness", "publication": "publication"}
_NEXT = {"normalize": "normalize.run", "view": "normalize.run", "qc": "asset.process", "vision": "asset.process", "metadata": "metadata.build"}


def with_actions(rows: DataFrame) -> DataFrame:
    """Suggested next operations as ``operation:access`` (and the start stage of a recompute)."""
    state, md = F.col("state"), F.col("md")
    first = F.coalesce(F.get("reasons", 0), F.lit(""))
    partial_free = (first == "METADATA_PARTIAL") & (F.size(or_empty(md["edited_fields"])) == 0)
    sellable = state.isin("platform_ready", "publication_approved", "ready_for_export")
    in_metadata = (state == "processing") & first.startswith("METADATA_")
    blocked = (state == "blocked") & (first == "READINESS_BLOCKED")
    review = state == "human_review"
    rules = [
        ((state == "blocked") & first.startswith("NORMALIZE_FAILED"), "normalize.get:read"),
        ((state == "blocked") & first.startswith("VIEW_FAILED"), "normalize.run:pipeline"),
        (blocked, "metadata.edit:pipeline"), (blocked, "metadata.reject:review"),
        ((state == "error") & (first == "VISION_FAILED"), "asset.process:pipeline"),
        ((state == "error") & (first != "VISION_FAILED"), "readiness.evaluate:pipeline"),
        *[((state == "stale") & (F.col("reprocess_from") == k), f"asset.reprocess:pipeline:{v}") for k, v in _RERUN.items()],
        *[((state == "processing") & (first == f"NOT_PROCESSED:{k}"), f"{v}:pipeline") for k, v in _NEXT.items()],
        ((state == "processing") & partial_free, "metadata.build:pipeline"),
        (in_metadata, "metadata.edit:pipeline"), (in_metadata, "metadata.reject:review"),
        (review, "metadata.edit:pipeline"), (review, "metadata.rebuild:pipeline"), (review, "metadata.escalate:pipeline"),
        (review & (F.coalesce(F.size(md["validation"]["errors"]), F.lit(0)) <= 0), "metadata.approve:review"), (review, "metadata.reject:review"),
        (state == "metadata_approved", "readiness.evaluate:pipeline"), (state == "metadata_approved", "metadata.reject:review"),
        (sellable & (F.col("creative_review_status") != CURRENT), "creative.review:pipeline"),
        (sellable & (F.col("publication_status") == MISSING), "publication.evaluate:pipeline"),
        (sellable & F.col("export_status").isin(MISSING, STALE), "export.prepare:pipeline"),
        (sellable, "metadata.reject:review"),
        (~state.isin("rejected", "source_invalid", "stale") & (F.col("enhancement_status") == STALE) & (F.col("view_status") == CURRENT), "enhancement.assess:pipeline"),
    ]
    return rows.withColumn("actions", codes(*rules))


def derive(inputs: DataFrame, identities: dict[str, dict], prompt_version: str, verify: bool = False) -> DataFrame:
    """Full derived state: statuses, inheritance, export, state, problems, actions."""
    rows = with_export(propagate(own_statuses(inputs, identities, prompt_version, verify)))
    return with_actions(with_problems(with_state(rows)))


# --- views over the derived state ------------------------------------------------------------

def pipeline_summary(rows: DataFrame) -> DataFrame:
    """Flat summary of an asset, as lists and statistics read it."""
    md = F.col("md")
    qc = F.when(F.col("qc_doc").isNull(), "pending").when(F.coalesce(F.col("qc_doc.passed"), F.lit(False)), "passed").otherwise("failed")
    vision = F.when(F.col("ai_result").isNotNull(), "done").when(log.newer(F.col("ai_failed_id"), F.col("ai_passed_id")), "failed").otherwise("pending")
    review = F.when(md["state"] == "human_review", or_empty(F.transform(md["review_gate"]["reasons"], lambda r: r["code"]))).otherwise(empty_strings())
    return rows.withColumns({
        "qc": qc, "vision": vision, "metadata_state": F.coalesce(md["state"], F.lit("none")), "completeness": md["completeness"],
        "metadata_approved": F.coalesce(md["state"].isin(*fixed.APPROVED_METADATA_STATES), F.lit(False)), "review_reasons": review})


def current_or_last(rows: DataFrame, stage: str, document: str) -> DataFrame:
    """The stored document as result only while its stage is current; otherwise as last, never both."""
    current = F.col(f"{stage}_status") == CURRENT
    return rows.select("asset_id", current.alias("is_current"), F.when(current, F.col(document)).alias("result"), F.when(~current, F.col(document)).alias("last_result"))


def attention(rows: DataFrame) -> DataFrame:
    """Review items with unconfirmed claims and whether a model release is needed."""
    md = F.col("md")
    claims = F.transform(F.filter(md["grounding"]["specific_claims"], lambda c: ~F.coalesce(c["confirmed"], F.lit(False))), lambda c: c["term"])
    people = F.exists(md["review_gate"]["reasons"], lambda r: r["code"] == "PEOPLE_RECOGNIZABLE") | F.array_contains("reasons", "MODEL_RELEASE_REQUIRED")
    return rows.filter(F.col("state") == "human_review").select("asset_id", or_empty(claims).alias("claims"), F.coalesce(people, F.lit(False)).alias("model_release_needed"))
