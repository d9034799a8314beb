"""Metadata documents: flags, grounding, validation, building, edits, decisions, rights.

Rows carry the vision answer as flat columns (subject, title, keywords, brands, ...) and the fields of the
document as ``f_title``, ``f_description``, ``f_keywords``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import text as tx
from plateworks.functions.arrays import compact, first_match, first_of_each, flag, let, or_empty

_CLAIM = "array<struct<term:string,field:string,reason:string,confirmed:boolean>>"


def flags() -> dict[str, Column]:
    trademark = (F.size("brands") > 0) | (F.size("logos") > 0)
    return {"model_release_required": F.col("people_present") | (F.col("people_count") > 0), "trademark_risk": trademark,
            "visible_text": F.size("text_visible") > 0, "editorial_risk_flag": (F.size("editorial_risk") > 0) | trademark, "ai_flag": F.col("ai_generated")}


def corpus() -> Column:
    """Distinct tokens of everything the vision answer says."""
    lists = F.concat("technical_subjects", "keywords", "text_visible", "brands", "logos", "editorial_risk")
    return tx.distinct_tokens(F.concat_ws(" ", "title", "description", "subject", "commercial_context", lists))


def clean_keywords(raw: Column) -> Column:
    """Raw keywords -> array<struct<keyword, reason>>; a null reason means kept."""
    return tx.sort_keywords(tx.keyword_parts(raw), tx.brand_terms(F.col("brands"), F.col("logos")))


def _named(items: Column) -> Column:
    """array<struct<raw, name>>: every item with its normalised lower-case form."""
    return F.transform(items, lambda x: F.struct(x.alias("raw"), F.lower(tx.tidy(x)).alias("name")))


def merged_keywords(primary: Column, others: Column) -> Column:
    """Primary keywords, then those of the vision answer that are not present yet (normalised compare)."""
    present = F.transform(tx.normalize_items(primary), F.lower)
    extra = let(F.struct(present.alias("present"), _named(others).alias("others")),
                lambda s: F.filter(s["others"], lambda p: ~F.array_contains(s["present"], p["name"])))
    return F.concat(primary, F.transform(extra, lambda p: p["raw"]))


def edited_keywords(current: Column, replacement: Column, add: Column, remove: Column) -> Column:
    """Replacement (or the current list) plus added ones without the removed ones (normalised compare)."""
    wanted = F.concat(F.coalesce(replacement, current), or_empty(add))
    removed = F.transform(tx.normalize_items(or_empty(remove)), F.lower)
    kept = let(F.struct(removed.alias("removed"), _named(wanted).alias("wanted")),
               lambda s: F.filter(s["wanted"], lambda p: ~F.array_contains(s["removed"], p["name"])))
    return F.transform(kept, lambda p: p["raw"])


def with_grounding(rows: DataFrame, confirmed: Column | None = None) -> DataFrame:
    """Splits the keywords into grounded, concept and claims; ``confirmed`` holds earlier ``term|field`` keys."""
    rows = rows.withColumn("corpus", corpus())
    text_claims = F.concat(tx.text_claims(F.col("f_description"), "description", F.col("corpus"), F.lit(True)),
                           tx.text_claims(F.col("f_title"), "title", F.col("corpus"), ~tx.is_title_case(F.col("f_title"))))
    rows = rows.withColumn("text_claims", text_claims)
    nouns = F.flatten(F.transform(F.filter("text_claims", lambda c: c["reason"] == "PROPER_NOUN"), lambda c: tx.tokens_stable(c["term"])))
    rows = rows.withColumn("noun_tokens", F.array_distinct(nouns))

    def sort(s: Column) -> Column:
        def kind(keyword: Column) -> Column:
            parts = keyword["tokens"]
            number = F.exists(F.array_intersect(parts, s["missing"]), lambda t: t.rlike("[0-9]"))
            return F.struct(keyword["keyword"].alias("keyword"), first_match([(tx.grounded_but(parts, s["missing"]), "vision"), (number, "NUMBER"),
                                                                              (F.arrays_overlap(parts, s["nouns"]), "PROPER_NOUN")], "concept").alias("kind"))
        return F.transform(s["keywords"], kind)

    # the corpus is gone through once per document, not once per keyword
    rows = rows.withColumn("token_keywords", F.transform("f_keywords", lambda k: F.struct(k.alias("keyword"), tx.tokens_stable(k).alias("tokens"))))
    rows = rows.withColumn("missing_tokens", tx.ungrounded(F.transform("token_keywords", lambda k: k["tokens"]), F.col("corpus")))
    rows = rows.withColumn("sorted_keywords", let(F.struct(F.col("missing_tokens").alias("missing"), F.col("noun_tokens").alias("nouns"), F.col("token_keywords").alias("keywords")), sort))
    keyword_claims = F.transform(F.filter("sorted_keywords", lambda k: k["kind"].isin("NUMBER", "PROPER_NOUN")),
                                 lambda k: F.struct(k["keyword"].alias("term"), F.lit("keywords").alias("field"), k["kind"].alias("reason")))
    keys = or_empty(confirmed) if confirmed is not None else F.expr("cast(array() as array<string>)")

    def key(claim: Column) -> Column:
        return F.concat_ws("|", F.lower(claim["term"]), claim["field"])

    unique = first_of_each(F.concat("text_claims", keyword_claims), key)
    # of the confirmed keys only those of the claims are looked at claim by claim
    claims = let(F.struct(unique.alias("claims"), keys.alias("all_keys")), lambda u: let(F.struct(u["claims"].alias("claims"), F.array_intersect(F.transform(u["claims"], key), u["all_keys"]).alias("keys")), lambda s: F.transform(s["claims"], lambda c: F.struct(
        c["term"].alias("term"), c["field"].alias("field"), c["reason"].alias("reason"), F.array_contains(s["keys"], key(c)).alias("confirmed")))))

    def of_kind(name: str) -> Column:
        return F.transform(F.filter("sorted_keywords", lambda k: k["kind"] == name), lambda k: k["keyword"])

    return rows.withColumns({"claims": claims.cast(_CLAIM), "vision_keywords": of_kind("vision"), "concept_keywords": of_kind("concept")}) \
        .drop("text_claims", "noun_tokens", "token_keywords", "missing_tokens", "sorted_keywords", "corpus")


def with_validation(rows: DataFrame) -> DataFrame:
    """Error and warning lists (``CODE:field``) over fields, flags and claims, in rule order."""
    rows = rows.withColumns(flags())
    title, description, keywords = F.col("f_title"), F.col("f_description"), F.col("f_keywords")
    count = F.size(keywords)
    brands = tx.brand_terms(F.col("brands"), F.col("logos"))

    def in_text(text: Column, field: str) -> Column:
        return let(F.lower(text), lambda low: F.transform(F.filter(tx.patterns_of(brands), lambda b: tx.holds(low, b)), lambda b: F.lit(f"BRAND_IN_TEXT:{field}")))

    errors = F.concat(
        compact(flag(title == "", "TITLE_EMPTY:title"), flag(F.length(title) > fixed.TITLE_MAX, "TITLE_TOO_LONG:title"),
                flag(description == "", "DESCRIPTION_EMPTY:description"), flag(F.length(description) > fixed.DESCRIPTION_MAX, "DESCRIPTION_TOO_LONG:description"),
                flag(count < fixed.KEYWORDS_MIN, "TOO_FEW_KEYWORDS:keywords"), flag(count > fixed.KEYWORDS_MAX, "TOO_MANY_KEYWORDS:keywords")),
        F.transform(F.filter(keywords, lambda k: F.length(k) > fixed.KEYWORD_MAX_LENGTH), lambda k: F.lit("KEYWORD_TOO_LONG:keywords")),
        in_text(title, "title"), in_text(description, "description"),
        F.transform(F.filter("claims", lambda c: ~c["confirmed"]), lambda c: F.concat(F.lit("UNCONFIRMED_CLAIM:"), c["field"])))
    warnings = compact(
        flag((F.length(title) > fixed.TITLE_RECOMMENDED) & (F.length(title) <= fixed.TITLE_MAX), "TITLE_LONG:title"),
        flag((count >= fixed.KEYWORDS_MIN) & (count < fixed.KEYWORDS_RECOMMENDED), "FEW_KEYWORDS:keywords"),
        flag(F.col("completeness") == "partial", "PARTIAL_DRAFT"), flag(F.col("model_release_required"), "MODEL_RELEASE_REQUIRED"),
        flag(F.col("trademark_risk"), "TRADEMARK_RISK"), flag(F.col("visible_text"), "VISIBLE_TEXT"),
        flag(F.col("editorial_risk_flag"), "EDITORIAL_RISK"), flag(F.col("ai_flag"), "AI_GENERATED"))
    return rows.withColumns({"errors": errors, "warnings": warnings})


def error_codes(errors: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(errors, lambda e: F.substring_index(e, ":", 1))))


def with_fields(rows: DataFrame, title: Column, description: Column, keywords: Column) -> DataFrame:
    """Normalised fields from raw texts, with the judged keywords kept for the dropped list."""
    rows = rows.withColumn("judged", clean_keywords(keywords))
    return rows.withColumns({"f_title": tx.normalize_title(title), "f_description": tx.normalize_text(description), "f_keywords": tx.kept_keywords(F.col("judged")),
                             "dropped": F.transform(tx.dropped_keywords(F.col("judged")), lambda k: F.concat_ws(":", k["reason"], k["keyword"]))}).drop("judged")


def build(rows: DataFrame, suggestion: Column) -> DataFrame:
    """Draft from the suggestion (full) or from the vision answer alone (partial)."""
    has = suggestion.isNotNull()
    keywords = F.when(has, merged_keywords(suggestion["keywords"], F.col("keywords"))).otherwise(F.col("keywords"))
    rows = with_fields(rows, F.when(has, suggestion["title"]).otherwise(F.col("title")), F.when(has, suggestion["description"]).otherwise(F.col("description")), keywords)
    rows = rows.withColumns({"completeness": F.when(has, "full").otherwise("partial"), "state": F.lit("draft")})
    return with_validation(with_grounding(rows))


def rebuild(rows: DataFrame, title: Column, description: Column, keywords: Column) -> DataFrame:
    """Current rules on unedited fields only; the document goes back to draft."""
    edited = {f: F.array_contains("edited_fields", f) for f in fixed.EDITABLE_FIELDS}
    fresh = with_fields(rows.withColumnsRenamed({"f_title": "old_title", "f_description": "old_description", "f_keywords": "old_keywords"}), title, description, keywords)
    kept = {f"f_{f}": F.when(edited[f], F.col(f"old_{f}")).otherwise(F.col(f"f_{f}")) for f in fixed.EDITABLE_FIELDS}
    return with_validation(with_grounding(fresh.withColumns(kept).withColumn("state", F.lit("draft"))))


def edit(rows: DataFrame) -> DataFrame:
    """rows with new_title, new_description, new_keywords (null = not edited), unknown_field -> outcome and changed fields."""
    judged = rows.withColumn("new_kept", F.when(F.col("new_keywords").isNotNull(), tx.kept_keywords(clean_keywords(or_empty(F.col("new_keywords"))))))
    new = {"title": tx.normalize_title(F.col("new_title")), "description": tx.normalize_text(F.col("new_description")), "keywords": F.col("new_kept")}
    applied = compact(*[flag(F.col(f"new_{f}").isNotNull() & ~new[f].eqNullSafe(F.col(f"f_{f}")), f) for f in fixed.EDITABLE_FIELDS])
    outcome = first_match([(F.col("unknown_field"), "INVALID_EDIT"), (F.size(F.col("applied")) == 0, "NO_CHANGES")], "EDITED")
    done = judged.withColumn("applied", F.when(~F.col("unknown_field"), applied).otherwise(F.expr("cast(array() as array<string>)"))).withColumn("outcome", outcome)
    return done.withColumns({
        "state_after": F.when(F.col("outcome") == "EDITED", "draft").otherwise(F.col("state")),
        "edited_after": F.array_union("edited_fields", "applied"),
        **{f"f_{f}": F.when(F.array_contains("applied", f), new[f]).otherwise(F.col(f"f_{f}")) for f in fixed.EDITABLE_FIELDS}})


def approve(allow_partial: Column, confirm_claims: Column) -> Column:
    """Outcome of an approval command over derived rows: APPROVED or the refusal with its error codes."""
    remaining = F.when(confirm_claims, F.filter("errors", lambda e: ~e.startswith("UNCONFIRMED_CLAIM"))).otherwise(F.col("errors"))
    return first_match([
        (~F.col("state").isin(*fixed.GATEABLE_STATES), F.concat(F.lit("INVALID_STATE:"), "state")),
        ((F.col("completeness") == "partial") & ~allow_partial, "PARTIAL"),
        (F.size(remaining) > 0, F.concat(F.lit("ERRORS:"), F.array_join(error_codes(remaining), ",")))], "APPROVED")


def reject(reason: Column) -> Column:
    return first_match([(~F.col("state").isin(*fixed.REJECTABLE_STATES), F.concat(F.lit("INVALID_STATE:"), "state")),
                        (tx.normalize_text(F.coalesce(reason, F.lit(""))) == "", "REASON_REQUIRED")], "REJECTED")


def build_policy(rows: DataFrame) -> DataFrame:
    """rows(existing, completeness, edited, force, model_ok) -> outcome, and whether the document is replaced."""
    retry_partial = F.col("existing") & (F.col("completeness") == "partial") & ~F.col("edited")
    outcome = first_match([(F.col("existing") & ~F.col("force") & ~retry_partial, "METADATA_EXISTS"),
                           (~F.col("model_ok") & retry_partial & ~F.col("force"), "METADATA_AI_FAILED"),
                           (~F.col("model_ok"), "DRAFTED:partial")], "DRAFTED:full")
    return rows.withColumn("outcome", outcome).withColumn("replaced", F.col("outcome").startswith("DRAFTED"))


# --- events of the commands, with their messages ---------------------------------------------

def _codes_of(items: Column) -> Column:
    return F.transform(items, lambda r: F.substring_index(r, ":", 1))


def _entry(step: int, status: str, message: Column) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(status).alias("status"), message.alias("message"))


def _message(**members: Column) -> Column:
    """A JSON object with its members in the given order; null members stay."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]), {"ignoreNullFields": "false"})


def drafted_event(trigger: str, step: int = 1) -> Column:
    return _entry(step, "DRAFTED", _message(builder_version=F.lit(fixed.BUILDER_VERSION), completeness=F.col("completeness"), trigger=F.lit(trigger), errors=F.size("errors"), warnings=F.size("warnings"), keywords=F.size("f_keywords")))


def gated_event(trigger: str, step: int, decision: Column | None = None, reasons: Column | None = None) -> Column:
    return _entry(step, "GATED", _message(policy_version=F.lit(fixed.GATE_POLICY_VERSION), decision=F.col("decision") if decision is None else decision, reasons=_codes_of(F.col("gate_reasons")) if reasons is None else reasons,
                                          notes=_codes_of(F.col("gate_notes")), state_before=F.col("state"), trigger=F.lit(trigger)))


def event_rows(rows: DataFrame, trigger: str = "build") -> DataFrame:
    """DRAFTED and GATED of derived documents with their gate result: asset_id, step, stage, status, message."""
    return rows.select("asset_id", F.lit("METADATA").alias("stage"), F.inline(F.array(drafted_event(trigger), gated_event(trigger, 2))))


def edit_events(rows: DataFrame) -> DataFrame:
    """One EDITED per changed field of edited documents (``edit`` on rows with old_title, old_description, old_keywords), in the order of the fields."""
    def value(prefix: str, field: str) -> Column:
        return F.to_json(F.struct(F.col(f"{prefix}_{field}").alias("v")), {"ignoreNullFields": "false"})

    def message(field: str) -> Column:
        # texts and keyword lists take their JSON form, so that all fields share one shape
        inner = lambda prefix: F.expr(f"substring({prefix}, 6, length({prefix}) - 6)")  # noqa: E731  what stands between {"v": and }
        return F.concat(F.lit(f'{{"field":"{field}","old":'), inner(f"o_{field}"), F.lit(',"new":'), inner(f"n_{field}"), F.lit(',"state_before":'), F.to_json(F.array("state")).substr(F.lit(2), F.length(F.to_json(F.array("state"))) - 2), F.lit("}"))

    rows = rows.filter("outcome = 'EDITED'").withColumns({f"o_{f}": value("old", f) for f in fixed.EDITABLE_FIELDS} | {f"n_{f}": value("f", f) for f in fixed.EDITABLE_FIELDS})
    changes = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit("EDITED").alias("status"), F.when(F.array_contains("applied", f), message(f)).alias("message")) for i, f in enumerate(fixed.EDITABLE_FIELDS)])
    return rows.select("asset_id", F.lit("METADATA").alias("stage"), F.inline(F.filter(changes, lambda c: c["message"].isNotNull())))


def approve_events(rows: DataFrame, allow_partial: Column, confirm_claims: Column) -> DataFrame:
    """APPROVED of the documents that an approval accepts, with the claims that it confirmed."""
    open_claims = F.transform(F.filter("claims", lambda c: ~c["confirmed"]), lambda c: c["term"])
    message = _message(builder_version=F.lit(fixed.BUILDER_VERSION), completeness=F.col("completeness"), allow_partial=allow_partial, confirmed_claims=F.when(confirm_claims, open_claims).otherwise(F.array().cast("array<string>")))
    accepted = rows.filter(approve(allow_partial, confirm_claims) == "APPROVED")
    return accepted.select("asset_id", F.lit("METADATA").alias("stage"), F.inline(F.array(_entry(1, "APPROVED", message))))


def reject_events(rows: DataFrame, reason: Column) -> DataFrame:
    message = _message(reason=tx.normalize_text(reason), state_before=F.col("state"))
    return rows.filter(reject(reason) == "REJECTED").select("asset_id", F.lit("METADATA").alias("stage"), F.inline(F.array(_entry(1, "REJECTED", message))))


def escalate_events(rows: DataFrame, reason: Column, accepted: Column) -> DataFrame:
    """ESCALATED and the GATED that follows: whatever the gate said, a person decides, and the escalation is a reason."""
    message = _message(reason=tx.normalize_text(reason), state_before=F.col("state"))
    reasons = F.array_union(_codes_of(F.col("gate_reasons")), F.array(F.lit("MANUAL_ESCALATION")))
    return rows.filter(accepted).select("asset_id", F.lit("METADATA").alias("stage"), F.inline(F.array(_entry(1, "ESCALATED", message), gated_event("escalate", 2, F.lit("human_review"), reasons))))


def authorize(commands: DataFrame) -> DataFrame:
    """commands(actor, operation, force, metadata_state) -> OK, INVALID_ACTOR or FORBIDDEN."""
    actor, operation = F.col("actor"), F.col("operation")
    agent, workflow = actor.startswith("agent:"), actor.startswith("workflow:")
    verdict = first_match([
        (~actor.rlike(fixed.ACTOR_PATTERN), "INVALID_ACTOR"),
        (operation.isin(*fixed.REVIEW_OPERATIONS) & (actor != "human"), "FORBIDDEN:review"),
        (agent & operation.isin(*fixed.AGENT_FORBIDDEN), "FORBIDDEN:agent"),
        (workflow & ~operation.isin(*fixed.WORKFLOW_ALLOWED), "FORBIDDEN:workflow"),
        (workflow & operation.isin(*fixed.WORKFLOW_NO_FORCE) & F.col("force"), "FORBIDDEN:force"),
        ((actor != "human") & operation.isin(*fixed.CONTENT_OPERATIONS) & F.col("metadata_state").isin("approved", "rejected"), "FORBIDDEN:human decision")], "OK")
    return commands.withColumn("verdict", verdict)
