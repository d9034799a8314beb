"""Review gate: visible texts, people, legal wording, personal documents, and the routing decision."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import text as tx
from plateworks.functions.arrays import compact, empty_strings, first_match, flag, let, or_empty, strings

_W = tx.WORD_CHAR
URL = rf"(?i)(?:https?://|www\.)|(?:^|[^{_W}])[{_W}-]+\.(?:com|net|org|ru|de|io|рф)(?:$|[^{_W}])"
# whether ``URL`` occurs, without its search for the start of a name: some run of word characters and hyphens always leads up to the
# dot. The first pattern is cheap and rules out nearly all texts, the second decides
MAYBE_URL = rf"(?i)[hw.](?:(?<=h)ttps?://|(?<=w)ww\.|(?<=\.)(?:com|net|org|ru|de|io|рф)(?:$|[^{_W}]))"
HAS_URL = rf"(?i)https?://|www\.|[{_W}-]\.(?:com|net|org|ru|de|io|рф)(?:$|[^{_W}])"
# whether an address by ``fixed.EMAIL_PATTERN`` occurs
HAS_EMAIL = r"\S@\S+\.\S"
CODE = rf"(?:^|[^{_W}]){fixed.CODE_PATTERN}(?:$|[^{_W}])"
LEGAL_CLAIM = rf"(?i)(?<![{_W}])(?:" + "|".join(fixed.LEGAL_CLAIM_PATTERNS) + rf")(?![{_W}])"


# literal starts of the legal wording: a text without any of them cannot match
_CLAIM_STEMS = tuple(re.match(r"[a-z ]+", p).group(0).strip() for p in fixed.LEGAL_CLAIM_PATTERNS)
_DOTTED = [f for f in fixed.LEGAL_FORMS if f.endswith(".")]
_PLAIN_FORMS = [f for f in fixed.LEGAL_FORMS if not f.endswith(".")]
# a token equal to a legal form, or to one followed by dots; most are told by their first letter
LEGAL_FORM = (rf"(?:^|[^{_W}.])(?=[{''.join(sorted({f[0] for f in fixed.LEGAL_FORMS}))}])(?:(?:" + "|".join(re.escape(f) for f in _PLAIN_FORMS) + r")\.*|" + "|".join(re.escape(f) for f in _DOTTED) + rf")(?:$|[^{_W}.])")
FIRST_IS_MARK = rf"^[^{_W}.]*\.*(?:" + "|".join(fixed.CONFORMITY_MARKS) + rf")\.*(?:$|[^{_W}.])"


def name_rule(text: Column, folded: Column, digits: Column | None = None, warning: Column | None = None) -> Column:
    """PROPER_NAME for several Title Case words, MIXED_CASE_NAME for a long mixed-case word, else null.

    Words are taken apart only where the text can match at all: no word starting in lower case, or a capital
    inside a word. ``digits`` and ``warning`` tell, where they are known, whether it has a digit or a warning word.
    """
    digits = text.rlike(r"\p{Nd}") if digits is None else digits
    warning = tx.has_any(folded, fixed.WARNING_WORDS) if warning is None else warning
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0))
    maybe_proper, maybe_mixed = ~text.rlike(r"(?:^|[^\p{L}-])\p{Ll}"), text.rlike(r"[\p{L}-]\p{Lu}")
    proper = maybe_proper & (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(fixed.TITLE_WORD_PATTERN))
    mixed = maybe_mixed & F.exists(words, lambda w: (F.length(w) >= 5) & w.rlike(r"\p{Ll}") & w.rlike(r"^.+\p{Lu}"))
    plain = ~digits & ~warning
    return F.when(maybe_proper | maybe_mixed, F.when(plain, F.when(proper, "PROPER_NAME").when(mixed, "MIXED_CASE_NAME")))


def text_rule(text: Column, lower: Column, folded: Column, brands: Column) -> Column:
    """Rule of one normalised visible text, first match wins; ``brands`` are folded names with their patterns.

    Most texts are plain prose, so every costly rule stands behind a test that prose fails early.
    """
    tokens = F.transform(F.regexp_extract_all(text, F.lit(rf"[{_W}.]+"), F.lit(0)), lambda t: F.lower(t))
    marks = strings(fixed.CONFORMITY_MARKS)
    phone = F.regexp_replace(F.regexp_extract(text, fixed.PHONE_PATTERN, 0), "[^0-9]", "")
    early = first_match([
        (F.exists(brands, lambda b: tx.holds(folded, b)), "BRAND"),
        (lower.rlike(LEGAL_FORM), "LEGAL_FORM"),
        (text.rlike("[" + "".join(fixed.LEGAL_SYMBOLS) + "]"), "LEGAL_SYMBOL"),
        (tx.has_any(folded, fixed.LEGAL_WORDS), "LEGAL_WORD"),
        (((text.contains(".") | lower.contains("http")) & text.rlike(MAYBE_URL) & text.rlike(HAS_URL)) | (text.contains("@") & text.rlike(HAS_EMAIL)), "CONTACT")])

    def late(s: Column) -> Column:
        digits, warning = s["digits"], s["warning"]
        name = name_rule(text, folded, digits, warning)
        return first_match([
            (s["early"].isNotNull(), s["early"]), (digits & (F.length(phone) >= 10), "CONTACT"), (name.isNotNull(), name),
            (lower.rlike(FIRST_IS_MARK) & (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.array_contains(marks, F.btrim(t, F.lit(".")))), "CONFORMITY_MARK"),
            (digits, "DIGITS"), (text.contains("-") & text.rlike(CODE), "CODE"), (warning, "WARNING_WORD")], "DEFAULT")

    return let(F.struct(early.alias("early"), text.rlike(r"\p{Nd}").alias("digits"), tx.has_any(folded, fixed.WARNING_WORDS).alias("warning")), late)


def category(rule: Column) -> Column:
    return F.when(rule.isin("CONFORMITY_MARK", "DIGITS", "CODE", "WARNING_WORD"), "technical").when(rule == "DEFAULT", "descriptive").otherwise("brand_or_legal")


def folded_brands() -> Column:
    return F.filter(tx.fold_items(F.concat("brands", "logos")), lambda b: b != "")


def text_items() -> Column:
    """array<struct<text, rule, category>> over the visible texts of a row, order kept."""
    def all_items(s: Column) -> Column:
        def item(pair: Column) -> Column:
            return F.struct(pair["text"].alias("text"), text_rule(pair["text"], pair["lower"], pair["folded"], s["brands"]).alias("rule"))
        return F.transform(s["pairs"], item)

    normal = F.transform(F.col("text_visible"), tx.tidy)
    lowered = F.transform(normal, lambda x: F.struct(x.alias("text"), F.lower(x).alias("lower")))
    pairs = F.transform(lowered, lambda x: F.struct(x["text"].alias("text"), x["lower"].alias("lower"), tx.fold_lower(x["lower"]).alias("folded")))
    ruled = let(F.struct(pairs.alias("pairs"), tx.patterns_of(folded_brands()).alias("brands")), all_items)
    return F.transform(ruled, lambda i: F.struct(i["text"].alias("text"), i["rule"].alias("rule"), category(i["rule"]).alias("category")))


def with_people(rows: DataFrame) -> DataFrame:
    """people_level and people_markers; a later rule's texts are made only where no earlier rule holds."""
    subject = tx.fold(F.col("subject"))
    child_text = tx.fold(F.concat_ws(" . ", "subject", "title", "description"))
    full = tx.fold(F.concat_ws(" ", "title", "description", "subject", "commercial_context", "technical_subjects", "keywords"))
    nobody = ~F.col("people_present") & (F.col("people_count") == 0)
    rows = rows.withColumn("child_markers", F.when(nobody, empty_strings()).otherwise(tx.found_terms(child_text, fixed.CHILD_WORDS, "child:")))
    settled = nobody | (F.size("child_markers") > 0)
    rows = rows.withColumns({"people_text": F.when(settled, "").otherwise(tx.without_phrases(full, fixed.NON_HUMAN_PHRASES)),
                             "people_subject": F.when(settled, "").otherwise(tx.without_phrases(subject, fixed.NON_HUMAN_PHRASES))})
    rows = rows.withColumns({"face_markers": tx.found_terms(tx.without_phrases(F.col("people_text"), fixed.FACE_NEGATIONS), fixed.RECOGNIZABLE_MARKERS),
                             "part_markers": tx.found_terms(F.col("people_text"), fixed.PARTIAL_MARKERS),
                             "who_markers": tx.found_terms(F.col("people_subject"), fixed.PERSON_SUBJECT_WORDS, "subject:")})
    rules = [(nobody, "none", empty_strings()), (F.size("child_markers") > 0, "recognizable", F.col("child_markers")), (F.size("face_markers") > 0, "recognizable", F.col("face_markers")),
             (F.size("part_markers") > 0, "partial", F.col("part_markers")), (F.size("who_markers") > 0, "recognizable", F.col("who_markers"))]
    return rows.withColumns({"people_level": first_match([(c, lv) for c, lv, _ in rules], "unclear"), "people_markers": first_match([(c, m) for c, _, m in rules], empty_strings())}) \
        .drop("child_markers", "people_text", "people_subject", "face_markers", "part_markers", "who_markers")


def legal_claims() -> Column:
    """``field: match`` of every legal wording in title, description and keywords."""
    def found(text: Column, field: str) -> Column:
        maybe = tx.may_hold(F.lower(text), _CLAIM_STEMS)
        return F.when(maybe, F.transform(F.regexp_extract_all(text, F.lit(LEGAL_CLAIM), F.lit(0)), lambda m: F.concat(F.lit(f"{field}: "), m))).otherwise(empty_strings())
    return F.concat(found(F.col("f_title"), "title"), found(F.col("f_description"), "description"),
                    F.flatten(F.transform("f_keywords", lambda k: found(k, "keywords"))))


def document_terms() -> Column:
    """Terms of documents with personal data in what the vision answer describes (not in visible texts)."""
    return tx.found_terms(tx.fold(F.concat_ws(" . ", "subject", "title", "description", "keywords")), fixed.DOCUMENT_TERMS)


def evaluate(rows: DataFrame, auto_approve: bool = True) -> DataFrame:
    """Derived metadata rows (errors, claims, f_*) with ``escalation`` -> gate_reasons, gate_notes, decision."""
    rows = with_people(rows).withColumns({"text_items": text_items(), "document_terms": document_terms(), "legal": legal_claims()})
    other = F.filter(F.array_sort(F.array_distinct(F.transform("errors", lambda e: F.substring_index(e, ":", 1)))), lambda c: c != "UNCONFIRMED_CLAIM")

    def items(kind: str, code: str) -> Column:
        return F.transform(F.filter("text_items", lambda i: i["category"] == kind), lambda i: F.concat(F.lit(f"{code}:"), i["text"]))

    def text_note(item: Column) -> Column:
        return F.concat(F.when(item["category"] == "technical", "TEXT_TECHNICAL:").otherwise("TEXT_DESCRIPTIVE:"), item["text"])

    named = F.concat("brands", "logos")
    escalated = F.col("escalation").isNotNull()
    reasons = F.concat(
        compact(flag(F.size(other) > 0, F.concat(F.lit("VALIDATION_ERRORS:"), F.array_join(other, ", ")))),
        F.transform(F.filter("claims", lambda c: ~c["confirmed"]), lambda c: F.concat(F.lit("UNCONFIRMED_CLAIM:"), c["term"])),
        compact(flag(F.size(named) > 0, F.concat(F.lit("TRADEMARK:"), F.array_join(named, ", ")))),
        items("brand_or_legal", "TEXT_BRAND_OR_LEGAL"), F.transform("legal", lambda x: F.concat(F.lit("LEGAL_CLAIM:"), x)),
        compact(flag(F.col("people_level") == "recognizable", F.concat(F.lit("PEOPLE_RECOGNIZABLE:"), F.array_join("people_markers", ", "))),
                flag(F.size("document_terms") > 0, F.concat(F.lit("PERSONAL_DOCUMENT:"), F.array_join("document_terms", ", "))),
                flag(F.size("editorial_risk") > 0, F.concat(F.lit("EDITORIAL_RISK:"), F.array_join("editorial_risk", ", "))),
                flag(F.col("ai_generated"), "AI_GENERATED"), flag(escalated, F.concat(F.lit("MANUAL_ESCALATION:"), "escalation"))))
    notes = F.concat(F.transform(F.filter("text_items", lambda i: i["category"] != "brand_or_legal"), text_note),
                     compact(flag(F.col("people_level") == "unclear", F.concat(F.lit("PEOPLE_INCIDENTAL:people.count="), F.col("people_count").cast("string"))),
                             flag(F.col("people_level") == "partial", F.concat(F.lit("PEOPLE_PARTIAL:"), F.array_join("people_markers", ", ")))))
    rows = rows.withColumns({"gate_reasons": reasons, "gate_notes": notes})
    deferred = (F.col("completeness") == "partial") & ~escalated
    free = F.size("gate_reasons") == 0
    if not auto_approve:
        rows = rows.withColumn("gate_reasons", F.when(free & ~deferred, strings(["AUTO_APPROVE_DISABLED"])).otherwise(F.col("gate_reasons")))
        free = F.lit(False)
    return rows.withColumn("decision", first_match([(deferred, "deferred"), (~free, "human_review")], "auto_approved"))


def apply(state: Column, decision: Column) -> Column:
    """State after the gate: human decisions stay, a deferred document is a draft."""
    return F.when(~state.isin(*fixed.GATEABLE_STATES), state).when(decision == "deferred", "draft").otherwise(decision)


def escalate(state: Column, reason: Column) -> Column:
    """Outcome of an escalation command."""
    return first_match([(~state.isin(*fixed.GATEABLE_STATES), F.concat(F.lit("INVALID_STATE:"), state)),
                        (tx.normalize_text(F.coalesce(reason, F.lit(""))) == "", "REASON_REQUIRED")], "ESCALATED")


def edge_escalation(rows: DataFrame) -> DataFrame:
    """rows(qc_doc, md) -> new escalation reason for border findings, null when there is nothing to do."""
    borders, md = F.col("qc_doc.edge_border"), F.col("md")
    found = F.concat(F.lit(fixed.EDGE_REASON_PREFIX), F.array_join(F.transform(borders, lambda b: F.concat_ws(" ", b["side"], b["width"].cast("string"), F.lit("px"))), ", "))
    existing = F.coalesce(md["review_gate"]["escalation"]["reason"], F.lit(""))
    due = (F.coalesce(F.size(borders), F.lit(0)) > 0) & md["state"].isin(*fixed.GATEABLE_STATES) & ~existing.contains("EDGE_BORDER:")
    return rows.withColumn("edge_reason", F.when(due, F.when(existing == "", found).otherwise(F.concat_ws("; ", existing, found))))


def strip_private_text(rows: DataFrame) -> DataFrame:
    """Visible texts of personal documents are emptied before storing; the number removed is recorded."""
    rows = rows.withColumn("document_terms", document_terms())
    private = F.size("document_terms") > 0
    return rows.withColumn("text_visible_removed", F.when(private, F.size("text_visible")).otherwise(F.lit(0)).cast("bigint")) \
        .withColumn("text_visible", F.when(private, empty_strings()).otherwise(or_empty(F.col("text_visible"))))
