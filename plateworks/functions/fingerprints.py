"""Fingerprints of results: a DAG of hashes over canonical JSON documents of what a result depends on.

Every builder names the real inputs of one stage, upstream fingerprints among them, so that a changed input changes exactly the
fingerprints below it:

    facts; representation -> view -> QC, enhancement, vision, creative;  readiness -> publication -> (advice), export

A document is a JSON object with sorted members, without spaces; whole numbers have no fraction. Nested documents of the
catalogue take part as they are, members sorted at every level (that is how VARIANT keeps objects). Nulls take part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import documents as doc

Parts = dict[str, Column]


def plain(value):
    """A constant in canonical form: whole floats as integers, tuples as lists."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def constant_text(value) -> str:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def constant(value) -> Column:
    """A constant document as a member."""
    return F.parse_json(F.lit(constant_text(value)))


def nested(text: Column) -> Column:
    """JSON text of the catalogue as a member with sorted members of its own; null for malformed text."""
    return F.try_parse_json(text)


def document(parts: Parts) -> Column:
    return F.to_json(F.struct(*[parts[name].alias(name) for name in sorted(parts)]), {"ignoreNullFields": "false"})


def of(parts: Parts) -> Column:
    """``sha256:`` and the SHA-256 of the document."""
    return F.concat(F.lit("sha256:"), F.sha2(document(parts), 256))


def members(text: Column) -> Column:
    """Member -> canonical JSON text of its value; null members are left out, as a missing one is the same."""
    values = F.transform_values(F.from_json(text, "map<string,variant>"), lambda k, v: F.to_json(v))
    return F.map_filter(values, lambda k, v: v != "null")


def changed_members(stored: Column, current: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Sorted names of the members in which two JSON objects differ at any depth. A text that isn't an object has no members."""
    differing = doc.changed_keys(members(stored), members(current))
    return F.filter(differing, lambda k: ~k.isin(*ignored)) if ignored else differing


# --- one builder per result ------------------------------------------------------------------

def facts(file_hash: Column) -> Parts:
    return {"source": file_hash, "version": F.lit(fixed.FACTS_VERSION)}


def representation(file_hash: Column) -> Parts:
    return {"params": F.lit(doc.NORMALIZER_PARAMS_DIGEST), "source": file_hash, "version": F.lit(fixed.NORMALIZER_VERSION)}


def view(representation_fp: Column) -> Parts:
    return {"normalizer": representation_fp, "view": F.lit(fixed.VIEW_VERSION)}


def qc(view_fp: Column, rules: dict = fixed.QC_RULES) -> Parts:
    return {"rules": constant(rules), "view": view_fp}


def enhancement(file_hash: Column, view_fp: Column) -> Parts:
    return {"file_hash": file_hash, "rules_version": F.lit(fixed.ENHANCEMENT_RULES_VERSION), "view": view_fp}


def vision(view_fp: Column, provider: str, identity: dict) -> Parts:
    """``identity``: what the answers of a provider depend on besides the view (model, prompt, schema, image encoding, parameters)."""
    return {"view": view_fp, "provider": F.lit(provider), **{k: constant(v) for k, v in identity.items()}}


def creative(file_hash: Column, vision_json: Column, prompt_version: Column, view_fp: Column) -> Parts:
    return {"file_hash": file_hash, "prompt_version": prompt_version, "view": view_fp, "vision": vision_json}


def readiness(file_hash: Column, facts_event_id: Column, source_event_id: Column, qc_passed: Column, state: Column, completeness: Column, fields: Column,
              vision_event_id: Column, attestation: Column, profiles: tuple[dict, ...] = fixed.PLATFORM_PROFILES) -> Column:
    """The fingerprint itself: an attestation (kind, event_id) is a member only while it is in force. ``fields``: JSON text."""
    base = {"completeness": completeness, "facts_event_id": facts_event_id, "fields": nested(fields), "file_hash": file_hash, "profiles": constant([p["version"] for p in sorted(profiles, key=lambda p: p["platform"])]),
            "qc_passed": qc_passed, "readiness_version": F.lit(fixed.READINESS_VERSION), "source_event_id": source_event_id, "state": state, "vision_event_id": vision_event_id}
    return F.when(attestation.isNull(), of(base)).otherwise(of({**base, "people_attestation": attestation}))


def publication(file_hash: Column, readiness_fp: Column, advice_current: Column, recommendation: Column, profiles: tuple[dict, ...] = fixed.PLATFORM_PROFILES) -> Parts:
    """The advisor takes part only while its result is current."""
    advice = F.struct(advice_current.alias("current"), F.when(advice_current, recommendation).alias("recommendation"))
    return {"advice": advice, "policy_version": F.lit(fixed.PUBLICATION_POLICY_VERSION), "profiles": constant({p["platform"]: p["version"] for p in profiles}), "readiness_fingerprint": readiness_fp, "source_sha256": file_hash}


#: For tracing only: a decision does not depend on it.
PUBLICATION_IGNORED = ("readiness_event_id",)


def export(profile: dict, readiness_fp: Column, view_fp: Column, text: Column, keywords: Column) -> Parts:
    nothing = F.array().cast("array<string>")
    snapshot = {"keywords": F.coalesce(keywords, nothing), profile["text_field"]: F.coalesce(text, F.lit(""))}
    return {"export_version": F.lit(fixed.EXPORT_VERSION), "normalizer_version": F.lit(fixed.NORMALIZER_VERSION), "profile": constant(profile), "readiness_fingerprint": readiness_fp,
            "snapshot": F.struct(*[snapshot[k].alias(k) for k in sorted(snapshot)]), "view": view_fp}


def of_file(file_hash: Column) -> dict[str, Column]:
    """The fingerprints that depend on the file alone."""
    rep = of(representation(file_hash))
    seen = of(view(rep))
    return {"fp_facts": of(facts(file_hash)), "fp_rep": rep, "fp_view": seen, "fp_qc": of(qc(seen)), "fp_enh": of(enhancement(file_hash, seen))}
