"""JSON documents: tolerant decoding, comparison of inputs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from plateworks import fixed


def is_json(text: Column) -> Column:
    """The text is a JSON value (an empty or null text is not)."""
    return F.try_parse_json(text).isNotNull()


def is_json_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def decode(text: Column, schema: str) -> Column:
    """Typed document, or null when the text is not JSON (never an error)."""
    return F.when(is_json(text), F.from_json(text, schema))


def field(text: Column, path: str) -> Column:
    """Scalar at a JSON path; null for malformed text, missing key or JSON null."""
    return F.get_json_object(text, path)


def changed_keys(stored: Column, current: Column) -> Column:
    """Sorted keys of two string maps whose values differ; a missing key differs from a present one."""
    nothing = F.expr("cast(map() as map<string,string>)")
    pairs = F.map_zip_with(F.coalesce(stored, nothing), F.coalesce(current, nothing), lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(pairs, lambda k, differs: differs)))


def digest_of(rules: dict) -> str:
    """Stable digest of a constant rule set (taken once when the query is built)."""
    return hashlib.sha256(json.dumps(rules, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


NORMALIZER_PARAMS_DIGEST = digest_of({
    "derived": fixed.DERIVED_CONTAINERS, "manifest_version": 2, "pass_through": fixed.PASS_THROUGH_CONTAINERS})
