"""Document checks over whole tables: strict decoding, advice consistency, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import documents as doc
from plateworks.functions import jsontext
from plateworks.functions import text as tx
from plateworks.functions.arrays import first_match
from plateworks.sources import schemas

# member -> type a model answer must have (fixed values)
_ANSWER_TYPES = {
    "title": "string", "description": "string", "subject": "string", "commercial_context": "string",
    "keywords": "array<string>", "categories": "array<string>", "technical_subjects": "array<string>", "brands": "array<string>",
    "logos": "array<string>", "text_visible": "array<string>", "editorial_risk": "array<string>",
    "people.present": "boolean", "people.count": "int", "ai_generated": "boolean", "confidence": "double"}


def strict_decode(answers: DataFrame) -> DataFrame:
    """answers(asset_id, raw) -> error code (null = accepted), typed document or the raw text cut for quarantine."""
    value = F.try_parse_json("raw")
    rows = answers.withColumn("value", value)

    def misfit(member: str, kind: str) -> Column:
        present = F.try_variant_get("value", f"$.{member}", "variant").isNotNull()
        return present & F.try_variant_get("value", f"$.{member}", kind).isNull()

    count, confidence = F.try_variant_get("value", "$.people.count", "int"), F.try_variant_get("value", "$.confidence", "double")
    error = first_match([
        (F.col("value").isNull(), "NOT_JSON"),
        *[(misfit(m, k), f"TYPE:{m}") for m, k in _ANSWER_TYPES.items()],
        (count < 0, "RANGE:people.count"), ((confidence < 0) | (confidence > 1), "RANGE:confidence")], F.lit(None).cast("string"))
    return rows.select("asset_id", error.alias("error"), F.when(error.isNull(), F.from_json("raw", schemas.VISION)).alias("answer"),
                       F.when(error.isNotNull(), F.substring("raw", 1, fixed.RAW_OUTPUT_CHARS)).alias("raw_output"))


def advice_violation(advice: Column) -> Column:
    """First broken cross-field rule of an enhancement advice, or null."""
    reasons, operations = advice["reasons"], advice["operations"]
    return first_match([
        ((advice["decision"] != "enhancement_not_needed") & (F.coalesce(F.size(reasons), F.lit(0)) <= 0), "REASON_REQUIRED"),
        (F.exists(reasons, lambda r: (r["reason"] == "other") & (F.trim(F.coalesce(r["detail"], F.lit(""))) == "")), "DETAIL_REQUIRED"),
        ((F.size(operations) > 0) & (advice["decision"] != "enhancement_recommended"), "OPERATIONS_NOT_ALLOWED")], F.lit(None).cast("string"))


# --- redaction of personal documents ---------------------------------------------------------

def _needles(texts: Column) -> Column:
    return F.filter(F.array_distinct(tx.fold_items(texts)), lambda x: F.length(x) >= fixed.REDACT_MIN_LENGTH)


def _redacted(text: Column, needles: Column) -> Column:
    return jsontext.strings_replaced(text, tx.fold, lambda v: jsontext.any_contained(v, needles), fixed.REDACTED)


def flagged(assets: DataFrame) -> DataFrame:
    """assets(asset_id, terms, text_visible, vision_json, metadata_json) -> those with document terms and recognised texts, with ``needles``."""
    items = F.from_json(F.get_json_object("metadata_json", "$.review_gate.text_items"), "array<struct<text:string>>")
    rows = assets.withColumn("item_texts", F.coalesce(F.transform(items, lambda i: i["text"]), F.array().cast("array<string>")))
    rows = rows.filter((F.size("terms") > 0) & ((F.size("text_visible") > 0) | (F.size("item_texts") > 0)))
    return rows.withColumn("needles", _needles(F.concat("text_visible", "item_texts")))


def redact_events(events: DataFrame, found: DataFrame, salts: int = 16) -> DataFrame:
    """The events of flagged assets whose JSON message holds a recognised text, with the text replaced: asset_id, id, message, hits.

    The few flagged rows are repeated per salt and the events spread over the salts, so the history of one asset is redacted by many tasks.
    """
    spread = found.select("asset_id", "needles", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = events.filter(F.col("message").startswith("{")).withColumn("salt", F.pmod("id", F.lit(salts)).cast("int")).join(spread, ["asset_id", "salt"])
    done = rows.filter(doc.is_json(F.col("message"))).select("asset_id", "id", _redacted(F.col("message"), F.col("needles")).alias("r"))
    return done.filter(F.col("r.hits") > 0).select("asset_id", "id", F.col("r.json").alias("message"), F.col("r.hits").alias("hits"))


def redact_documents(found: DataFrame) -> DataFrame:
    """The vision answers without visible texts and the metadata documents with their strings replaced and no text items: asset_id, vision_json, metadata_json, hits."""
    done = found.withColumn("r", F.when(doc.is_json_object(F.col("metadata_json")), _redacted(F.col("metadata_json"), F.col("needles"))))
    emptied = jsontext.member_replaced(F.col("r.json"), ("review_gate", "text_items"), "[]")
    return done.select("asset_id", jsontext.member_replaced(F.col("vision_json"), ("text_visible",), "[]").alias("vision_json"), emptied.alias("metadata_json"), F.coalesce("r.hits", F.lit(0)).alias("hits"))


def redaction_events(found: DataFrame, documents: DataFrame, events: DataFrame) -> DataFrame:
    """The PRIVACY/REDACTED event of every flagged asset (asset_id, stage, status, message): what was removed and which events changed."""
    changed = events.groupBy("asset_id").agg(F.array_sort(F.collect_list("id")).alias("events_updated"), F.sum("hits").alias("event_strings_redacted"))
    rows = found.join(documents.select("asset_id", "hits"), "asset_id").join(changed, "asset_id", "left")
    message = F.to_json(F.struct(
        F.lit("PERSONAL_DOCUMENT").alias("reason"), "terms", F.size("text_visible").alias("text_visible_removed"), F.size("item_texts").alias("text_items_removed"), F.col("hits").alias("metadata_strings_redacted"),
        F.coalesce("events_updated", F.array().cast("array<bigint>")).alias("events_updated"), F.coalesce("event_strings_redacted", F.lit(0)).alias("event_strings_redacted")))
    return rows.select("asset_id", F.lit("PRIVACY").alias("stage"), F.lit("REDACTED").alias("status"), message.alias("message"))
