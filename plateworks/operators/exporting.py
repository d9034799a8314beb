"""Export names, snapshots, sizes, statuses and upload batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import text as tx
from plateworks.functions.arrays import codes, first_match, let
from plateworks.operators import integrity, log, statistics
from plateworks.operators.eventstore import EventStore
from plateworks.session import materialize

FILENAME_MAX = fixed.EXPORT_PROFILES[0]["filename_max"]


def export_filename(title: Column, asset_id: Column, own_name: str | None = None, maximum: int = FILENAME_MAX) -> Column:
    """Longest word prefix of the title's slug that fits, then ``_<id>.jpg``; the suffix is never cut."""
    suffix = F.concat(F.lit("_"), asset_id.cast("string"), F.lit(fixed.EXPORT_EXTENSION))
    limit = F.lit(maximum) - F.length(suffix)

    def named(words: Column) -> Column:
        def step(acc: Column, word: Column) -> Column:
            longer = F.when(acc["base"] == "", word).otherwise(F.concat_ws("_", acc["base"], word))
            stop = acc["stopped"] | (F.length(longer) > limit)
            return F.struct(F.when(stop, acc["base"]).otherwise(longer).alias("base"), stop.alias("stopped"))

        fitted = F.aggregate(words, F.struct(F.lit("").alias("base"), F.lit(False).alias("stopped")), step)["base"]
        fallback = F.substring(F.coalesce(F.get(words, 0), F.lit("untitled")), F.lit(1), F.greatest(limit, F.lit(0)))
        return F.when(fitted != "", fitted).otherwise(fallback)

    base = let(tx.slug(title, own_name), named)
    return F.when(base != "", F.concat(base, suffix)).otherwise(F.concat(asset_id.cast("string"), F.lit(fixed.EXPORT_EXTENSION)))


def filename_problems(name: Column, asset_id: Column, own_name: str | None = None, maximum: int = FILENAME_MAX) -> Column:
    end = F.concat(asset_id.cast("string"), F.lit(fixed.EXPORT_EXTENSION))
    stem = F.substring(name, F.lit(1), F.greatest(F.length(name) - len(fixed.EXPORT_EXTENSION), F.lit(0)))
    parts = F.split(stem, "_")
    words = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(words, lambda w: ~w.rlike("^[a-z0-9]+$") | tx.forbidden_token(w, own_name))
    return codes((F.length(name) > maximum, "TOO_LONG"), (~F.endswith(name, F.concat(F.lit("_"), end)) & (name != end), "SUFFIX_MISSING"), (bad, "FORBIDDEN_TOKENS"))


def snapshot_checks(profile: dict, text: Column, keywords: Column) -> tuple[Column, Column]:
    """(refusal, warnings) of the text and keywords an export would carry."""
    field, count, words = profile["text_field"].upper(), F.size(keywords), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    refusal = first_match([(F.trim(text) == "", f"{field}_EMPTY"), (F.length(text) > profile["title_max"], f"{field}_TOO_LONG_FOR_PROFILE"),
                           ((count < profile["keywords_min"]) | (count > profile["keywords_max"]), "KEYWORDS_OUT_OF_RANGE")], F.lit(None).cast("string"))
    rules = [(F.length(text) > profile["title_recommended"], profile["long_code"])]
    if profile["comma_warning"]:
        rules.append((text.contains(","), f"{field}_HAS_COMMA"))
    if profile["text_min_words"]:
        rules.append((words < profile["text_min_words"], f"{field}_SHORT"))
    return refusal, F.when(refusal.isNull(), codes(*rules))


def input_refusal(platform: str) -> Column:
    """Why an export of this platform is refused from the state columns, or null."""
    ready = F.array_contains("ready_for", platform)
    approved = F.array_contains("approved_for", platform)
    plan = F.coalesce(F.col("readiness_evaluated.platforms")[platform]["status"] == "ready", F.lit(False))
    return first_match([
        (F.col("source_status") != "ok", "SOURCE_CHANGED"),
        ((F.col("readiness_status") == "stale") | (F.col("publication_status") == "stale"), "STALE"),
        ((F.col("readiness_status") != "current") | ~ready, "NOT_READY:readiness"),
        ((F.col("publication_status") != "current") | ~approved, "NOT_READY:publication"), (~plan, "NOT_READY:plan")], F.lit(None).cast("string"))


def fit_size(profile: dict, width: Column, height: Column) -> Column:
    """Target size under the megapixel maximum (never enlarged); refusal below the minimum."""
    pixels = width.cast("double") * height
    if profile["max_mp"] is None:
        w, h, shrink = width.cast("bigint"), height.cast("bigint"), F.lit(False)
    else:
        limit = profile["max_mp"] * 1_000_000
        scale = F.sqrt(F.lit(limit) / pixels)
        shrink = pixels > limit
        w = F.when(shrink, F.greatest(F.lit(1), F.floor(width * scale))).otherwise(width).cast("bigint")
        h = F.when(shrink, F.greatest(F.lit(1), F.floor(height * scale))).otherwise(height).cast("bigint")
    refused = pixels / 1_000_000 < profile["min_mp"]
    return F.struct(F.when(refused, "RESOLUTION_TOO_LOW").alias("refusal"), F.when(~refused, w).alias("width"), F.when(~refused, h).alias("height"), (shrink & ~refused).alias("downscaled"))


def last_failure(platform: str) -> Column:
    """Code of the newest export failure, only if newer than the file."""
    failed, made = F.col(f"export_failed_{platform}_id"), F.col(f"export_{platform}_id")
    return F.when(failed.isNotNull() & (made.isNull() | (failed > made)), F.col(f"export_failed_{platform}.code"))


def whitelist_audit(inventory: Column, whitelist: Column) -> Column:
    extra, missing = F.array_sort(F.array_except(inventory, whitelist)), F.array_sort(F.array_except(whitelist, inventory))
    verdict = first_match([(F.size(extra) > 0, "METADATA_NOT_CLEAN"), (F.size(missing) > 0, "VERIFY_FAILED")], "OK")
    return F.struct(verdict.alias("verdict"), F.array_join(extra, ",").alias("not_allowed"), F.array_join(missing, ",").alias("missing"))


def padded(number: Column, digits: int = 3) -> Column:
    """A number with leading zeros; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), "0")


def collect(pending: DataFrame, next_batch: DataFrame, day: str) -> DataFrame:
    """Pending rows with outcome collect -> manifest rows of one new batch per platform."""
    numbered = pending.filter(F.col("outcome") == "collect").join(F.broadcast(next_batch), "platform", "left")  # one row per platform
    batch = F.coalesce("next_batch", F.lit(1)).cast("bigint")
    folder = F.concat(F.lit("publish/"), "platform", F.lit("/"), padded(batch), F.lit(f"_{day}"))
    return numbered.select("platform", batch.alias("batch"), folder.alias("folder"), "asset_id", "filename", "text",
                           F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint").alias("words"), "sha256", "export_event_id")


def collected_events(taken: DataFrame) -> DataFrame:
    """The OUTBOX/COLLECTED event of every file of a batch: platform, asset_id, stage, status, message."""
    profile = F.create_map(*[F.lit(x) for p in fixed.PLATFORM_PROFILES for x in (p["platform"], p["version"])])[F.col("platform")]
    message = F.to_json(F.struct("platform", profile.alias("profile"), "batch", "folder", "filename", "sha256", "export_event_id"))
    return taken.select("platform", "asset_id", F.lit("OUTBOX").alias("stage"), F.lit("COLLECTED").alias("status"), message.alias("message"))


def outcomes(taken: DataFrame, pending: DataFrame) -> DataFrame:
    """What a collection did, per platform: its files, the skipped with the reason, and NOTHING_TO_COLLECT where no file was due."""
    text = F.lit(None).cast("string")
    none = [F.lit(None).cast("bigint").alias("batch"), text.alias("folder")]
    files = taken.select("platform", F.lit("COLLECTED").alias("outcome"), "asset_id", "batch", "folder", text.alias("reason"))
    skipped = pending.filter(F.col("outcome").startswith("skipped: ")).select("platform", F.lit("SKIPPED").alias("outcome"), "asset_id", *none, F.expr("substr(outcome, 10)").alias("reason"))
    platforms = pending.sparkSession.createDataFrame([(p,) for p in fixed.PLATFORMS], "platform string")
    idle = platforms.join(taken.select("platform").distinct(), "platform", "left_anti").select(
        "platform", F.lit("NOTHING_TO_COLLECT").alias("outcome"), F.lit(None).cast("bigint").alias("asset_id"), *none, text.alias("reason"))
    return files.unionByName(skipped).unionByName(idle)


def collect_into(store: EventStore, key: str, exports: DataFrame, listing: DataFrame, day: str) -> None:
    """Collects what the log of ``store`` does not name yet: one commit of the events, the table ``manifest`` and the table ``outcomes``.

    Batch numbers follow the log. The same key again changes nothing; another key finds only what is new.
    """
    if store.committed(key):
        return
    collected = log.collected(store.events())
    pending = materialize(integrity.batch_pending(exports, collected, listing), "pending")
    batches = statistics.next_batch(collected, collected.select("platform", F.element_at(F.split("folder", "/"), -1).alias("folder")))
    taken = materialize(collect(pending, batches, day), "taken")
    store.append(key, collected_events(taken), ("platform", "asset_id"), {"manifest": taken, "outcomes": outcomes(taken, pending)})


def to_prepare(states: DataFrame) -> DataFrame:
    """Approved assets without a current file, per platform: prepare, or refused with the reason (platform, asset_id, action, detail)."""
    todo = None
    for platform in fixed.PLATFORMS:
        refusal = input_refusal(platform)
        part = states.filter(F.col("state").isin("publication_approved", "ready_for_export") & F.array_contains("approved_for", platform) & (F.col(f"{platform}_file.status") != "ready_for_export")) \
            .select(F.lit(platform).alias("platform"), "asset_id", F.when(refusal.isNull(), "prepare").otherwise("refused").alias("action"), refusal.alias("detail"))
        todo = part if todo is None else todo.unionByName(part)
    return todo


def collect_all(store: EventStore, key: str, states: DataFrame, exports: DataFrame, listing: DataFrame, day: str) -> DataFrame:
    """Per platform: approved assets without a current file to prepare or refuse, then the new batch, then the outcome of the platform."""
    collect_into(store, key, exports, listing, day)
    done = store.result(key, "outcomes")
    collected = done.filter("outcome = 'COLLECTED'").select("platform", "asset_id", F.lit("collect").alias("action"), F.col("folder").alias("detail"))
    outcome = done.filter("outcome <> 'SKIPPED'").select("platform", F.lit(None).cast("bigint").alias("asset_id"), F.lit("outcome").alias("action"), F.col("outcome").alias("detail")).distinct()
    return to_prepare(states).unionByName(collected).unionByName(outcome)
