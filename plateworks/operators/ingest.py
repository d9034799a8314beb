"""Registration of files: hashing, deduplication, classification, paths, the actor of an event."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import documents as doc
from plateworks.functions import jsontext
from plateworks.functions.arrays import first_match
from plateworks.operators.ranking import with_position


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def supported(listing: DataFrame, extensions=fixed.SUPPORTED_EXTENSIONS) -> DataFrame:
    return listing.filter(suffix(F.col("path")).isin(*extensions))


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of the content, which is not carried further."""
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def container(content: Column) -> Column:
    """Container type from the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 16))
    brand = F.substring(content, 9, 4).cast("string")
    rules = [(head.startswith(sig), name) for sig, name in fixed.SIGNATURES]
    ftyp = head.substr(9, 8) == "66747970"
    rules += [(ftyp & (brand == b), name) for b, name in fixed.FTYP_BRANDS.items()]
    rules.append((head.startswith("52494646") & (head.substr(17, 8) == "57454250"), "WEBP"))
    return first_match(rules, F.lit(None).cast("string"))


def extension_container(extension: Column) -> Column:
    return first_match([(F.lower(extension) == e, c) for e, c in fixed.EXTENSION_CONTAINER.items()], F.lit(None).cast("string"))


def register(arrivals: DataFrame, registry: DataFrame, extensions=fixed.SUPPORTED_EXTENSIONS) -> DataFrame:
    """arrivals(path, extension, file_hash, file_size, decodable) -> outcome per file and ids of new assets.

    The first path of a content within the batch is a map-side combined minimum; the many copies of one
    content never meet in one task.
    """
    checked = arrivals.withColumn("refused", F.when(~F.lower("extension").isin(*extensions), "UNSUPPORTED"))
    # content is looked up once per distinct hash, not once per copy
    firsts = (checked.filter(F.col("refused").isNull()).groupBy("file_hash").agg(F.min(F.when(F.col("decodable"), F.col("path"))).alias("path"))
              .join(registry.select("file_hash").distinct(), "file_hash", "left_anti").filter(F.col("path").isNotNull()))
    start = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))
    fresh = with_position(firsts.select("path"), "path").join(F.broadcast(start)).select("path", (F.col("position") + F.col("last_id")).alias("asset_id"))
    outcome = first_match([(F.col("refused").isNotNull(), F.col("refused")), (F.col("asset_id").isNotNull(), "REGISTERED"),
                           (~F.col("decodable"), "UNDECODABLE")], "DUPLICATE")
    return checked.join(fresh, "path", "left").select("path", "file_hash", "asset_id", outcome.alias("outcome"))


SALTS = 16


def looked_up(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row per ``key``). Only keys that rows hold are joined, and the answer is sent
    to ``SALTS`` places, so that rows of one key are spread by ``by`` and never meet in one task."""
    answers = rows.select(key).distinct().join(table, key).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(answers, [key, "salt"], "left").drop("salt")


def pending(arrivals: DataFrame, registry: DataFrame) -> DataFrame:
    """Arrivals not registered by path, with the asset that already has the same content."""
    known = registry.select(slashes(F.col("source_path")).alias("path")).distinct()
    same = registry.groupBy("file_hash").agg(F.max("id").alias("duplicate_of"))
    return looked_up(arrivals.join(known, "path", "left_anti"), same, "file_hash", "path")


def classify(arrivals: DataFrame, registry: DataFrame) -> DataFrame:
    """already_registered (exact path) before duplicate_content (hash) before new."""
    by_path = registry.groupBy(F.col("source_path").alias("path")).agg(F.max("id").alias("by_path"))
    by_hash = registry.groupBy("file_hash").agg(F.max("id").alias("by_hash"))
    kind = first_match([(F.col("by_path").isNotNull(), "already_registered"), (F.col("by_hash").isNotNull(), "duplicate_content")], "new")
    return looked_up(arrivals.join(by_path, "path", "left"), by_hash, "file_hash", "path").withColumn("kind", kind)


def path_changes(registry: DataFrame) -> DataFrame:
    """Rows whose stored path needs normalising, with the event to append; a second run finds nothing."""
    old = F.col("source_path")
    changed = registry.filter(F.instr(old, "\\") > 0).select("id", old.alias("old"), slashes(old).alias("new"))
    return changed.withColumn("message", F.to_json(F.struct("old", "new")))


def unreadable(rows: DataFrame) -> DataFrame:
    """rows(asset_id, file_hash, actual_hash, container, decodable) -> failure code, null when readable. Without facts (nulls) a file is of no known format."""
    code = first_match([
        (F.col("actual_hash").isNull(), "SOURCE_MISSING"), (F.col("actual_hash") != F.col("file_hash"), "SOURCE_CHANGED"),
        (F.col("decodable"), F.lit(None).cast("string")), (F.col("container") == "HEIF", "MISSING_CODEC"),
        (F.col("container").isNotNull(), "DECODE_ERROR")], "UNSUPPORTED_FORMAT")
    return rows.withColumn("code", code)


def restrict(assets: DataFrame, from_id: int, to_id: int | None = None, ids: DataFrame | None = None, column: str = "asset_id") -> DataFrame:
    """id >= from [and <= to] and, optionally, membership in a list of ids."""
    kept = assets.filter(F.col(column) >= from_id)
    if to_id is not None:
        kept = kept.filter(F.col(column) <= to_id)
    return kept if ids is None else kept.join(ids.select(column).distinct(), column, "left_semi")


def user_set(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Assets whose content lies in a folder, and files without an asset (asset_id null)."""
    assets = registry.join(files.select("file_hash").distinct(), "file_hash", "left_semi").select(F.col("id").alias("asset_id"), F.lit(None).cast("string").alias("path"))
    known = registry.select("file_hash", F.lit(True).alias("known")).distinct()
    orphans = looked_up(files, known, "file_hash", "path").filter(F.col("known").isNull()).select(F.lit(None).cast("bigint").alias("asset_id"), "path")
    return assets.unionByName(orphans)


def stamp_actor(message: Column, actor: str) -> Column:
    """Sets the top-level actor of a JSON object, whatever it held: in its place, or at the end. Any other text stays as it is.

    Members of other objects that are called actor are not touched, and all other bytes stay. An object with a key twice is no JSON object here.
    """
    return F.when(doc.is_json_object(message), jsontext.with_member(message, "actor", json.dumps(actor, ensure_ascii=False))).otherwise(message)
