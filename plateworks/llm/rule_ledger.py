"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps one failure bit per rule beside the measurements. A
policy is a versioned mask over these bits: applying, comparing or ablating policies is bit arithmetic on the ledger and
reads no text again.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return. A null or
empty text has no words, fails ``few_words`` and has measurements of zero. Repeated rows get a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"

# Fixed values of the rules: bit number, rule, thresholds.
FEW_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS_PER_100_WORDS = 30
DUP_LINE_PERCENT = 60
MEAN_WORD_LOW, MEAN_WORD_HIGH = 2, 25
BAR_WORD_PERCENT = 20
SHOUT_PERCENT = 70

RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "bars", "shouting")


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, RULES)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_bar_words,
    n_upper and n_lower (A-Z, a-z).

    Repeated windows: each 3-word window is hashed (64 bits); hashes, packed with their position, are sorted within the
    row, so that equal windows are neighbours, which the full hashes confirm. The positions of repeated windows, sorted,
    cover ``least(3, distance to the next)`` words each. Nothing is exploded or shuffled.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bar_words", "n_upper", "n_lower")
    docs = docs.drop(*names)
    kept = docs.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(whole, F.lit(SPACE))
    df = docs.withColumn("__trimmed", trimmed).withColumn(
        "__words", F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", "[ \\t-\\r]+")))
    words = F.col("__words")
    df = df.withColumn("__n", F.size(words)).withColumn(
        "__windows", F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                                 lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    # as many low bits as the positions need; the rest of the 64 are the hash's
    bits = F.length(F.bin(F.col("__n").cast("long")))
    df = df.withColumn("__bits", bits).withColumn(
        "__sorted", F.sort_array(F.transform("__windows", lambda h, i: F.call_function("shiftleft", h, F.col("__bits")).bitwiseOR(i.cast("long")))))
    keys, windows, shift = F.col("__sorted"), F.col("__windows"), F.col("__bits")

    def position(key: Column) -> Column:
        return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1).cast("int")

    def hash_of(key: Column) -> Column:
        return F.get(windows, position(key))

    def repeated(key: Column, i: Column) -> Column:
        def same(other: Column) -> Column:
            top = F.call_function("shiftright", key.bitwiseXOR(other), shift) == 0
            return F.coalesce(top & (hash_of(key) == hash_of(other)), F.lit(False))
        return same(F.get(keys, i - 1)) | same(F.get(keys, i + 1))

    df = df.withColumn("__at", F.sort_array(F.transform(F.filter(keys, repeated), position)))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = df.withColumn("__lines", lines)

    def count_of(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(whole, pattern, "")).cast("long")

    # an array of one struct, unrolled: conditions on measurements stay above it instead of repeating the expressions below
    found = F.struct(
        F.col("__n").cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count_of("[^#*$%&|<>]+").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("__lines").cast("long").alias("n_lines"), F.size(F.filter(words, lambda w: w == "|")).cast("long").alias("n_bar_words"),
        count_of("[^A-Z]+").alias("n_upper"), count_of("[^a-z]+").alias("n_lower"))
    return df.select(*kept, F.inline(F.array(found)))


def _failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < FEW_WORDS,
        "repeated_windows": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > SYMBOLS_PER_100_WORDS * n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < MEAN_WORD_LOW * n) | (F.col("word_chars") > MEAN_WORD_HIGH * n),
        "bars": 100 * F.col("n_bar_words") > BAR_WORD_PERCENT * n,
        "shouting": 100 * F.col("n_upper") > SHOUT_PERCENT * (F.col("n_upper") + F.col("n_lower")),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and failed_bits (long): bit k is set where rule k of ``RULES`` fails."""
    failures = _failures()
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits + F.when(failures[rule], F.lit(1 << k)).otherwise(F.lit(0))
    return measured(docs.drop("failed_bits"), text).withColumn("failed_bits", bits.cast("long"))


def passes(policy: Policy, bits: str | Column = "failed_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = (BASE, STRICT)) -> DataFrame:
    """Per policy and rule in it: n_docs, n_failed (by the rule), n_only (by no other rule of the policy), n_kept, n_kept_without the rule.

    The ledger is first reduced to its distinct bit patterns, 2**len(RULES) at most, whatever the number of documents.
    """
    patterns = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("__n"))
    cases = F.array(*[F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
                               F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
                      for p in policies for r in p.rules])
    hit = F.col("failed_bits").bitwiseAND(F.col("c.mask"))

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("__n")).otherwise(0))

    return (patterns.withColumn("c", F.explode(cases)).groupBy("c.policy", "c.version", "c.rule").agg(
        F.sum("__n").alias("n_docs"), count(hit.bitwiseAND(F.col("c.bit")) != 0).alias("n_failed"), count(hit == F.col("c.bit")).alias("n_only"),
        count(hit == 0).alias("n_kept"), count((hit == 0) | (hit == F.col("c.bit"))).alias("n_kept_without")))


def verdicts(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """doc_id, the measurements, failed_bits, base_failed and kept (by ``policy``, which holds the base rules too)."""
    book = ledger(docs.select("doc_id", "text"))
    failed = ~passes(BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & passes(policy)).alias("kept"), "failed_bits")


def filtered(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows and columns of ``docs`` that pass the base rules and ``policy``; columns named like a measurement stay as they are.

    Null and empty texts have no words and fail; very long ones are measured whole; repeated rows are judged alike; an empty table gives none.
    """
    book = ledger(docs.select(F.struct("*").alias("row"), "text"))
    return book.where(passes(BASE) & passes(policy)).select("row.*")
