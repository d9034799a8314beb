"""Text expressions: normalisation, folding, term containment, tokens, claims, file-name slugs.

Text columns are made NFKC-stable once, on entry (``stabilize``); only strings that hold characters
outside ASCII and ``_NFKC_STABLE`` are sent to Python for it. After that every rule is a built-in expression.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateworks import fixed
from plateworks.functions.arrays import compact, flag, let, repeated, strings

# Characters beside ASCII that NFKC maps to themselves and that cannot start or join a composition: Latin-1
# and Latin Extended-A letters without compatibility forms, Cyrillic, common typography.
_NFKC_STABLE = (
    "\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u012F\\u0131\\u0134-\\u013E"
    "\\u0141-\\u0148\\u014A-\\u017E\\u0401\\u0410-\\u044F\\u0451\\u2010\\u2012-\\u2015\\u2018-\\u201F\\u2032\\u2212"
)
# two ranges reject most characters; the long class is asked about the others only
_RARE = r"[^\x00-\x7F\u00BF-\u012F]"
_UNSTABLE = rf"{_RARE}(?<![{_NFKC_STABLE}])"

# Typographic quotes and dashes become ASCII, invisible characters vanish (fixed values).
_QUOTES_SINGLE = "‘’‚‛′"
_QUOTES_DOUBLE = "“”„‟″«»"
_DASHES = "‐‑‒–—―−"
_INVISIBLE = "­​‌‍⁠﻿"
_WIDE_SEPARATORS = "\uff0c\ufe50\uff1b\ufe54"
_HELD_SEPARATORS = "\ue000\ue000\ue001\ue001"  # private-use stand-ins, turned into , and ; after the split
_FROM = _QUOTES_SINGLE + _QUOTES_DOUBLE + _DASHES + "\ue000\ue001" + _INVISIBLE
_TO = "'" * len(_QUOTES_SINGLE) + '"' * len(_QUOTES_DOUBLE) + "-" * len(_DASHES) + ",;"
_TYPOGRAPHIC = rf"{_RARE}(?<=[{_FROM}])"
# White space and control characters; nearly all texts hold only those of ASCII.
_BLANKS = r"[\x00-\x20\x7F]+"
_CONTROLS = r"[\x00-\x1F\x7F]"
_WIDE_BLANKS = r"\x80-\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

WORD_CHAR = r"\p{L}\p{N}_"
_BEFORE = rf"(?:^|[^{WORD_CHAR}])"
_AFTER = rf"(?:$|[^{WORD_CHAR}])"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_items(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in v])


def _beyond_ascii(text: Column) -> Column:
    """Told by the number of bytes, which costs far less than a pattern."""
    return F.octet_length(text) > F.length(text)


def _unstable(text: Column) -> Column:
    return _beyond_ascii(text) & text.rlike(_UNSTABLE)


def stabilize(df: DataFrame, *names: str, keywords: tuple[str, ...] = ()) -> DataFrame:
    """NFKC of the named string and string-array columns; stable values (nearly all) stay in the JVM.

    Python gets null for a stable value and gives null back, so each value is tested once. Raw keyword columns keep
    wide commas and semicolons apart from plain ones, because keywords are split before they are normalised.
    """
    stable = {}
    for name in (*names, *keywords):
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.ArrayType):
            if name in keywords:
                value = F.transform(value, lambda x: F.when(_beyond_ascii(x) & x.rlike(rf"{_RARE}(?<=[{_WIDE_SEPARATORS}])"), F.translate(x, _WIDE_SEPARATORS, _HELD_SEPARATORS)).otherwise(x))
            stable[name] = F.coalesce(_nfkc_items(let(value, lambda v: F.when(F.exists(v, _unstable), v))), value)
        else:
            stable[name] = F.coalesce(_nfkc(F.when(_unstable(value), value)), value)
    return df.withColumns(stable)


def tidy(text: Column) -> Column:
    """Normalisation after NFKC: typography, control characters, white space.

    A translation asks a map about every character, so it runs only over texts that hold one of its characters; one test
    tells the texts that hold no rare character at all.
    """
    def spaced(text: Column) -> Column:
        # prose has nothing but single spaces between its words
        return F.when(text.contains("  ") | text.rlike(_CONTROLS), F.regexp_replace(text, _BLANKS, " ")).otherwise(text)

    def rare(text: Column) -> Column:
        plain = F.when(text.rlike(_TYPOGRAPHIC), F.translate(text, _FROM, _TO)).otherwise(text)
        return let(plain, lambda t: F.when(_beyond_ascii(t) & t.rlike(rf"{_RARE}(?<=[{_WIDE_BLANKS}])"), F.regexp_replace(t, rf"[\x00-\x20\x7F{_WIDE_BLANKS}]+", " ")).otherwise(spaced(t)))

    return F.trim(let(text, lambda t: F.when(_beyond_ascii(t) & t.rlike(_RARE), rare(t)).otherwise(spaced(t))))


def normalize_text(text: Column) -> Column:
    return tidy(text)


def normalize_items(items: Column) -> Column:
    return F.transform(items, tidy)


def fold_stable(text: Column) -> Column:
    """Case folding of normalised text: lower case, with sharp s and the final sigma folded."""
    return fold_lower(F.lower(text))


def fold_lower(lower: Column) -> Column:
    """``fold_stable`` of a text that is in lower case already."""
    return F.replace(F.replace(lower, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def fold(text: Column) -> Column:
    """Normalised and case-folded text."""
    return fold_stable(tidy(text))


def fold_items(items: Column) -> Column:
    return F.transform(items, fold)


def normalize_title(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(normalize_text(text), r"\.+$", ""))


# --- terms -----------------------------------------------------------------------------------

def term_pattern(term: str) -> str:
    """Pattern that finds a literal term on word boundaries (no look-around needed to test presence)."""
    return _BEFORE + re.escape(term) + _AFTER


def has_term(text: Column, term: str) -> Column:
    """Whole-word presence of a literal term: a plain substring search rejects most texts before the pattern runs."""
    return text.contains(term) & text.rlike(term_pattern(term))


def _each(text: Column, terms: Iterable[str], test, combine) -> Column:
    """Combines a test per term over one evaluation of the text."""
    return let(text, lambda t: functools.reduce(combine, [test(t, term) for term in terms]))


def may_hold(text: Column, terms: Iterable[str]) -> Column:
    """Some term occurs as a substring (necessary for ``has_any``)."""
    return _each(text, terms, lambda t, term: t.contains(term), lambda a, b: a | b)


def has_any(text: Column, terms: Iterable[str]) -> Column:
    return _each(text, terms, has_term, lambda a, b: a | b)


def found_terms(text: Column, terms: Iterable[str], prefix: str = "") -> Column:
    """Terms present in the text, in list order."""
    return let(text, lambda t: compact(*[flag(has_term(t, term), prefix + term) for term in terms]))


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms are present."""
    return F.size(found_terms(text, terms))


def quoted(term: Column) -> Column:
    return F.regexp_replace(term, rf"([^{WORD_CHAR} ])", r"\\$1")


def pattern_of(term: Column) -> Column:
    return F.concat(F.lit(_BEFORE), quoted(term), F.lit(_AFTER))


def patterns_of(terms: Column) -> Column:
    """array<struct<term, pattern>> of an array of terms, empty ones left out; for ``holds``."""
    return F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.struct(t.alias("term"), pattern_of(t).alias("pattern")))


def holds(text: Column, term: Column) -> Column:
    """Whole-word presence of an element of ``patterns_of``: only a text with the term in it has its pattern compiled."""
    return text.contains(term["term"]) & F.rlike(text, term["pattern"])


def contains_term(text: Column, term: Column) -> Column:
    """Whole-word presence of a term that is itself a column; an empty term is never present.

    The first place of the term decides where it stands between word boundaries; a pattern, compiled anew for every term, runs only
    where it doesn't.
    """
    def decided(s: Column) -> Column:
        within, sought, at = s["text"], s["term"], s["at"]
        edge = lambda c: ~c.rlike(f"[{WORD_CHAR}]")  # noqa: E731  of no character too: a start or an end
        before = F.when(at > 1, F.substring(within, at - 1, F.lit(1))).otherwise("")
        free = edge(before) & edge(F.substring(within, at + F.length(sought), F.lit(1)))
        return F.when((at == 0) | (sought == ""), False).when(free, True).otherwise(F.rlike(within, pattern_of(sought)))

    return let(F.struct(text.alias("text"), term.alias("term"), F.instr(text, term).alias("at")), decided)


def without_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """Each listed phrase, one after the other, becomes a space; a pattern runs only where its phrase occurs at all."""
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(rf"(?<![{WORD_CHAR}]){re.escape(p)}(?![{WORD_CHAR}])").alias("pattern")) for p in phrases])
    return F.aggregate(pairs, text, lambda t, p: F.when(t.contains(p["phrase"]), F.regexp_replace(t, p["pattern"], F.lit(" "))).otherwise(t))


# --- tokens and grounding --------------------------------------------------------------------

def _stem(token: Column) -> Column:
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def tokens_stable(text: Column) -> Column:
    """Lower-case alphanumeric tokens, final s dropped from long ones, of normalised text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)), _stem)


def tokens(text: Column) -> Column:
    return tokens_stable(normalize_text(text))


def distinct_tokens(text: Column) -> Column:
    """``tokens`` without repeats; each distinct word is shortened once."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(F.lower(normalize_text(text)), F.lit(r"[a-z0-9]+"), F.lit(0))), _stem))


def grounded(token_list: Column, corpus: Column) -> Column:
    """Non-empty token list wholly inside the corpus."""
    return (F.size(token_list) > 0) & (F.size(F.array_except(token_list, corpus)) == 0)


def ungrounded(token_lists: Column, corpus: Column) -> Column:
    """Distinct tokens of many lists that the corpus lacks: one pass over lists and corpus, whatever their sizes."""
    return F.array_except(F.flatten(token_lists), corpus)


def grounded_but(token_list: Column, missing: Column) -> Column:
    """``grounded`` of one of the lists that ``missing`` was made of; no list is compared with the whole corpus again."""
    return (F.size(token_list) > 0) & ~F.arrays_overlap(token_list, missing)


_WORD = r"[A-Za-z0-9][A-Za-z0-9'\-]*"


def is_title_case(text: Column) -> Column:
    """At least 80 % of the words of four letters or more, after the first word, are capitalised."""
    def long_words(words: Column) -> Column:
        return F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.length(w) >= 4)

    def mostly_capital(words: Column) -> Column:
        return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) >= 0.8 * F.size(words))

    return let(let(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), long_words), mostly_capital)


def text_claims(text: Column, field: str, corpus: Column, proper_nouns: Column) -> Column:
    """Ungrounded numbers and proper nouns of a text: array<struct<term, field, reason>>."""
    bound = F.struct(F.split(text, r"(?<=[.!?])\s+").alias("sentences"), corpus.alias("corpus"), proper_nouns.alias("nouns"))

    def find(s: Column) -> Column:
        def bare(raw: Column) -> Column:
            return F.btrim(F.regexp_replace(raw, "'s$", ""), F.lit("'-"))

        def shaped_word(raw: Column, i: Column) -> Column:
            # a word keeps its first character and its digits when it is stripped, so most words are told by one test as they stand
            return raw.rlike("^[A-Z]|[0-9]") & (raw.rlike("[0-9]") | (s["nouns"] & ((i > 0) | bare(raw).rlike("^[A-Z]{2,}$"))))

        def claim(raw: Column) -> Column:
            word = bare(raw)
            reason = F.when(raw.rlike("[0-9]"), "NUMBER").otherwise("PROPER_NOUN")
            return F.struct(F.struct(word.alias("term"), F.lit(field).alias("field"), reason.alias("reason")).alias("claim"), tokens_stable(word).alias("tokens"))

        def of_sentence(sentence: Column) -> Column:
            return F.transform(F.filter(F.regexp_extract_all(sentence, F.lit(_WORD), F.lit(0)), shaped_word), claim)

        shaped = F.flatten(F.transform(s["sentences"], of_sentence))
        return let(F.struct(shaped.alias("shaped"), s["corpus"].alias("corpus")), unfounded)

    def unfounded(s: Column) -> Column:
        bound = F.struct(s["shaped"].alias("shaped"), ungrounded(F.transform(s["shaped"], lambda x: x["tokens"]), s["corpus"]).alias("missing"))
        return let(bound, lambda b: F.transform(F.filter(b["shaped"], lambda x: ~grounded_but(x["tokens"], b["missing"])), lambda x: x["claim"]))

    return let(bound, find)


# --- keywords --------------------------------------------------------------------------------

def keyword_parts(raw: Column) -> Column:
    """Raw keywords split on commas and semicolons, normalised, original form kept beside the clean one."""
    parts = F.flatten(F.transform(raw, lambda x: F.split(x, "[,;]")))

    def clean(original: Column) -> Column:
        # from the first letter or number to the last: both are looked for from the ends. A stripped part of tidy text is tidy
        keyword = F.regexp_extract(F.lower(original), r"(?s)^[^\p{L}\p{N}]*+(.*[\p{L}\p{N}])", 1)
        return F.struct(keyword.alias("keyword"), original.alias("original"))

    return F.transform(F.transform(parts, tidy), clean)


def sort_keywords(parts: Column, brands: Column) -> Column:
    """Adds the reason a keyword is dropped for (null = kept), first occurrence wins."""
    def judged(s: Column) -> Column:
        def judge(part: Column, i: Column) -> Column:
            keyword = part["keyword"]
            reason = (F.when(keyword == "", "EMPTY")
                      .when(F.exists(s["brands"], lambda b: holds(keyword, b)), "BRAND")
                      .when(keyword.isin(*fixed.KEYWORD_STOPWORDS), "STOPWORD")
                      .when(F.get(s["repeated"], i), "DUPLICATE"))
            return F.struct(F.when(keyword == "", part["original"]).otherwise(keyword).alias("keyword"), reason.alias("reason"))
        return F.transform(s["parts"], judge)

    return let(parts, lambda ps: let(
        F.struct(ps.alias("parts"), repeated(F.transform(ps, lambda p: p["keyword"])).alias("repeated"), patterns_of(brands).alias("brands")), judged))


def kept_keywords(judged: Column) -> Column:
    return F.transform(F.filter(judged, lambda k: k["reason"].isNull()), lambda k: k["keyword"])


def dropped_keywords(judged: Column) -> Column:
    return F.filter(judged, lambda k: k["reason"].isNotNull())


def brand_terms(brands: Column, logos: Column) -> Column:
    """Lower-cased brand and logo names, empty ones removed."""
    return F.filter(F.transform(normalize_items(F.concat(brands, logos)), F.lower), lambda b: b != "")


# --- file names ------------------------------------------------------------------------------

_ONE_LETTER = {k: v for k, v in fixed.TRANSLITERATION.items() if len(v) == 1}
_OTHER_LENGTH = {k: v for k, v in fixed.TRANSLITERATION.items() if len(v) != 1}
# Latin letters whose NFKD base is one ASCII letter, generated rather than listed.
_LATIN = "".join(chr(c) for c in range(0xC0, 0x180)
                 if re.fullmatch("[A-Za-z]", unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() or "-"))
_LATIN_BASE = "".join(unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in _LATIN)


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def forbidden_token(token: Column, own_name: str | None = None) -> Column:
    words = (*fixed.FILENAME_STOP_WORDS, *fixed.FILENAME_FORBIDDEN, *((own_name,) if own_name else ()))
    return token.isin(*words) | token.rlike(fixed.FILENAME_FORBIDDEN_PATTERN)


def slug(text: Column, own_name: str | None = None) -> Column:
    """ASCII tokens of a title allowed in a file name."""
    text = F.translate(F.lower(text), "".join(_ONE_LETTER), "".join(_ONE_LETTER.values()))
    for letter, spelling in _OTHER_LENGTH.items():
        text = F.replace(text, F.lit(letter), F.lit(spelling))
    text = F.translate(text, _LATIN, _LATIN_BASE)
    foreign = text.rlike(r"[^\x00-\x7Fß]")  # sharp s has no ASCII base: it vanishes
    text = F.when(foreign, _ascii_fold(F.when(foreign, text))).otherwise(F.regexp_replace(text, "ß", ""))
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: (t != "") & ~forbidden_token(t, own_name))
