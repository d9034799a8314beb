"""DuckDB spellings of the text rules, used only by the comparison SQL."""

from __future__ import annotations

import re

from plateworks.functions import text as tx

W = r"\p{L}\p{N}_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(translate({x}, {q(tx._FROM)}, {q(tx._TO)}), '\\p{{Cc}}', ' ', 'g'), '\\s+', ' ', 'g'))")


def fold(x: str) -> str:
    return f"replace(lower({norm(x)}), 'ß', 'ss')"


def esc(term: str) -> str:
    return re.sub(rf"([^\w ])", r"\\\1", term)


def has(text: str, terms) -> str:
    return f"regexp_matches({text}, {q(f'(?:^|[^{W}])(?:' + '|'.join(esc(t) for t in terms) + f')(?:$|[^{W}])')})"


def found(text: str, terms, prefix: str = "") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(text, [t])} THEN {q(prefix + t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"


def count(text: str, terms) -> str:
    return "(" + " + ".join(f"CAST({has(text, [t])} AS INT)" for t in terms) + ")"


def contains(text: str, term: str) -> str:
    """Whole-word presence: the term becomes a mark, then one constant pattern tests its neighbours."""
    mark = "chr(1)"
    return f"(len({term}) > 0 AND regexp_matches(replace({text}, {term}, {mark}), '(?:^|[^{W}\\x01])\\x01(?:$|[^{W}\\x01])'))"


def without(text: str, phrases) -> str:
    for p in phrases:
        text = f"regexp_replace({text}, {q(f'(^|[^{W}]){esc(p)}($|[^{W}])')}, '\\1 \\2', 'g')"
    return text


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda tk: CASE WHEN len(tk) > 3 AND ends_with(tk, 's') THEN tk[1:-2] ELSE tk END)"


def grounded(tok: str, corpus: str) -> str:
    return f"(len({tok}) > 0 AND list_has_all({corpus}, {tok}))"


def title_case(x: str) -> str:
    words = f"list_filter(regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9''\\-]*')[2:], lambda w: len(w) >= 4)"
    return f"coalesce(len({words}) > 0 AND len(list_filter({words}, lambda w: regexp_matches(w, '^[A-Z]'))) >= 0.8 * len({words}), FALSE)"


def claims(text: str, field: str, corpus: str, nouns: str) -> str:
    word = "trim(regexp_replace(w, '''s$', ''), '''-')"
    reason = (f"CASE WHEN len({word}) = 0 OR {grounded(tokens(word), corpus)} THEN NULL WHEN regexp_matches({word}, '[0-9]') THEN 'NUMBER' "
              f"WHEN {nouns} AND ((i > 1 AND regexp_matches({word}, '^[A-Z]')) OR regexp_matches({word}, '^[A-Z]{{2,}}$')) THEN 'PROPER_NOUN' END")
    per = (f"list_filter(list_transform(regexp_extract_all(s, '[A-Za-z0-9][A-Za-z0-9''\\-]*'), lambda w, i: {{'term': {word}, 'field': '{field}', 'reason': {reason}}}), lambda c: c.reason IS NOT NULL)")
    return f"flatten(list_transform(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: {per}))"


def slug(x: str, own: str | None = None) -> str:
    from plateworks import fixed
    text = f"lower({x})"
    one = {k: v for k, v in fixed.TRANSLITERATION.items() if len(v) == 1}
    text = f"translate({text}, {q(''.join(one))}, {q(''.join(one.values()))})"
    for k, v in fixed.TRANSLITERATION.items():
        if len(v) != 1:
            text = f"replace({text}, {q(k)}, {q(v)})"
    words = ", ".join(q(w) for w in (*fixed.FILENAME_STOP_WORDS, *fixed.FILENAME_FORBIDDEN))
    return (f"list_filter(regexp_split_to_array(replace(strip_accents({text}), 'ß', ''), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({words}) "
            f"AND NOT regexp_matches(t, {q(fixed.FILENAME_FORBIDDEN_PATTERN)}))")
