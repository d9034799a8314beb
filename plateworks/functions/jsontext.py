"""Rewriting of JSON texts in place: members and strings are exchanged, order and all other bytes stay.

A text is cut into tokens by one pattern; what changes is exchanged token by token, and the rest is put together again. Callers test that
a text is JSON (an object with a key twice is none); other texts would come back changed in undefined ways.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A JSON string. The repetition is possessive: nothing in it can match the closing quote, so no match is lost, and the pattern
# engine keeps no frame per character (a string of some thousand characters would overflow the task's stack).
STRING = r'"(?:[^"\\]++|\\.)*+"'
# A string (with the colon, where it is a key) or what lies between strings.
STRINGS = STRING + r'(?:\s*:)?|[^"]+'
# A key with its colon, another string, white space, one sign of the structure, or a number or word.
TOKENS = STRING + r'\s*:|' + STRING + r'|\s+|[\[\]{},]|[^\[\]{},:"\s]+'


def unquoted(token: Column) -> Column:
    """The value of a JSON string token."""
    return F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v")


def strings_replaced(text: Column, fold, hit, replacement: str) -> Column:
    """(json, hits): every string value, at any depth, for which ``hit(fold(value))`` holds becomes ``replacement``; keys stay.

    Values are unquoted and folded once each, before ``hit`` looks at them as often as it likes.
    """
    tokens = F.regexp_extract_all(text, F.lit(STRINGS), 0)
    folded = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.when(t.startswith('"') & t.endswith('"'), fold(unquoted(t))).alias("value")))
    marked = F.transform(folded, lambda m: F.struct(m["t"].alias("t"), F.coalesce(hit(m["value"]), F.lit(False)).alias("hit")))
    hits = F.size(F.filter(marked, lambda m: m["hit"]))
    written = F.array_join(F.transform(marked, lambda m: F.when(m["hit"], F.lit('"' + replacement + '"')).otherwise(m["t"])), "")
    return F.struct(F.when(hits > 0, written).otherwise(text).alias("json"), hits.alias("hits"))


def has_member(text: Column, name: str) -> Column:
    """The object has the member at its top level, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), name), F.lit(False))


def member_replaced(text: Column, path: tuple[str, ...], value: str) -> Column:
    """The member at ``path`` (of objects inside objects) gets the JSON text ``value``, whatever it held; without it the text stays."""
    names = F.array(*[F.lit(p) for p in path])
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("matched"), F.lit("copy").alias("mode"), F.lit("").alias("out"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        blank = t.rlike(r"^\s+$")
        named = t.endswith(":") & (unquoted(F.regexp_replace(t, r"\s*:$", "")) == F.get(names, s["matched"]))
        # a key counts only directly inside the object that the path has led to
        here = (s["mode"] == "copy") & (s["depth"] == s["matched"] + 1) & named
        last = s["matched"] == len(path) - 1
        ends = (s["mode"] == "drop") & (s["depth"] == s["matched"] + 1) & (t.isin(",", "}"))
        entered = (s["mode"] == "enter") & (t == "{")
        mode = (F.when(here & last, "drop").when(here, "enter").when(ends, "copy").when((s["mode"] == "enter") & ~blank, "copy").otherwise(s["mode"]))
        left = (t == "}") & (depth == s["matched"]) & (s["matched"] > 0) & (s["mode"] != "drop")
        matched = s["matched"] + F.when(entered, 1).when(left, -1).otherwise(0)
        written = F.when(here & last, F.concat(s["out"], t, F.lit(value))).when((s["mode"] == "drop") & ~ends, s["out"]).otherwise(F.concat(s["out"], t))
        return F.struct(depth.alias("depth"), matched.alias("matched"), mode.alias("mode"), written.alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKENS), 0), start, step)["out"]


def with_member(text: Column, name: str, value: str) -> Column:
    """The top-level member ``name`` of an object gets the JSON text ``value``: in its place where there is one, else at the end."""
    body = F.regexp_replace(text, r"\s*\}\s*$", "")
    added = F.concat(body, F.when(body.rlike(r"^\s*\{\s*$"), "").otherwise(","), F.lit(f'"{name}":{value}}}'))
    # the plain case: the name stands once and holds a scalar, so the pattern finds the member itself
    scalar = r'("' + name + r'"\s*:\s*)(?:' + STRING + r'|[^\s"\[\]{},]+)'
    once = (F.regexp_count(text, F.lit(f'"{name}"\\s*:')) == 1) & text.rlike(scalar)
    exchanged = F.when(once, F.regexp_replace(text, scalar, "$1" + value.replace("\\", "\\\\").replace("$", "\\$"))).otherwise(member_replaced(text, (name,), value))
    return F.when(has_member(text, name), exchanged).otherwise(added)


def any_contained(value: Column, needles: Column) -> Column:
    """The text holds one of ``needles``."""
    return F.exists(needles, lambda n: F.contains(value, n))
