"""Small Column helpers over arrays and ordered rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(*items: Column) -> Column:
    """Array of the non-null items, order kept."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def flag(condition: Column, value) -> Column:
    """``value`` when the condition holds, otherwise null (also for a null condition)."""
    return F.when(condition, value if isinstance(value, Column) else F.lit(value))


def codes(*rules: tuple[Column, str]) -> Column:
    """Array of the codes whose conditions hold, in rule order."""
    return compact(*[flag(cond, code) for cond, code in rules])


def first_match(rules: Iterable[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    """Value of the first rule whose condition holds (a null condition does not hold)."""
    expr = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def strings(values: Iterable[str]) -> Column:
    """Literal array of strings; an empty one keeps its type."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def empty_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def or_empty(items: Column) -> Column:
    return F.coalesce(items, empty_strings())


def n(items: Column) -> Column:
    """Array size as BIGINT, 0 for null."""
    return F.coalesce(F.size(items), F.lit(0)).cast("bigint")


def joined(items: Column, separator: str = ",") -> Column:
    return F.array_join(items, separator)


def sorted_distinct(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``: inside lambdas an expression would be evaluated per item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column by an outer generator: a filter on a plain one is pushed below it, with a copy of the whole
    expression for every mention of the column."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def repeated(values: Column) -> Column:
    """Per value, whether an equal one stands before it: by sorting, so long arrays aren't searched value by value."""
    ordered = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    marked = let(ordered, lambda s: F.transform(s, lambda p, j: F.struct(p["i"].alias("i"), ((j > 0) & F.coalesce(F.get(s, j - 1)["v"] == p["v"], F.lit(False))).alias("again"))))
    return F.transform(F.array_sort(marked), lambda p: p["again"])


def first_of_each(items: Column, key) -> Column:
    """Structs whose key is seen for the first time, order kept."""
    def pick(xs: Column) -> Column:
        return let(F.struct(xs.alias("xs"), repeated(F.transform(xs, key)).alias("again")), lambda s: F.filter(s["xs"], lambda x, i: ~F.get(s["again"], i)))
    return let(items, pick)
