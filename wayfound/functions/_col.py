"""Small column helpers shared by the function modules."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    """The column as text, missing values as ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def squeeze(c) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def words(c) -> Column:
    """Space-separated words of already clean text, without empty ones."""
    return F.filter(F.split(col(c), " "), lambda w: w != "")


def _literal(v) -> str:
    """A value as SQL text: long literal lists are sent to the engine as one expression, not value by value."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)


def str_array(values) -> Column:
    vals = list(values)
    return F.expr("array(" + ",".join(_literal(v) for v in vals) + ")") if vals else F.array().cast("array<string>")


def one_of(c, values) -> Column:
    """Is the text one of the listed values?"""
    return F.array_contains(str_array(values), col(c))


def lookup(mapping: dict, key, default=None) -> Column:
    """Literal-map lookup; unknown keys give ``default`` (null when omitted)."""
    found = F.try_element_at(F.expr("map(" + ",".join(_literal(x) for kv in mapping.items() for x in kv) + ")"), col(key))
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def any_word(values) -> str:
    """Regex alternation of literal words."""
    return "|".join(re.escape(v) for v in values)


def chain(c, rules) -> Column:
    """Apply (pattern, replacement) rules in order."""
    out = col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def let(value, body) -> Column:
    """``body(v)`` with ``value`` computed once: keeps long rule chains linear in size."""
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def steps(value, *bodies) -> Column:
    """Nested :func:`let`: each body gets the result of the one before."""
    out = col(value)
    for body in bodies:
        out = let(out, body)
    return out
