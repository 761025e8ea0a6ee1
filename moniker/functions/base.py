"""Building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it.
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    return F.filter(F.split(strip(text), f"(?U){SPACE}+"), lambda t: t != "")


def spaced(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def distinct(texts: Column) -> Column:
    """Non-empty texts, the first of equals kept."""
    return F.array_distinct(F.filter(texts, lambda t: t != ""))


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a fixed table, null where it has no such key."""
    pairs = [F.lit(x) if not isinstance(x, (list, tuple)) else F.array(*map(F.lit, x)) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def among(value: Column, members: Iterable[str]) -> Column:
    return value.isin(*sorted(members))


def also(texts: Column, other: Callable[[Column], Column]) -> Column:
    """Each text followed by what ``other`` makes of it, if that is different."""
    return F.flatten(F.transform(texts, lambda t: let(other(t), lambda o: F.when(o == t, F.array(t)).otherwise(F.array(t, o)))))
