"""Cluster lines: tab-joined cells ``tag{value}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CELLS, LATIN, SCRIPTS
from .base import let, strip



def _split(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"[\r\n]+$", ""), "\t")


def _cell(part: Column) -> Column:
    return F.struct(F.substring(part, 1, 2).alias("tag"), part.substr(F.lit(4), F.length(part) - 4).alias("value"))


def parse_lenient(line: Column) -> Column:
    """Cells of a line, null unless every part is two lower-case letters and braces; values may be empty."""
    return let(F.split(line, "\t"), lambda parts: F.when(F.forall(parts, lambda p: p.rlike(r"(?s)^[a-z]{2}\{.*\}$")), F.transform(parts, _cell)).otherwise(F.lit(None).cast(CELLS)))


def _reason(part: Column) -> Column:
    shaped = part.rlike(r"(?s)^(?:" + "|".join(SCRIPTS) + r")\{.*\}$")
    return F.when(~shaped, F.lit("malformed_cell")).when(F.length(part) == 4, F.lit("empty_value"))


def validate(line: Column) -> Column:
    """Struct ok, reason (of the first bad cell; null if ok), tags seen before it."""

    def checked(parts):
        bad = F.transform(parts, lambda p: F.coalesce(_reason(p), F.lit("")))
        at = F.array_position(F.transform(bad, lambda r: r != ""), True)
        tags = F.transform(F.slice(parts, F.lit(1), F.when(at == 0, F.size(parts)).otherwise(at.cast("int") - 1)), lambda p: F.substring(p, 1, 2))

        def result(x):
            reason = F.when(x["at"] > 0, F.element_at(bad, F.greatest(x["at"].cast("int"), F.lit(1)))).when(~F.array_contains(x["tags"], LATIN), F.lit("no_la_cell"))
            return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.array_distinct(x["tags"]).alias("tags"))

        return let(F.struct(at.alias("at"), tags.alias("tags")), result)

    blank = strip(line) == ""
    empty = F.struct(F.lit(False).alias("ok"), F.lit("empty_line").alias("reason"), F.array().cast("array<string>").alias("tags"))
    return F.when(line.isNull() | blank, empty).otherwise(let(_split(line), checked))


def parse(line: Column) -> Column:
    """Cells of a valid line, null for any other."""
    return F.when(validate(line)["ok"], F.transform(_split(line), _cell))


def format_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat(c["tag"], F.lit("{"), c["value"], F.lit("}"))), "\t")


def valid_cells(line: Column) -> Column:
    """The good cells of a line, whatever the others are."""
    return F.transform(F.filter(_split(line), lambda p: _reason(p).isNull()), _cell)


def forms(cells: Column, tag: str = LATIN) -> Column:
    return F.transform(F.filter(cells, lambda c: c["tag"] == tag), lambda c: c["value"])


def others(cells: Column) -> Column:
    return F.filter(cells, lambda c: c["tag"] != LATIN)


def missing_tags(tags: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, SCRIPTS)), tags)


def merge_by_tag(first: Column, second: Column) -> Column:
    """Maps tag to forms joined by tag, order kept, nothing twice."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(first, second, lambda _, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
