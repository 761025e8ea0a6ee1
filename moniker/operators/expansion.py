"""Expanding cluster lines without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import scripts, variants
from ..schema import SCRIPTS
from ..sources.lines import spread


def company_lines(lines: DataFrame) -> DataFrame:
    """Columns line_no, line, route, display of cluster lines (line_no, line) of companies.

    Lines of Latin cells are ``expanded``: the spellings seen, then those of the first one in title case. Lines with
    cells of other scripts are ``passed`` as they are; what is no cluster line is left out. Input order is kept by line_no.
    """
    parsed = spread(lines).withColumn("c", C.parse_lenient(F.col("line"))).where("c is not null")
    seen = F.transform("c", lambda c: c["value"])
    is_latin = F.forall("c", lambda c: c["tag"] == "la")
    routed = parsed.withColumns({"route": F.when(is_latin, "expanded").otherwise("passed"), "seen": seen, "display": F.when(is_latin, variants.title_org(F.element_at(seen, 1)))})
    forms = F.array_distinct(F.concat("seen", variants.company_variants(F.col("display"))))
    line = F.when(F.col("route") == "passed", F.col("line")).otherwise(F.array_join(F.transform(forms, lambda f: F.concat(F.lit("la{"), f, F.lit("}"))), "\t"))
    return routed.select("line_no", line.alias("line"), "route", "display")


def company_script_forms(forms: Column, chinese: tuple[str, str] = ("", "")) -> Column:
    """Forms by tag (a map) with Cyrillic yo written plainly and both sorts of Chinese; no orders or initials."""

    def more(tag, value):
        cn = F.array(value, F.translate(value, *chinese), F.translate(value, *chinese[::-1])) if chinese[0] else F.array(value)
        return F.when(tag == "cy", F.array(value, scripts.without_yo(value))).when(tag == "cn", cn).otherwise(F.array(value))

    return F.transform_values(forms, lambda tag, values: F.array_distinct(F.flatten(F.transform(values, lambda v: more(tag, v)))))


def cluster_cells(latin: Column, forms: Column) -> Column:
    """Cells in corpus order: Latin spellings, then the forms of each script."""
    cell = lambda tag: lambda v: F.struct(F.lit(tag).alias("tag"), v.alias("value"))
    none = F.array().cast("array<string>")
    return F.concat(F.transform(latin, cell("la")), *(F.transform(F.coalesce(forms[t], none), cell(t)) for t in SCRIPTS[1:]))
