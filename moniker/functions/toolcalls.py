"""Tool calls in raw model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SCRIPTS
from .base import distinct, let, strip
from .names import heal, is_usable
from .variants import person_variants

CALL = r"(?s)<tool_call>\s*<function=([^>\s]+)\s*>(.*?)</function>\s*</tool_call>"
#: Scripts for which a call may give other spellings beside the main one.
WITH_ALTERNATIVES = ("cy", "ab", "cn", "jp", "kr")
PARAMETER = r"(?s)<parameter=([^>\s]+)\s*>(.*?)</parameter>"


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def calls(text: Column) -> Column:
    """Array of struct name, args (map of raw parameter texts); the XML form first, else a JSON list of calls."""

    none = F.create_map().cast("map<string,string>")

    def found(text, pattern, **groups):
        return F.struct(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(name) for name, k in groups.items()))

    def arguments(body):
        from_json = F.when(strip(body).startswith("{"), F.from_json(strip(body), "map<string,string>"))
        # of parameters given twice the last counts
        last = lambda p, k: F.element_at(F.reverse(p["v"]), F.array_position(F.reverse(p["k"]), k).cast("int"))
        given = lambda p: F.map_from_entries(F.transform(F.array_distinct(p["k"]), lambda k: F.struct(k.alias("key"), strip(last(p, k)).alias("value"))))
        return let(found(body, PARAMETER, k=1, v=2), lambda p: F.when(F.size(p["k"]) > 0, given(p)).otherwise(F.coalesce(from_json, none)))

    def of(t):
        listed = F.when(strip(t).startswith("["), F.from_json(strip(t), "array<struct<name:string,arguments:map<string,string>,parameters:map<string,string>>>"))
        json = F.transform(
            F.filter(F.coalesce(listed, F.array().cast("array<struct<name:string,arguments:map<string,string>,parameters:map<string,string>>>")), lambda c: c["name"].isNotNull()),
            lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], c["parameters"], none).alias("args")),
        )
        xml = lambda x: F.zip_with(x["n"], x["b"], lambda n, b: F.struct(strip(n).alias("name"), arguments(b).alias("args")))
        return let(found(t, CALL, n=1, b=2), lambda x: F.when(F.size(x["n"]) > 0, xml(x)).otherwise(json))

    return let(strip_thinking(text), of)


def string_list(value: Column, most: int) -> Column:
    """A JSON list, or a single text, as at most so many distinct non-empty texts."""
    none = F.array().cast("array<string>")

    def of(s):
        listed = F.when(s.startswith("["), F.from_json(s, "array<string>"))
        return F.when(s.isNull() | (s == ""), none).otherwise(F.slice(distinct(F.transform(F.coalesce(listed, F.array(s)), lambda x: strip(F.coalesce(x, F.lit("None"))))), 1, most))

    return let(strip(value), of)


def extraction(call: Column) -> Column:
    """Struct outcome, variants of a call that extracts a name; null for other calls."""
    text = lambda key: strip(F.coalesce(call["args"][key], F.lit("")))
    none = F.lit(None).cast("array<string>")
    result = lambda outcome, variants: F.struct(F.lit(outcome).alias("outcome"), variants.alias("variants"))
    named = let(
        heal(text("given"), text("family")),
        lambda n: F.when(is_usable(n["given"], n["family"]), result("extract_name", person_variants(n["given"], n["family"]))).otherwise(result("incomplete_name", none)),
    )
    return F.when(call["name"] == "not_a_person_name", result("not_a_person_name", none)).when(call["name"] == "extract_name", named)


def plausible_scripts(call: Column) -> Column:
    """Script tags that a judging call names; null for other calls."""
    return F.when(call["name"] == "plausible_company_scripts", F.filter(string_list(call["args"]["scripts"], len(SCRIPTS)), lambda t: t.isin(*SCRIPTS)))


def emitted_scripts(call: Column, alternatives: int = 2) -> Column:
    """Map of tag to forms that a transliterating call gives; null for other calls."""
    none = F.array().cast("array<string>")
    entries = []
    for tag in SCRIPTS[1:]:
        main = strip(F.coalesce(call["args"][tag], F.lit("")))
        alts = string_list(call["args"][f"{tag}_alt"], alternatives) if tag in WITH_ALTERNATIVES else none
        extra = F.array(strip(F.coalesce(call["args"]["jp_kana"], F.lit("")))) if tag == "jp" else none
        entries.append(F.struct(F.lit(tag).alias("key"), distinct(F.concat(F.array(main), alts, extra)).alias("value")))
    found = F.map_filter(F.map_from_entries(F.array(*entries)), lambda _, v: F.size(v) > 0)
    return F.when(call["name"] == "emit_scripts", found)


def alternative_spellings(call: Column, most: int = 3) -> Column:
    """Other Latin spellings that a call gives, none twice; null for other calls."""
    return F.when(call["name"] == "emit_alt_latin", F.coalesce(string_list(call["args"]["alts"], most), F.array().cast("array<string>")))
