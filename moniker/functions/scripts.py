"""Forms within non-Latin scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names as N
from .base import distinct, let, spaced, strip, words

GERESH = "׳"
PATRONYMICS = ("ович", "евич", "овна", "евна", "ична", "инична", "івна")
# Unicode blocks of each script.
BLOCKS = {
    "cy": r"\x{0400}-\x{052F}",
    "gk": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "ab": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "cn": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
    "jp": r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}",
    "kr": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "dv": r"\x{0900}-\x{097F}",
    "hb": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}",
    "th": r"\x{0E00}-\x{0E7F}",
    "gg": r"\x{10A0}-\x{10FF}\x{2D00}-\x{2D2F}",
    "am": r"\x{0530}-\x{058F}\x{FB13}-\x{FB17}",
}


def in_script(text: Column, tag: Column) -> Column:
    """There are letters and all are of the tag's script; tags without blocks take any text."""
    letters = F.regexp_replace(text, r"\P{L}", "")
    out = None
    for name, block in BLOCKS.items():
        fits = letters.rlike(f"^[{block}]+$")
        out = F.when(tag == name, fits) if out is None else out.when(tag == name, fits)
    return out.otherwise(True)


def _orders(given: Column, family: Column, initials: Column) -> Column:
    """Family first and last, with the given side in full and in initials, and after a comma."""
    none = F.array().cast("array<string>")
    full = lambda *forms: F.when(given != "", F.array(*forms)).otherwise(none)
    short = lambda *forms: F.when(initials != "", F.array(*forms)).otherwise(none)
    forms = F.concat(
        full(F.concat_ws(" ", family, given)),
        short(F.concat_ws(" ", family, initials)),
        full(F.concat_ws(" ", given, family)),
        short(F.concat_ws(" ", initials, family), F.concat(family, F.lit(", "), initials)),
        F.when((given == "") & (initials == ""), F.array(family)).otherwise(none),
    )
    return F.when(family == "", none).otherwise(distinct(forms))


def _initial(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lit("."))


def cyrillic_name(text: Column) -> Column:
    """Struct first, patronymic, family of a name of two or three tokens; null for others."""
    is_patronymic = lambda t: t.rlike("(?:" + "|".join(PATRONYMICS) + ")$")
    name = lambda a, b, c: F.struct(a.alias("first"), b.alias("patronymic"), c.alias("family"))

    def parts(t):
        at = lambda k: F.element_at(t, F.least(F.lit(k), F.greatest(F.size(t), F.lit(1))))
        return (
            F.when(F.size(t) == 2, name(at(1), F.lit(""), at(2)))
            .when((F.size(t) == 3) & is_patronymic(F.lower(at(2))), name(at(1), at(2), at(3)))
            .when((F.size(t) == 3) & is_patronymic(F.lower(at(3))), name(at(2), at(3), at(1)))
            .when(F.size(t) == 3, name(F.concat_ws(" ", at(1), at(2)), F.lit(""), at(3)))
        )

    return let(words(text), parts)


def cyrillic_variants(first: Column, patronymic: Column, family: Column) -> Column:
    def of(x):
        given = F.when(x["first"] == "", F.lit("")).otherwise(strip(F.concat_ws(" ", x["first"], x["patronymic"])))
        initials = F.concat(F.array_join(F.transform(words(x["first"]), _initial), ""), F.when(x["patronymic"] == "", F.lit("")).otherwise(_initial(x["patronymic"])))
        return _orders(given, x["family"], initials)

    return let(F.struct(N.title_name(first).alias("first"), N.title_name(patronymic).alias("patronymic"), N.title_name(family).alias("family")), of)


def two_parts(text: Column) -> Column:
    """Struct given, family: the last token is the family name; null for fewer than two tokens."""
    return let(words(text), lambda t: F.when(F.size(t) >= 2, F.struct(spaced(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))).alias("given"), F.element_at(t, -1).alias("family"))))


def greek_variants(given: Column, family: Column) -> Column:
    return let(
        F.struct(N.title_name(given).alias("g"), N.title_name(family).alias("f")),
        lambda x: _orders(x["g"], x["f"], F.when(x["g"] == "", F.lit("")).otherwise(_initial(x["g"]))),
    )


def hebrew_variants(given: Column, family: Column) -> Column:
    return let(
        F.struct(strip(given).alias("g"), strip(family).alias("f")),
        lambda x: _orders(x["g"], x["f"], F.when(x["g"] == "", F.lit("")).otherwise(F.concat(F.substring(x["g"], 1, 1), F.lit(GERESH)))),
    )


def without_yo(text: Column) -> Column:
    return F.translate(text, "ёЁ", "еЕ")


def order_flips(text: Column, tag: Column) -> Column:
    """A Chinese or Korean name as it is, two parts exchanged, and a first character that is a family name moved last."""
    separator = r"(?U)[\s·・＝=]+"

    def of(t):
        parts = F.filter(F.split(t, separator), lambda p: p != "")
        between = F.regexp_extract(t, f"({separator[4:]})", 1)
        swapped = F.when(F.size(parts) == 2, F.concat(F.element_at(parts, -1), F.when(between == "", F.lit(" ")).otherwise(between), F.element_at(parts, 1)))
        compact = ((tag == "cn") & t.rlike(r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]{2,3}$")) | ((tag == "kr") & t.rlike(r"^[\x{AC00}-\x{D7AF}]{2,3}$"))
        moved = F.when(compact, F.concat(F.substring(t, 2, 8), F.substring(t, 1, 1)))
        return distinct(F.array_compact(F.array(t, swapped, moved)))

    return let(strip(text), of)


def simplified_traditional(spark) -> tuple[str, str]:
    """Characters U+4E00-U+9FFF whose traditional form is another one, and those forms, by ICU on the driver.

    Character by character: phrases that are written differently as a whole are not covered.
    """
    convert = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Simplified-Traditional")
    every = "".join(map(chr, range(0x4E00, 0xA000)))
    done = convert.transliterate(every)
    pairs = [(a, b) for a, b in zip(every, done, strict=True) if a != b] if len(done) == len(every) else []
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def expand(value: Column, tag: Column, chinese: tuple[str, str] = ("", "")) -> Column:
    """All forms of a value within its script, the value first. ``chinese``: as ``simplified_traditional`` gives it."""
    as_is = F.array(value)
    cy = let(cyrillic_name(value), lambda n: F.when(n.isNull(), as_is).otherwise(F.concat(as_is, cyrillic_variants(n["first"], n["patronymic"], n["family"]))))
    cy = F.flatten(F.transform(F.array_distinct(cy), lambda f: F.array(f, without_yo(f))))
    gk = let(two_parts(value), lambda n: F.when(n.isNull(), as_is).otherwise(F.concat(as_is, greek_variants(n["given"], n["family"]))))
    hb = let(two_parts(value), lambda n: F.when(n.isNull(), as_is).otherwise(F.concat(as_is, hebrew_variants(n["given"], n["family"]))))
    cn = order_flips(value, F.lit("cn"))
    if chinese[0]:
        cn = F.flatten(F.transform(cn, lambda f: F.array(f, F.translate(f, *chinese), F.translate(f, *chinese[::-1]))))
    return F.array_distinct(F.when(tag == "cy", cy).when(tag == "gk", gk).when(tag == "hb", hb).when(tag == "cn", cn).when(tag == "kr", order_flips(value, F.lit("kr"))).otherwise(as_is))
