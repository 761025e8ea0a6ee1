"""Person names: tokens, initials, case, suffixes, splitting."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import among, let, lookup, spaced, strip, words

INITIALISM = r"^(?:(?:[A-Za-z]\.)+|[A-Za-z](?:-[A-Za-z])+|(?:[A-Za-z]\.-)+[A-Za-z]\.)$"

# Multi-letter expansions, letters without a decomposition, particles, generational suffixes.
DIGRAPHS = {"ä": "ae", "Ä": "Ae", "ö": "oe", "Ö": "Oe", "ü": "ue", "Ü": "Ue", "ß": "ss", "ø": "oe", "Ø": "Oe"}
PLAIN_LETTERS = {
    "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "đ": "d", "Đ": "D",
    "ħ": "h", "Ħ": "H", "œ": "oe", "Œ": "Oe", "ı": "i", "ĳ": "ij", "Ĳ": "IJ",
}
PARTICLES = (
    "van", "von", "de", "der", "den", "des", "ter", "ten", "te", "zu", "zum", "zur", "da", "das", "dos", "do", "di", "du",
    "del", "della", "degli", "delle", "la", "le", "el", "y", "af", "av",
)
GENERATIONAL = {
    "jr": ("Jr.", "Jr", "Junior"),
    "junior": ("Jr.", "Jr", "Junior"),
    "sr": ("Sr.", "Sr", "Senior"),
    "senior": ("Sr.", "Sr", "Senior"),
    "ii": ("II",),
    "iii": ("III",),
    "iv": ("IV",),
}


def _decomposed() -> dict[str, str]:
    """Letters of up to U+1FFF that lose marks when decomposed, with what is left."""
    out = {}
    for code in range(0xC0, 0x2000):
        left = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if left and left != chr(code):
            out[chr(code)] = left
    return out


_MARKED = _decomposed()
_ONE = {a: b for a, b in _MARKED.items() if len(b) == 1}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_marks(text: Column) -> Column:
    """Without accents, and plain letters for those that are no accented letter.

    Composed letters up to U+1FFF are decomposed by table; Hangul syllables stay composed.
    """
    text = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    text = F.regexp_replace(text, r"\p{Mn}", "")
    one = {a: b for a, b in PLAIN_LETTERS.items() if len(b) == 1}
    text = F.translate(text, "".join(one), "".join(one.values()))
    return _replaced(text, {a: b for a, b in PLAIN_LETTERS.items() if len(b) > 1})


def digraph(text: Column) -> Column:
    """German and Nordic letters written out, then without accents."""
    return strip_marks(_replaced(text, DIGRAPHS))


def is_initialism(token: Column) -> Column:
    """``E.``, ``E.A.``, ``J-M``, ``J.-M.``"""
    return token.rlike(INITIALISM)


def is_initial(token: Column) -> Column:
    """A bare letter or an initialism."""
    return let(strip(token), lambda t: t.rlike(r"^\p{L}$") | is_initialism(t))


def is_usable(given: Column, family: Column) -> Column:
    """Both sides have a token that is no initial."""
    full = lambda side: F.exists(words(side), lambda t: ~is_initial(t))
    return F.coalesce(full(given) & full(family), F.lit(False))


def _capitalised(part: Column) -> Column:
    mc = F.lower(part).startswith("mc") & part.rlike(r"^..\p{L}")
    return (
        F.when(part == "", part)
        .when(is_initialism(part), F.upper(part))
        .when(mc, F.concat(F.lit("Mc"), F.upper(F.substring(part, 3, 1)), F.lower(F.substring(part, 4, 1 << 30))))
        .otherwise(F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, 2, 1 << 30))))
    )


def title_token(token: Column) -> Column:
    """Capitalised by hyphen parts; initialisms in capitals, McX."""
    return F.when(is_initialism(token), F.upper(token)).otherwise(F.array_join(F.transform(F.split(token, "-"), _capitalised), "-"))


def title_name(text: Column) -> Column:
    return spaced(F.transform(words(text), title_token))


def particle_forms(family: Column) -> Column:
    """The family name and, if that differs, the same with particles in lower case."""

    def forms(tokens):
        low = spaced(F.transform(tokens, lambda t: F.when(among(F.lower(t), PARTICLES), F.lower(t)).otherwise(t)))
        return F.when((F.size(tokens) < 2) | (low == family), F.array(family)).otherwise(F.array(family, low))

    return let(words(family), forms)


def generational_surfaces(token: Column) -> Column:
    """Spellings of a generational suffix, null for any other token."""
    return lookup(GENERATIONAL, F.regexp_replace(F.lower(F.regexp_replace(token, ",+$", "")), r"\.+$", ""))


def peel_generational(text: Column) -> Column:
    """Struct of the name without a trailing generational suffix, and the suffix's spellings (or null)."""

    def peeled(tokens):
        last = F.when(F.size(tokens) > 0, generational_surfaces(F.element_at(tokens, F.greatest(F.size(tokens), F.lit(1)))))
        core = strip(F.regexp_replace(spaced(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))), ",+$", ""))
        return let(last, lambda s: F.struct(F.when(s.isNull(), text).otherwise(core).alias("core"), s.alias("surfaces")))

    return let(words(text), peeled)


def initial_forms(token: Column) -> Column:
    """``E.`` of a plain token; ``J.-M.``, ``J-M``, ``JM`` of a hyphenated one."""

    def forms(parts):
        letters = F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1)))
        dotted = F.transform(letters, lambda c: F.concat(c, F.lit(".")))
        return (
            F.when(F.size(parts) == 0, F.array().cast("array<string>"))
            .when(F.size(parts) == 1, dotted)
            .otherwise(F.array(F.array_join(dotted, "-"), F.array_join(letters, "-"), F.array_join(letters, "")))
        )

    return let(F.filter(F.split(token, "-"), lambda p: p != ""), forms)


def space_hyphens(text: Column) -> Column:
    """Hyphens of words as spaces; initialisms stay, a trailing comma too."""

    def one(token):
        core = F.regexp_replace(token, ",$", "")
        comma = F.when(token.endswith(","), F.lit(",")).otherwise(F.lit(""))
        return F.when(is_initialism(core), token).otherwise(F.concat(F.translate(core, "-", " "), comma))

    return spaced(F.transform(words(text), one))


def split_display(name: Column) -> Column:
    """Struct given, family of a display name; a generational suffix goes with the family."""

    def split(peeled):
        core = strip(F.regexp_replace(peeled["core"], ",+$", ""))

        def sides(core):
            tokens = words(core)
            comma = F.instr(core, ",")
            given = F.when(comma > 0, strip(F.substring_index(core, ",", 1 << 30).substr(comma + 1, F.length(core)))).otherwise(spaced(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))))
            family = F.when(comma > 0, strip(core.substr(F.lit(1), comma - 1))).when(F.size(tokens) < 2, core).otherwise(F.element_at(tokens, -1))
            suffix = F.when(peeled["surfaces"].isNotNull() & (family != ""), F.concat(F.lit(" "), F.element_at(peeled["surfaces"], 1))).otherwise(F.lit(""))
            return F.when(core == "", F.struct(F.lit("").alias("given"), F.lit("").alias("family"))).otherwise(F.struct(given.alias("given"), F.concat(family, suffix).alias("family")))

        return let(core, sides)

    return let(peel_generational(strip(name)), split)


def heal(given: Column, family: Column) -> Column:
    """Struct given, family; an empty family takes the last token of the given side unless that is a bare initial."""

    def healed(x):
        tokens, g, f = x["t"], x["g"], x["f"]
        last = F.element_at(tokens, F.greatest(F.size(tokens), F.lit(1)))
        takes = (f == "") & (F.size(tokens) >= 2) & ~F.regexp_replace(F.coalesce(last, F.lit("")), r"\.+$", "").rlike(r"^\p{L}$")
        return F.struct(F.when(takes, spaced(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))))).otherwise(g).alias("given"), F.when(takes, last).otherwise(f).alias("family"))

    return let(F.struct(strip(given).alias("g"), strip(family).alias("f")), lambda s: let(F.struct(words(s["g"]).alias("t"), s["g"].alias("g"), s["f"].alias("f")), healed))


def sides_of_forms(forms: Column) -> Column:
    """Struct given, family of the first spelling with a comma (null if none has one)."""
    first = F.element_at(F.filter(forms, lambda x: x.contains(",")), 1)
    comma = F.instr(first, ",")
    return F.when(F.exists(forms, lambda x: x.contains(",")), F.struct(strip(first.substr(comma + 1, F.length(first))).alias("given"), strip(first.substr(F.lit(1), comma - 1)).alias("family")))
