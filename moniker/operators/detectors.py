"""What may be wrong with a cluster: detectors that give flags (detector, evidence)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.base import among, let, strip, words
from ..functions.names import PARTICLES, is_initial
from ..schema import FLAGS
from ..sources.lines import spread

# Title, generational, noise words; particles that are syllables too; title markers by script.
TITLES = (
    "dr", "prof", "mr", "mrs", "ms", "rev", "fr", "sir", "dame", "col", "capt", "cmdr", "hon", "phd", "ph.d", "md", "m.d", "esq", "st",
    "ing", "arq", "lic", "abg", "sr", "sra", "arch", "herr", "frau", "dipl", "mme", "mlle", "me", "dott", "dottore", "avv", "eng",
)
GENERATIONAL = ("jr", "sr", "junior", "senior", "ii", "iii", "iv")
SHORT_PARTICLES = ("zu", "du", "di", "da", "do", "de", "te", "la", "le", "y", "del")
NOISE = (
    "inc", "corp", "corporation", "ltd", "llc", "plc", "gmbh", "sarl", "ag", "bv", "nv", "sl", "spa", "sml", "university", "college",
    "institute", "laboratory", "lab", "bldg", "building", "avenue", "blvd", "street", "road", "lane", "suite", "apt", "campus", "plaza",
    "usa", "us", "u.s.a", "uk", "canada", "france", "germany", "india", "china", "japan", "korea", "mexico", "brazil", "sweden", "italy",
    "spain", "russia", "poland", "denmark", "norway", "finland", "austria", "switzerland", "netherlands", "belgium", "portugal", "greece",
    "turkey", "israel", "singapore", "australia", "new", "zealand",
)
TITLE_MARKERS = {
    "cy": ("др", "д-р", "д р", "доктор"),
    "gk": ("δρ",),
    "ab": ("دكتور",),
    "dv": ("डॉ", "डॉक्टर"),
    "hb": ("ד׳ר", "ד״ר"),
    "th": ("ดร",),
    "gg": ("დრ", "დ-რ"),
    "am": ("դր", "դ-ր"),
}

_NONE = "array<struct<key:string,detector:string,evidence:string>>"


def token_key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"\.+$", "")


def _found(key: Column, detector: str, evidence: Column) -> Column:
    return F.array(F.struct(key.alias("key"), F.lit(detector).alias("detector"), evidence.alias("evidence")))


def _none() -> Column:
    return F.array().cast(_NONE)


def _once(found: Column) -> Column:
    """Flags whose key has not come before."""
    seen = F.aggregate(
        found,
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast(FLAGS).alias("flags")),
        lambda s, f: F.when(F.array_contains(s["keys"], f["key"]), s).otherwise(
            F.struct(F.array_append(s["keys"], f["key"]).alias("keys"), F.array_append(s["flags"], F.struct(f["detector"].alias("detector"), f["evidence"].alias("evidence"))).alias("flags"))
        ),
        lambda s: s["flags"],
    )
    return seen


def _by_token(forms: Column, of: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``of(form, tokens, token, place from 0)`` for every token of every form."""
    return F.flatten(F.transform(forms, lambda form: let(words(form), lambda toks: F.flatten(F.transform(toks, lambda t, i: of(form, toks, t, i))))))


def _place(i: Column, n: Column) -> Column:
    return F.when(i == 0, "lead").when(i == n - 1, "trail").otherwise("middle")


def _quoted(token: Column, form: Column, between: Column | str) -> Column:
    return F.concat(F.lit("'"), token, F.lit("'"), between if isinstance(between, Column) else F.lit(between), F.lit(" in '"), form, F.lit("'"))


def titles(forms: Column) -> Column:
    def of(form, toks, t, i):
        k, place = token_key(t), _place(i, F.size(toks))
        is_title = ~t.rlike(r"^(?:[A-Za-z]\.)+$") & (F.length(k) >= 2) & among(k, TITLES) & ~((i == F.size(toks) - 1) & among(k, GENERATIONAL))
        return F.when(is_title, _found(F.concat_ws("\t", k, place), "D1_title", _quoted(t, form, F.concat(F.lit(" ("), place, F.lit(")"))))).otherwise(_none())

    return _once(_by_token(forms, of))


def misplaced_generational(forms: Column) -> Column:
    def of(form, toks, t, i):
        k, place = token_key(t), _place(i, F.size(toks))
        return F.when(among(k, GENERATIONAL) & (i < F.size(toks) - 1), _found(F.concat_ws("\t", k, place), "D2_generational", _quoted(t, form, F.concat(F.lit(" ("), place, F.lit(")"))))).otherwise(_none())

    return _once(_by_token(forms, of))


def particles(cells: Column, forms: Column) -> Column:
    """Particles alone on the family side or anywhere on the given side of comma forms.

    Where the cluster has Han characters, short particles that stand alone are taken for syllables.
    """
    cjk = F.exists(cells, lambda c: (c["tag"] != "la") & c["value"].rlike(r"[\x{4E00}-\x{9FFF}]"))

    def of(form):
        comma = F.instr(form, ",")
        family, given = words(form.substr(F.lit(1), F.greatest(comma - 1, F.lit(0)))), words(form.substr(comma + 1, F.length(form)))

        def sides(x):
            fam, giv = x["family"], x["given"]
            alone = F.element_at(fam, 1)
            k = token_key(alone)
            first = (F.size(fam) == 1) & ~is_initial(alone) & among(k, PARTICLES) & ~(cjk & among(k, SHORT_PARTICLES))
            on_family = F.when(F.coalesce(first, F.lit(False)), _found(k, "D3_particle_family", _quoted(alone, form, " lone-particle family side"))).otherwise(_none())

            def one(t):
                k = token_key(t)
                is_particle = ~is_initial(t) & among(k, PARTICLES) & ~(cjk & among(k, SHORT_PARTICLES) & (F.size(giv) == 1))
                return F.when(is_particle, _found(k, "D3_particle_given", _quoted(t, form, " on given side"))).otherwise(_none())

            return F.concat(on_family, F.flatten(F.transform(giv, one)))

        return F.when(comma == 0, _none()).otherwise(let(F.struct(family.alias("family"), given.alias("given")), sides))

    return _once(F.flatten(F.transform(F.filter(forms, lambda f: f.contains(",")), of)))


def noise(forms: Column) -> Column:
    def of(form):
        when = lambda test, code, what: F.when(test, _found(F.lit(code), code, F.concat(F.lit(what + " in '"), form, F.lit("'")))).otherwise(_none())
        tokens = F.flatten(F.transform(words(form), lambda t: F.when(among(token_key(t), NOISE), _found(token_key(t), "D4_noise", _quoted(t, form, ""))).otherwise(_none())))
        return F.concat(when(form.rlike(r"\p{Nd}"), "D4_digit", "digit"), when(form.rlike("[()]"), "D4_paren", "parentheses"), when(form.contains("&"), "D4_amp", "'&'"), tokens)

    return _once(F.flatten(F.transform(forms, of)))


def structure(forms: Column) -> Column:
    def of(form):
        v = strip(form)
        when = lambda test, code, what: F.when(test, _found(F.lit(code), code, F.concat(F.lit(what + " in '"), form, F.lit("'")))).otherwise(_none())

        def tokens(toks):
            pairs = F.zip_with(F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 2, 1 << 20), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            twice = lambda p: (F.lower(p["a"]) == F.lower(p["b"])) & ~(is_initial(p["a"]) & is_initial(p["b"]))
            repeated = F.flatten(F.transform(F.filter(pairs, twice), lambda p: _found(F.lower(p["a"]), "D5_duplicate", _quoted(F.concat_ws(" ", p["a"], p["b"]), form, ""))))
            marks = F.flatten(F.transform(F.filter(toks, lambda t: t.rlike(r"^[.,'\-]+$")), lambda t: _found(F.lit("D5_punct"), "D5_punct", F.concat(F.lit("punctuation-only token '"), t, F.lit("' in '"), form, F.lit("'")))))
            return F.concat(repeated, marks)

        return F.concat(
            when(v.startswith(",") | v.endswith(","), "D5_edge_comma", "edge comma"),
            when(F.length(v) - F.length(F.translate(v, ",", "")) > 1, "D5_multi_comma", "multiple commas"),
            let(words(v), tokens),
        )

    return _once(F.flatten(F.transform(forms, of)))


def taint(cells: Column) -> Column:
    """Latin letters or title markers in cells of other scripts; flagged in every cell."""

    def of(c):
        tokens = F.transform(words(c["value"]), token_key)
        flag = lambda detector, evidence: F.struct(F.lit(detector).alias("detector"), evidence.alias("evidence"))
        leak = F.array(flag("D6_latin_leak", F.concat(F.lit("latin chars in "), c["tag"], F.lit("{"), F.substring(c["value"], 1, 40), F.lit("}"))))
        marks = F.array().cast(FLAGS)
        for tag, markers in TITLE_MARKERS.items():
            hits = F.filter(F.array(*map(F.lit, sorted(markers))), lambda m: F.array_contains(tokens, m))
            marks = F.when(c["tag"] == tag, F.transform(hits, lambda m: flag("D6_title_taint", F.concat(F.lit("'"), m, F.lit("' in "), c["tag"], F.lit(" cell"))))).otherwise(marks)
        return F.when(c["value"].rlike("[A-Za-z]"), leak).otherwise(marks)

    return F.flatten(F.transform(C.others(cells), of))


#: In the order in which flags are listed.
DETECTORS: dict[str, Callable[[Column, Column], Column]] = {
    "titles": lambda cells, forms: titles(forms),
    "generational": lambda cells, forms: misplaced_generational(forms),
    "particles": particles,
    "noise": lambda cells, forms: noise(forms),
    "structure": lambda cells, forms: structure(forms),
    "taint": lambda cells, forms: taint(cells),
}


def flag(clusters: DataFrame, cells: str = "cells", only: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """``clusters`` with forms (Latin spellings) and flags of all detectors, or of some by name; by all cores."""
    out = spread(clusters).withColumn("forms", C.forms(F.col(cells)))
    for name in only:
        out = out.withColumn(f"__{name}", DETECTORS[name](F.col(cells), F.col("forms")))
    return out.withColumn("flags", F.concat(*(F.col(f"__{n}") for n in only))).drop(*(f"__{n}" for n in only))


def each_flag(flagged: DataFrame, *keep: str) -> DataFrame:
    """A row (detector, evidence) for each flag.

    By the outer explode, as the other one asks for flags beforehand: a filter that runs the detectors before rows are dealt out.
    """
    return flagged.select(*keep, F.explode_outer("flags").alias("__f")).where("__f is not null").select(*keep, "__f.detector", "__f.evidence")


def by_detector(flagged: DataFrame) -> DataFrame:
    """Flags by the family of their detector."""
    return each_flag(flagged).groupBy(F.substring_index("detector", "_", 1).alias("detector")).agg(F.count("*").alias("n"))
