"""Spelling variants of person and company names, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names as N
from .base import also, distinct, let, lookup, spaced, strip, words

MOST_ALTS = 3
MOST_COMPANY_FORMS = 64

# Spellings of legal forms and acronyms.
ORG_CASE = {
    "llc": "LLC", "llp": "LLP", "plc": "PLC", "gmbh": "GmbH", "ag": "AG", "se": "SE", "oy": "Oy", "pte": "Pte.", "srl": "S.R.L.",
    "ooo": "OOO", "zoo": "zoo",
}
LEGAL_FORMS = {
    "inc": ("Inc.", "Inc", "Incorporated"),
    "incorp": ("Incorp.", "Incorporated"),
    "incorporated": ("Inc.", "Inc", "Incorporated"),
    "ltd": ("Ltd.", "Ltd", "Limited"),
    "limited": ("Ltd.", "Ltd", "Limited"),
    "llc": ("LLC", "L.L.C.", "L.L.C"),
    "llp": ("LLP", "L.L.P."),
    "lp": ("L.P.", "L.P"),
    "corp": ("Corp.", "Corp", "Corporation"),
    "corporation": ("Corp.", "Corp", "Corporation"),
    "co": ("Co.", "Co", "Company"),
    "company": ("Co.", "Co", "Company"),
    "pte": ("Pte.", "Pte"),
    "plc": ("PLC", "P.L.C."),
    "sa": ("SA", "S.A."),
    "nv": ("NV", "N.V."),
    "bv": ("BV", "B.V."),
    "kk": ("KK", "K.K."),
    "kaisha": ("Kaisha", "K.K."),
    "ooo": ("OOO", "O.O.O."),
    "ab": ("AB", "Ab"),
    "spz": ("Sp.",),
    "gmbh": ("GmbH",),
    "ag": ("AG",),
    "se": ("SE",),
    "oy": ("Oy", "OY"),
    "zoo": ("zoo", "ZOO"),
    "aktiengesellschaft": ("Aktiengesellschaft", "AG", "A.G."),
    "sarl": ("SARL", "S.A.R.L.", "Société à responsabilité limitée"),
    "companyltd": ("Company, Ltd.", "Co., Ltd.", "Co Ltd.", "Company Limited", "Ltd."),
    "coltd": ("Co., Ltd.", "Co Ltd.", "Co., Limited", "Company, Ltd.", "Ltd."),
    "companylimited": ("Company Limited", "Company, Limited", "Co., Ltd.", "Ltd."),
    "colimited": ("Co., Ltd.", "Co Ltd.", "Co., Limited", "Ltd."),
    "corpltd": ("Corp., Ltd.", "Corporation, Ltd.", "Ltd."),
    "corporationltd": ("Corp., Ltd.", "Corporation, Ltd.", "Ltd."),
    "pteltd": ("Pte. Ltd.", "Pte Ltd.", "Pty. Ltd."),
    "kabushikikaisha": ("Kabushiki Kaisha", "K.K.", "KK"),
}
#: Tokens that name the kind of a legal entity and are no part of a canonical key.
ENTITY_TOKENS = (
    "inc", "incorp", "incorporated", "ltd", "limited", "llc", "llp", "lp", "corp", "corporation", "co", "company", "gmbh", "ag", "sa",
    "se", "bv", "nv", "plc", "pty", "kabushiki", "kaisha", "kk", "srl", "spz", "zoo", "ooo", "oy", "ab",
)


def canonical_key(raw: Column) -> Column:
    """Lower-case ASCII letters and digits by token, without legal-entity tokens."""
    tokens = F.split(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "), " ")
    return spaced(F.filter(tokens, lambda t: (t != "") & ~t.isin(*ENTITY_TOKENS)))


def _given_forms(given: Column) -> Column:
    """Full, first, all initials, compact initials, first and initials; one empty form of an empty given side."""

    def forms(tokens):
        lists = F.filter(F.transform(tokens, N.initial_forms), lambda x: F.size(x) > 0)
        none = F.array().cast("array<string>")
        product = F.aggregate(
            lists,
            F.array(F.lit("")),
            lambda have, more: F.flatten(F.transform(have, lambda a: F.transform(more, lambda b: F.when(a == "", b).otherwise(F.concat_ws(" ", a, b))))),
        )
        firsts = F.transform(lists, lambda x: F.element_at(x, 1))
        rest = F.filter(F.transform(F.slice(tokens, 2, 1 << 20), N.initial_forms), lambda x: F.size(x) > 0)
        several = F.size(tokens) > 1
        plain = ~F.exists(tokens, lambda t: t.contains("-"))
        return F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(
            distinct(
                F.concat(
                    F.array(spaced(tokens), F.element_at(tokens, 1)),
                    F.when(F.size(lists) > 0, product).otherwise(none),
                    F.when(several & plain, F.array(F.array_join(firsts, ""))).otherwise(none),
                    F.when(several & (F.size(rest) > 0), F.array(F.concat_ws(" ", F.element_at(tokens, 1), spaced(F.transform(rest, lambda x: F.element_at(x, 1)))))).otherwise(none),
                )
            )
        )

    return let(words(given), forms)


def spelled(forms: Column) -> Column:
    """Each form followed by the one without accents and the one written out, where they differ."""

    def three(form):
        return let(
            F.struct(N.strip_marks(form).alias("s"), N.digraph(form).alias("d")),
            lambda x: F.concat(
                F.array(form),
                F.when(x["s"] == form, F.array().cast("array<string>")).otherwise(F.array(x["s"])),
                F.when((x["d"] == form) | (x["d"] == x["s"]), F.array().cast("array<string>")).otherwise(F.array(x["d"])),
            ),
        )

    return F.flatten(F.transform(forms, three))


def person_variants(given: Column, family: Column) -> Column:
    """Spellings of a person's name in Latin script, in order of generation; none without a family name."""

    def of(sides):
        surfaces = F.coalesce(sides["f"]["surfaces"], sides["g"]["surfaces"])
        families = N.particle_forms(N.title_name(sides["f"]["core"]))
        givens = _given_forms(N.title_name(sides["g"]["core"]))
        ordered = F.flatten(
            F.transform(
                families,
                lambda fam: F.flatten(F.transform(givens, lambda giv: F.when(giv == "", F.array(fam)).otherwise(F.array(F.concat_ws(" ", giv, fam), F.concat(fam, F.lit(", "), giv))))),
            )
        )
        with_suffix = let(ordered, lambda b: F.when(surfaces.isNull(), b).otherwise(F.flatten(F.transform(b, lambda x: F.transform(surfaces, lambda s: F.concat_ws(" ", x, s))))))
        cased = also(also(spelled(with_suffix), N.space_hyphens), F.upper)
        return F.when(sides["f"]["core"] == "", F.array().cast("array<string>")).otherwise(distinct(F.transform(cased, strip)))

    none = F.array().cast("array<string>")
    return F.when(strip(family) == "", none).otherwise(let(F.struct(N.peel_generational(strip(family)).alias("f"), N.peel_generational(strip(given)).alias("g")), of))


def with_alternatives(given: Column, family: Column, alternatives: Column, base: Column | None = None) -> Column:
    """Variants of the name and of up to three other spellings; one whose family is a given name here is left out."""
    alts = F.slice(distinct(F.transform(alternatives, strip)), 1, MOST_ALTS)
    own = F.transform(words(given), F.lower)
    sides = F.filter(F.transform(alts, N.split_display), lambda s: (s["family"] != "") & ~F.array_contains(own, F.lower(s["family"])))
    more = F.flatten(F.transform(sides, lambda s: person_variants(s["given"], s["family"])))
    return F.array_distinct(F.concat(person_variants(given, family) if base is None else base, more))


def org_token(token: Column) -> Column:
    """A token of a company name: acronyms by table, digits and & as they are, else capitalised."""
    known = lookup(ORG_CASE, F.lower(F.regexp_replace(token, r"^[.,]+|[.,]+$", "")))
    return F.coalesce(known, F.when(token.rlike(r"[\p{Nd}&]"), token).otherwise(N.title_token(token)))


def title_org(text: Column) -> Column:
    return spaced(F.transform(words(text), org_token))


def suffix_key(text: Column) -> Column:
    return F.regexp_replace(N.strip_marks(F.lower(text)), "[^a-z0-9]+", "")


def peel_legal_form(tokens: Column) -> Column:
    """Struct of the tokens without a legal form of two tokens or one, and the form's spellings (none: empty)."""
    n = F.size(tokens)
    none = F.array().cast("array<string>")
    two = F.when(n >= 3, lookup(LEGAL_FORMS, suffix_key(spaced(F.slice(tokens, F.greatest(n - 1, F.lit(1)), F.lit(2))))))
    one = F.when(n >= 2, lookup(LEGAL_FORMS, suffix_key(F.element_at(tokens, F.greatest(n, F.lit(1))))))
    return let(
        F.struct(two.alias("two"), one.alias("one")),
        lambda x: F.when(x["two"].isNotNull(), F.struct(F.slice(tokens, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("core"), x["two"].alias("surfaces")))
        .when(x["one"].isNotNull(), F.struct(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("core"), x["one"].alias("surfaces")))
        .otherwise(F.struct(tokens.alias("core"), none.alias("surfaces"))),
    )


def company_variants(display: Column) -> Column:
    """Spellings of a company name, at most 64: legal form spelled or dropped, accents, hyphens, &, capitals."""

    def of(peeled):
        core = spaced(F.transform(peeled["core"], org_token))

        def forms(core):
            bare = F.regexp_replace(core, "[.,]+$", "")
            base = F.concat(F.transform(peeled["surfaces"], lambda s: F.concat_ws(" ", core, s)), F.array(F.when(bare == "", core).otherwise(bare)))
            separated = also(spelled(base), N.space_hyphens)
            anded = also(separated, lambda v: F.regexp_replace(v, r"(?U)\s&\s", " and "))
            return F.slice(distinct(F.transform(also(anded, F.upper), lambda v: spaced(words(v)))), 1, MOST_COMPANY_FORMS)

        return let(core, forms)

    return let(words(display), lambda t: F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(let(peel_legal_form(t), of)))
