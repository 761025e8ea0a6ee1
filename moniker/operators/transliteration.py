"""Forms of a name in other scripts, and other Latin spellings, from a model: passes, narrow retries, filters.

Requests are rows; every step asks for all keys at once and is joined back by key. ``key`` identifies a label.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import names, scripts, toolcalls, variants
from ..functions.base import distinct, let, strip
from ..functions.contaminants import holds_example, label_key
from ..schema import SCRIPTS
from ..sources.lines import settled, spread
from . import prompts
from .expansion import company_script_forms
from .stages import Client, attempted, read_call

TAGS = SCRIPTS[1:]
# Scripts asked for together.
PASSES = {
    "transliterate_a": ("cy", "gk", "hb", "ab"),
    "transliterate_b": ("cn", "jp", "kr"),
    "transliterate_c": ("dv", "th", "gg", "am"),
}


def _all_tags() -> Column:
    return F.array(*map(F.lit, TAGS))


def _nothing() -> Column:
    return F.create_map().cast("map<string,array<string>>")


def answered(client: Client, asks: DataFrame, attempt: int) -> DataFrame:
    """``asks`` (stage, key, label, tags) with ``found``: forms by tag, of the tags asked for; null without such a call."""
    raw = spread(client.answers(prompts.prompted(asks.withColumn("attempt", F.lit(attempt)))))
    found = read_call(F.col("raw_text"), toolcalls.emitted_scripts)
    return raw.select(*asks.columns, F.map_filter(found, lambda t, _: F.array_contains("tags", t)).alias("found"))


def tried(client: Client, asks: DataFrame) -> DataFrame:
    """``answered``, asked once more where no call came."""
    first = settled(answered(client, asks, 0), "answers")
    return first.where("found is not null").unionByName(answered(client, first.where("found is null").drop("found"), 1))


def gathered(rows: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``rows`` (key, ...) with the forms by tag of all their answers, those of the first stage by name first."""
    # the outer explode, as the other one asks for the map beforehand, which reads each answer once more
    entries = answers.select("key", "stage", F.explode_outer("found").alias("tag", "forms")).where("tag is not null")
    by_key = entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("stage", "tag", "forms"))).alias("e"))
    of = lambda e, t: F.array_distinct(F.flatten(F.transform(F.filter(e, lambda x: x["tag"] == t), lambda x: x["forms"])))
    merged = lambda e: F.map_from_entries(F.transform(_all_tags(), lambda t: F.struct(t.alias("key"), of(e, t).alias("value"))))
    forms = F.map_filter(let(F.col("e"), merged), lambda _, v: F.size(v) > 0)
    return rows.join(by_key.select("key", forms.alias(name)), "key", "left").withColumn(name, F.coalesce(name, _nothing()))


def person_forms(forms: Column, chinese: tuple[str, str] = ("", "")) -> Column:
    """Every form with the orders and spellings usual in its script."""
    return F.transform_values(forms, lambda tag, vs: F.array_distinct(F.flatten(F.transform(vs, lambda v: scripts.expand(v, tag, chinese)))))


def fitted(forms: Column, label: Column) -> Column:
    """Struct kept, rejected of forms by tag; rejected: in another script, or an example form of another name.

    ``label`` is a ``label_key``.
    """
    judged = lambda tag, v: F.struct(v.alias("form"), (scripts.in_script(v, tag) & ~holds_example(label, v)).alias("good"))
    each = F.transform_values(forms, lambda t, vs: F.transform(distinct(F.transform(vs, strip)), lambda v: judged(t, v)))
    told = lambda m, test: F.map_filter(F.transform_values(m, lambda _, vs: F.transform(F.filter(vs, test), lambda v: v["form"])), lambda _, vs: F.size(vs) > 0)
    return let(each, lambda m: F.struct(told(m, lambda v: v["good"]).alias("kept"), told(m, lambda v: ~v["good"]).alias("rejected")))


def missing(forms: Column, wanted: Column | None = None) -> Column:
    """Wanted tags (all but Latin if not given) without a form, in corpus order."""
    return F.array_except(_all_tags() if wanted is None else wanted, F.map_keys(forms))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("key", "label").distinct().withColumn("label_key", label_key(F.coalesce("label", F.lit(""))))


def _narrow(rows: DataFrame, stage: str) -> DataFrame:
    """A request for each missing tag."""
    each = rows.select("key", "label", "rejected", F.explode("missing").alias("tag"))
    return each.select(F.concat(F.lit(f"{stage}_"), "tag").alias("stage"), "key", "label", F.array("tag").alias("tags"), "rejected")


def completed(client: Client, rows: DataFrame, passes: Mapping[str, tuple[str, ...]] = PASSES, chinese: tuple[str, str] = ("", "")) -> DataFrame:
    """``rows`` (key, label) with forms by tag and the tags still missing (empty: the cluster is complete).

    The passes, each asked once more without a call; forms are widened and filtered; then a request for each missing
    tag (stage ``transliterate_<tag>``), whose forms are widened and filtered by themselves.
    """
    todo = _keyed(rows)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.array(*map(F.lit, t)).alias("tags")) for s, t in passes.items())))
    asks = todo.select(each.alias("p"), "key", "label").select("p.stage", "key", "label", "p.tags")
    first = spread(gathered(todo, tried(client, asks), "raw")).withColumn("fit", fitted(person_forms(F.col("raw"), chinese), F.col("label_key")))
    first = settled(first.select("key", "label", "label_key", "fit.kept", "fit.rejected", missing(F.col("fit.kept")).alias("missing")), "passes")
    more = spread(gathered(first, answered(client, _narrow(first, "transliterate"), 1), "extra"))
    extra = fitted(person_forms(F.col("extra"), chinese), F.col("label_key"))["kept"]
    done = more.select("key", C.merge_by_tag(F.col("kept"), extra).alias("forms"))
    return rows.join(done.withColumn("missing", missing(F.col("forms"))), "key", "left")


def transcribed(client: Client, rows: DataFrame, chinese: tuple[str, str] = ("", "")) -> DataFrame:
    """``rows`` (key, label) with forms and missing: one request for all tags, one for each missing tag, one for what is left.

    Answers add up, and what has come so far is widened and filtered anew each time; widened forms are never widened again.
    """

    def state(raw: DataFrame) -> DataFrame:
        fit = spread(raw).withColumn("fit", fitted(person_forms(F.col("raw"), chinese), F.col("label_key")))
        return settled(fit.select("key", "label", "label_key", "raw", F.col("fit.kept").alias("forms"), "fit.rejected", missing(F.col("fit.kept")).alias("missing")), "wave")

    def added(now: DataFrame, answers: DataFrame) -> DataFrame:
        return state(gathered(now, answers, "more").withColumn("raw", C.merge_by_tag(F.col("raw"), F.col("more"))))

    todo = _keyed(rows)
    whole = lambda df, tags: df.select(F.lit("transcribe").alias("stage"), "key", "label", tags.alias("tags"))
    now = state(gathered(todo, answered(client, whole(todo, _all_tags()), 0), "raw"))
    now = added(now, answered(client, _narrow(now, "transcribe"), 0))
    now = added(now, answered(client, whole(now.where("size(missing) > 0"), F.col("missing")), 1))
    return rows.join(now.select("key", "forms", "missing"), "key", "left")


def company_scripts(client: Client, rows: DataFrame, chinese: tuple[str, str] = ("", "")) -> DataFrame:
    """``rows`` (label) with the scripts judged plausible and forms by tag; rows of one label share them.

    The judge is asked twice at most; then one request (stage ``company_emit``) for the judged scripts, and one more for
    those that came to nothing where the first was answered. Whatever is missing then, the row stays.
    """
    shown = rows.select("label").where("label is not null").distinct().withColumn("key", F.col("label"))
    told = attempted(client, shown, "judge", toolcalls.plausible_scripts).select("key", "label", F.array_intersect(_all_tags(), F.coalesce("result", F.array().cast("array<string>"))).alias("tags"))
    told = settled(told, "judged")
    asks = told.where("size(tags) > 0").select(F.lit("company_emit").alias("stage"), "key", "label", "tags")
    widened = lambda c: fitted(company_script_forms(F.col(c), chinese), label_key(F.col("label")))
    first = answered(client, asks, 0).where("found is not null").withColumn("fit", widened("found"))
    first = first.select("stage", "key", "label", "tags", F.col("fit.kept").alias("kept"), "fit.rejected").withColumn("missing", missing(F.col("kept"), F.col("tags")))
    first = settled(first, "emitted")
    again = answered(client, first.where("size(missing) > 0").select("stage", "key", "label", F.col("missing").alias("tags"), "rejected"), 1)
    extra = again.where("found is not null").select("key", widened("found")["kept"].alias("extra"))
    done = first.join(extra, "key", "left").select("label", C.merge_by_tag(F.col("kept"), F.coalesce("extra", _nothing())).alias("forms"))
    out = rows.join(told.select("label", F.col("tags").alias("scripts")), "label", "left").join(done, "label", "left")
    return out.withColumn("forms", F.coalesce("forms", _nothing()))


def sides_of_latin(forms: Column) -> Column:
    """Struct given, family of the first spelling with a comma, else of the first one."""
    with_comma = F.filter(forms, lambda x: x.contains(","))
    return names.split_display(F.coalesce(F.get(with_comma, 0), F.get(forms, 0), F.lit("")))


def display_name(given: Column, family: Column) -> Column:
    return F.concat_ws(" ", F.nullif(strip(given), F.lit("")), strip(family))


def respelled(client: Client, lines: DataFrame) -> DataFrame:
    """``lines`` (line_no, line) with other Latin spellings from a model added after those there; one line for each.

    Lines that are no cluster, or give no family name, come back as they are, as do those without an answer after two attempts.
    """
    cells = spread(lines).withColumn("c", C.parse_lenient(F.col("line"))).withColumn("la", C.forms(F.col("c")))
    sides = cells.withColumn("n", F.when(F.size("la") > 0, sides_of_latin(F.col("la")))).withColumn("key", F.when(F.col("n.family") != "", F.col("line_no").cast("string")))
    sides = settled(sides, "sides")
    asks = sides.where("key is not null").select("key", display_name(F.col("n.given"), F.col("n.family")).alias("label"))
    alts = attempted(client, asks, "alternatives", toolcalls.alternative_spellings).select("key", F.col("result").alias("alts"))
    latin = variants.with_alternatives(F.col("n.given"), F.col("n.family"), F.col("alts"), F.col("la"))
    cell = lambda v: F.struct(F.lit("la").alias("tag"), v.alias("value"))
    rebuilt = C.format_line(F.concat(F.transform(latin, cell), C.others(F.col("c"))))
    line = F.when(F.col("key").isNull(), F.col("line")).when(F.size(F.coalesce("alts", F.array().cast("array<string>"))) > 0, rebuilt)
    kept = C.format_line(F.concat(F.transform(F.array_distinct("la"), cell), C.others(F.col("c"))))
    return spread(sides.join(alts, "key", "left")).select("line_no", line.otherwise(kept).alias("line"))
