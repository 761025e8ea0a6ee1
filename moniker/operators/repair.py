"""Repairing flagged clusters: audit, other spellings, other scripts, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import toolcalls, variants
from ..sources.lines import settled
from .dataset import rewritten
from .expansion import cluster_cells
from .stages import Client, attempted, audited
from .transliteration import display_name, transcribed


def repaired(client: Client, flagged: DataFrame, chinese: tuple[str, str] = ("", "")) -> DataFrame:
    """A record for each of ``flagged`` (line_no, line, given, family, flags): outcome, new_line, drop_reason, warnings.

    Fixed names get new Latin spellings, with alternatives, and forms in every other script; a name that still lacks
    a script is dropped. All four answers are joined by line.
    """
    rows = flagged.withColumn("key", F.col("line_no").cast("string"))
    told = settled(audited(client, rows), "audits")
    fixed = told.where("outcome = 'fixed'").select("key", display_name(F.col("fixed_given"), F.col("fixed_family")).alias("label"))
    alts = attempted(client, fixed, "alternatives", toolcalls.alternative_spellings).select("key", F.coalesce("result", F.array().cast("array<string>")).alias("alts"))
    forms = transcribed(client, fixed, chinese).select("key", "forms", "missing")
    both = told.join(alts, "key", "left").join(forms, "key", "left")
    short = (F.col("outcome") == "fixed") & (F.size("missing") > 0)
    latin = variants.with_alternatives(F.col("fixed_given"), F.col("fixed_family"), F.col("alts"))
    both = both.withColumns({
        "drop_reason": F.when(short, "transliteration_incomplete").otherwise(F.col("drop_reason")),
        "warnings": F.when(short, F.array(F.concat(F.lit("no form in "), F.array_join("missing", ", ")))).when(F.col("outcome") == "dropped", F.array(F.lit("no valid fix"))).otherwise(F.array().cast("array<string>")),
        "outcome": F.when(short, "dropped").otherwise(F.col("outcome")),
    })
    kept = lambda c: F.when(F.col("outcome") == "fixed", c)
    records = both.select(
        "line_no", F.col("line").alias("original"), "flags", "given", "family",
        kept(F.col("fixed_given")).alias("fixed_given"), kept(F.col("fixed_family")).alias("fixed_family"), kept(F.col("alts")).alias("alts"),
        kept(C.format_line(cluster_cells(latin, F.col("forms")))).alias("new_line"), "outcome", "drop_reason", "warnings",
    )
    return settled(records, "repair")


def report_lines(records: DataFrame) -> DataFrame:
    """line_no and the record as JSON, for records of a repair or rows of a dry run."""
    return records.select("line_no", F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("line"))


def dry_run(flagged: DataFrame) -> DataFrame:
    """The report without a model: what was flagged, and why."""
    flags = F.transform("flags", lambda f: F.struct(f["detector"].alias("d"), f["evidence"].alias("e")))
    return report_lines(flagged.select("line_no", F.col("line").alias("original"), "given", "family", flags.alias("flags")))


def repair_counts(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Counters of a repair of ``lines`` (line_no, line): lines, what could not be read, outcomes, lines written."""
    cells = C.parse_lenient(F.col("line"))
    read = lines.agg(F.count("*").alias("n_lines"), F.count_if(cells.isNull()).alias("n_unparseable"), F.count_if(cells.isNotNull() & (F.size(C.forms(cells)) == 0)).alias("n_no_la"))
    done = records.agg(
        F.count("*").alias("n_flagged"), F.count_if(F.col("outcome") == "fixed").alias("n_repaired"), F.count_if(F.col("outcome") == "clean").alias("n_clean"), F.count_if(F.col("outcome") == "dropped").alias("n_dropped")
    )
    return read.crossJoin(done).withColumn("n_output_lines", F.col("n_lines") - F.col("n_dropped"))


def dropped_by_reason(records: DataFrame) -> DataFrame:
    return records.where("outcome = 'dropped'").groupBy("drop_reason").agg(F.count("*").alias("n"))


def repaired_corpus(lines: DataFrame, records: DataFrame) -> DataFrame:
    """The corpus in order: fixed lines replaced, dropped ones left out, the rest as it was."""
    return rewritten(lines, records)
