"""Queries over whole corpora: merging, files and shards, stages that ask a model, reports; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import dataset, evaluation, merging, repair, stages, tokens, transliteration
from ..sources import clusters as shards
from ..sources import lines as files
from . import inputs as I
from .inputs import table
from .queries import query

# merging

_MERGE = f"""WITH {I.ORDERED}, cell AS (SELECT line_no, pos, tag, value, tag || '{{' || value || '}}' AS cell FROM ordered),
people AS (SELECT line_no, string_agg(cell, chr(9) ORDER BY pos) AS raw, coalesce(string_agg(cell, chr(9) ORDER BY pos) FILTER (length(value) <= 9), '') AS line, count(*) FILTER (length(value) > 9) AS n_pruned, NOT bool_or(tag = 'la' AND length(value) <= 9) AS dead FROM cell GROUP BY line_no),
val AS (SELECT raw, min(line_no) AS line_no FROM people JOIN orders ON o_orderkey = line_no WHERE o_orderstatus = 'F' GROUP BY raw),
fresh AS (SELECT * FROM people WHERE raw NOT IN (SELECT raw FROM val)),
people_test AS (SELECT line_no FROM fresh ORDER BY md5('456:' || line_no), line_no LIMIT 60),
firms AS (SELECT p_partkey AS line_no, concat_ws(chr(9), CASE WHEN length(p_name) <= 9 THEN 'la{{' || p_name || '}}' END, CASE WHEN length(p_type) <= 9 THEN 'cy{{' || p_type || '}}' END) AS line,
  CAST(length(p_name) > 9 AS BIGINT) + CAST(length(p_type) > 9 AS BIGINT) AS n_pruned, length(p_name) > 9 AS dead FROM part),
held AS (SELECT line_no FROM firms ORDER BY md5('123:' || line_no), line_no LIMIT 50),
firms_test AS (SELECT line_no FROM firms WHERE NOT dead AND line_no NOT IN (SELECT line_no FROM held) ORDER BY md5('456:' || line_no), line_no LIMIT 40),
x AS (SELECT 'old_val' AS source, line_no, 'val' AS split, raw AS line, 0 AS n_pruned FROM val
  UNION ALL SELECT 'inventor', line_no, 'skipped', raw, 0 FROM people WHERE raw IN (SELECT raw FROM val)
  UNION ALL SELECT 'inventor', line_no, CASE WHEN dead THEN 'dead' WHEN line_no IN (SELECT line_no FROM people_test) THEN 'test' ELSE 'pool' END, line, n_pruned FROM fresh
  UNION ALL SELECT 'company', line_no, CASE WHEN dead THEN 'dead' WHEN line_no IN (SELECT line_no FROM held) THEN 'val' WHEN line_no IN (SELECT line_no FROM firms_test) THEN 'test' ELSE 'pool' END, line, n_pruned FROM firms)"""


def _merged(spark, d) -> DataFrame:
    people = I.lines(spark, d)
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("line_no"))
    firms = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.format_string("la{%s}\tcy{%s}", "p_name", "p_type").alias("line"))
    return merging.merged(people.join(finished, "line_no", "left_semi"), people, firms, lambda c: dataset.short_cells(c, 10), 50, 123, 60, 40, 456, exact=False)


@query(_MERGE + " SELECT source, line_no, split, line, CAST(n_pruned AS BIGINT) AS n_pruned FROM x")
def merge_splits(spark, d):
    """Validation, test and pool of three sources, drawn by hash."""
    return _merged(spark, d)


@query(
    _MERGE
    + """ SELECT count(*) FILTER (source = 'old_val') AS old_val, count(*) FILTER (source = 'company') AS company_lines, CAST(sum(n_pruned) FILTER (source = 'company') AS BIGINT) AS company_pruned_cells,
count(*) FILTER (source = 'company' AND split = 'dead') AS company_dead_dropped, count(*) FILTER (source = 'company' AND split = 'val') AS company_holdout, count(*) FILTER (source = 'company' AND split = 'pool') AS company_to_pool,
count(*) FILTER (split = 'skipped') AS inventor_skipped_val, CAST(sum(n_pruned) FILTER (source = 'inventor') AS BIGINT) AS inventor_pruned_cells, count(*) FILTER (source = 'inventor' AND split = 'dead') AS inventor_dead_dropped,
count(*) FILTER (source = 'inventor' AND split = 'pool') AS inventor_to_pool, count(*) FILTER (split = 'pool') AS pool_total, count(*) FILTER (split = 'val') AS val_total,
count(*) FILTER (source = 'inventor' AND split = 'test') AS test_inventor, count(*) FILTER (source = 'company' AND split = 'test') AS test_company, count(*) FILTER (split = 'test') AS test_total FROM x"""
)
def merge_counts(spark, d):
    """Fifteen counters of the merge."""
    return merging.merge_counts(_merged(spark, d))


# files and shards

_PLACED = f"WITH {I.LINES}, placed AS (SELECT line_no AS order_no, row_number() OVER (ORDER BY line_no) - 1 AS idx, line FROM lines)"


@query(_PLACED + " SELECT idx AS line_no, line FROM placed")
def lines_round_trip(spark, d):
    """Lines written in order to several gzip files, and numbered again when read."""
    path = files.scratch(spark, "lines")
    files.write_lines(I.lines(spark, d), path)
    return files.read_raw(spark, path)


@query(_PLACED + " SELECT idx AS line_no, trim(line) AS line FROM placed")
def trimmed_lines(spark, d):
    """Non-empty trimmed lines of files with blank ones between (S3)."""
    path = files.scratch(spark, "trimmed")
    files.write_lines(I.lines(spark, d).withColumn("line", F.concat(F.lit("\n  "), "line", F.lit(" \n"))), path)
    return files.read_trimmed(spark, path)


@query("SELECT p_name AS raw, count(*) AS n FROM part WHERE p_name <> '' GROUP BY ALL")
def column_strings(spark, d):
    """Non-empty texts of one Parquet column."""
    return files.read_column(spark, f"{d}/part.parquet", "p_name").groupBy("raw").agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, 2 AS n_surfaces, p_name || '|' || p_type AS texts FROM part")
def clusters_round_trip(spark, d):
    """Clusters as JSON lines, one surface an object and one a text with the line's tag."""
    parts = table(spark, d, "part")
    said = F.struct(F.col("p_partkey").cast("string").alias("id"), F.lit("cy").alias("tag"))
    body = F.concat(F.expr("substr(j, 1, length(j) - 1)"), F.lit(', "surfaces": ['), F.to_json(F.struct(F.lit("la").alias("tag"), F.col("p_name").alias("text"))), F.lit(', "'), "p_type", F.lit('"]}'))
    path = files.scratch(spark, "clusters")
    parts.withColumn("j", F.to_json(said)).select(body.alias("value")).write.text(path)
    return shards.read_clusters(spark, path).select("key", F.size("surfaces").alias("n_surfaces"), F.array_join(F.transform("surfaces", lambda s: s["text"]), "|").alias("texts"))


_SHARDED = _PLACED + ", s AS (SELECT *, idx // 2048 AS shard, idx % 2048 AS position, printf('cluster-%09d', idx) AS key FROM placed)"


def _written_shards(spark, d, settle: bool = False) -> tuple[str, DataFrame]:
    """Folder of the shards and their records, which are written too if more than the shards is made of them."""
    placed = files.positions(I.clusters(spark, d), "line_no", "idx")
    records = dataset.sharded(placed, "idx", 2048).select("shard", "position", "key", F.transform("cells", lambda c: c["tag"]).alias("tags"), F.transform("cells", lambda c: c["value"]).alias("cells"))
    records = files.settled(records, "records") if settle else records
    path = files.scratch(spark, "shards")
    shards.write_shards(records, path)
    return path, records


@query(_SHARDED + " SELECT shard, position, key, line FROM s")
def shards_round_trip(spark, d):
    """Records in compressed shards and back."""
    path, _ = _written_shards(spark, d)
    back = shards.checked_records(shards.read_shards(spark, path))
    cells = F.zip_with("tags", "cells", lambda t, v: F.struct(t.alias("tag"), v.alias("value")))
    return back.select("shard", "position", "key", C.format_line(cells).alias("line"))


@query(_SHARDED + ", m AS (SELECT shard, count(*) AS n FROM s GROUP BY shard) SELECT shard, n, n AS n_read, CAST(sum(n) OVER (ORDER BY shard) - n AS BIGINT) AS \"begin\", CAST(sum(n) OVER (ORDER BY shard) AS BIGINT) AS \"end\" FROM m")
def shards_verified(spark, d):
    """Members read back from each shard against the manifest, and the shards' offsets (K3, K5)."""
    path, records = _written_shards(spark, d, settle=True)
    manifest = files.settled(dataset.manifest(records, 2048), "manifest")
    return shards.verified_shards(spark, path, manifest.select("shard", "n")).join(shards.offsets(manifest), "shard")


# stages that ask a model, answered from a table

_FORMS = dict(zip(transliteration.TAGS, ("Иван", "Νίκος", "أحمد", "北京大学", "カナ", "대한민국", "राम", "משה", "สมชาย", "გიორგი", "Արամ"), strict=True))
_PER_TAG = f"WITH t AS (SELECT p_partkey, j, {list(_FORMS)!r}[j + 1] AS tag, p_size + j AS n FROM part, range(11) r(j))"


def _call(value: Callable[[int, str], Column | None], tags=transliteration.TAGS) -> Column:
    """A call with a parameter for each tag; ``value(place, tag)`` null: without it."""
    given = [F.coalesce(F.concat(F.lit(f"<parameter={t}>"), value(transliteration.TAGS.index(t), t), F.lit("</parameter>")), F.lit("")) for t in tags]
    return F.concat(F.lit("<tool_call><function=emit_scripts>"), *given, F.lit("</function></tool_call>"))


def _answers(spark, d, *rows: tuple[Column, Column, Column], key: str = "p_partkey") -> stages.Responses:
    """Answers (stage, attempt, raw_text; null: none) for each part."""
    each = F.explode(F.array(*(F.struct(s.alias("stage"), a.alias("attempt"), t.alias("raw_text")) for s, a, t in rows))).alias("r")
    said = files.spread(table(spark, d, "part")).select(F.col(key).cast("string").alias("key"), each).select("r.stage", "key", "r.attempt", "r.raw_text")
    return stages.Responses(files.settled(said.where("raw_text is not null").distinct(), "said"))


def _first(j: int, tag: str) -> Column:
    return F.when((F.col("p_size") + j) % 4 == 0, F.lit("abc")).otherwise(F.lit(_FORMS[tag]))


def _narrow(stage: str, attempt: int) -> list[tuple[Column, Column, Column]]:
    of = lambda j, t: F.when((F.col("p_size") + j) % 8 == 0, _call(lambda *_: F.lit(_FORMS[t]), (t,)))
    return [(F.lit(f"{stage}_{t}"), F.lit(attempt), of(j, t)) for j, t in enumerate(transliteration.TAGS)]


def _labels(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("label"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.array_join("missing", ",").alias("missing"), F.size("forms").cast("long").alias("n_forms"))


@query(_PER_TAG + " SELECT CAST(p_partkey AS VARCHAR) AS key, coalesce(string_agg(tag, ',' ORDER BY j) FILTER (n % 4 = 0 AND n % 8 <> 0), '') AS missing, count(*) FILTER (n % 4 <> 0 OR n % 8 = 0) AS n_forms FROM t GROUP BY p_partkey")
def transliteration_passes(spark, d):
    """Three passes with a retry, forms of another script rejected, a narrow retry for each missing script."""
    odd = (F.col("p_partkey") % 2).cast("int")
    passes = [(F.lit(s), odd, _call(_first, tags)) for s, tags in transliteration.PASSES.items()]
    return _told(transliteration.completed(_answers(spark, d, *passes, *_narrow("transliterate", 1)), _labels(spark, d)))


@query(_PER_TAG + " SELECT CAST(p_partkey AS VARCHAR) AS key, coalesce(string_agg(tag, ',' ORDER BY j) FILTER (n % 16 = 12), '') AS missing, count(*) FILTER (n % 16 <> 12) AS n_forms FROM t GROUP BY p_partkey")
def transcribe_wave(spark, d):
    """One request for all scripts, one for each missing, one more for what is left."""
    again = _call(lambda j, t: F.when((F.col("p_size") + j) % 16 == 4, F.lit(_FORMS[t])))
    answers = _answers(spark, d, (F.lit("transcribe"), F.lit(0), _call(_first)), (F.lit("transcribe"), F.lit(1), again), *_narrow("transcribe", 0))
    return _told(transliteration.transcribed(answers, _labels(spark, d)))


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) % 3 = 0 THEN 'cy,jp' WHEN length(p_name) % 3 = 1 THEN 'kr' ELSE '' END AS scripts,
CASE WHEN length(p_name) % 3 = 0 THEN CASE WHEN length(p_name) % 2 = 1 THEN 'cy,jp' ELSE 'cy' END WHEN length(p_name) % 3 = 1 AND length(p_name) % 2 = 1 THEN 'kr' ELSE '' END AS forms FROM part"""
)
def company_scripts_judged(spark, d):
    """Judged scripts by name, their forms with one retry; rows of one name share them, incomplete ones stay."""
    n = F.length("p_name")
    judge = F.when(n % 3 == 0, '["jp", "cy", "xx"]').when(n % 3 == 1, '["kr"]')
    said = F.concat(F.lit("<tool_call><function=plausible_company_scripts><parameter=scripts>"), judge, F.lit("</parameter></function></tool_call>"))
    both = F.when(n % 3 == 0, _call(lambda _, t: F.lit(_FORMS["cy"]), ("cy", "jp"))).when((n % 3 == 1) & (n % 2 == 1), _call(lambda _, t: F.lit(_FORMS[t]), ("kr",)))
    again = F.when((n % 3 == 0) & (n % 2 == 1), _call(lambda _, t: F.lit(_FORMS[t]), ("jp", "th")))
    answers = _answers(spark, d, (F.lit("judge"), (n % 2).cast("int"), said), (F.lit("company_emit"), F.lit(0), both), (F.lit("company_emit"), F.lit(1), again), key="p_name")
    out = transliteration.company_scripts(answers, table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label")))
    return out.select("p_partkey", F.array_join("scripts", ",").alias("scripts"), F.array_join(F.array_sort(F.map_keys("forms")), ",").alias("forms"))


def _sides() -> tuple[Column, Column]:
    return F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))


@query("SELECT p_partkey AS line_no, true AS kept, CASE WHEN p_size % 4 = 3 THEN p_size % 4 ELSE 11 END AS n_cells FROM part")
def respelled_lines(spark, d):
    """Other Latin spellings added to cluster lines, one line for each."""
    a, b = _sides()
    k = F.col("p_size") % 4
    alts = F.concat(F.lit('<tool_call><function=emit_alt_latin><parameter=alts>["x'), a, F.lit(" "), b, F.lit('"]</parameter></function></tool_call>'))
    line = F.concat(F.lit("la{"), a, F.lit(" "), b, F.lit("}\tcy{"), "p_type", F.lit("}\tla{"), b, F.lit(", "), a, F.lit("}"))
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), line.alias("line"))
    answers = _answers(spark, d, (F.lit("alternatives"), (k % 2).cast("int"), F.when(k != 3, alts)))
    told = transliteration.respelled(answers, lines).withColumnRenamed("line", "new").join(lines, "line_no")
    latin = lambda c: F.filter(F.split(c, "\t"), lambda x: x.startswith("la{"))
    kept = F.slice(latin("new"), 1, 2) == latin("line")
    return told.select("line_no", (kept & F.element_at(F.split("new", "\t"), -1).startswith("cy{")).alias("kept"), F.size(F.split("new", "\t")).alias("n_cells"))


def _repaired(spark, d) -> DataFrame:
    a, b = _sides()
    k = F.col("p_size") % 4
    call = lambda name, *args: F.concat(F.lit(f"<tool_call><function={name}>"), *args, F.lit("</function></tool_call>"))
    fix = call("fix", F.lit("<parameter=given>x"), a, F.lit("</parameter><parameter=family>"), b, F.lit("</parameter>"))
    audit = F.when(k == 0, call("clean")).when(k == 1, fix).when(k == 2, call("unrecoverable"))
    forms = _call(lambda j, t: F.when((F.lit(t) != "th") | (F.col("p_size") % 8 == 1), F.lit(_FORMS[t])))
    answers = _answers(spark, d, (F.lit("audit"), (F.col("p_partkey") % 2).cast("int"), audit), (F.lit("transcribe"), F.lit(0), forms))
    flags = F.array(F.struct(F.lit("D4_digit").alias("detector"), b.alias("evidence")))
    return repair.repaired(answers, table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.concat(F.lit("la{"), "p_name", F.lit("}")).alias("line"), a.alias("given"), b.alias("family"), flags.alias("flags")))


_REPAIR = """WITH r AS (SELECT p_partkey AS line_no, 'la{' || p_name || '}' AS original, CASE WHEN p_size % 4 = 0 THEN 'clean' WHEN p_size % 8 = 1 THEN 'fixed' ELSE 'dropped' END AS outcome,
  CASE WHEN p_size % 4 IN (2, 3) THEN 'audit_unrecoverable_or_invalid' WHEN p_size % 8 = 5 THEN 'transliteration_incomplete' END AS drop_reason, CASE WHEN p_size % 8 = 1 THEN 19 END AS n_cells FROM part)"""


@query(_REPAIR + " SELECT * FROM r")
def repair_records(spark, d):
    """Audits, spellings and forms joined by line."""
    cells = F.when(F.col("new_line").isNotNull(), F.size(F.split("new_line", "\t")))
    return _repaired(spark, d).select("line_no", "original", "outcome", "drop_reason", cells.alias("n_cells"))


@query(_REPAIR + " SELECT count(*) AS n_lines, 0 AS n_unparseable, 0 AS n_no_la, count(*) AS n_flagged, count(*) FILTER (outcome = 'fixed') AS n_repaired, count(*) FILTER (outcome = 'clean') AS n_clean, count(*) FILTER (outcome = 'dropped') AS n_dropped, count(*) FILTER (outcome <> 'dropped') AS n_output_lines FROM r")
def repair_counts(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.concat(F.lit("la{"), "p_name", F.lit("}")).alias("line"))
    return repair.repair_counts(lines, _repaired(spark, d))


@query(_REPAIR + " SELECT drop_reason, count(*) AS n FROM r WHERE outcome = 'dropped' GROUP BY 1")
def dropped_by_reason(spark, d):
    """Dropped clusters by reason."""
    return repair.dropped_by_reason(_repaired(spark, d))


# vocabulary, losses, probes


@query("""WITH p AS (SELECT DISTINCT piece FROM (SELECT props AS piece FROM events UNION ALL SELECT event_type FROM events)) SELECT count(*) AS vocab_size,
(SELECT string_agg(s, '|') FROM (SELECT unnest(['click', 'none of these', 'error']) AS s) WHERE s NOT IN (SELECT piece FROM p)) AS missing_specials,
string_agg(piece, '|' ORDER BY piece) FILTER ((contains(piece, '{') OR contains(piece, '}')) AND length(piece) > 1) AS pieces_with_braces FROM p""")
def vocabulary_report(spark, d):
    """Pieces, missing specials, pieces with braces (A10)."""
    events = table(spark, d, "events")
    pieces = events.select(F.col("props").alias("piece")).union(events.select("event_type")).distinct()
    out = tokens.vocabulary_report(pieces, ("click", "none of these", "error"))
    return out.select("vocab_size", F.array_join("missing_specials", "|").alias("missing_specials"), F.array_join("pieces_with_braces", "|").alias("pieces_with_braces"))


@query("SELECT round(avg(ce), 8) AS ce FROM (SELECT avg(l_discount) FILTER (l_returnflag <> 'R') AS ce FROM lineitem GROUP BY l_linenumber)")
def cross_entropy(spark, d):
    """Mean cost over the labels that count, by draw and over the draws."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", -100).otherwise(1).alias("label"), F.col("l_discount").alias("nll"), F.col("l_linenumber").alias("draw"))
    return evaluation.cross_entropy(rows).select(F.round("ce", 8).alias("ce"))


@query("SELECT round(avg(len(string_split(p_name, ' '))), 8) AS tokens_per_cell, round(avg(length(p_name)), 8) AS chars_per_cell FROM part")
def cell_averages(spark, d):
    """Tokens and characters a cell."""
    cells = table(spark, d, "part").select(F.col("p_name").alias("value"), F.split("p_name", " ").alias("ids"))
    return evaluation.cell_averages(cells).select(*(F.round(c, 8).alias(c) for c in ("tokens_per_cell", "chars_per_cell")))


@query("SELECT length(text) + 512 <= 4096 AS fits, count(*) AS n FROM documents GROUP BY 1")
def prompts_that_fit(spark, d):
    """Prompts whose tokens (here characters) and answer fit the window."""
    return table(spark, d, "documents").groupBy(tokens.prompt_fits(F.length("text"), 512).alias("fits")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey AS key, avg(o_totalprice) AS own FROM orders GROUP BY 1 HAVING count(*) >= 2), m AS (SELECT own, c_acctbal AS other, c_acctbal - own AS margin FROM o JOIN customer ON key = c_custkey),
s AS (SELECT list_sort(list(margin)) AS l, count(*) AS n, avg(own) AS a, avg(other) AS b, avg(margin) AS c, avg(CAST(margin > 0 AS INT)) AS p FROM m)
SELECT round(a, 4) AS own_mean, round(b, 4) AS other_mean, round(c, 4) AS margin_mean, round(l[n // 10 + 1], 4) AS margin_p10, round(l[n // 2 + 1], 4) AS margin_p50, round(l[CAST(floor(0.9 * n) AS BIGINT) + 1], 4) AS margin_p90, round(p, 8) AS positive FROM s""")
def selectivity_by_company(spark, d):
    """Margins of company means, companies of too few cells left out."""
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("nll"))
    others = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("nll"))
    out = evaluation.selectivity(evaluation.selectivity_probe(members, others))
    return out.select(*(F.round(c, 4).alias(c) for c in ("own_mean", "other_mean", "margin_mean", "margin_p10", "margin_p50", "margin_p90")), F.round("positive", 8).alias("positive"))
