"""The queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import ids, names, scripts, toolcalls, variants
from ..functions.base import spaced, strip, words
from ..operators import batching, dataset, detectors, evaluation, expansion, grouping, letters, scoring, stages, tokens
from ..sources.lines import last_by_key, positions, spread
from ..streaming import feed
from . import inputs as I
from .inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        name = run.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


_KEY = "list_aggregate(list_filter(string_split(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN (" + ", ".join(f"'{t}'" for t in variants.ENTITY_TOKENS) + ")), 'string_agg', ' ')"
_GROUPED = f"WITH {I.RAW}, r AS (SELECT trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS raw, row_no FROM raw), k AS (SELECT raw, row_no, coalesce({_KEY}, '') AS org_key FROM r WHERE raw <> ''), c AS (SELECT org_key, raw, count(*) AS n, min(row_no) AS place FROM k WHERE org_key <> '' GROUP BY ALL)"


@query(_GROUPED + " SELECT org_key, string_agg('la{' || raw || '}', chr(9) ORDER BY n DESC, length(raw) DESC, raw) AS line, min(place) AS first_row FROM c GROUP BY org_key")
def company_groups(spark, d):
    """Raw strings grouped by canonical key, as cluster lines."""
    return grouping.as_lines(grouping.group_companies(I.raw_rows(spark, d)))


@query(_GROUPED + " SELECT (SELECT count(*) FROM r WHERE raw <> '') AS n_rows, (SELECT count(DISTINCT raw) FROM r WHERE raw <> '') AS n_raw, count(DISTINCT org_key) AS n_organisations FROM c")
def company_summary(spark, d):
    rows = I.raw_rows(spark, d)
    return grouping.summary(rows, grouping.group_companies(rows))


@query(f"WITH {I.COMPANIES} SELECT id, coalesce({_KEY.replace('raw', 'display')}, '') AS org_key FROM companies")
def canonical_key(spark, d):
    return I.companies(spark, d).select("id", variants.canonical_key(F.col("display")).alias("org_key"))


@query(f"WITH {I.RAW} SELECT count(*) AS n_lines, count(DISTINCT trim(raw)) AS n_distinct, CAST(sum(length(trim(raw))) AS BIGINT) AS n_chars FROM raw WHERE trim(raw) <> ''")
def text_lines(spark, d):
    """Trimmed non-empty lines."""
    lines = I.raw_rows(spark, d).select(strip(F.col("raw")).alias("line")).where("line <> ''")
    return lines.agg(F.count("*").alias("n_lines"), F.count_distinct("line").alias("n_distinct"), F.sum(F.length("line")).alias("n_chars"))


@query(f"WITH {I.LINES} SELECT line_no, line FROM lines")
def format_lines(spark, d):
    return I.lines(spark, d)


@query(f"WITH {I.ORDERED}, fine AS (SELECT line_no FROM ordered GROUP BY line_no HAVING bool_or(tag = 'la')) SELECT line_no, CAST(pos - 1 AS INT) AS pos, tag, value FROM ordered JOIN fine USING (line_no) WHERE line_no % 7 NOT IN (1, 2, 3, 4)")
def parse_cells(spark, d):
    """Strictly parsed cells of broken lines."""
    cells = I.broken(spark, d).select("line_no", C.parse(F.col("line")).alias("cells"))
    return cells.select("line_no", F.posexplode("cells").alias("pos", "c")).select("line_no", "pos", "c.tag", "c.value")


@query(f"WITH {I.BROKEN} SELECT line_no, line_no % 7 NOT IN (1, 4) AS parsed, CASE WHEN line_no % 7 NOT IN (1, 4) THEN len(string_split(line, chr(9))) END AS n_cells FROM broken")
def parse_lenient(spark, d):
    parsed = I.broken(spark, d).select("line_no", C.parse_lenient(F.col("line")).alias("c"))
    return parsed.select("line_no", F.col("c").isNotNull().alias("parsed"), F.when(F.col("c").isNotNull(), F.size("c").cast("long")).alias("n_cells"))


_REASON = "CASE WHEN line_no % 7 IN (1, 2) THEN 'malformed_cell' WHEN line_no % 7 = 3 THEN 'empty_value' WHEN line_no % 7 = 4 THEN 'empty_line' WHEN NOT bool_or(tag = 'la') THEN 'no_la_cell' END"


@query(f"WITH {I.ORDERED} SELECT line_no, {_REASON} IS NULL AS ok, {_REASON} AS reason, {_REASON} IS NULL AND count(DISTINCT tag) = 12 AS complete FROM ordered GROUP BY line_no")
def clean_reasons(spark, d):
    return dataset.checked(I.broken(spark, d)).select("line_no", "ok", "reason", "complete")


@query(f"WITH {I.ORDERED}, r AS (SELECT coalesce({_REASON}, CASE WHEN count(DISTINCT tag) < 12 THEN 'missing_tags' END, 'ok') AS reason FROM ordered GROUP BY line_no) SELECT reason, count(*) AS n, CAST(count(*) FILTER (reason = 'ok') AS BIGINT) AS n_complete FROM r GROUP BY reason")
def clean_stats(spark, d):
    return dataset.clean_stats(dataset.checked(I.broken(spark, d), drop_incomplete=True))


@query(f"WITH {I.ORDERED}, g AS (SELECT line_no, list(DISTINCT tag) AS tags FROM ordered GROUP BY line_no) SELECT line_no, len(tags) = 12 AS complete, coalesce(list_aggregate(list_filter({I._TAG_LIST}, lambda t: NOT list_contains(tags, t)), 'string_agg', ','), '') AS missing FROM g")
def complete_clusters(spark, d):
    c = I.clusters(spark, d)
    return c.select("line_no", dataset.all_scripts(F.col("cells")).alias("complete"), F.array_join(C.missing_tags(F.transform("cells", lambda x: x["tag"])), ",").alias("missing"))


@query(f"WITH {I.ORDERED} SELECT line_no, coalesce(string_agg(value, '|' ORDER BY pos) FILTER (tag = 'la'), '') AS latin, CAST(count(*) FILTER (tag <> 'la') AS INT) AS n_others FROM ordered GROUP BY line_no")
def split_cluster(spark, d):
    c = I.clusters(spark, d)
    return c.select("line_no", F.array_join(C.forms(F.col("cells")), "|").alias("latin"), F.size(C.others(F.col("cells"))).alias("n_others"))


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders) SELECT o_orderkey, i AS idx FROM o WHERE i IN (SELECT (k * (SELECT count(*) FROM orders)) // 97 FROM range(97) t(k))")
def stratified_val(spark, d):
    rows = positions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "idx")
    return rows.where(dataset.evenly_picked(F.col("idx"), table(spark, d, "orders").count(), 97))


@query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def hash_holdout(spark, d):
    return dataset.hash_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


_VAL = f"WITH {I.LINES}, val AS (SELECT DISTINCT line FROM lines WHERE line_no % 50 = 0)"


@query(_VAL + " SELECT line_no, line FROM lines WHERE line NOT IN (SELECT line FROM val)")
def leakage_anti(spark, d):
    lines = I.lines(spark, d)
    return dataset.without(lines, lines.where("line_no % 50 = 0")).select("line_no", "line")


@query(_VAL + " SELECT count(*) AS n_overlap, count(DISTINCT line) AS n_lines FROM lines WHERE line IN (SELECT line FROM val)")
def leakage_overlap(spark, d):
    lines = I.lines(spark, d)
    return dataset.overlap(lines, lines.where("line_no % 50 = 0")).agg(F.count("*").alias("n_overlap"), F.count_distinct("line").alias("n_lines"))


@query(f"WITH {I.LINES} SELECT 0 AS source_rank, line_no, line FROM lines UNION ALL SELECT 1, p_partkey, 'la{{' || p_name || '}}' FROM part")
def pool_union(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.concat(F.lit("la{"), "p_name", F.lit("}")).alias("line"))
    return dataset.pooled(I.lines(spark, d), parts)


_SHARDS = "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), s AS (SELECT o_orderkey, i // 2048 AS shard, i % 2048 AS position, printf('cluster-%09d', i) AS key FROM o)"


def _sharded(spark, d):
    return dataset.sharded(positions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "idx"), "idx", 2048).select("o_orderkey", "shard", "position", "key")


@query(_SHARDS + " SELECT * FROM s")
def shard_assign(spark, d):
    return _sharded(spark, d)


@query(_SHARDS + " SELECT shard, count(*) AS n, min(key) AS first_key, max(key) AS last_key, count(*) = 2048 AS \"full\" FROM s GROUP BY shard")
def manifest_counts(spark, d):
    return dataset.manifest(_sharded(spark, d), 2048)


@query(_SHARDS + " SELECT key, CAST(split_part(key, '-', 2) AS BIGINT) AS idx FROM s WHERE CAST(split_part(key, '-', 2) AS BIGINT) BETWEEN 100 AND 299")
def record_keys(spark, d):
    return _sharded(spark, d).where(dataset.in_range(F.concat("key", F.lit(".json")), 100, 300)).select("key", dataset.key_index(F.col("key")).alias("idx"))


@query(_SHARDS + ", c AS (SELECT shard, count(*) AS n FROM s GROUP BY shard) SELECT CAST(max(b) AS BIGINT) AS batches FROM (SELECT ceil(sum(n) / 32.0) AS b FROM c GROUP BY shard % 3)")
def rank_batches(spark, d):
    return dataset.rank_batches(_sharded(spark, d).groupBy("shard").agg(F.count("*").alias("n")), 32, 3)


@query("SELECT p_partkey, greatest(1, CAST(ceil(p_retailprice / p_size) AS BIGINT) * greatest(1, p_partkey % 3)) AS steps FROM part")
def scheduler_steps(spark, d):
    return table(spark, d, "part").select("p_partkey", dataset.scheduler_steps(F.col("p_retailprice"), F.col("p_partkey") % 3, F.col("p_size")).alias("steps"))


@query(f"WITH {I.CELLS} SELECT tag, letter, count(*) AS n FROM (SELECT tag, unnest(regexp_extract_all(value, '\\p{{L}}')) AS letter FROM cells WHERE tag NOT IN ('cn', 'jp', 'kr')) GROUP BY ALL")
def letter_frequency(spark, d):
    return letters.letter_frequency(I.clusters(spark, d))


@query(f"WITH {I.RAW} SELECT raw, min(row_no) AS row_no FROM raw GROUP BY raw")
def first_occurrences(spark, d):
    return dataset.first_occurrences(I.raw_rows(spark, d), "raw", "row_no")


@query(f"WITH {I.ORDERED}, k AS (SELECT * FROM ordered WHERE octet_length(encode(value)) <= 10) SELECT line_no, count(*) AS n_cells, bool_or(tag = 'la') AS alive FROM k GROUP BY line_no")
def short_cells(spark, d):
    """Cells that fit the byte limit, and whether a Latin one is left."""
    kept = I.clusters(spark, d).select("line_no", dataset.short_cells(F.col("cells"), 11).alias("cells")).where("size(cells) > 0")
    return kept.select("line_no", F.size("cells").cast("long").alias("n_cells"), dataset.alive(F.col("cells")).alias("alive"))


@query(f"WITH {I.ORDERED}, g AS (SELECT line_no, count(*) AS n, count(*) FILTER (length(value) > 10) AS l FROM ordered GROUP BY line_no) SELECT CAST(sum(l) AS BIGINT) AS n_long_surfaces, count(*) FILTER (n > 4) AS n_large_clusters FROM g")
def over_caps(spark, d):
    return dataset.over_caps(I.clusters(spark, d), 10, 4, F.transform("cells", lambda c: F.length(c["value"])))


# names

_TITLE = lambda x: f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"
_WORDS = lambda x, f: f"list_aggregate(list_transform(string_split({x}, ' '), lambda t: {f('t')}), 'string_agg', ' ')"


@query(f"WITH {I.PEOPLE} SELECT id, given <> '' AS usable FROM people")
def usable_person_name(spark, d):
    return I.people(spark, d).select("id", names.is_usable(F.col("given"), F.col("family")).alias("usable"))


@query(f"WITH {I.PEOPLE} SELECT id, coalesce({_WORDS('family', _TITLE)}, '') AS titled FROM people")
def title_name(spark, d):
    return I.people(spark, d).select("id", names.title_name(F.upper("family")).alias("titled"))


@query(f"WITH {I.PEOPLE} SELECT id, CASE id % 4 WHEN 1 THEN 'Van Der ' || ({_TITLE('b')}) || '|van der ' || ({_TITLE('b')}) WHEN 2 THEN ({_TITLE('b')}) || ' Jr.' ELSE {_TITLE('b')} END AS forms FROM people")
def particle_forms(spark, d):
    return I.people(spark, d).select("id", F.array_join(names.particle_forms(names.title_name(F.col("family"))), "|").alias("forms"))


@query(f"WITH {I.PEOPLE} SELECT id, CASE WHEN id % 4 = 2 THEN b ELSE family END AS core, CASE WHEN id % 4 = 2 THEN 'Jr.|Jr|Junior' END AS surfaces FROM people")
def generational(spark, d):
    peeled = I.people(spark, d).select("id", names.peel_generational(F.col("family")).alias("p"))
    return peeled.select("id", "p.core", F.array_join("p.surfaces", "|").alias("surfaces"))


@query(f"WITH {I.PEOPLE} SELECT id, upper(a[1]) || '.' AS one, upper(a[1]) || '.-' || upper(b[1]) || '.|' || upper(a[1]) || '-' || upper(b[1]) || '|' || upper(a[1]) || upper(b[1]) AS two FROM people")
def initial_forms(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("w"))
    return p.select("id", F.array_join(names.initial_forms(F.col("w")[0]), "|").alias("one"), F.array_join(names.initial_forms(F.array_join("w", "-")), "|").alias("two"))


@query(f"WITH {I.PEOPLE} SELECT id, a || ' ' || b || ', J.-M.' AS spaced FROM people")
def space_hyphens(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.translate("p_name", " ", "-"), F.lit(", J.-M.")).alias("x"))
    return p.select("id", names.space_hyphens(F.col("x")).alias("spaced"))


@query(f"WITH {I.PEOPLE} SELECT id, CASE WHEN id % 2 = 0 THEN a ELSE b || ' ' || a END AS given, CASE WHEN id % 2 = 0 THEN b || CASE WHEN id % 3 = 0 THEN ' III' ELSE '' END ELSE 'de ' || b || CASE WHEN id % 3 = 0 THEN ' III' ELSE '' END END AS family FROM people")
def split_display(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("w"))
    suffix = F.when(F.col("id") % 3 == 0, " iii").otherwise("")
    shown = F.when(F.col("id") % 2 == 0, F.concat(F.array_join("w", " "), suffix)).otherwise(F.concat(F.lit("de "), F.col("w")[1], F.lit(", "), F.col("w")[1], F.lit(" "), F.col("w")[0], suffix))
    return p.select("id", names.split_display(shown).alias("s")).select("id", "s.given", "s.family")


@query(f"WITH {I.PEOPLE} SELECT id, CASE WHEN id % 2 = 0 THEN a ELSE a || ' ' || b || ' R.' END AS given, CASE WHEN id % 2 = 0 THEN b ELSE '' END AS family FROM people")
def heal_names(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" R.")).alias("g"))
    return p.select("id", names.heal(F.col("g"), F.lit("")).alias("s")).select("id", "s.given", "s.family")


_VARIANTS = f"""WITH {I.PEOPLE}, t AS (SELECT id, {_TITLE('a')} AS a, {_TITLE('b')} AS b, given, family FROM people),
g AS (SELECT id, unnest([1, 2, 3, 4, 5]) AS gi, unnest(CASE id % 5 WHEN 1 THEN [a || ' ' || b, a, a[1] || '. ' || b[1] || '.', a[1] || '.' || b[1] || '.', a || ' ' || b[1] || '.']
  WHEN 2 THEN [a || '-' || b, a[1] || '.-' || b[1] || '.', a[1] || '-' || b[1], a[1] || b[1], NULL] WHEN 3 THEN ['', NULL, NULL, NULL, NULL] ELSE [a, a[1] || '.', NULL, NULL, NULL] END) AS g FROM t),
f AS (SELECT id, unnest([1, 2]) AS fi, unnest(CASE id % 4 WHEN 1 THEN ['Van Der ' || b, 'van der ' || b] ELSE [b, NULL] END) AS f FROM t),
o AS (SELECT id, fi, gi, unnest([1, 2]) AS oi, unnest(CASE WHEN g = '' THEN [f, NULL] ELSE [g || ' ' || f, f || ', ' || g] END) AS x FROM f JOIN g USING (id) WHERE f IS NOT NULL AND g IS NOT NULL),
s AS (SELECT id, fi, gi, oi, unnest([1, 2, 3]) AS si, unnest(CASE id % 4 WHEN 2 THEN [x || ' Jr.', x || ' Jr', x || ' Junior'] ELSE [x, NULL, NULL] END) AS x FROM o WHERE x IS NOT NULL),
h AS (SELECT id, fi, gi, oi, si, unnest([1, 2]) AS hi, unnest([x, CASE WHEN id % 5 = 2 AND gi = 1 THEN replace(x, '-', ' ') END]) AS x FROM s WHERE x IS NOT NULL),
u AS (SELECT id, fi, gi, oi, si, hi, unnest([1, 2]) AS ui, unnest([x, upper(x)]) AS x FROM h WHERE x IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fi, gi, oi, si, hi, ui) AS place FROM u),
d AS (SELECT id, x, min(place) AS place FROM n GROUP BY id, x)
SELECT id, string_agg(x, '|' ORDER BY place) AS variants FROM d GROUP BY id"""


@query(_VARIANTS)
def person_variants(spark, d):
    """All Latin spellings of a name (G1)."""
    return spread(I.people(spark, d)).select("id", F.array_join(variants.person_variants(F.col("given"), F.col("family")), "|").alias("variants"))


@query(f"WITH {I.PEOPLE}, t AS (SELECT id, {_TITLE('a')} AS a, {_TITLE('b')} AS b FROM people) SELECT id, CASE WHEN a = b THEN 8 ELSE 16 END AS n FROM t")
def person_alternatives(spark, d):
    """Spellings with another romanisation; one that swaps the sides is left out."""
    p = spread(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")).select("id", F.split("p_name", " ").alias("w"))
    alternatives = F.array(F.concat(F.col("w")[1], F.lit(" "), F.col("w")[0]), F.concat(F.lit("zoe "), F.col("w")[1]))
    return p.select("id", F.size(variants.with_alternatives(F.col("w")[0], F.col("w")[1], alternatives)).alias("n"))


@query(f"WITH {I.COMPANIES} SELECT id, {_WORDS('p_name', _TITLE)} || CASE f WHEN 0 THEN ' Inc' WHEN 1 THEN ' Ltd.' WHEN 2 THEN ' Co., Ltd.' WHEN 3 THEN ' GmbH' WHEN 4 THEN ' S.A.' WHEN 5 THEN ' Corporation' WHEN 6 THEN ' B.V.' ELSE '' END AS titled FROM companies")
def company_title(spark, d):
    return I.companies(spark, d).select("id", variants.title_org(F.upper("display")).alias("titled"))


_FORM = "CASE f WHEN 0 THEN ['Inc.', 'Inc', 'Incorporated'] WHEN 1 THEN ['Ltd.', 'Ltd', 'Limited'] WHEN 2 THEN ['Co., Ltd.', 'Co Ltd.', 'Co., Limited', 'Company, Ltd.', 'Ltd.'] WHEN 3 THEN ['GmbH'] WHEN 4 THEN ['SA', 'S.A.'] WHEN 5 THEN ['Corp.', 'Corp', 'Corporation'] WHEN 6 THEN ['BV', 'B.V.'] ELSE [] END"


@query(f"WITH {I.COMPANIES} SELECT id, p_name AS core, list_aggregate({_FORM}, 'string_agg', '|') AS surfaces FROM companies WHERE f < 7")
def suffix_peel(spark, d):
    peeled = I.companies(spark, d).select("id", variants.peel_legal_form(words(F.col("display"))).alias("p")).where("size(p.surfaces) > 0")
    return peeled.select("id", spaced(F.col("p.core")).alias("core"), F.array_join("p.surfaces", "|").alias("surfaces"))


@query(f"""WITH {I.COMPANIES}, t AS (SELECT id, {_WORDS('p_name', _TITLE)} AS c, {_FORM} AS s FROM companies),
b AS (SELECT id, unnest(list_concat(list_transform(s, lambda x: c || ' ' || x), [c])) AS x, unnest(range(len(s) + 1)) AS bi FROM t),
u AS (SELECT id, unnest([x, upper(x)]) AS x, unnest([2 * bi, 2 * bi + 1]) AS place FROM b), d AS (SELECT id, x, min(place) AS place FROM u GROUP BY id, x)
SELECT id, string_agg(x, '|' ORDER BY place) AS variants FROM d GROUP BY id""")
def company_variants(spark, d):
    return spread(I.companies(spark, d)).select("id", F.array_join(variants.company_variants(F.col("display")), "|").alias("variants"))


@query(f"""WITH {I.COMPANIES}, t AS (SELECT id, display, {_WORDS('p_name', _TITLE)} AS c, {_FORM} AS s, f FROM companies),
b AS (SELECT id, display, f, unnest(list_concat(list_transform(s, lambda x: c || ' ' || x), [c])) AS x, unnest(range(len(s) + 1)) AS bi FROM t),
u AS (SELECT id, unnest([x, upper(x)]) AS x, unnest([2 * bi, 2 * bi + 1]) AS place FROM b UNION ALL SELECT id, display, -1 FROM t), d AS (SELECT id, x, min(place) AS place FROM u GROUP BY id, x)
SELECT id AS line_no, CASE WHEN id % 5 = 0 THEN 'la{{' || any_value(display) || '}}' || chr(9) || 'cy{{x}}' ELSE string_agg('la{{' || x || '}}', chr(9) ORDER BY place) END AS line, CASE WHEN id % 5 = 0 THEN 'passed' ELSE 'expanded' END AS route
FROM d JOIN companies USING (id) WHERE id % 7 <> 0 GROUP BY id""")
def company_lines(spark, d):
    """The path of company lines without a model: expanded, passed through or left out."""
    shown = I.companies(spark, d)
    k = F.col("id")
    line = F.when(k % 7 == 0, F.col("display")).when(k % 5 == 0, F.concat(F.lit("la{"), "display", F.lit("}\tcy{x}"))).otherwise(F.concat(F.lit("la{"), "display", F.lit("}")))
    return expansion.company_lines(shown.select(k.alias("line_no"), line.alias("line"))).select("line_no", "line", "route")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'la{' || p_name || '}' || chr(9) || 'cy{Фёдор}' || chr(9) || 'cy{Федор}' || chr(9) || 'gk{Α Β}' ELSE 'la{' || p_name || '}' || chr(9) || 'gk{Α Β}' END AS line FROM part")
def company_scripts(spark, d):
    """Forms of companies in other scripts, as a cluster line."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name")
    forms = F.when(F.col("key") % 2 == 0, F.create_map(F.lit("gk"), F.array(F.lit("Α Β")), F.lit("cy"), F.array(F.lit("Фёдор")))).otherwise(F.create_map(F.lit("gk"), F.array(F.lit("Α Β"))))
    cells = expansion.cluster_cells(F.array("p_name"), F.col("forms"))
    return p.withColumn("forms", expansion.company_script_forms(forms)).select("key", C.format_line(cells).alias("line"))


_MARKS = "strip_accents(replace(replace(replace(replace(x, 'ß', 'ß'), 'ø', 'o'), 'œ', 'oe'), 'æ', 'ae'))"


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[^a-zäöüßéèêàâçñóíáú]+', ' ', 'g'), ' ')) AS x FROM documents)
SELECT x AS word, {_MARKS} AS plain, strip_accents(replace(replace(replace(replace(x, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS written_out FROM w WHERE x <> ''""")
def strip_diacritics(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split(F.regexp_replace("text", "[^a-zäöüßéèêàâçñóíáú]+", " "), " ")).alias("word")).where("word <> ''").distinct()
    return w.select("word", names.strip_marks(F.col("word")).alias("plain"), names.digraph(F.col("word")).alias("written_out"))


# scripts



@query(f"""WITH {I.PEOPLE}, c AS (SELECT id, translate(a, 'abvgdejziklmnoprstufhcyxwq', 'абвгдежзиклмнопрстуфхцчшэ') AS a, translate(b, 'abvgdejziklmnoprstufhcyxwq', 'абвгдежзиклмнопрстуфхцчшэ') AS b FROM people),
t AS (SELECT id, a, b, {_TITLE('a')} AS x, {_TITLE('b')} AS y FROM c)
SELECT id, y || ' ' || x || '|' || y || ' ' || x[1] || '.|' || x || ' ' || y || '|' || x[1] || '. ' || y || '|' || y || ', ' || x[1] || '.' AS forms FROM t""")
def cyrillic_variants(spark, d):
    cy = F.translate("p_name", "abvgdejziklmnoprstufhcyxwq", "абвгдежзиклмнопрстуфхцчшэ")
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), scripts.cyrillic_name(cy).alias("n"))
    return n.select("id", F.array_join(scripts.cyrillic_variants(F.col("n.first"), F.col("n.patronymic"), F.col("n.family")), "|").alias("forms"))


@query(f"WITH {I.PEOPLE} SELECT id, b || ' ' || a || '|' || b || ' ' || a[1] || '׳|' || a || ' ' || b || '|' || a[1] || '׳ ' || b || '|' || b || ', ' || a[1] || '׳' AS forms FROM people")
def hebrew_variants(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), scripts.two_parts(F.col("p_name")).alias("n"))
    return n.select("id", F.array_join(scripts.hebrew_variants(F.col("n.given"), F.col("n.family")), "|").alias("forms"))


@query(f"WITH {I.PEOPLE} SELECT id, id % 3 = 0 AS cyrillic, id % 3 = 1 AS latin_tag FROM (SELECT id FROM people)")
def script_check(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    text = F.when(F.col("id") % 3 == 0, "иван 7").when(F.col("id") % 3 == 1, "王小").otherwise("иvan")
    return p.select("id", scripts.in_script(text, F.lit("cy")).alias("cyrillic"), scripts.in_script(text, F.lit("cn")).alias("latin_tag"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '王小明|小明王' WHEN 1 THEN '김철수|철수김' ELSE '田中 一|一 田中' END AS forms FROM part")
def order_flips(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    k = F.col("id") % 3
    text, tag = F.when(k == 0, "王小明").when(k == 1, "김철수").otherwise("田中 一"), F.when(k == 1, "kr").otherwise("cn")
    return p.select("id", F.array_join(scripts.order_flips(text, tag), "|").alias("forms"))


# quality

_FLAGS = """WITH p AS (SELECT p_partkey AS line_no, p_partkey % 9 AS k, p_partkey % 4 AS o, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
f AS (SELECT line_no, k, o, a, b, CASE k WHEN 1 THEN 'Dr. ' || a || ' ' || b WHEN 2 THEN a || ' Jr ' || b WHEN 3 THEN 'zu, ' || a WHEN 4 THEN a || ' University 7' WHEN 5 THEN a || ' ' || a || ' - (x) & ' || b WHEN 6 THEN b || ', van ' || a || ',' ELSE a || ' ' || b END AS form FROM p),
x AS (SELECT line_no, 'D1_title' AS detector, '''Dr.'' (lead) in ''' || form || '''' AS evidence FROM f WHERE k = 1
UNION ALL SELECT line_no, 'D2_generational', '''Jr'' (middle) in ''' || form || '''' FROM f WHERE k = 2
UNION ALL SELECT line_no, 'D3_particle_family', '''zu'' lone-particle family side in ''' || form || '''' FROM f WHERE k = 3 AND o <> 3
UNION ALL SELECT line_no, 'D3_particle_given', '''van'' on given side in ''' || form || '''' FROM f WHERE k = 6
UNION ALL SELECT line_no, 'D4_digit', 'digit in ''' || form || '''' FROM f WHERE k = 4 UNION ALL SELECT line_no, 'D4_noise', '''University'' in ''' || form || '''' FROM f WHERE k = 4
UNION ALL SELECT line_no, 'D4_noise', '''new'' in ''' || CASE WHEN k = 6 THEN b || ', ' || a ELSE form END || '''' FROM f WHERE a = 'new' OR (b = 'new' AND k NOT IN (3, 4, 6))
UNION ALL SELECT line_no, 'D4_paren', 'parentheses in ''' || form || '''' FROM f WHERE k = 5 UNION ALL SELECT line_no, 'D4_amp', '''&'' in ''' || form || '''' FROM f WHERE k = 5
UNION ALL SELECT line_no, 'D5_duplicate', '''' || a || ' ' || a || ''' in ''' || form || '''' FROM f WHERE k = 5 UNION ALL SELECT line_no, 'D5_punct', 'punctuation-only token ''-'' in ''' || form || '''' FROM f WHERE k = 5
UNION ALL SELECT line_no, 'D5_edge_comma', 'edge comma in ''' || form || '''' FROM f WHERE k = 6 UNION ALL SELECT line_no, 'D5_multi_comma', 'multiple commas in ''' || form || '''' FROM f WHERE k = 6
UNION ALL SELECT line_no, 'D5_duplicate', '''' || a || ' ' || b || ''' in ''' || form || '''' FROM f WHERE k NOT IN (1, 2, 3, 4, 5, 6) AND lower(a) = lower(b)
UNION ALL SELECT line_no, 'D5_duplicate', '''' || a || ' ' || b || ''' in ''' || form || '''' FROM f WHERE k = 1 AND lower(a) = lower(b)
UNION ALL SELECT line_no, 'D6_title_taint', '''др'' in cy cell' FROM f WHERE o = 1 UNION ALL SELECT line_no, 'D6_latin_leak', 'latin chars in cy{' || a || '}' FROM f WHERE o = 2)"""


def _flags(spark, d, only=tuple(detectors.DETECTORS)):
    return detectors.flag(I.flagged_people(spark, d), only=only)


def _one(spark, d, name):
    return detectors.each_flag(_flags(spark, d, (name,)), "line_no")


@query(_FLAGS + " SELECT * FROM x WHERE detector LIKE 'D1%'")
def detect_titles(spark, d):
    return _one(spark, d, "titles")


@query(_FLAGS + " SELECT * FROM x WHERE detector LIKE 'D2%'")
def detect_generational(spark, d):
    return _one(spark, d, "generational")


@query(_FLAGS + " SELECT * FROM x WHERE detector LIKE 'D3%'")
def detect_particles(spark, d):
    return _one(spark, d, "particles")


@query(_FLAGS + " SELECT * FROM x WHERE detector LIKE 'D4%'")
def detect_noise(spark, d):
    return _one(spark, d, "noise")


@query(_FLAGS + " SELECT * FROM x WHERE detector LIKE 'D5%'")
def detect_structural(spark, d):
    return _one(spark, d, "structure")


@query(_FLAGS + " SELECT * FROM x WHERE detector LIKE 'D6%'")
def detect_taint(spark, d):
    return _one(spark, d, "taint")


@query(_FLAGS + " SELECT substr(detector, 1, 2) AS detector, count(*) AS n FROM x GROUP BY 1")
def flags_by_detector(spark, d):
    return detectors.by_detector(_flags(spark, d))


def _results(spark, d):
    lines = I.lines(spark, d).where("line_no % 3 = 0")
    outcome = F.when(F.col("line_no") % 4 == 0, "dropped").when(F.col("line_no") % 4 == 1, "fixed").otherwise("clean")
    return lines.select("line_no", outcome.alias("outcome"), F.when(outcome == "fixed", F.upper("line")).alias("new_line"))


@query(f"WITH {I.LINES} SELECT line_no, CASE WHEN line_no % 3 = 0 AND line_no % 4 = 1 THEN upper(line) ELSE line END AS line FROM lines WHERE NOT (line_no % 3 = 0 AND line_no % 4 = 0)")
def order_preserving_rewrite(spark, d):
    return dataset.rewritten(I.lines(spark, d), _results(spark, d))


@query(f"WITH {I.LINES} SELECT CASE line_no % 4 WHEN 0 THEN 'dropped' WHEN 1 THEN 'fixed' ELSE 'clean' END AS outcome, count(*) AS n FROM lines WHERE line_no % 3 = 0 GROUP BY 1")
def outcome_counts(spark, d):
    return _results(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def checkpoint_last_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id").withColumn("at", F.col("event_id"))
    return last_by_key(rows, "user_id", "at").select("user_id", "event_type", "event_id")


@query(f"WITH {I.LINES} SELECT line_no FROM lines WHERE line_no % 3 <> 0")
def resume_anti(spark, d):
    return I.lines(spark, d).join(_results(spark, d), "line_no", "left_anti").select("line_no")


@query("SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 1 THEN 'not_a_person_name' WHEN 2 THEN NULL ELSE 'extract_name' END AS name, CASE WHEN p_partkey % 4 IN (0, 3) THEN split_part(p_name, ' ', 1) END AS given, CASE WHEN p_partkey % 4 IN (0, 3) THEN CASE WHEN p_partkey % 3 = 1 THEN '' ELSE split_part(p_name, ' ', 2) END END AS family FROM part")
def tool_call_parse(spark, d):
    call = I.raw_calls(spark, d).select("key", stages.first_call(F.col("raw_text")).alias("c"))
    return call.select("key", "c.name", F.col("c.args")["given"].alias("given"), F.col("c.args")["family"].alias("family"))


@query("SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 1 THEN 'not_a_person_name' WHEN 2 THEN 'malformed' ELSE CASE WHEN p_partkey % 3 = 1 THEN 'incomplete_name' ELSE 'extract_name' END END AS outcome, CASE WHEN p_partkey % 4 IN (0, 3) AND p_partkey % 3 <> 1 THEN 8 END AS n_variants FROM part")
def extraction_outcomes(spark, d):
    """The extracting stage over a table of responses, with one retry (L1)."""
    raw = I.raw_calls(spark, d)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    responses = raw.select(F.lit("extract").alias("stage"), "key", F.lit(0).alias("attempt"), "raw_text")
    return stages.extracted(stages.Responses(responses), rows).select("key", "outcome", F.when(F.col("variants").isNotNull(), F.size("variants")).alias("n_variants"))


@query("SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'plain' ELSE '' END AS items FROM part")
def string_lists(spark, d):
    k = F.col("p_partkey") % 3
    value = F.when(k == 0, '["a", " b ", "a", "", "c"]').when(k == 1, " plain ").otherwise("")
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.array_join(toolcalls.string_list(value, 2), "|").alias("items"))


# scoring

_CENTRES = "WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS dim FROM embeddings), c AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL), s AS (SELECT e.vec_id, c.label, sum(power(e.x - c.m, 2)) AS score FROM e JOIN c USING (dim) GROUP BY ALL)"


def _scores(spark, d):
    """Squared distances of the vectors to the centres of the labels, the stated panel."""
    e = table(spark, d, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("dim", "x"))
    centres = long.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"))
    far = scoring.total(F.zip_with("embedding", "centre", lambda x, m: (x - m) * (x - m)))
    return e.select("vec_id", "embedding").crossJoin(F.broadcast(centres)).select("vec_id", "label", far.alias("score"))


@query(_CENTRES + " SELECT vec_id, label, round(score, 6) AS score FROM s")
def score_cross(spark, d):
    return _scores(spark, d).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(_CENTRES + ", r AS (SELECT vec_id AS id, label AS name, score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score, label) AS INT) AS rank FROM s) SELECT id, rank, name, round(score, 6) AS score, round((SELECT median(o.score) FROM r o WHERE o.id = r.id AND o.name <> r.name) - score, 6) AS margin FROM r WHERE rank <= 3")
def match_topk_margin(spark, d):
    scores = _scores(spark, d).select(F.col("vec_id").alias("id"), F.col("label").alias("name"), "score")
    out = scoring.ranked(scores, "name", 3)
    return out.select("id", "rank", "name", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS dim FROM embeddings), q AS (SELECT vec_id, sum(x * (dim % 3 - 1)) / 8 AS s FROM e GROUP BY vec_id),
w AS (SELECT label, dim, x, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM e JOIN q USING (vec_id)) SELECT label, CAST(dim AS INT) AS dim, round(sum(w * x) / sum(w), 6) AS value FROM w GROUP BY label, dim""")
def cluster_pool_softmax(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector"))
    probe = F.array(*(F.lit(float(k % 3 - 1)) for k in range(64)))
    return scoring.pooled(e, probe, "label").select("label", "dim", F.round("value", 6).alias("value"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS dim FROM embeddings), v AS (SELECT vec_id, CAST(x AS DOUBLE) AS m, exp(CAST(x AS DOUBLE)) AS var, CAST(x AS DOUBLE) AS lv FROM e)
SELECT vec_id, round(sum(0.5 * (m * m + var - 1 - lv)), 6) AS kl_sum, round(avg(0.5 * (m * m + var - 1 - lv)), 6) AS kl_mean, round(avg(var), 6) AS var_mean, round(list_sort(list(var))[32], 6) AS var_p50, round(quantile_cont(var, 0.9), 6) AS var_p90,
round(max(var), 6) AS var_max, round(list_sort(list(sqrt(var)))[32], 6) AS std_p50, round(count(*) FILTER (var > 1) / count(*), 6) AS dims_over_prior FROM v GROUP BY vec_id""")
def posterior_stats(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("mean"), F.col("embedding").cast("array<double>").alias("logvar"))
    out = scoring.posterior_stats(e)
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in ("kl_sum", "kl_mean", "var_mean", "var_p50", "var_p90", "var_max", "std_p50", "dims_over_prior")))


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS val_ce, round(sum(l_tax * l_linenumber) / sum(l_linenumber), 8) AS val_kl FROM lineitem")
def weighted_val_loss(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_discount").alias("ce"), F.col("l_tax").alias("kl"), F.col("l_quantity").alias("n_tok"), F.col("l_linenumber").alias("n_cl"))
    return evaluation.weighted_loss(b).select(F.round("val_ce", 8).alias("val_ce"), F.round("val_kl", 8).alias("val_kl"))


@query(f"SELECT {I._TAG_LIST}[l_partkey % 12 + 1] AS tag, round(avg(l_discount), 8) AS nll_primed, round(avg(l_tax), 8) AS nll_unprimed, round(avg(CAST(l_returnflag = 'R' AS INT)), 8) AS match_rate, count(*) AS n FROM lineitem GROUP BY 1")
def spot_check_by_tag(spark, d):
    from ..schema import SCRIPTS

    rows = table(spark, d, "lineitem").select(
        F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("l_partkey") % 12 + 1).cast("int")).alias("tag"), F.col("l_discount").alias("nll_primed"), F.col("l_tax").alias("nll_unprimed"), (F.col("l_returnflag") == "R").alias("matched")
    )
    return evaluation.spot_check(rows).select("tag", *(F.round(c, 8).alias(c) for c in ("nll_primed", "nll_unprimed", "match_rate")), "n")


@query(f"WITH {I.ORDERED} SELECT line_no, string_agg(value, '|' ORDER BY pos) FILTER (pos <= 2) AS inputs, string_agg(value, '|' ORDER BY pos) FILTER (pos > 2) AS held_out FROM ordered GROUP BY line_no HAVING count(*) > 2")
def spot_check_split(spark, d):
    records = I.clusters(spark, d).select(F.col("line_no").alias("key"), F.transform("cells", lambda c: c["value"]).alias("cells"))
    return evaluation.split_inputs(records, 2).select(F.col("key").alias("line_no"), F.array_join("inputs", "|").alias("inputs"), F.array_join("held_out", "|").alias("held_out"))


@query("WITH m AS (SELECT o_totalprice AS own, c_acctbal AS other FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT list_sort(list(other - own)) AS l, count(*) AS n, avg(own) AS a, avg(other) AS b, avg(other - own) AS c, avg(CAST(other > own AS INT)) AS p FROM m) SELECT round(a, 4) AS own_mean, round(b, 4) AS other_mean, round(c, 4) AS margin_mean, round(l[n // 10 + 1], 4) AS margin_p10, round(l[n // 2 + 1], 4) AS margin_p50, round(l[CAST(floor(0.9 * n) AS BIGINT) + 1], 4) AS margin_p90, round(p, 8) AS positive FROM s")
def selectivity_percentiles(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("own"), F.col("c_acctbal").alias("other"))
    out = evaluation.selectivity(rows)
    return out.select(*(F.round(c, 4).alias(c) for c in ("own_mean", "other_mean", "margin_mean", "margin_p10", "margin_p50", "margin_p90")), F.round("positive", 8).alias("positive"))


@query("WITH p AS (SELECT p_partkey AS key, p_name AS value FROM part ORDER BY md5('3:' || p_partkey), p_partkey LIMIT 64), j AS (SELECT a.key, b.key AS other_key, b.value AS negative, md5('3:' || a.key || ':' || b.key || ':' || b.value) AS h FROM p a JOIN p b ON a.key <> b.key) SELECT key, other_key, negative FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, other_key, negative) AS r FROM j) WHERE r <= 5")
def sampled_negatives(spark, d):
    """Of a sampled panel, cells of other members."""
    p = dataset.hash_sample(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")), "key", 64, 3)
    return evaluation.negatives(p, p, 5, 3)


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), s AS (SELECT user_id, sum(c) AS n, count(*) AS u, sum(c * ln(c)) AS x FROM c GROUP BY user_id) SELECT user_id AS cluster, CAST(n AS BIGINT) AS n, u AS n_unique, round(CASE WHEN u > 1 THEN (ln(n) - x / n) / ln(n) ELSE 0 END, 8) AS normalized_entropy FROM s")
def decode_entropy(spark, d):
    decodes = table(spark, d, "events").select(F.col("user_id").alias("cluster"), F.col("event_type").alias("text"))
    return evaluation.decode_diversity(decodes).withColumn("normalized_entropy", F.round("normalized_entropy", 8))


@query("WITH h AS (SELECT o_custkey AS run, o_orderkey AS step, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS t FROM orders) SELECT run, arg_max(v, step) FILTER (v IS NOT NULL) AS last_val_loss, min(v) AS best_val_loss, arg_max(t, step) FILTER (t IS NOT NULL) AS last_train_loss, count(v) AS n_val FROM h GROUP BY run")
def sweep_final_metrics(spark, d):
    is_val = F.col("o_orderkey") % 3 == 0
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.when(is_val, F.col("o_totalprice")).alias("val_loss"), F.when(~is_val, F.col("o_totalprice")).alias("train_loss"))
    return evaluation.final_metrics(h)


@query("SELECT md5(string_agg(p_name || p_partkey, '' ORDER BY p_name, p_partkey)) AS checksum FROM part")
def vocabulary_checksum(spark, d):
    return tokens.vocabulary_checksum(table(spark, d, "part").select(F.col("p_name").alias("piece"), F.col("p_partkey").alias("id")))


@query(f"WITH {I.COMPANIES} SELECT id, rank, count(*) AS n FROM (SELECT id, id % 4 AS rank FROM companies) GROUP BY ALL")
def rank_split(spark, d):
    """Shards dealt in turn to four ranks (R2)."""
    epochs = table(spark, d, "part").select(F.col("p_partkey").alias("pos"))
    out = None
    for rank in range(4):
        part = feed.rank_share(epochs, rank, 4).groupBy(F.col("pos").alias("id")).agg(F.lit(rank).cast("long").alias("rank"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# beyond SQL: seeded generators, iteration, digests


@query()
def epoch_permutation(spark, d):
    return feed.epoch_table(spark, [f"shard-{k:06d}" for k in range(20)], 123, 2)


@query()
def token_chunks(spark, d):
    text = table(spark, d, "documents").select(F.explode(tokens.chunks(F.col("text"))).alias("chunk"))
    return text.groupBy("chunk").agg(F.count("*").alias("n"))


@query()
def bpe_verify(spark, d):
    """A vocabulary trained on the parts' names, round trips by tag."""
    cells = I.clusters(spark, d).select("line_no", F.posexplode("cells").alias("pos", "c")).select(F.concat_ws(":", "line_no", "pos").alias("key"), "c.tag", "c.value")
    vocabulary = tokens.train(table(spark, d, "part").select("p_name"), "p_name", 320)
    ids_ = tokens.encoded(cells, "key", "value", vocabulary)
    return tokens.verified(tokens.decoded(cells.join(ids_, "key"), vocabulary))


@query()
def corrupt_letters(spark, d):
    cells = I.clusters(spark, d).select("line_no", F.posexplode("cells").alias("pos", "c")).select(F.concat_ws(":", "line_no", "pos").alias("key"), "c.tag", "c.value")
    return letters.corrupted(cells, 5, 0.1, {"la": dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 1.0)})


@query()
def collate_targets(spark, d):
    records = I.clusters(spark, d).select(F.col("line_no").alias("idx"), F.col("line_no").cast("string").alias("key"), F.transform("cells", lambda c: c["tag"]).alias("tags"))
    out = batching.collated(records, 11)
    return out.select("key", F.array_join("input_places", ",").alias("inputs"), F.array_join("target_places", ",").alias("targets"))


@query()
def config_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.short_id_column(F.col("p_name")).alias("short_id"))


@query()
def panel_scores(spark, d):
    """Cost by token of the regions' names under each part's name, with the stand-in scorer."""
    cluster = lambda key, name: (F.col(key).cast("string").alias("key"), F.array(F.struct(F.lit("la").alias("tag"), F.col(name).alias("text"))).alias("surfaces"))
    asked, panel = table(spark, d, "part").select(*cluster("p_partkey", "p_name")), table(spark, d, "region").select(*cluster("r_regionkey", "r_name"))
    return scoring.cross_scored(asked, panel, scoring.TrigramScorer(), (True, False)).withColumn("nll_tok", F.round("nll_tok", 9))


@query()
def confusion_classes(spark, d):
    rows = [(s, c, m) for s, own in letters.confusion().items() for c, m in sorted(own.items())]
    return spark.createDataFrame(rows, "script string, letter string, mates string")


