"""Corpora made from the driver's tables: raw strings, people, companies, clusters; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCRIPTS

_TAG_LIST = "[" + ", ".join(f"'{t}'" for t in SCRIPTS) + "]"
FORMS = ("Inc", "Ltd.", "Co., Ltd.", "GmbH", "S.A.", "Corporation", "B.V.", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents: row_no (ascending in document and line), raw."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return lines.select((F.col("doc_id") * (1 << 20) + F.col("at")).alias("row_no"), "raw")


RAW = "raw AS (SELECT doc_id * 1048576 + i - 1 AS row_no, string_split(text, chr(10))[i] AS raw FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, given, family: two words of a part, a second given name, particles and suffixes by id."""
    p = table(spark, sf_dir, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    k = F.col("p_partkey")
    given = F.when(k % 5 == 1, F.concat_ws(" ", a, b)).when(k % 5 == 2, F.concat_ws("-", a, b)).when(k % 5 == 3, F.lit("")).otherwise(a)
    family = F.when(k % 4 == 1, F.concat(F.lit("van der "), b)).when(k % 4 == 2, F.concat(b, F.lit(" Jr."))).otherwise(b)
    return p.select(k.alias("id"), given.alias("given"), family.alias("family"))


PEOPLE = """people AS (SELECT p_partkey AS id,
  CASE p_partkey % 5 WHEN 1 THEN a || ' ' || b WHEN 2 THEN a || '-' || b WHEN 3 THEN '' ELSE a END AS given,
  CASE p_partkey % 4 WHEN 1 THEN 'van der ' || b WHEN 2 THEN b || ' Jr.' ELSE b END AS family, a, b
  FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, display: part names with legal forms."""
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.rtrim(F.concat_ws(" ", "p_name", form)).alias("display"))


COMPANIES = f"companies AS (SELECT p_partkey AS id, rtrim(p_name || ' ' || {list(FORMS)!r}[p_partkey % {len(FORMS)} + 1]) AS display, p_name, p_partkey % {len(FORMS)} AS f FROM part)"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, cells: the parts of an order, tagged by part."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tags = F.array(*map(F.lit, SCRIPTS))
    cell = F.struct("l_linenumber", "l_partkey", F.element_at(tags, (F.col("l_partkey") % 12 + 1).cast("int")).alias("tag"), F.col("p_name").alias("value"))
    grouped = items.groupBy(F.col("l_orderkey").alias("line_no")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return grouped.select("line_no", F.transform("c", lambda c: F.struct(c["tag"].alias("tag"), c["value"].alias("value"))).alias("cells"))


CELLS = f"cells AS (SELECT l_orderkey AS line_no, l_linenumber AS ln, l_partkey AS pk, {_TAG_LIST}[l_partkey % 12 + 1] AS tag, p_name AS value FROM lineitem JOIN part ON l_partkey = p_partkey)"
ORDERED = CELLS + ", ordered AS (SELECT line_no, tag, value, row_number() OVER (PARTITION BY line_no ORDER BY ln, pk) AS pos FROM cells)"
LINES = ORDERED + ", lines AS (SELECT line_no, string_agg(tag || '{' || value || '}', chr(9) ORDER BY pos) AS line FROM ordered GROUP BY line_no)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.cells import format_line

    return clusters(spark, sf_dir).select("line_no", format_line(F.col("cells")).alias("line"))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are cut, badly tagged, without a value, or empty."""
    k, line = F.col("line_no") % 7, F.col("line")
    bad = (
        F.when(k == 1, line.substr(F.lit(1), F.length(line) - 1))
        .when(k == 2, F.concat(F.lit("zz"), line.substr(F.lit(3), F.length(line))))
        .when(k == 3, F.concat(F.substring(line, 1, 3), line.substr(F.instr(line, "}"), F.length(line))))
        .when(k == 4, F.lit(""))
        .otherwise(line)
    )
    return lines(spark, sf_dir).select("line_no", bad.alias("line"))


BROKEN = (
    LINES
    + """, broken AS (SELECT line_no, CASE line_no % 7 WHEN 1 THEN substr(line, 1, length(line) - 1) WHEN 2 THEN 'zz' || substr(line, 3)
  WHEN 3 THEN substr(line, 1, 3) || substr(line, strpos(line, '}')) WHEN 4 THEN '' ELSE line END AS line FROM lines)"""
)


def flagged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, cells: clusters with what detectors look for, by part."""
    k = F.col("p_partkey")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    form = (
        F.when(k % 9 == 1, F.concat(F.lit("Dr. "), a, F.lit(" "), b))
        .when(k % 9 == 2, F.concat(a, F.lit(" Jr "), b))
        .when(k % 9 == 3, F.concat(F.lit("zu, "), a))
        .when(k % 9 == 4, F.concat(a, F.lit(" University 7")))
        .when(k % 9 == 5, F.concat(a, F.lit(" "), a, F.lit(" - (x) & "), b))
        .when(k % 9 == 6, F.concat(b, F.lit(", van "), a, F.lit(",")))
        .otherwise(F.concat_ws(" ", a, b))
    )
    other = F.when(k % 4 == 1, F.concat(F.lit("др. иванов"))).when(k % 4 == 2, a).when(k % 4 == 3, F.lit("王小明")).otherwise(F.lit("иван"))
    cell = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.alias("value"))
    return table(spark, sf_dir, "part").select(k.alias("line_no"), F.array(cell("la", form), cell("la", F.concat(b, F.lit(", "), a)), cell("cy", other)).alias("cells"))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, raw_text: model outputs with tool calls, made from parts."""
    k = F.col("p_partkey")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    call = F.concat(F.lit("<think>hm</think><tool_call>\n<function=extract_name>\n<parameter=given>\n"), a, F.lit("\n</parameter>\n<parameter=family>"), F.when(k % 3 == 1, F.lit("")).otherwise(b), F.lit("</parameter>\n</function>\n</tool_call>"))
    listed = F.concat(F.lit('[{"name": "not_a_person_name", "arguments": {}}]'))
    return table(spark, sf_dir, "part").select(k.alias("key"), F.when(k % 4 == 1, listed).when(k % 4 == 2, F.lit("no call")).otherwise(call).alias("raw_text"))


