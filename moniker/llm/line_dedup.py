"""Line dedup over content-defined chunks of lines, in DataFrame functions throughout.

A document is cut into chunks of lines where a rolling hash over the hashes of the last two lines says so (and did
not say so a line before), so that a passage is cut alike wherever it stands. Chunks of two lines or more that occur again anywhere in the corpus
go, but for their first occurrence. Candidates are found by hash; chunks are only removed after the bytes of all that
have a hash have been compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_key, written

#: A boundary may come after a line if the rolling hash is a multiple of this; of two in a row the first counts.
DIVISOR = 2
#: Lines of a chunk: fewer are no multi-line chunk and stay.
LEAST = 2
#: Repeated hashes (24 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 1 << 20

_BASE, _MODULUS = 1_000_003, (1 << 31) - 1


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each chunk: ``keep``, first (its first line, from 0), lines, last (whether it ends the text)."""
    lines = docs.select(*keep, F.split("text", "\n").alias("__lines"))
    hashed = lines.withColumn("__h", F.transform("__lines", _line_hash))
    rolled = F.transform("__h", lambda h, i: F.when(i == 0, h).otherwise((F.element_at("__h", F.greatest(i, F.lit(1))) * _BASE + h) % _MODULUS))
    n = F.size("__lines")
    says = lambda i: F.element_at("__r", i) % DIVISOR == 0
    marked = hashed.withColumn("__r", rolled).withColumn(
        "__cut", F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i > 1) & says(i) & ~says(F.greatest(i - 1, F.lit(1)))))
    )  # the lines, from 1, that end a chunk
    begin = lambda k: F.when(k == 0, 0).otherwise(F.element_at("__cut", F.greatest(k, F.lit(1))))
    chunks = F.transform("__cut", lambda end, k: F.struct(begin(k).alias("first"), F.slice("__lines", begin(k) + 1, end - begin(k)).alias("lines")))
    # outer, or the optimiser derives a filter that computes all of this anew inside its lambdas
    return marked.select(*keep, F.inline_outer(chunks))


def dedup_lines(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with what is left of each text; columns as in ``docs``, and no row is dropped.

    Lines end at ``\\n``; the kept ones are joined by it again, and a text of which nothing is left is empty. A chunk's
    first occurrence is the one with the smallest doc_id (null last), then text hash, then line. Null text stays null,
    empty text is one empty line. Rows that repeat as a whole share their fate: their chunks count once. Should two
    different chunks ever have equal hashes (128 bits), both stay.
    """
    own = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.withColumnsRenamed(dict(zip(docs.columns, own, strict=True)))
    name = dict(zip(docs.columns, own, strict=True))
    text, doc = name["text"], name["doc_id"]
    keyed = rows.select(F.coalesce(F.col(doc).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), text_key(text).alias("key"), F.col(text).alias("text"))
    chunks = chunked(keyed.where("text is not null"), ["doc", "key"]).where(F.size("lines") >= LEAST)
    body = F.array_join("lines", "\n")
    place = F.struct("doc", "key", "first")
    chunks = chunks.select("doc", "key", "first", (F.col("first") + F.size("lines")).alias("end"), body.alias("body"))
    hashed = chunks.select("*", F.xxhash64("body").alias("hash"), F.xxhash64(F.lit(1), "body").alias("hash2"))
    # a place counts once, also where rows repeat: least and largest place differ
    repeated = hashed.groupBy("hash", "hash2").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most").drop("most")
    repeated = written(repeated, "line-hashes")
    if repeated.count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    occurrences = written(hashed.join(repeated, ["hash", "hash2"]), "line-occurrences")
    # the byte comparison: all texts of a hash are equal if the least and the largest are; others stay as they are
    unequal = occurrences.groupBy("hash", "hash2").agg(F.min("body").alias("a"), F.max("body").alias("b")).where(F.col("a").cast("binary") != F.col("b").cast("binary"))
    removed = occurrences.where(place != F.col("least")).select("doc", "key", "first", "end", "hash", "hash2")
    unequal = written(unequal.select("hash", "hash2"), "line-unequal")
    if not unequal.isEmpty():
        removed = removed.join(unequal, ["hash", "hash2"], "left_anti")
    by_doc = removed.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("__gone"))
    marked = rows.withColumns({"doc": F.coalesce(F.col(doc).cast("long"), F.lit((1 << 63) - 1)), "key": text_key(text)}).join(by_doc, ["doc", "key"], "left")
    marked = marked.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split(text, "\n")))
    return marked.select(*(F.when(F.col("__gone").isNull(), F.col(text)).otherwise(_left("__lines")).alias(c) if c == "text" else F.col(o).alias(c) for c, o in name.items()))


def _left(lines: str) -> Column:
    """What stays of the lines when those in the ranges ``__gone`` go."""
    begins = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda g: g["end"]))
    ends = F.concat(F.transform("__gone", lambda g: g["first"]), F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = dedup_lines(docs)
    return left.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


OP2_SQL = r"""
WITH l AS (SELECT r, doc_id, text, i, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n
  FROM (SELECT row_number() OVER () AS r, doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
s AS (SELECT *, CASE WHEN i = 1 THEN h ELSE (lag(h) OVER w * 1000003 + h) % 2147483647 END % 2 = 0 AS says FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, coalesce(lag(i > 1 AND says AND NOT before) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM (SELECT *, coalesce(lag(says) OVER (PARTITION BY r ORDER BY i), false) AS before FROM s)),
k AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY r ORDER BY i) AS chunk FROM c),
b AS (SELECT r, any_value(doc_id) AS doc_id, chunk, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS lines FROM k GROUP BY r, chunk),
d AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS nth FROM b WHERE lines >= 2),
kept AS (SELECT r, string_agg(body, chr(10) ORDER BY first) AS text FROM b WHERE (r, chunk) NOT IN (SELECT (r, chunk) FROM d WHERE nth > 1) GROUP BY r)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256
FROM (SELECT doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS t FROM (SELECT row_number() OVER () AS r, * FROM documents) documents LEFT JOIN kept USING (r))
"""
