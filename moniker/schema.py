"""Names and types that everything else shares."""

from __future__ import annotations

from pyspark.sql import types as T

#: The script tags of a cluster, in corpus order.
SCRIPTS = ("la", "cy", "gk", "ab", "cn", "jp", "kr", "dv", "hb", "th", "gg", "am")
LATIN = "la"
CJK = ("cn", "jp", "kr")
CASED = ("la", "cy", "gk", "am")

CELL = T.StructType([T.StructField("tag", T.StringType()), T.StructField("value", T.StringType())])
CELLS = T.ArrayType(CELL)
FLAGS = T.ArrayType(T.StructType([T.StructField("detector", T.StringType()), T.StructField("evidence", T.StringType())]))
#: A cluster as shards store it.
RECORD = T.StructType([T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("cells", T.ArrayType(T.StringType()))])
