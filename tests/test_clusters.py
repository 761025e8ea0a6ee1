"""Cells, validation, detectors, splits, sources."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from moniker.functions import cells as C
from moniker.functions import toolcalls as T
from moniker.operators import dataset, detectors, grouping, tokens
from moniker.sources import clusters, lines


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "reason", "tags"),
    [
        ("la{A}\tcy{Б}", None, ["la", "cy"]),
        ("", "empty_line", []),
        (" \t ", "empty_line", []),
        ("la{A}\tzz{B}", "malformed_cell", ["la"]),
        ("la{A}\tcy{}", "empty_value", ["la"]),
        ("cy{Б}", "no_la_cell", ["cy"]),
        ("la{A}}", None, ["la"]),
        ("la{A}\tcy{Б", "malformed_cell", ["la"]),
        ("la{A}\r\n", None, ["la"]),
    ],
)
def test_validate(spark, line, reason, tags):
    got = value(spark, C.validate(F.lit(line)))
    assert (got["ok"], got["reason"], got["tags"]) == (reason is None, reason, tags)


def test_lenient_and_strict_parsing_differ(spark):
    assert [tuple(c) for c in value(spark, C.parse_lenient(F.lit("xx{}\tla{a}}")))] == [("xx", ""), ("la", "a}")]
    assert value(spark, C.parse(F.lit("xx{}\tla{a}"))) is None
    assert value(spark, C.parse_lenient(F.lit("la{a"))) is None
    assert [tuple(c) for c in value(spark, C.valid_cells(F.lit("xx{a}\tla{b}\tcy{}")))] == [("la", "b")]


def test_round_trip(spark):
    line = "la{A b}\tcy{Б}\tla{C}"
    assert value(spark, C.format_line(C.parse(F.lit(line)))) == line


def flags(spark, cells):
    df = spark.createDataFrame([(1, cells)], "line_no long, cells array<struct<tag:string,value:string>>")
    return [f["detector"] for f in detectors.flag(df).first()["flags"]]


def test_detectors(spark):
    assert flags(spark, [("la", "Dr. Ada King"), ("la", "King, Ada")]) == ["D1_title"]
    assert flags(spark, [("la", "Ada King Jr.")]) == []
    assert flags(spark, [("la", "Ada Jr. King")]) == ["D2_generational"]
    assert flags(spark, [("la", "Zu, Qun"), ("cn", "祖群")]) == []
    assert flags(spark, [("la", "Zu, Qun")]) == ["D3_particle_family"]
    assert flags(spark, [("la", "Park, Ji Sung")]) == []
    assert flags(spark, [("la", "Y. Li"), ("la", "Li, Y.")]) == []
    assert flags(spark, [("la", "Ada 7 (x) & University")]) == ["D4_digit", "D4_paren", "D4_amp", "D4_noise"]
    assert flags(spark, [("la", ",Ada, King,")]) == ["D5_edge_comma", "D5_multi_comma"]
    assert flags(spark, [("la", "A. A. King King")]) == ["D5_duplicate"]
    assert flags(spark, [("la", "Ada - King")]) == ["D5_punct"]
    assert flags(spark, [("la", "Ada King"), ("cy", "др Кинг"), ("gk", "abc")]) == ["D6_title_taint", "D6_latin_leak"]
    assert flags(spark, [("la", "Ada King"), ("cy", "Драгомир Кинг")]) == []


def test_group_companies(spark):
    raw = ["Acme Inc", "ACME", "Acme Inc", "  ", "Inc.", "Bolt Ltd", "acme!", "Acme"]
    rows = spark.createDataFrame(list(enumerate(raw)), "row_no long, raw string")
    groups = grouping.group_companies(rows)
    got = [r["line"] for r in grouping.as_lines(groups).orderBy("first_row").collect()]
    assert got == ["la{Acme Inc}\tla{acme!}\tla{ACME}\tla{Acme}", "la{Bolt Ltd}"]
    assert tuple(grouping.summary(rows, groups).first()) == (7, 6, 2)


def test_evenly_picked_and_numbered(spark):
    df = lines.positions(spark.range(1000, 1103, numPartitions=5).select(F.col("id").alias("v")), "v", "i", width=16)
    assert [r["i"] for r in df.orderBy("v").collect()] == list(range(103))
    assert [r["i"] for r in lines.numbered(spark.range(0, 50, numPartitions=7), "i").orderBy("id").collect()] == list(range(50))
    assert [tuple(r) for r in df.orderBy("v").limit(2).collect()] == [(1000, 0), (1001, 1)]
    got = {r["i"] for r in df.where(dataset.evenly_picked(F.col("i"), 103, 10)).collect()}
    assert got == {(k * 103) // 10 for k in range(10)}


def test_leakage_guard_keeps_repeats(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "c")], "line_no long, line string")
    val = rows.where("line_no = 0")
    assert sorted(r["line_no"] for r in dataset.without(rows, val).collect()) == [1, 3, 4]
    assert dataset.overlap(rows, val).count() == 2
    assert sorted(r["line_no"] for r in dataset.first_occurrences(rows).collect()) == [0, 1, 3]


def test_tool_calls(spark):
    text = "<think>a<tool_call></think><tool_call>\n<function=f>\n<parameter=x> 1 </parameter><parameter=x>2</parameter></function></tool_call>"
    assert [(c["name"], c["args"]) for c in value(spark, T.calls(F.lit(text)))] == [("f", {"x": "2"})]
    body = '<tool_call><function=g>{"a": "b"}</function></tool_call>'
    assert [(c["name"], c["args"]) for c in value(spark, T.calls(F.lit(body)))] == [("g", {"a": "b"})]
    listed = '[{"name": "h", "arguments": {"k": "v"}}, {"nope": 1}]'
    assert [(c["name"], c["args"]) for c in value(spark, T.calls(F.lit(listed)))] == [("h", {"k": "v"})]
    assert value(spark, T.calls(F.lit("nothing"))) == []


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\n  y \n", encoding="utf-8")
    assert [r["line"] for r in lines.read_trimmed(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()] == ["x", "y"]
    (tmp_path / "e.txt").write_text("\n \n", encoding="utf-8")
    with pytest.raises(ValueError, match="no text lines"):
        lines.read_trimmed(spark, str(tmp_path / "e.txt"))
    rows = [{"id": "q", "surfaces": [{"tag": "la", "text": "A"}]}, {"tag": "cy", "surfaces": ["Б"]}, {"id": "z", "surfaces": []}]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\nnot json\n", encoding="utf-8")
    got = {r["key"]: r for r in clusters.read_clusters(spark, str(tmp_path / "c.jsonl"), strict=False).collect()}
    assert got["q"]["surfaces"][0]["text"] == "A" and got["line-2"]["surfaces"][0]["tag"] == "cy" and "z" not in got
    assert "invalid JSON" in got["line-5"]["error"]
    with pytest.raises(Exception, match="invalid JSON"):
        clusters.read_clusters(spark, str(tmp_path / "c.jsonl")).collect()


def test_shards_round_trip(spark, tmp_path):
    rows = [(k // 3, k % 3, f"cluster-{k:09d}", ["la", "cy"], [f"n{k}", f"н{k}"]) for k in range(7)]
    df = spark.createDataFrame(rows, "shard long, position long, key string, tags array<string>, cells array<string>")
    clusters.write_shards(df, str(tmp_path / "s"))
    back = clusters.checked_records(clusters.read_shards(spark, str(tmp_path / "s"))).orderBy("shard", "position").collect()
    assert [tuple(r) for r in back] == rows
    assert clusters.expand_braces("a-{008..010}.tar") == ["a-008.tar", "a-009.tar", "a-010.tar"]


def test_checkpoint_last_wins(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('{"line_no": 1, "outcome": "x"}\n{"line_no": 2, "outcome": "y"}\n{"line_no": 1, "outcome": "z"}\n{"line_no": 3, "out', encoding="utf-8")
    from pyspark.sql import types as ST

    schema = ST.StructType([ST.StructField("line_no", ST.LongType()), ST.StructField("outcome", ST.StringType())])
    got = {r["line_no"]: r["outcome"] for r in lines.read_checkpoint(spark, str(tmp_path / "c"), schema).collect()}
    assert got == {1: "z", 2: "y"}


def test_shards_are_written_by_several_tasks_and_read_by_any_tar(spark, tmp_path):
    cells = F.array(F.concat(F.lit('é"\\'), F.col("id").cast("string")), F.lit("张"))
    records = spark.range(400).select(F.floor(F.col("id") / 20).alias("shard"), F.pmod("id", F.lit(20)).alias("position"), F.format_string("c-%09d", "id").alias("key"), F.array(F.lit("la"), F.lit("cn")).alias("tags"), cells.alias("cells"))
    clusters.write_shards(records.coalesce(1), str(tmp_path / "s"))
    written = spark.read.parquet(str(tmp_path / "s"))
    assert len(written.inputFiles()) > 1
    with tarfile.open(fileobj=io.BytesIO(written.where("shard = 3").first()["blob"]), mode="r:gz") as tar:
        got = [(m.name, json.loads(tar.extractfile(m).read())) for m in tar]
    assert got == [(f"c-{k:09d}.json", {"tags": ["la", "cn"], "cells": [f'é"\\{k}', "张"]}) for k in range(60, 80)]


def test_each_distinct_text_is_encoded_once(spark):
    vocabulary = tokens.Vocabulary([("a", "b")])
    rows = spark.createDataFrame([("1", "ab ab"), ("2", "ab ab"), ("3", ""), ("4", None)], "key string, value string")
    out = tokens.encoded(rows, "key", "value", vocabulary)
    got = {r["key"]: r["ids"] for r in out.collect()}
    one = [i for c in ("ab", " ab") for i in vocabulary.encode_chunk(c)]
    assert got == {"1": one, "2": one, "3": [], "4": []}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().treeString()
