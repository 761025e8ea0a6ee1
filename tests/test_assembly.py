"""Merging, files, shards, stages that ask a model, vocabularies, quantiles."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from moniker.functions import toolcalls
from moniker.operators import dataset, evaluation, letters, merging, prompts, repair, stages, tokens, transliteration
from moniker.sources import clusters, lines


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")


def plain_merge(old_val, people, firms, keep, holdout, seed, n_people, n_firms, test_seed):
    """The same over lists."""
    val = list(dict.fromkeys(x for x in old_val if x))
    draw = lambda n, k, s: set(random.Random(s).sample(range(n), min(k, n)))
    cut = lambda line: [c for c in line.split("\t") if keep(c)]
    dead = lambda cells: not any(c.startswith("la{") for c in cells)
    held = draw(len(firms), holdout, seed)
    free = [i for i, x in enumerate(firms) if not dead(cut(x)) and i not in held]
    test = {free[j] for j in draw(len(free), n_firms, test_seed)}
    out = [("old_val", "val", x) for x in val]
    for i, x in enumerate(firms):
        out.append(("company", "dead" if dead(cut(x)) else "val" if i in held else "test" if i in test else "pool", "\t".join(cut(x))))
    fresh = [x for x in people if x not in val]
    out += [("inventor", "skipped", x) for x in people if x in val]
    test = draw(len(fresh), n_people, test_seed)
    for i, x in enumerate(fresh):
        out.append(("inventor", "dead" if dead(cut(x)) else "test" if i in test else "pool", "\t".join(cut(x))))
    return sorted(out)


def test_merge_is_the_plain_one(spark):
    rng = random.Random(5)
    line = lambda: "\t".join(f"{rng.choice(['la', 'la', 'cy'])}{{{'x' * rng.randint(1, 12)}{rng.randint(0, 9)}}}" for _ in range(rng.randint(1, 3)))
    people, firms = [line() for _ in range(120)], [line() for _ in range(80)]
    val = [*people[:20], "", people[3], "la{other}"]
    got = merging.merged(rows_of(spark, val), rows_of(spark, people), rows_of(spark, firms), lambda c: dataset.short_cells(c, 10), 15, 1, 20, 10, 2)
    keep = lambda cell: len(cell) - 4 <= 9
    assert sorted((r["source"], r["split"], r["line"]) for r in got.collect()) == plain_merge(val, people, firms, keep, 15, 1, 20, 10, 2)
    counts = merging.merge_counts(got).first().asDict()
    assert counts["pool_total"] == counts["inventor_to_pool"] + counts["company_to_pool"] and counts["test_total"] == counts["test_inventor"] + counts["test_company"]
    with pytest.raises(Exception, match="malformed line"):
        merging.merged(rows_of(spark, val), rows_of(spark, ["la{a"]), rows_of(spark, firms), lambda c: c, 1, 1).collect()


def test_merge_of_nothing(spark):
    none = rows_of(spark, ["x"]).where("false")
    got = merging.merged(none, none, none, lambda c: c, 5, 1, 5, 5)
    assert got.count() == 0 and set(merging.merge_counts(got).first()) == {0}


def test_files_are_numbered_by_name(spark, tmp_path):
    for name, n in (("b", 500), ("a", 3), ("c", 40)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}\n" for k in range(n)), encoding="utf-8")
    got = [r["line"] for r in lines.read_raw(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [f"{name}{k}" for name, n in (("a", 3), ("b", 500), ("c", 40)) for k in range(n)]
    rows = lines.read_raw(spark, str(tmp_path))
    assert lines.line_at(rows, 3).first()["line"] == "b0" and lines.line_at(rows, -1).first()["line"] == "c39"
    with pytest.raises(IndexError):
        lines.line_at(rows, 543)


def test_shards_that_lack_members(spark, tmp_path):
    rows = [(k // 3, k % 3, f"cluster-{k:09d}", ["la"], [f"n{k}"]) for k in range(7)]
    df = spark.createDataFrame(rows, "shard long, position long, key string, tags array<string>, cells array<string>")
    manifest = dataset.manifest(df, 3).select("shard", "n")
    clusters.write_shards(df, str(tmp_path / "s"))
    assert {r["shard"]: r["n_read"] for r in clusters.verified_shards(spark, str(tmp_path / "s"), manifest).collect()} == {0: 3, 1: 3, 2: 1}
    with pytest.raises(Exception, match="shard 1 holds 3 members, not 4"):
        clusters.verified_shards(spark, str(tmp_path / "s"), manifest.withColumn("n", F.col("n") + (F.col("shard") == 1).cast("int"))).collect()
    assert [r["key"] for r in clusters.first_records(df, 2).collect()] == ["cluster-000000000", "cluster-000000001"]
    assert clusters.shard_pattern("val", 0) is None and clusters.shard_pattern("val", 3) == "val/shard-{000000..000002}.tar.gz"
    frequency = letters.letter_frequency(spark.createDataFrame([([("la", "abba"), ("cy", "Я")],)], "cells array<struct<tag:string,value:string>>"))
    clusters.write_tables(str(tmp_path / "t"), manifest, frequency)
    assert (tmp_path / "t" / "offsets.json").read_text() == "[0, 3, 6, 7]"
    assert clusters.read_frequencies(str(tmp_path / "t"))["la"] == [("a", 2), ("b", 2)]


def test_places_among_many_equal_values(spark):
    rng = random.Random(9)
    for values in ([rng.gauss(0, 1) for _ in range(997)], [5.0] * 400 + [rng.random() * 10 for _ in range(103)], [1.0], [2.0, 1.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = evaluation.at_shares(df, "v", (0.0, 0.1, 0.5, 0.9, 1.0)).first()
        n = len(values)
        assert list(got) == [sorted(values)[min(n - 1, int(q * n))] for q in (0.0, 0.1, 0.5, 0.9, 1.0)]


def test_stated_panels(spark):
    with pytest.raises(ValueError, match="more than 3"):
        evaluation.stated(spark.range(4), 3)


def test_vocabulary_files(spark, tmp_path):
    vocabulary = tokens.train(spark.createDataFrame([("low lower lowest {low}",)] * 3, "t string"), "t", 300)
    tokens.save_vocabulary(vocabulary, str(tmp_path / "v"))
    assert tokens.load_vocabulary(str(tmp_path / "v")).pieces == vocabulary.pieces
    rows = tokens.vocabulary_rows(spark, vocabulary)
    assert tokens.usable_vocabulary(rows).count() == len(vocabulary.pieces)
    with pytest.raises(ValueError, match=r"\[am\]"):
        tokens.usable_vocabulary(rows.where("piece <> '[am]'"))
    (tmp_path / "v" / "merges.txt").write_text("a b\n", encoding="utf-8")
    with pytest.raises(ValueError, match="don't agree"):
        tokens.load_vocabulary(str(tmp_path / "v"))


def call(name, **args):
    return f"<tool_call><function={name}>" + "".join(f"<parameter={k}>{v}</parameter>" for k, v in args.items()) + "</function></tool_call>"


def answers(spark, *rows):
    return stages.Responses(spark.createDataFrame(rows, "stage string, key string, attempt int, raw_text string"))


def test_missing_scripts_are_asked_for_one_by_one(spark):
    rows = spark.createDataFrame([("k", "Ada King"), ("n", "Bo Li")], "key string, label string")
    client = answers(
        spark,
        ("transliterate_a", "k", 0, call("emit_scripts", cy="abc", gk="Νίκος", jp="カナ")),  # jp is not of this pass
        ("transliterate_b", "k", 1, call("emit_scripts", cn="北京大学", jp="ギヨーム・フィリオン")),  # an example of another name
        ("transliterate_jp", "k", 1, call("emit_scripts", jp="アダ", th="สมชาย")),
        ("transliterate_cy", "k", 1, call("emit_scripts", cy="xyz")),
    )
    got = {r["key"]: r for r in transliteration.completed(client, rows).collect()}
    assert set(got["k"]["forms"]) == {"gk", "jp", "cn"} and got["k"]["forms"]["jp"] == ["アダ"]
    assert got["k"]["missing"] == ["cy", "ab", "kr", "dv", "hb", "th", "gg", "am"]
    assert got["n"]["forms"] == {} and len(got["n"]["missing"]) == 11


def test_spellings_leave_other_lines_alone(spark):
    texts = ["la{Ada King}\tcy{Кинг}", "no cluster", "cy{Кинг}", "la{King, Ada}\tla{King, Ada}"]
    client = answers(spark, ("alternatives", "0", 1, call("emit_alt_latin", alts='["Ada Kyng", "Kyng Ada", "Ada Kyng"]')), ("alternatives", "3", 0, "junk"))
    got = {r["line_no"]: r["line"] for r in transliteration.respelled(client, rows_of(spark, texts)).collect()}
    cells = got[0].split("\t")
    assert cells[0] == "la{Ada King}" and cells[-1] == "cy{Кинг}" and "la{Kyng, Ada}" in cells and "la{Ada, Kyng}" not in cells
    assert got[1] == texts[1] and got[2] == texts[2] and got[3] == "la{King, Ada}"


def test_repair_drops_what_stays_incomplete(spark):
    flagged = spark.createDataFrame([(1, "la{x}", "Ada", "King", [("D", "e")]), (2, "la{y}", "Bo", "Li", [])], "line_no long, line string, given string, family string, flags array<struct<detector:string,evidence:string>>")
    records = repair.repaired(answers(spark, ("audit", "1", 0, call("fix", given="Ada", family="Byron")), ("audit", "2", 0, call("clean"))), flagged)
    got = {r["line_no"]: r for r in records.collect()}
    assert (got[1]["outcome"], got[1]["drop_reason"], got[1]["new_line"]) == ("dropped", "transliteration_incomplete", None)
    assert got[2]["outcome"] == "clean" and got[2]["warnings"] == []
    corpus = rows_of(spark, ["la{0}", "la{x}", "la{y}"])
    assert [r["line"] for r in repair.repaired_corpus(corpus, records).orderBy("line_no").collect()] == ["la{0}", "la{y}"]
    assert '"d":"D"' in repair.dry_run(flagged).where("line_no = 1").first()["line"]


def test_a_service_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def answer(stage, key, attempt, prompt):
        with open(log, "a") as out:
            out.write(f"{stage} {key} {attempt}\n")
        return '[{"name": "not_a_person_name", "arguments": {}}]' if attempt and "one tool call" in prompt else "junk"

    rows = spark.createDataFrame([("a",), ("b",)], "key string")
    out = stages.extracted(stages.Service(answer), rows)
    assert {r["outcome"] for r in out.collect()} == {"not_a_person_name"} and out.count() == 2
    assert sorted(open(log).read().split("\n"))[1:] == [f"extract {k} {n}" for k in "ab" for n in (0, 1)]


def test_tools_name_their_tags():
    tool = prompts.script_tool(("cy", "jp", "th"))["function"]["parameters"]
    assert tool["required"] == ["cy", "jp", "th"] and set(tool["properties"]) == {"cy", "jp", "th", "jp_kana", "cy_alt", "jp_alt"}


def test_a_call_is_taken_out_of_an_answer_once(spark):
    asks = spark.createDataFrame([("transcribe", "k", "x", ["cy"])], "stage string, key string, label string, tags array<string>")
    told = transliteration.answered(answers(spark, ("transcribe", "k", 0, "none")), asks, 0)
    plan = told._jdf.queryExecution().optimizedPlan().treeString().replace(" ", "")
    assert 0 < plan.count("regexp_extract_all") <= 4


def test_answers_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    said = call("emit_alt_latin", alts="a, b")
    keys = spark.range(400).select(F.col("id").cast("string").alias("key"))
    keys.select(F.lit("alternatives").alias("stage"), "key", F.lit(0).alias("attempt"), F.lit(said).alias("raw_text")).coalesce(1).write.parquet(str(tmp_path / "one"))
    client = stages.Responses(spark.read.parquet(str(tmp_path / "one")))
    out = stages.attempted(client, keys, "alternatives", toolcalls.alternative_spellings)
    assert out.where("result[0] = 'a, b'").count() == 400
    assert len(out.inputFiles()) > 1


def test_second_forms_of_a_call_are_read(spark):
    asks = spark.createDataFrame([("transcribe", "k", "x", ["cy"])], "stage string, key string, label string, tags array<string>")
    told = transliteration.answered(answers(spark, ("transcribe", "k", 0, call("emit_scripts", cy="Иван", cy_alt='["Иоанн", "Ваня", "Ян"]'))), asks, 0)
    assert told.first()["found"] == {"cy": ["Иван", "Иоанн", "Ваня"]}


def test_checksum_of_more_pieces_than_a_million(spark):
    n = (1 << 20) + 7
    rows = spark.range(n).select(F.concat(F.lit("é"), F.col("id") % 1000).alias("piece"), "id")
    ordered = sorted((f"é{k % 1000}", k) for k in range(n))
    assert [r["checksum"] for r in tokens.vocabulary_checksum(rows).collect()] == [hashlib.md5("".join(f"{p}{k}" for p, k in ordered).encode()).hexdigest()]
    assert tokens.vocabulary_checksum(rows.where("false")).first()["checksum"] == hashlib.md5(b"").hexdigest()
