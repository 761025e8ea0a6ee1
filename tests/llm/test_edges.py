"""Nulls in any column, empty tables, repeated rows, long texts, clashing columns: every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import corpus, documents
from moniker.llm import ann, decontamination, language, line_dedup, lm_scoring, mixing, secrets, simhash, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, score double"


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows of nulls, repeated rows, ties, an empty and a very long text."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(60_000))
    rows = [(None,) * 8, (None,) * 8, (1, None, "en", None, 0, 1, "k", None), (2, "", None, "s", None, None, None, 1.0), (3, "same text\nand line", "en", "s", 1, 1, "a", 1.0)] * 2
    rows += [(None, "same text\nand line", "en", "s", 1, 1, "a", 1.0), (4, long, "en", "s", 1, 1, "a", 1.0), (5, "x", "en", "t", 1, 1, "a", 1.0), (3, "other text", "fr", "t", 1, 1, "a", 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "same text"), (None, "x"), (2, None), (3, ""), (1, "same text"), (4, "a b c")], "item_id long, text string")


def operators(benchmark):
    return {
        "line_dedup": line_dedup.dedup_lines,
        "substring": lambda d: substring_dedup.remove_repeats(d, 2),
        "secrets": lambda d: secrets.scan(d, secrets.Detector(secrets.random_strings(500), ["word", "other"])),
        "language": lambda d: language.predict(d, language.fit(d, F.lit(True), 10)),
        "language_stage": lambda d: language.keep_identified(d, 10),
        "lm": lambda d: lm_scoring.score(d, F.col("doc_id") < 5, 4),
        "simhash": simhash.near_duplicates,
        "simhash_stage": simhash.keep_one,
        "mixing": mixing.mix,
        "decontamination": lambda d: decontamination.contamination(d, benchmark),
        "decontamination_stage": lambda d: decontamination.remove_contaminated(d, benchmark),
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_awkward_rows(spark, awkward, benchmark, name):
    out = operators(benchmark)[name](awkward)
    n = out.count()
    assert n == awkward.count() if "stage" not in name else n <= awkward.count()
    assert len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", list(operators(None)))
def test_empty_table(spark, benchmark, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert operators(benchmark.limit(0))[name](empty).count() == 0


def test_empty_benchmark_finds_nothing(spark, awkward, benchmark):
    out = decontamination.contamination(awkward, benchmark.limit(0))
    assert out.agg(F.sum("n_hit")).first()[0] == 0


def test_urls(spark):
    rows = [(None, None, "a"), (1, "", "b"), (2, "no scheme", "c"), (3, "http://", "d"), (4, "http://" + "a" * 50_000 + ".com/fr/x", "e"), (4, "http://x.com/fr/", "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = [tuple(r) for r in url_filter.judge(pages, url_filter.RULES).collect()]
    assert got[0] == (None, "", "", None, "allow") and got[2][1:3] == ("", "") and got[4][3] == "com/fr/"
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], ["**"]).collect()} == {"block"}
    hosts = spark.createDataFrame([(1, "http://community.net/a"), (2, "http://a.com"), (3, "http://com/x")], "page_id long, url string")
    got = url_filter.judge(hosts, [url_filter.Rule("block", "com", "")], []).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["allow", "block", "block"]


def test_vectors(spark):
    rows = [(k, [float(k % 3), 1.0, float(k), 0.5], 1) for k in range(40)]
    rows += [(100, None, 1), (120, [0.0] * 4, 1), (140, [1.0, None, 1.0, 1.0], 1), (160, [float("nan"), 1.0, 1.0, 1.0], 1), (180, [1.0, 2.0], 1), (None, [1.0] * 4, 1), (39, [0.0, 1.0, 39.0, 0.5], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 20}
    best = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 20)
    assert best[:3] == [(1, 39), (2, 39), (3, 38)] and len(best) == 20
    assert ann.nearest_neighbours(vectors.limit(0), F.lit(True)).count() == 0
    few = ann.nearest_neighbours(vectors.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6


def test_pipeline_stages_keep_columns_and_clean_documents(spark, benchmark, tmp_path):
    docs = documents(spark, corpus(3, 60))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.count() <= docs.count()
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and out["doc_id"].is_unique and (out["taken"] == out["copies"] * out["size"]).all()
    again = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_copies_that_line_dedup_empties_are_one_group(spark, tmp_path):
    rng = random.Random(9)
    text = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) for _ in range(2))
    docs = documents(spark, [text, text, None, text, "another text", " \n"])
    lines = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert lines.count() == 6 and lines.where(r"not coalesce(text, '') rlike '\\S'").count() == 4
    kept = corpus_pipeline.drop_near_duplicates(spark, lines, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4]
