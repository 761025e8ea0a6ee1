"""Ranking, evaluation, tokenizer, corruption, batching, stages, feeds."""

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moniker.functions import ids
from moniker.operators import batching, evaluation, letters, scoring, stages, tokens
from moniker.streaming import feed


def test_ranked_margins(spark):
    rng = random.Random(3)
    rows = [(q, f"n{k}", k, rng.randint(0, 5) / 2) for q in range(6) for k in range(q + 1)]
    df = spark.createDataFrame(rows, "id int, name string, place int, score double")
    got = {(r["id"], r["name"]): r for r in scoring.ranked(df, "place").collect()}
    for q, name, place, score in rows:
        own = sorted((s, p) for i, _, p, s in rows if i == q)
        others = [s for i, n, _, s in rows if i == q and n != name]
        r = got[q, name]
        assert r["rank"] == own.index((score, place)) + 1
        assert r["margin"] is None if not others else math.isclose(r["margin"], median(others) - score)


def test_posterior_stats(spark):
    df = spark.createDataFrame([([0.0, 1.0, -1.0, 2.0], [0.0, math.log(3.0), math.log(10.0), math.log(2.0)])], "mean array<double>, logvar array<double>")
    r = scoring.posterior_stats(df).first()
    assert r["var_p50"] == pytest.approx(2.0) and r["var_p90"] == pytest.approx(7.9) and r["dims_over_prior"] == pytest.approx(3 / 4)
    assert r["kl_mean"] == pytest.approx(r["kl_sum"] / 4)


def test_weighted_loss_and_selectivity(spark):
    b = spark.createDataFrame([(2.0, 0.5, 10, 1), (4.0, 1.0, 10, 1)], "ce double, kl double, n_tok int, n_cl int")
    assert tuple(evaluation.weighted_loss(b).first()) == (3.0, 0.75)
    assert math.isnan(evaluation.weighted_loss(b.limit(0)).first()["val_ce"])
    rows = spark.createDataFrame([(0.0, float(k)) for k in range(1, 11)], "own double, other double")
    r = evaluation.selectivity(rows).first()
    assert (r["margin_p10"], r["margin_p50"], r["margin_p90"], r["positive"]) == (2.0, 6.0, 10.0, 1.0)


def test_decode_diversity(spark):
    rows = spark.createDataFrame([(1, t) for t in "aabc"] + [(2, "x")] * 3, "cluster int, text string")
    got = {r["cluster"]: r["normalized_entropy"] for r in evaluation.decode_diversity(rows).collect()}
    assert got[2] == 0.0 and got[1] == pytest.approx(-(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25)) / math.log(4))


def test_cross_scores_cover_all_pairs(spark):
    rows = [(f"k{k}", [("la", f"name {k}"), ("cy", "имя")]) for k in range(4)]
    c = spark.createDataFrame(rows, "key string, surfaces array<struct<tag:string,text:string>>")
    got = scoring.cross_scored(c, c, scoring.TrigramScorer(), (True, False))
    assert got.count() == 4 * 4 * 2
    assert got.where("id = candidate").agg(F.max("nll_tok")).first()[0] <= got.where("id <> candidate").agg(F.max("nll_tok")).first()[0]


def test_bpe_round_trip(spark):
    texts = ["low lower lowest", "newer  wider ", "été é 日本 \U0001f600", "", "a-[la]b"] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, t string")
    vocabulary = tokens.train(df, "t", 300)
    assert len(vocabulary.pieces) == 300
    out = tokens.decoded(tokens.encoded(df, "key", "t", vocabulary), vocabulary).collect()
    assert {r["key"]: r["decoded"] for r in out} == dict(enumerate(texts))
    assert vocabulary.id_of("nothing") == vocabulary.id_of("[unk]")
    assert vocabulary.encode_chunk("low") == [vocabulary.ids["low"]]


def test_chunks(spark):
    df = spark.createDataFrame([("it's  a b 12!",)], "t string")
    assert df.select(tokens.chunks(F.col("t"))).first()[0] == ["it", "'s", " ", " a", " ", "b", " 12", "!"]


def test_corruption(spark):
    def run(rows, rate, frequency=None, weight=0.7):
        df = spark.createDataFrame([(str(k), t, v) for k, (t, v) in enumerate(rows)], "key string, tag string, value string")
        return [r["corrupted"] for r in letters.corrupted(df, 1, rate, frequency, weight).orderBy(F.col("key").cast("int")).collect()]

    latin = {"la": {"a": 1.0, "b": 3.0, "c": 0.0}}
    assert run([("cn", "王小明"), ("xx", "abc"), ("la", None), ("la", ""), ("la", "12 -")], 1.0, latin) == ["王小明", "abc", None, "", "12 -"]
    assert run([("la", "abc")], 0.0, latin) == ["abc"]
    assert all(len(x) == 1 for x in run([("la", "a")] * 200, 1.0, latin))
    assert all(set(x) <= set("ab") for x in run([("la", "defh")] * 50, 1.0, latin))
    many = run([("la", "aeuvwxcdfh")] * 2000, 0.2)
    assert 0.08 < sum(10 - len(x) for x in many) / 20000 < 0.12 and many == run([("la", "aeuvwxcdfh")] * 2000, 0.2)
    alone = run([("la", "w")] * 2000, 1.0, latin)
    assert 0.2 < alone.count("a") / 2000 < 0.3 and alone.count("a") + alone.count("b") == 2000
    seen = set(run([("la", "o")] * 300, 1.0, None, 1.0))
    assert seen == set(letters.confusion()["la"]["o"])
    assert letters.classes(["ab", "bc", "xy"]) == {"a": "bc", "b": "ac", "c": "ab", "x": "y", "y": "x"}
    with pytest.raises(ValueError, match="0 to 1"):
        run([("la", "a")], 2.0)


def test_draws_keep_their_number(spark):
    shapes = [["la"], ["cy", "gk"], ["la", "cy", "gk", "ab", "la", "hb", "th"], ["la"] * 9, []]
    rows = [(k, str(k), shapes[k % 5]) for k in range(400)]
    df = spark.createDataFrame(rows, "idx long, key string, tags array<string>")
    got = batching.collated(df, 3, 3, 2, 1).collect()
    assert got == batching.collated(df, 3, 3, 2, 1).collect()
    for r in got:
        tags, inputs, targets = r["tags"], r["input_places"], r["target_places"]
        if not tags:
            assert inputs == targets == r["primed"] == []
            continue
        assert len(targets) == len(r["primed"]) == 3 and 1 <= len(inputs) <= 3 and len(set(inputs)) == len(inputs)
        assert all(0 <= x < len(tags) for x in inputs + targets)
        if len(tags) == 9:
            assert not set(inputs) & set(targets) and len(set(targets)) == 3
        if len(tags) == 7:  # four cells are no candidates; the targets are three of them
            assert len(set(targets)) == 3 and not set(inputs) & set(targets)
    assert {len(r["input_places"]) for r in got if len(r["tags"]) == 9} == {1, 2, 3}
    assert 0.4 < sum(sum(r["primed"]) for r in got) / sum(len(r["primed"]) for r in got) < 0.6


def test_stages_retry_then_give_up(spark):
    call = "<tool_call><function=extract_name><parameter=given>Ada</parameter><parameter=family>King</parameter></function></tool_call>"
    table = [("extract", "a", 0, "junk"), ("extract", "a", 1, call), ("extract", "b", 0, "junk"), ("extract", "c", 0, '[{"name": "not_a_person_name", "arguments": {}}]')]
    responses = stages.Responses(spark.createDataFrame(table, "stage string, key string, attempt int, raw_text string"))
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    got = {r["key"]: (r["outcome"], r["variants"]) for r in stages.extracted(responses, rows).collect()}
    assert got["a"][0] == "extract_name" and "Ada King" in got["a"][1]
    assert [got[k][0] for k in "bcd"] == ["malformed", "not_a_person_name", "malformed"]


def test_audit_outcomes(spark):
    def call(verdict, given="", family=""):
        return f"<tool_call><function={verdict}><parameter=given>{given}</parameter><parameter=family>{family}</parameter></function></tool_call>"

    texts = {"a": call("clean"), "b": call("fix", "Ada", "Byron"), "c": call("fix", "ada", "KING"), "d": call("unrecoverable"), "e": call("fix", "A", "Byron")}
    responses = stages.Responses(spark.createDataFrame([("audit", k, 0, t) for k, t in texts.items()], "stage string, key string, attempt int, raw_text string"))
    rows = spark.createDataFrame([(k, "Ada", "King") for k in "abcdef"], "key string, given string, family string")
    got = {r["key"]: r["outcome"] for r in stages.audited(responses, rows).collect()}
    assert got == {"a": "clean", "b": "fixed", "c": "clean", "d": "dropped", "e": "dropped", "f": "dropped"}


def test_transliterations_merge_and_fit(spark):
    def call(**args):
        return "<tool_call><function=emit_scripts>" + "".join(f"<parameter={k}>{v}</parameter>" for k, v in args.items()) + "</function></tool_call>"

    rows = [("transliterate_a", "k", 0, call(cy="Ада Кинг", gk="abc")), ("transliterate_b", "k", 0, call(jp="アダ", jp_kana="あだ")), ("transliterate_c", "k", 1, call(cy="Ада Кинг", hb="עדה"))]
    responses = stages.Responses(spark.createDataFrame(rows, "stage string, key string, attempt int, raw_text string"))
    got = stages.transliterated(responses, spark.createDataFrame([("k",)], "key string")).first()["forms"]
    assert "Кинг Ада" in got["cy"] and "gk" not in got and got["jp"] == ["アダ", "あだ"] and got["hb"] == ["עדה"]


def test_feed_resumes(spark):
    shards = [f"s{k}" for k in range(5)]
    whole = list(feed.feed(shards, 7))
    assert sorted(whole) == shards and list(feed.feed(shards, 7, done=2)) == whole[2:]
    again = feed.feed(shards, 7, endless=True)
    assert [next(again) for _ in range(10)] == whole * 2
    p = feed.Progress(5, 4, 7)
    p.advance(28)
    assert p.state() == {"seed": 7, "processed_epochs": 1, "processed_samples": 8} and p.shards == 2
    q = feed.Progress(5, 4, 7)
    q.restore(p.state())
    assert q.state() == p.state()
    with pytest.raises(ValueError, match="seed"):
        q.restore({"seed": 8})
    with pytest.raises(ValueError, match="whole number"):
        q.restore({"seed": 7, "processed_epochs": 0, "processed_samples": 3})


def test_waves_go_on_after_a_restart(spark, tmp_path):
    schema = T.StructType([T.StructField("line_no", T.LongType())])
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(0, 6).withColumnRenamed("id", "line_no").repartition(2).write.parquet(source)
    work = lambda rows: rows.withColumn("outcome", F.lit("x"))
    feed.run_waves(feed.stream_records(spark, source, schema), work, out, mark)
    spark.range(6, 9).withColumnRenamed("id", "line_no").write.mode("append").parquet(source)
    feed.run_waves(feed.stream_records(spark, source, schema), work, out, mark)
    got = feed.latest(spark.read.parquet(out))
    assert sorted(r["line_no"] for r in got.collect()) == list(range(9)) and spark.read.parquet(out).count() == 9


def test_ids():
    a, b = ids.spec("1", {"d": 3, "a": True}, {"c": 2}), ids.layout("1", {"w": (3, 4), "b": (3,)})
    assert a == "1\nF a=True\nF d=3\nC c=2" and b == "1\nS b=3\nS w=3,4"
    now = ids.config_id(a, b)
    assert len(now) == 7 and not set(now) & set("ILOU") and ids.mismatch(now, now) is None
    assert ids.mismatch("000" + now[3:], now) in ("wiring", None) and ids.mismatch("x", now) == "malformed"


def test_sampling(spark):
    import numpy as np

    from moniker.operators import sampling

    rng = np.random.default_rng(1)
    logits = np.log([0.5, 0.3, 0.15, 0.05])
    assert sampling.draw_token(logits, 0, None, rng) == 0
    drawn = [sampling.draw_token(logits, 1.0, 0.6, rng) for _ in range(4000)]
    assert set(drawn) == {0, 1} and abs(drawn.count(0) / 4000 - 0.5 / 0.8) < 0.03
    df = spark.createDataFrame([("a", [0.0, 1.0], [0.0, 0.0])], "cluster string, mean array<double>, logvar array<double>")
    step = lambda z, ids: np.array([z[0], z[1], float(len(ids))])
    out = [tuple(r["ids"]) for r in sampling.decodes(df, step, 2, 5, 3).orderBy("sample").collect()]
    assert out == [tuple(r["ids"]) for r in sampling.decodes(df, step, 2, 5, 3).orderBy("sample").collect()] and len(out) == 5


def test_sweeps(spark, tmp_path):
    from moniker.operators import sweeps

    assert sweeps.parse_combos("lr=1e-3, b=2; lr=5", ("lr", "b")) == [{"lr": 1e-3, "b": 2.0}, {"lr": 5.0}]
    with pytest.raises(ValueError, match="unknown"):
        sweeps.parse_combos("x=1", ("lr",))
    assert sweeps.combo_name({"lr": 5e-4, "b": 128.0}) == "b128-lr0.0005" and len(sweeps.grid(a=[1, 2], b=[3])) == 2
    base = {"m": {"a": 1}}
    assert sweeps.overlay(base, {"m.a": 2, "n.b": 3}) == {"m": {"a": 2}, "n": {"b": 3}} and base == {"m": {"a": 1}}
    assert sweeps.slug("a b/c") == "a_b_c" and sweeps.sibling("/d/x.txt.gz", "fixed") == "/d/x.fixed.txt.gz"
    (tmp_path / "m.csv").write_text("epoch,val_loss,train_loss\n0,2.5,\n0,,3.0\n1,2.0,\n1,,2.5\n", encoding="utf-8")
    r = evaluation.final_metrics(sweeps.read_history(spark, str(tmp_path / "m.csv"), "r")).first()
    assert (r["last_val_loss"], r["best_val_loss"], r["last_train_loss"], r["n_val"]) == (2.0, 2.0, 2.5, 2)


def test_contaminants(spark):
    from moniker.functions.contaminants import is_contaminant

    rows = [("Wei Zhang", "张伟", False), ("Li Na", "张伟", True), ("José María García-López", "何塞·玛丽亚·加西亚-洛佩斯", False), ("Yuki Abe", "田中雪", False), ("Ada King", "田中雪x", True), ("Ada King", "エイダ", False)]
    df = spark.createDataFrame(rows, "label string, value string, wanted boolean")
    assert df.where(is_contaminant(F.col("label"), F.col("value")) != F.col("wanted")).count() == 0


def test_a_panel_is_scored_where_the_query_is(spark):
    kind = "key string, surfaces array<struct<tag:string,text:string>>"
    texts = {"a": ["Ada King"], "b": ["Bo Li", "Li Bo"], "none": []}
    own = spark.createDataFrame([(k, [("la", x) for x in of]) for k, of in texts.items()], kind)
    panel = spark.createDataFrame([("p", [("la", "Ada"), ("cy", "Ада Кинг")]), ("q", [("la", "Bo Li")])], kind)
    scorer = scoring.TrigramScorer()
    out = scoring.cross_scored(own, panel, scorer, (True, False))
    got = {(r["id"], r["candidate"], r["primed"]): r["nll_tok"] for r in out.collect()}
    means = {k: np.asarray(scorer.encode([("la", x) for x in of])[0]) for k, of in texts.items() if of}
    cost = lambda k, forms: np.mean([np.mean(scorer.nll(means[k], None, x)) for x in forms])
    wanted = {(k, c, p): cost(k, forms) for k in means for c, forms in {"p": ["Ada", "Ада Кинг"], "q": ["Bo Li"]}.items() for p in (True, False)}
    assert got == pytest.approx(wanted)
    plan = out._jdf.queryExecution().optimizedPlan().treeString()
    assert "Join" not in plan and "Repartition" in plan
