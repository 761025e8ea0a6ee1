"""Rejection by the language models, and the hash arrays against the models that they come from."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moniker.llm import language
from test_operators import language_texts

SCHEMA = "doc_id long, text string, lang string"


def junk(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


def test_hash_arrays_hold_what_the_models_say():
    counts = {}
    for lang in ("a", "b"):
        rng = np.random.default_rng(len(counts))
        symbols = rng.choice([0, 97, 98, 99, 100], 3000, p=[0.2, 0.3, 0.3, 0.1, 0.1]).astype(np.uint16)
        counts[lang] = np.unique(language.codes(symbols), return_counts=True)
    model = language.Model.fit(counts)
    letters = len(set().union(*(np.unique(language._low(g, 1)).tolist() for g, _ in counts.values())))
    plain = [language.KneserNey(*counts[s], letters) for s in model.names]
    rng = np.random.default_rng(9)
    asked = language.codes(rng.choice([0, 97, 98, 99, 100, 120, 121], 2000).astype(np.uint16))
    assert np.allclose(model.logp(asked), np.stack([p.logp(asked) for p in plain], 1), atol=1e-4)


@pytest.mark.parametrize("labelled", [False, True])
def test_letters_without_order_go_and_clean_texts_stay(spark, labelled):
    clean = language_texts(1, 600)
    langs = sorted({r[2] for r in clean})
    noise = [(10_000 + k, junk(k), langs[k % len(langs)] if labelled else None) for k in range(60)]
    docs = spark.createDataFrame(clean + noise, SCHEMA).repartition(4)
    kept = {r["doc_id"] for r in language.keep_identified(docs).collect()}
    assert sum(k < 10_000 for k in kept) >= 0.995 * len(clean)
    assert sum(k >= 10_000 for k in kept) <= 3


def test_without_labels_every_document_stays(spark):
    rows = [(k, t, None) for k, t, _ in language_texts(2, 30)] + [(99, None, None), (100, "12 3", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["doc_id"] for r in language.keep_identified(docs).collect()) == sorted(r[0] for r in rows)


def test_prediction_agrees_with_plain_cross_entropy(spark):
    rows = language_texts(5, 120)
    model = language.fit(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    texts = [t for _, t, _ in language_texts(6, 40)]
    best, score, rejected = model.predict(pa.array(texts))
    for k, text in enumerate(texts):
        folded, _ = language.letters(pa.array([text]))
        sums = model.logp(language.codes(folded)).astype(float).sum(0)
        assert best[k] == sums.argmax() and 0 < score[k] <= 1 and not rejected[k]
