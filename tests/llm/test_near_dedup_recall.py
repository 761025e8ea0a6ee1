"""The near-dedup stage against all pairs, by length of text."""

import random

import pytest

from brute import components, documents, words
from moniker.llm import simhash


def sets_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("length,vocabulary", [(80, 3000), (300, 3000), (1500, 3000), (1500, 60000)])
def test_pairs_of_the_stated_similarity_are_found(spark, length, vocabulary):
    rng = random.Random(length + vocabulary)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(vocabulary)]
    texts = []
    for k in range(120):
        base = [vocab[min(int(rng.paretovariate(0.6)) - 1, vocabulary - 1)] for _ in range(length)]
        other = list(base)
        for at in rng.sample(range(length), max(1, int(length * (0.004 + 0.02 * k / 120)))):
            other[at] = rng.choice(vocab)
        texts += [" ".join(base), " ".join(other)]
    sets = [sets_of(t) for t in texts]
    near = [(a, a + 1) for a in range(0, len(texts), 2) if len(c := sets[a] & sets[a + 1]) >= 0.8 * (len(sets[a]) + len(sets[a + 1]) - len(c))]
    wanted = set(components(near, range(len(texts))).values())
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert wanted <= kept  # nothing goes that is no near-duplicate
    assert len(near) > 40 and 1 - len(kept - wanted) / len(near) >= 0.9


def test_short_texts_are_compared_whole(spark):
    texts = ["a b c", "a b c", "a b d", "A  b C", "x", "x y", "one two three four five", "one two three four six"]
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert kept == {0, 2, 4, 5, 6, 7}
