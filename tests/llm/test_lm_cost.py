"""Scoring looks up equal contexts once, and gives each run the bits that it has alone."""

import numpy as np
import pyarrow as pa

from moniker.llm import lm_scoring


def mixer_of(texts):
    code, word, _ = lm_scoring._runs(texts)
    one, _, times = lm_scoring.distinct(code, word)
    key, n = lm_scoring._summed(*([x] for x in lm_scoring.count_halves(code[one], word[one], times)))
    row = key >> np.uint64(4)
    mixer = lm_scoring.Mixer([(key, n)], int((np.diff(row, prepend=~row[:1]) != 0).sum()))
    mixer.settle(mixer.learned([(code[one], word[one], times)]))
    return mixer


def test_equal_contexts_are_looked_up_once_and_bits_stay(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdé"), size=3)) for _ in range(60)]
    texts = pa.array([" ".join(rng.choice(words, size=200)) for _ in range(20)] + ["", "x", "\x00ÿ"])
    mixer = mixer_of(texts)
    code, word, _ = lm_scoring._runs(texts)
    one, _, _ = lm_scoring.distinct(code, word)
    code, word = code[one], word[one]
    code, word = np.append(code, code[:40] ^ np.uint64(0x11)), np.append(word, word[:40] + np.uint64(1 << 32))
    asked, slot = [], lm_scoring.Mixer.slot
    monkeypatch.setattr(lm_scoring.Mixer, "slot", lambda self, key: asked.append(len(key)) or slot(self, key))
    got = mixer.cost(code, word)
    assert sum(asked) < 0.7 * 2 * lm_scoring.CONTEXTS * len(code)
    alone = np.array([mixer.cost(code[k : k + 1], word[k : k + 1])[0] for k in range(len(code))])
    assert np.allclose(got, alone, rtol=1e-6)
    assert len(mixer.cost(code[:0], word[:0])) == 0
