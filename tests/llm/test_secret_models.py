"""The secret scan: base spans against a plain search, planted strings, levels that wrong labels don't move."""

import random
import re
import string

import pytest

from moniker.llm import secrets, shared

WORDS = ["".join(random.Random(k).choices(["ka", "lo", "mi", "ter", "en", "sch", "ung", "ation", "pre", "con", "s"], k=2 + k % 4)) for k in range(1500)]


@pytest.fixture(scope="module")
def detector():
    return secrets.Detector(secrets.random_strings(6000), secrets.identifiers(WORDS))


def plain_base(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    for pattern, least, kind in ((r"AKIA[A-Z0-9]+", 16, "access"), (r"[0-9a-f]+", 32, "hex")):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_base_spans_are_the_plain_ones(detector):
    rng = random.Random(4)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", ": ", "=", "'", '"', " ", "  ", "AKIA", "ABCDEFGHIJKL", "abcdefgh", "0123456789abcdef", "x.y-z/+=", "\n", "é", "日本"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        spans = detector.spans(text)
        assert [s for s in spans if s[2] != "random"] == plain_base(text)
        base = plain_base(text)
        assert not any(a < d and c < b for a, b, k in spans if k == "random" for c, d, _ in base)


def test_planted_strings_are_found_and_ordinary_tokens_are_not(detector):
    rng = random.Random(8)
    planted = ["".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(16, 40))) for _ in range(600)]
    letters = ["".join(rng.choices(string.ascii_letters, k=rng.randint(16, 40))) for _ in range(600)]
    found = lambda tokens: sum(any(k == "random" for _, _, k in detector.spans(f"see {t} there")) for t in tokens) / len(tokens)
    assert found(planted) >= 0.99 and found(letters) >= 0.97
    assert found([t for t in secrets.identifiers(WORDS, seed=77) if len(t) >= 16]) <= 0.002


def test_wrong_labels_do_not_close_the_detector(detector):
    ordinary = secrets.identifiers(WORDS)
    wrong = secrets.Detector(secrets.random_strings(6000), ordinary + secrets.random_strings(4, seed=5))
    assert abs(wrong.threshold - detector.threshold) < 0.5


def test_a_cluster_must_name_its_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert shared.shared_dir(Session(spark_master="local[2]")) == shared.FALLBACK_DIR
    assert shared.shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="s3://b/c/")) == "s3://b/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session(spark_master="yarn"))
