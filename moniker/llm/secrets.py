"""Secret scans: fixed patterns, and Markov models of characters for random strings that no pattern names.

Two models of second order, one of random strings and one of ordinary identifiers, are fitted to labelled samples.
A token whose log-likelihood ratio per character is above a calibrated threshold is reported.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table, text_key

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: Tokens that the models judge: the shortest strings labelled random have as many characters.
LEAST_CHARS = 16
_TOKEN = re.compile(rf"(?=([A-Za-z0-9+/_-]{{{LEAST_CHARS},}}={{0,2}}))\1")

_ALPHABET = string.ascii_letters + string.digits + "+/_-="
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}  # 0 stands before a token
#: Random strings generated, and documents and words of each that ordinary identifiers come from.
RANDOM_STRINGS = 20_000
SAMPLE_DOCS = 2_000
SAMPLE_WORDS = 100
#: Nats per character that the threshold has at least, and the share of held-out samples that may lie beyond the level of their label.
LEAST = 0.5
BEYOND = 0.001


class Markov:
    """Second-order character model, interpolated down to single characters."""

    def __init__(self, tokens: list[str], weight: float = 4.0):
        size = len(_ALPHABET) + 1
        one, two, three = np.zeros(size), np.zeros((size, size)), np.zeros((size, size, size))
        for a, b, c in (_coded(t) for t in tokens):
            np.add.at(one, c, 1)
            np.add.at(two, (b, c), 1)
            np.add.at(three, (a, b, c), 1)
        p = (one + 1) / (one.sum() + size)
        p = (two + weight * p) / (two.sum(1, keepdims=True) + weight)
        self.logp = np.log((three + weight * p[None]) / (three.sum(2, keepdims=True) + weight))

    def score(self, token: str) -> float:
        a, b, c = _coded(token)
        return float(self.logp[a, b, c].sum())


def _coded(token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.array([0, 0, *(_CODE[c] for c in token)])
    return code[:-2], code[1:-1], code[2:]


class Detector:
    """Log-likelihood ratio per character with its threshold."""

    def __init__(self, random_strings: list[str], ordinary: list[str]):
        self.random, self.ordinary = Markov(random_strings[::2]), Markov(ordinary[::2] or ["a"])
        # halfway between the labels' held-out samples; a few wrongly labelled ones move neither level
        low, high = self._level(ordinary[1::2], 1 - BEYOND), self._level(random_strings[1::2], BEYOND)
        self.threshold = LEAST if low is None or high is None else max(LEAST, (low + high) / 2)

    def _level(self, tokens: list[str], share: float) -> float | None:
        ratios = [self.ratio(t) for t in tokens if len(t) >= LEAST_CHARS]
        return float(np.quantile(ratios, share)) if ratios else None

    def ratio(self, token: str) -> float:
        return (self.random.score(token) - self.ordinary.score(token)) / len(token)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans (start, end, kind), code points, by start and kind as listed."""
        out = []
        if _NAMES.search(text):
            out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
        base = sorted((a, b) for a, b, _ in out)
        starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        for m in _TOKEN.finditer(text):
            before = bisect_left(starts, m.end(1))
            if before and ends[before - 1] > m.start(1):  # within a span of a pattern
                continue
            if self.ratio(m[1]) > self.threshold:
                out.append((m.start(1), m.end(1), "random"))
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def random_strings(n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Samples labelled random: strings over the alphabets that keys and tokens use."""
    rng = random.Random(seed)
    alphabets = (string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-")
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))) for _ in range(n)]


def identifiers(words: list[str], seed: int = 7) -> list[str]:
    """Samples labelled ordinary: words, and the names, paths and slugs that are made of words and numbers."""
    rng = random.Random(seed)
    words = sorted({w for w in words if w})
    out = list(words)
    for _ in range(len(words) and 20_000):
        some = [rng.choice(words) for _ in range(rng.randint(2, 6))]
        number = str(rng.randrange(10 ** rng.randint(1, 8)))
        some.insert(rng.randint(1, len(some)), number)
        style = rng.randrange(4)
        out.append("".join(w.capitalize() for w in some) if style == 3 else "_-/"[style].join(some))
    rng.shuffle(out)
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Detector:
    """A detector whose ordinary words come from about ``sample_docs`` documents, chosen by a hash of their text.

    At most ``sample_words`` distinct words of letters of each are taken, the least by hash.
    """
    usable = docs.select("text").where("text is not null")
    share = min(1.0, sample_docs / max(1, usable.count()))
    sample = usable.where(F.pmod(text_key(), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))

    def run(batches):
        for whole in batches:
            for batch in tk.slices(whole):
                for text in batch.column("text").to_pylist():
                    words = np.array(sorted(set(re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,40}(?![A-Za-z0-9+/_=-])", text))), object)
                    if len(words):
                        h = tk.hashes(tk.words(pa.array(words, pa.string())))
                        words = words[np.argsort(h)[:sample_words]]
                        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    words = [r["word"] for r in sample.mapInArrow(run, "word string").distinct().collect()]
    return Detector(random_strings(), identifiers(words))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with ``secrets``: kind, start and end (code points, end exclusive) of every span, by start, then kind.

    The kinds by pattern are leftmost and don't overlap within a kind; ``random`` spans come from the models and overlap
    no other. Null text counts as empty. Repeated rows get equal spans; a column named ``secrets`` is replaced.
    """
    docs = docs.drop("secrets")
    kept = docs.columns
    schema = docs.select("*", F.lit(None).cast(SPANS).alias("secrets")).schema
    handle = docs.sparkSession.sparkContext.broadcast(detector)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        own = handle.value
        for whole in batches:
            for batch in tk.slices(whole):
                spans = [[{"kind": k, "start": a, "end": b} for a, b, k in own.spans(t or "")] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*kept, "secrets"])

    return docs.mapInArrow(run, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs)).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
