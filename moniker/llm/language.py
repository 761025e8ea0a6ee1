"""Language identification with interpolated Kneser-Ney models of characters.

One model for each label, of ``ORDER`` characters. For each order one sorted array of n-gram hashes serves
all models: a row of it holds the n-gram's log-probability in each language, another array the contexts'
back-off weights. The language with the lowest cross-entropy per character wins.

Labels may be wrong, so fitting takes two turns: two halves of the sample judge each other's texts, those far from what
is usual of their label (by median and median deviation) are left out, and the models are fitted on the rest.
How far above a language's own level a text may lie is then calibrated, by a high quantile, on texts that the models have not seen.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table, text_key

ORDER = 4
#: Documents of each language that its model is fitted on, and one in so many of them calibrates.
SAMPLE_DOCS = 2000
CALIBRATE = 5
#: More labels than this are joined by shuffle.
BROADCAST_LABELS = 100_000
#: Deviations (by the median one) above the median of its label beyond which a text is not learned from.
OUTLYING = 8.0
#: A text is rejected beyond so many times this quantile of the calibrated excess, if it is also this part of the way from
#: its language's level to that of letters without order.
QUANTILE, SLACK = 0.99, 2.0
FAR = 0.75
#: Letters beyond which a longer text does not narrow the calibrated excess.
ENOUGH = 400
_BITS = 16  # of an n-gram's code for each character; 0 is a word boundary


@functools.cache
def _folded() -> np.ndarray:
    """For each code point the 16-bit code of its lower-case letter, 0 if it is no letter.

    Letters beyond the basic plane share the private-use codes.
    """
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            low = ord(low) if len(low) == 1 else c
            out[c] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return out


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all rows in one array, 0 where a run of others stands, and the row offsets.

    Every row begins with ORDER - 1 boundaries and ends with one.
    """
    raw, off = tk.buffers(column)
    text = raw.tobytes().decode("utf-8", "replace")
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    if len(text) != place[-1]:  # broken UTF-8: count row by row
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        text, place = "".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    folded = _folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = folded != 0
    starts = place[:-1][place[:-1] < len(folded)]
    after = np.concatenate([[False], keep[:-1]])
    after[starts] = False  # a leading run stands for itself in the padding
    keep |= after
    kept = np.concatenate([[0], np.cumsum(keep)])[place]
    # a row that ends with a letter lacks its closing boundary, so each gets one and a doubled one is cut below
    n = len(place) - 1
    sizes = np.diff(kept)
    last = np.zeros(n, bool)
    some = sizes > 0
    body = folded[keep]
    last[some] = body[kept[1:][some] - 1] != 0
    width = sizes + (ORDER - 1) + last
    offsets = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(offsets[-1], np.uint16)
    at = np.repeat(offsets[:-1] + (ORDER - 1) - kept[:-1], sizes) + np.arange(len(body))
    out[at] = body
    return out, offsets


def codes(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Code of the n-gram that ends at each position from ORDER - 1 on."""
    n = max(0, len(symbols) - ORDER + 1)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        at = ORDER - order + k
        out = (out << np.uint64(_BITS)) | symbols[at : at + n].astype(np.uint64)
    return out


def _low(code: np.ndarray, n: int) -> np.ndarray:
    return code & np.uint64((1 << (_BITS * n)) - 1)


class HashArray:
    """Hashes of n-gram codes in order, with the place where each run of leading bits begins."""

    def __init__(self, code: np.ndarray):
        hashed = tk.mix(code)
        self.order = np.argsort(hashed)
        self.keys = np.append(hashed[self.order], np.uint64(2**64 - 1))
        bits = max(1, int(len(code) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each code, and whether it is there."""
        hashed = tk.mix(code)
        at = self.begin[hashed >> self.shift]
        key = self.keys[at]
        behind = np.flatnonzero(key < hashed)
        while len(behind):
            at[behind] += 1
            key[behind] = self.keys[at[behind]]
            behind = behind[key[behind] < hashed[behind]]
        found = key == hashed
        np.minimum(at, len(self.keys) - 2, out=at)
        return at, found


class KneserNey:
    """One language: log-probabilities by recursion from the n-gram counts of the highest order."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, letters: int):
        self.uniform = -np.log(letters + 2)
        self.orders: list[tuple] = []
        for n in range(ORDER, 0, -1):
            order = np.argsort(gram)
            gram, count = gram[order], count[order].astype(float)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9)
            context, at = np.unique(gram >> np.uint64(_BITS), return_inverse=True)
            total, kinds = np.bincount(at, count), np.bincount(at)
            self.orders.append((n, gram, np.maximum(count - discount, 0) / total[at], context, np.log(discount * kinds / total)))
            gram, count = np.unique(_low(gram, n - 1), return_counts=True)
        self.orders.reverse()

    def backoff(self, context: np.ndarray, n: int) -> np.ndarray:
        _, _, _, known, weight = self.orders[n - 1]
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        return np.where(known[at] == context, weight[at], 0.0)

    def logp(self, gram: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.full(len(gram), self.uniform)
        _, known, share, _, _ = self.orders[n - 1]
        lower = self.backoff(gram >> np.uint64(_BITS), n) + self.logp(_low(gram, n - 1), n - 1)
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        return np.where(known[at] == gram, np.logaddexp(np.log(np.maximum(share[at], 1e-300)), lower), lower)


@dataclass
class Model:
    """All languages: for each order hashes in order, and a row of values for each."""

    names: list[str]
    grams: list[tuple[HashArray, np.ndarray]]  #: by order 1..ORDER
    contexts: list[tuple[HashArray, np.ndarray]]
    uniform: float
    level: np.ndarray | None = None  #: by language: usual cross-entropy of its own texts
    excess: np.ndarray | None = None  #: by language: how far a text may lie above that, times the root of its letters

    @staticmethod
    def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        names = sorted(counts)
        alphabet = set().union(*(np.unique(_low(g, 1)).tolist() for g, _ in counts.values()))
        fitted = [KneserNey(*counts[s], len(alphabet)) for s in names]
        grams, contexts = [], []
        for n in range(1, ORDER + 1):
            for out, parts, value in (
                (grams, [f.orders[n - 1][1] for f in fitted], lambda f, x, n=n: f.logp(x, n)),
                (contexts, [f.orders[n - 1][3] for f in fitted], lambda f, x, n=n: f.backoff(x, n)),
            ):
                every = np.unique(np.concatenate(parts))
                array = HashArray(every)
                out.append((array, np.stack([value(f, every) for f in fitted], 1)[array.order].astype(np.float32)))
        return Model(names, grams, contexts, fitted[0].uniform if fitted else 0.0)

    def logp(self, gram: np.ndarray, n: int = ORDER) -> np.ndarray:
        """A row of log-probabilities by language for each n-gram."""
        if n == 0:
            return np.full((len(gram), len(self.names)), self.uniform, np.float32)
        at, known = self.grams[n - 1][0].find(gram)
        out = self.grams[n - 1][1][at]
        missing = np.flatnonzero(~known)
        if len(missing):
            rest = gram[missing]
            at, known = self.contexts[n - 1][0].find(rest >> np.uint64(_BITS))
            out[missing] = self.logp(_low(rest, n - 1), n - 1) + np.where(known[:, None], self.contexts[n - 1][1][at], 0)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each row in each language, and its letters."""
        folded, off = letters(column)
        gram = codes(folded)
        n_letters = np.diff(np.concatenate([[0], np.cumsum(folded != 0)])[off])
        sums = np.zeros((len(off) - 1, len(self.names)))
        # the padding is context only
        position = np.zeros(len(folded), bool)
        width = np.diff(off) - (ORDER - 1)
        begin = off[:-1]
        position[np.repeat(begin + ORDER - 1 - (np.cumsum(width) - width), width) + np.arange(width.sum())] = True
        wanted = gram[position[ORDER - 1 :]]
        ends = np.concatenate([[0], np.cumsum(width)])
        some = np.flatnonzero(width > 0)
        step = 1 << 20
        values = np.empty((len(wanted), len(self.names)), np.float32)
        for k in range(0, len(wanted), step):
            values[k : k + step] = self.logp(wanted[k : k + step])
        if len(some):
            for j in range(len(self.names)):
                sums[some, j] = np.add.reduceat(values[:, j].astype(np.float64), ends[:-1][some])
        return -sums / np.maximum(width, 1)[:, None], n_letters

    def calibrate(self, entropy: np.ndarray, n_letters: np.ndarray, label: np.ndarray) -> None:
        """Usual cross-entropy of each language's texts and what lies above it; a language without texts rejects none."""
        self.level, self.excess = np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for j in range(len(self.names)):
            own = np.flatnonzero((label == j) & (n_letters > 0))
            if len(own):
                root = np.sqrt(np.minimum(n_letters[own], ENOUGH))
                self.level[j] = _middle(entropy[own], root)
                over = (entropy[own] - self.level[j]) * root
                sure = over <= OUTLYING * _deviation(over)
                self.excess[j] = max(np.quantile(over[sure], QUANTILE), 2 * _deviation(over))

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language (place in names; -1 without letters), score, rejected."""
        if not self.names:
            n = len(column)
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        entropy, n_letters = self.entropies(column)
        best = entropy.argmin(1)
        lead = (entropy - entropy.min(1, keepdims=True)) * np.minimum(n_letters, 50)[:, None]
        score = 1 / np.exp(-np.minimum(lead, 700)).sum(1)
        least = entropy.min(1)
        over = (least - self.level[best]) * np.sqrt(np.minimum(n_letters, ENOUGH))
        none = n_letters == 0
        far = least - self.level[best] > FAR * (-self.uniform - self.level[best])  # uniform is a log-probability
        return np.where(none, -1, best), np.where(none, 0.0, score), none | ((over > SLACK * self.excess[best]) & far)


def _middle(x: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(x)
    sums = np.cumsum(weight[order])
    return float(x[order][np.searchsorted(sums, sums[-1] / 2)])


def _deviation(x: np.ndarray) -> float:
    """Standard deviation as the median one tells it; never zero."""
    return max(1.4826 * float(np.median(np.abs(x - np.median(x)))), 0.05)


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo ``by``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def fit(docs: DataFrame, learn_from: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Models of the labels in ``docs`` where ``learn_from`` holds, from about ``sample_docs`` whole texts of each.

    The sample goes by a hash of doc_id and text. N-grams are counted where the texts are; the driver gets the
    distinct ones. Null texts, labels and ids are not learned from.
    """
    usable = docs.select("doc_id", "text", "lang").where(learn_from & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [], [], 0.0)
    shares = docs.sparkSession.createDataFrame([(s, min(1.0, sample_docs / n)) for s, n in sizes.items()], "lang string, share double")
    key = F.xxhash64("doc_id", text_key())
    sample = usable.join(F.broadcast(shares) if len(sizes) <= BROADCAST_LABELS else shares, "lang").where(F.pmod(key, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    part = F.pmod(F.shiftright(key, 20), F.lit(2 * CALIBRATE))  # 0 and 1 calibrate, the others are the halves
    sample = sample.select("lang", "text", F.when(part < 2, 2).otherwise(part % 2).cast("int").alias("half"))
    learned = sample.where("half < 2")

    def counted(texts: DataFrame, judge=None) -> list[Model]:
        """Models of the halves; or, if texts are judged, one of all that pass."""

        def count(batches):
            for whole in batches:
                for batch in tk.slices(whole):
                    labels, half = np.array(batch.column("lang").to_pylist(), object), batch.column("half").to_numpy()
                    good = np.ones(len(half), bool) if judge is None else judge(batch)
                    for s in np.unique(labels):
                        for k in (0, 1):
                            some = (labels == s) & (half == k) & good
                            if not some.any():
                                continue
                            folded, off = letters(batch.column("text").filter(pa.array(some)))
                            inner = np.ones(len(folded), bool)
                            for i in range(ORDER - 1):
                                inner[off[:-1] + i] = False  # padding predicts nothing
                            gram, n = np.unique(codes(folded)[inner[ORDER - 1 :]], return_counts=True)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([s] * len(n)), pa.array(np.full(len(n), k if judge is None else 0), pa.int32()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                                names=["lang", "half", "gram", "n"],
                            )

        grams = texts.mapInArrow(count, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")).toPandas()
        label, half, gram, n = (grams[c].to_numpy() for c in ("lang", "half", "gram", "n"))
        of = lambda k, s: (half == k) & (label == s)
        return [Model.fit({s: (gram[x].view(np.uint64), n[x]) for s in np.unique(label) if (x := of(k, s)).any()}) for k in ((0, 1) if judge is None else (0,))]

    def measured(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each row's label, its entropy under that, its letters; -1 and 0 if the model doesn't know the label."""
        places = {s: j for j, s in enumerate(model.names)}
        own = np.array([places.get(s, -1) for s in batch.column("lang").to_pylist()], np.int64)
        if not model.names or not len(own):
            return own, np.zeros(len(own)), np.zeros(len(own), np.int64)
        entropy, n_letters = model.entropies(batch.column("text"))
        return own, np.where(own >= 0, entropy[np.arange(len(own)), own], 0.0), n_letters

    def measure(rows: DataFrame, of) -> tuple[np.ndarray, ...]:
        """Label, entropy and letters of every row, by the model that ``of`` gives for its half."""

        def run(batches):
            for whole in batches:
                for batch in tk.slices(whole, most=1 << 20):
                    for k in (0, 1, 2):
                        some = batch.filter(pa.array(batch.column("half").to_numpy() == k))
                        if some.num_rows:
                            own, entropy, n_letters = measured(some, of(k))
                            known = own >= 0
                            yield pa.RecordBatch.from_arrays(
                                [some.column("lang").filter(pa.array(known)), pa.array(entropy[known]), pa.array(n_letters[known].astype(np.int64))], names=["lang", "entropy", "letters"]
                            )

        got = rows.mapInArrow(run, "lang string, entropy double, letters long").toPandas()
        return got["lang"].to_numpy(), got["entropy"].to_numpy(), got["letters"].to_numpy()

    halves = counted(learned)
    label, entropy, n_letters = measure(learned, lambda k: halves[1 - k])
    usual = {}
    for s in np.unique(label):
        own = (label == s) & (n_letters > 0)
        if own.any():
            root = np.sqrt(np.minimum(n_letters[own], ENOUGH))
            level = _middle(entropy[own], root)
            usual[s] = level, OUTLYING * _deviation((entropy[own] - level) * root)

    def passes(batch: pa.RecordBatch) -> np.ndarray:
        """Texts that the other half finds usual for their label, or can't judge."""
        labels, half, good = np.array(batch.column("lang").to_pylist(), object), batch.column("half").to_numpy(), np.ones(batch.num_rows, bool)
        for k in (0, 1):
            some = np.flatnonzero(half == k)
            if len(some):
                own, entropy, n_letters = measured(batch.take(pa.array(some)), halves[1 - k])
                level, most = (np.array([usual.get(s, (0.0, np.inf))[i] for s in labels[some]]) for i in (0, 1))
                good[some] = (own < 0) | ((entropy - level) * np.sqrt(np.minimum(n_letters, ENOUGH)) <= most)
        return good

    model = counted(learned, passes)[0]
    label, entropy, n_letters = measure(sample.where("half = 2"), lambda k: model)
    places = {s: j for j, s in enumerate(model.names)}
    model.calibrate(entropy, n_letters, np.array([places[s] for s in label], np.int64))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; only the text is looked at.

    Null texts and texts without letters are ``und`` with score 0 and rejected; so is every text if nothing could
    be learned. Columns of the same names are replaced; repeated rows get equal results.
    """
    added = ("lang_pred", "score", "rejected")
    docs = docs.drop(*added)
    kept = docs.columns
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = handle.value
        names = np.array([*own.names, "und"], object)
        for whole in batches:
            for batch in tk.slices(whole, most=1 << 20):
                best, score, rejected = own.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], names=[*kept, *added])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Drop the documents whose text is rejected as none of the learned languages; columns as in ``docs``.

    Null texts and texts without letters are in no language and go. Where no language could be learned, as all labels, ids or texts are null,
    every document stays. Repeated rows share their fate; clashing column names are kept apart.
    """
    model = fit(docs, F.lit(True), sample_docs)
    if not model.names:
        return docs
    named = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score", "rejected")}
    marked = predict(docs.withColumnsRenamed(named), model)
    return marked.where("not rejected").drop("lang_pred", "score", "rejected").withColumnsRenamed({v: k for k, v in named.items()}).select(*docs.columns)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of op 6, and ``rejected``: every row of ``documents``; a null doc_id is not held out nor learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, remainder(3) != 1)
    rows = docs.select("doc_id", "text", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"))
    return predict(rows, model).drop("text")
