"""Plain versions of the operators, and documents to hold them against."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return (text or "").translate(LOWER)


def corpus(seed=1, n=120, vocabulary=60):
    """Texts with copies, near copies, shared passages, odd white space, nulls and empties."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéßя日", k=rng.randint(1, 9))).capitalize() if k % 4 == 0 else "".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for k in range(vocabulary)]
    passages = [" ".join(rng.choices(vocab, k=60)) for _ in range(3)]
    out = []
    for k in range(n):
        kind = rng.randrange(8)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1 and out:
            w = (rng.choice(out) or "x").split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        elif kind == 2:
            out.append("\n".join([" ".join(rng.choices(vocab, k=rng.randint(0, 30))), rng.choice(passages), "\t".join(rng.choices(vocab, k=rng.randint(1, 30)))]))
        elif kind == 3 and k % 3 == 0:
            out.append(rng.choice([None, "", " \n\t ", "a", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"]))
        else:
            out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\x0b"]) for w in rng.choices(vocab, k=rng.randint(1, 120))))
    return out


def documents(spark, texts, first=0, lang=None):
    """doc_id, text, lang, source, n_chars, with columns of clashing names beside."""
    rows = [(first + k, t, (lang or ["en", "fr"])[k % 2], f"s{k % 5}" if k % 7 else None, len(t or ""), k, "x", 0.5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, score double")


def repeats(rows, window):
    """For (doc_id, text) rows: words and which of them a window covers that also starts earlier."""
    split = [(d, words(t)) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            place = (float("inf") if d is None else d, i)
            first[key] = min(first.get(key, place), place)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if d is None else d, i):
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


__all__ = ["Counter", "components", "corpus", "documents", "lowered", "repeats", "words"]
