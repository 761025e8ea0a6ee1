"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed into the words of one Shift-And state: a bit for each literal of each rule, a
self-loop for each star. One step reads one byte of every URL of a batch and moves all rules at once:
``state = (state << 1 & LITERAL[byte]) | (state & LOOP[byte])``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table

_ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains, below a path prefix."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        quoted = _quote(self.host.lower()), _quote(self.path)
        return ["{}\0{}**".format(*quoted), "*.{}\0{}**".format(*quoted)]


def _quote(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class Automaton:
    """Globs over bytes: ``**`` any text, ``*`` any text without a slash, ``?`` one character but a slash, ``\\`` quotes."""

    def __init__(self, globs: Sequence[str]):
        literal: list[np.ndarray] = []  # for each state the bytes that enter it
        loop: list[np.ndarray] = []  # for each state the bytes that stay in it
        self.initial, self.final = [], []
        every, flat, tail = np.ones(256, bool), np.arange(256) != ord("/"), (np.arange(256) & 0xC0) == 0x80
        for glob in globs:
            self.initial.append(len(literal))
            literal.append(np.zeros(256, bool))
            loop.append(np.zeros(256, bool))
            at = 0
            while at < len(glob):
                if glob.startswith("**", at):
                    loop[-1] |= every
                    at += 2
                elif glob[at] == "*":
                    loop[-1] |= flat
                    at += 1
                elif glob[at] == "?":
                    literal.append(flat & ~tail)
                    loop.append(tail.copy())
                    at += 1
                else:
                    at += glob[at] == "\\" and at + 1 < len(glob)
                    for byte in glob[at].encode():
                        literal.append(np.arange(256) == byte)
                        loop.append(np.zeros(256, bool))
                    at += 1
            self.final.append(len(literal) - 1)
        self.words = max(1, -(-len(literal) // 64))
        self.literal, self.loop = _pack(literal, self.words), _pack(loop, self.words)
        self.start = np.zeros(self.words, np.uint64)
        for k in self.initial:
            self.start[k >> 6] |= _ONE << np.uint64(k & 63)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs fit which whole texts: a row for each text, a column for each glob."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, sizes = offsets[:-1][order], length[order]
        state = np.repeat(self.start[None], len(order), 0)
        live = len(order)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= at:
                live = int(np.searchsorted(-sizes, -at, "left"))
            byte = data[begin[:live] + at]
            old = state[:live]
            moved = old << _ONE
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.literal[byte]) | (old & self.loop[byte])
        out = np.zeros((len(order), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[:, bit >> 6] >> np.uint64(bit & 63)) & _ONE
        return out


def _pack(states: list[np.ndarray], words: int) -> np.ndarray:
    out = np.zeros((256, words), np.uint64)
    for k, entered in enumerate(states):
        out[entered, k >> 6] |= _ONE << np.uint64(k & 63)
    return out


#: Globs that judge what no rule fits; they see the host, a zero byte and the path. Whatever they don't block is allowed.
BLOCK_GLOBS = (
    "ads.**",
    "*.ads.**",
    "m.**",
    "**/login**",
    "**/cart/**",
    "**/wp-admin/**",
    "**/*.zip",
    "**/*.jp?g",
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str = "url"):
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule], block_globs: Sequence[str] = BLOCK_GLOBS, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Columns ``keep`` and host, path, rule, verdict of each row of ``pages``.

    The rule with the longest name that fits decides (of equals the first given); without one, a fitting glob of
    ``block_globs`` blocks and the rest is allowed. Null urls and urls without ``://`` have empty host and path, so
    only globs that fit the empty text fit them. Repeated rows get equal verdicts; other columns are left out, also
    those named as an added one.
    """
    host, path = host_and_path()
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([g for r in ranked for g in r.globs()] + list(block_globs))
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.action for r in ranked], object)
    schema = rows.select("*", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    schema["rule"].nullable = True

    def run(batches):
        for batch in batches:
            hosts, hoff = tk.buffers(batch.column("host"))
            paths, poff = tk.buffers(batch.column("path"))
            sizes = np.diff(hoff) + 1 + np.diff(poff)  # a zero byte between them
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            data = np.zeros(offsets[-1], np.uint8)
            at = np.arange(len(data)) - np.repeat(offsets[:-1], sizes) - np.repeat(np.diff(hoff), sizes)
            data[at < 0], data[at > 0] = hosts, paths
            hit = automaton.match(data, offsets)
            n = len(ranked)
            by_rule = hit[:, : 2 * n].reshape(-1, n, 2).any(2) if n else np.zeros((len(hit), 0), bool)
            which = np.where(by_rule.any(1), by_rule.argmax(1), n) if n else np.zeros(len(hit), int)
            verdict = np.where(hit[:, 2 * n :].any(1), "block", "allow").astype(object)
            ruled = which < n
            verdict[ruled] = verdicts[which[ruled]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[which], pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP1_SQL = r"""
WITH rules(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
best AS (SELECT s.r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(action, length(rules.host || rules.path)) AS action
  FROM s JOIN rules ON (s.host = rules.host OR ends_with(s.host, '.' || rules.host)) AND starts_with(s.path, rules.path) GROUP BY s.r)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_full_match(host || path, '(?s)ads\..*|[^/]*\.ads\..*|m\..*|.*/login.*|.*/cart/.*|.*/wp-admin/.*|.*/[^/]*\.zip|.*/[^/]*\.jp[^/]g') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN best USING (r)
"""
