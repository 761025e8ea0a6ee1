"""Drawing inputs and targets of training samples, and masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..schema import LATIN
from .letters import uniform


def _ordered(places: Column, rank) -> Column:
    """The places by what ``rank`` gives for each (columns, compared in turn)."""
    return F.transform(F.array_sort(F.transform(places, lambda i: F.struct(*(r.alias(f"r{k}") for k, r in enumerate(rank(i))), i.alias("i")))), lambda x: x["i"])


def _targets(tags: Column, taken: Column, own, want: int, u) -> Column:
    """``want`` places: those whose tag is ``own`` and that are not taken, then others not taken, then any again."""
    places = F.sequence(F.lit(0), F.size(tags) - 1)
    free = F.filter(places, lambda i: ~F.array_contains(taken, i))
    first = F.slice(_ordered(free, lambda i: (F.when(own(F.get(tags, i)), 0).otherwise(1), u(i, 1))), 1, want)
    again = F.transform(F.sequence(F.lit(1), F.lit(want)), lambda j: F.floor(u(j, 2) * F.size(tags)).cast("int"))
    return F.slice(F.concat(first, again), 1, want)


def collated(
    records: DataFrame, seed: int, most_inputs: int = 4, latin_targets: int = 1, other_targets: int = 1, prime: float = 0.5, weights: Sequence[float] | None = None
) -> DataFrame:
    """``records`` (idx, key, tags, cells) with input_places, target_places, primed.

    Up to ``most_inputs`` cells are candidates, and a number drawn by ``weights`` (even ones, if none) of them are inputs. Targets
    are Latin ones, then others; both sorts keep off the candidates while they can, then take of the other sort, and
    repeat cells at last, so that their number is always the same. No cells: no places. Draws hang on seed, idx, key and place only.
    """
    share = [1.0] * most_inputs if weights is None else list(weights)
    upto = [sum(share[: k + 1]) / sum(share) for k in range(most_inputs - 1)]
    u = lambda salt: lambda i, k: uniform(F.lit(seed), "idx", "key", F.lit(salt), F.lit(k), i)
    tags = F.col("tags")
    none = F.array().cast("array<int>")
    drawn = _ordered(F.sequence(F.lit(0), F.size(tags) - 1), lambda i: (u("candidates")(i, 0),))
    number = 1 + sum((F.lit(x) <= u("number")(F.lit(0), 0)).cast("int") for x in upto) if upto else F.lit(1)

    def places(candidates: Column) -> Column:
        latin = _targets(tags, candidates, lambda t: t == LATIN, latin_targets, u("latin")) if latin_targets else none
        return let(
            latin,
            lambda a: F.struct(
                F.slice(_ordered(candidates, lambda i: (u("inputs")(i, 0),)), F.lit(1), number).alias("input_places"),
                F.concat(a, _targets(tags, F.concat(candidates, a), lambda t: t != LATIN, other_targets, u("others")) if other_targets else none).alias("target_places"),
            ),
        )

    empty = F.struct(none.alias("input_places"), none.alias("target_places"))
    out = records.withColumn("__d", F.when(F.size(tags) > 0, let(F.slice(drawn, 1, most_inputs), places)).otherwise(empty)).select(*records.columns, "__d.*")
    return out.withColumn("primed", F.transform("target_places", lambda t, j: u("prime")(j, 0) < prime))


def masked(rows: DataFrame, ids: str, mask: int, share: float, seed: int, most: int = 512) -> DataFrame:
    """Token ids cut to ``most``, with labels (-100 where nothing is predicted): a seeded hash picks ``share`` of them."""
    cut = F.slice(F.col(ids), 1, most)
    picked = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("key"), i), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.withColumns(
        {"input_ids": F.transform(cut, lambda t, i: F.when(picked(i), mask).otherwise(t)), "labels": F.transform(cut, lambda t, i: F.when(picked(i), t).otherwise(-100))}
    )
