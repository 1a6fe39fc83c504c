"""Token agreement and the greedy token-set score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the agreement rule.
MAX_SUFFIX = 3
EDIT_MIN_LENGTH = 5
EDIT_ONE_MAX_LENGTH = 7


def tokens_agree(a: Column, b: Column) -> Column:
    """Equal; or root plus a short suffix; or a small spelling variant of a word long enough."""
    shorter = F.least(F.length(a), F.length(b))
    gap = F.abs(F.length(a) - F.length(b))
    suffix = (gap <= MAX_SUFFIX) & (F.startswith(a, b) | F.startswith(b, a))
    spelling = (
        (shorter >= EDIT_MIN_LENGTH)
        & (gap <= 2)
        & (
            ((shorter <= EDIT_ONE_MAX_LENGTH) & (F.levenshtein(a, b, 1) >= 0))
            | ((shorter > EDIT_ONE_MAX_LENGTH) & (F.levenshtein(a, b, 2) >= 0))
        )
    )
    return (a == b) | suffix | spelling


def token_set_score(first: Column, second: Column, empty_is_compatible: bool) -> Column:
    """Greedy one-to-one pairing: m / (n1 + n2 - m).

    Every token of ``first`` in order takes the first token of ``second`` still free that agrees,
    so the order of the arguments counts.
    """

    def take(state: Column, token: Column) -> Column:
        hits = F.filter(state["free"], lambda other: tokens_agree(token, other))
        return F.transform(
            F.slice(hits, 1, 1),
            lambda hit: F.struct(
                (state["matched"] + 1).alias("matched"), F.array_remove(state["free"], hit).alias("free")
            ),
        )

    def step(state: Column, token: Column) -> Column:
        return F.coalesce(F.get(take(state, token), F.lit(0)), state)

    start = F.struct(F.lit(0).alias("matched"), second.alias("free"))
    matched = F.aggregate(first, start, step, lambda state: state["matched"])
    return (
        F.when((F.size(first) == 0) & (F.size(second) == 0), F.lit(1.0))
        .when((F.size(first) == 0) | (F.size(second) == 0), F.lit(1.0 if empty_is_compatible else 0.0))
        .otherwise(
            F.transform(
                F.array(matched), lambda m: m / (F.size(first) + F.size(second) - m).cast("double")
            )[0]
        )
    )


def sizes_can_reach(n1: Column, n2: Column, threshold: float) -> Column:
    """Whether two non-empty sets of these sizes can score ``threshold`` at all."""
    return F.least(n1, n2) >= F.lit(threshold) * F.greatest(n1, n2)
