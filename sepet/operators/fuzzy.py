"""Joining tokens that agree, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import EDIT_MIN_LENGTH, EDIT_ONE_MAX_LENGTH, MAX_SUFFIX, tokens_agree

# Words up to this length are keyed by what is left after deletions, longer ones by pairs of segments:
# the number of deletions grows with the square of the length, that of pairs does not.
DELETION_MAX_LENGTH = 32
_TWO_EDITS_MIN = EDIT_ONE_MAX_LENGTH + 1


def _tagged(tag: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(tag + ":"), t))


def _when_length(token: Column, low: int, high: int | None, texts: Column) -> Column:
    n = F.length(token)
    fits = (n >= low) if high is None else n.between(low, high)
    return F.when(fits, texts).otherwise(F.array().cast("array<string>"))


def _roots(token: Column) -> Column:
    """The token without its last one to three characters; never the empty text."""
    cuts = F.filter(F.array(*[F.lit(i) for i in range(1, MAX_SUFFIX + 1)]), lambda i: i < F.length(token))
    return F.transform(cuts, lambda i: F.substring(token, F.lit(1), F.length(token) - i))


def _one_deletion(token: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1)))
    cut = F.transform(places, lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substr(token, i + 1)))
    return F.array_distinct(F.array_append(cut, token))


def _two_deletions(token: Column) -> Column:
    n = F.greatest(F.length(token), F.lit(1))
    # i = j stands for one deletion only.
    cut = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.transform(
                F.sequence(i, n),
                lambda j: F.concat(
                    F.substring(token, F.lit(1), i - 1),
                    F.substring(token, i + 1, j - i - 1),
                    F.substr(token, j + 1),
                ),
            ),
        )
    )
    return F.array_distinct(F.array_append(cut, token))


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
# By how much a word within two edits is longer, and how far its untouched segments lie from their places there.
_MOVES = [
    (first + between + rest, -first, -first - between)
    for first in range(-2, 3)
    for between in range(-2, 3)
    for rest in range(-2, 3)
    if abs(first) + abs(between) + abs(rest) <= 2
]


def _segment(token: Column, length: Column, i: Column, shift: Column) -> Column:
    """Quarter i of a word of ``length``, cut from ``token`` at its place plus ``shift``; null where it would not
    lie inside the token."""
    quarter = F.floor(length / 4).cast("int")
    size = F.when(i < 3, quarter).otherwise(length - quarter * 3)
    start = quarter * i + 1 + shift
    return F.when((start >= 1) & (start + size - 1 <= F.length(token)), F.substring(token, start, size))


def _pair_key(token: Column, i: int, j: int, gap: Column, shift_i: Column, shift_j: Column) -> Column:
    length = F.length(token) + gap
    first, second = _segment(token, length, F.lit(i), shift_i), _segment(token, length, F.lit(j), shift_j)
    # concat, unlike concat_ws, is null where a part is.
    return F.concat(F.lit(f"part/{i}{j}/"), length.cast("string"), F.lit("/"), first, F.lit("/"), second)


def _own_segments(token: Column) -> Column:
    none = F.lit(0)
    return F.array(*[_pair_key(token, i, j, none, none, none) for i, j in _PAIRS])


def _sought_segments(token: Column) -> Column:
    """Where two quarters of a word within two edits may lie in ``token``: two edits leave two of them whole."""
    moves = F.array(*[_ints(*m) for m in _MOVES])

    def of_pair(i: int, j: int) -> Column:
        return F.transform(moves, lambda m: _pair_key(token, i, j, m[0], m[1], m[2]))

    return F.array_distinct(F.array_compact(F.concat(*[of_pair(i, j) for i, j in _PAIRS])))


def _signatures(token: Column, seeking: bool) -> Column:
    itself = F.array(token)
    root_parts = (
        [_tagged("whole", itself), _tagged("whole", _roots(token)), _tagged("root", itself)]
        if seeking
        else [_tagged("whole", itself), _tagged("root", _roots(token))]
    )
    long_word = DELETION_MAX_LENGTH + 1
    segments = _sought_segments(token) if seeking else _own_segments(token)
    return F.concat(
        *root_parts,
        _when_length(token, EDIT_MIN_LENGTH, _TWO_EDITS_MIN, _tagged("one", _one_deletion(token))),
        _when_length(token, _TWO_EDITS_MIN, DELETION_MAX_LENGTH + 2, _tagged("two", _two_deletions(token))),
        _when_length(token, long_word, None, segments),
    )


def fuzzy_token_join(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs (token_a, token_b) of agreeing tokens, within equal ``by`` columns.

    Every rule of agreement is turned into shared keys, so this is an equi-join: equal words share
    the word; a root and its longer form share the root; words within one or two edits share what
    is left after as many deletions, or, when long, two of four segments. No rule is missed, and
    each candidate is checked, so the result is exact.
    """
    keys = [*by, "_sig"]
    a = left.select(*by, F.col("token").alias("token_a")).distinct()
    b = right.select(*by, F.col("token").alias("token_b")).distinct()
    a = a.withColumn("_sig", F.explode(_signatures(F.col("token_a"), seeking=True)))
    b = b.withColumn("_sig", F.explode(_signatures(F.col("token_b"), seeking=False)))
    return (
        a.join(b, keys)
        .filter(tokens_agree(F.col("token_a"), F.col("token_b")))
        .select(*by, "token_a", "token_b")
        .distinct()
    )
