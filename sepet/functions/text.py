"""Normalising and tokenising text columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FILLER_WORDS, FOLD_FROM, FOLD_TO, TITLE_ALIASES, UNIT_WORDS, UNKNOWN_BRAND

# Anything but letters, decimal digits and white space. Letters beyond the basic plane count as
# separators, because the rule is stated on 16-bit characters.
_SEPARATORS = r"(?U)[^\p{L}\p{Nd}\s]|[\x{10000}-\x{10FFFF}]"


def is_blank(col: Column) -> Column:
    """True for null, empty, and all-white-space text (any Unicode white space)."""
    return col.isNull() | ~col.rlike(r"(?U)\S")


def trim_all(col: Column) -> Column:
    """Trim all Unicode white space; the built-in trim takes spaces only."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def lower_text(col: Column) -> Column:
    """Lower case, with the dotted capital I mapped to a plain i first."""
    return F.lower(F.replace(col, F.lit("İ"), F.lit("i")))


def normalize_text(col: Column) -> Column:
    """Lower case with the six Turkish letters folded; blank becomes ''."""
    return F.when(is_blank(col), F.lit("")).otherwise(F.translate(lower_text(col), FOLD_FROM, FOLD_TO))


def tokenize(col: Column, exclude: Column | None = None, min_length: int = 2) -> Column:
    """Distinct tokens in first-seen order, without short ones, pure numbers and ``exclude``."""
    words = F.split(F.regexp_replace(normalize_text(col), _SEPARATORS, " "), " ")
    kept = F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.rlike(r"^\p{Nd}+$"))
    return F.array_distinct(kept) if exclude is None else F.array_except(kept, exclude)


def alias_expand(col: Column, aliases: Mapping[str, str] = TITLE_ALIASES) -> Column:
    """Replace whole alias words, case-blind."""
    for alias, words in aliases.items():
        col = F.regexp_replace(col, rf"(?iuU)\b\Q{alias}\E\b", words)
    return col


def default_brand(col: Column) -> Column:
    return F.when(is_blank(col), F.lit(UNKNOWN_BRAND)).otherwise(col)


def brand_key(brand: Column) -> Column:
    """What two spellings of one brand share: case, the dotted capital I and end spaces do not count."""
    return lower_text(F.rtrim(brand))


def brand_words(brand: Column) -> Column:
    """The brand's own words: normalised and split on spaces, punctuation kept."""
    return F.filter(F.split(normalize_text(brand), " "), lambda w: F.length(w) > 0)


def tokenize_title(
    title: Column,
    brand: Column,
    aliases: Mapping[str, str] = TITLE_ALIASES,
    dropped: Iterable[str] = UNIT_WORDS + FILLER_WORDS,
) -> Column:
    """Tokens that tell products apart: no units, fillers or brand words, three letters or more."""
    fixed = F.array(*[F.lit(w) for w in dict.fromkeys(dropped)])
    return tokenize(alias_expand(title, aliases), F.concat(fixed, brand_words(brand)), min_length=3)


def slug(col: Column) -> Column:
    """Text to url part: folded, only [a-z0-9], words joined by hyphens."""
    plain = F.regexp_replace(normalize_text(col), r"(?U)[^a-z0-9\s-]", "")
    return F.replace(F.trim(F.regexp_replace(plain, r"(?U)[\s-]+", " ")), F.lit(" "), F.lit("-"))
