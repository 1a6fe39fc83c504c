"""Keys made from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key_md5(col: Column) -> Column:
    """Signed 64-bit key: the first eight bytes of the text's MD5, lowest byte first."""
    pairs = F.regexp_extract_all(F.substring(F.md5(col), 1, 16), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, -10).cast("long")
