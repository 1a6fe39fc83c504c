"""Numbers as shown to shoppers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_display(price: Column) -> Column:
    """Turkish lira text: sign, currency mark, points between thousands, comma before the cents."""
    digits = F.translate(F.format_number(F.abs(price), 2), ",.", ".,")
    return F.concat(F.when(price < 0, F.lit("-")).otherwise(F.lit("")), F.lit("₺"), digits)


def percent_display(score: Column) -> Column:
    """A score between 0 and 1 as a whole percent, halves rounded up."""
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))
