"""Size, unit and pack count out of titles; unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COUNT_ONLY, COUNT_UNIT, PACK_FIRST, SIZE_ONLY, UNIT_FACTORS

SIZE_TYPE = "decimal(18,4)"


def _base_value(number: Column, unit: Column) -> Column:
    factors = F.create_map(*[F.lit(x) for u, (_, f) in UNIT_FACTORS.items() for x in (u, f)])
    value = F.replace(number, F.lit(","), F.lit(".")).try_cast(SIZE_TYPE)
    return (value * factors[F.lower(unit)]).try_cast(SIZE_TYPE)


def _base_unit(unit: Column) -> Column:
    return F.create_map(*[F.lit(x) for u, (c, _) in UNIT_FACTORS.items() for x in (u, c)])[F.lower(unit)]


def _struct(value: Column, unit: Column, quantity: Column, ok: Column) -> Column:
    return F.struct(
        value.alias("size_value"), unit.alias("size_unit"), quantity.alias("pack_quantity"), ok.alias("size_ok")
    )


def _parse(text: Column) -> Column:
    def found(value: Column, unit: Column, quantity: Column) -> Column:
        return _struct(value, unit, quantity, value.isNotNull() & quantity.isNotNull())

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    pack, pack_number, pack_unit = (part(PACK_FIRST, g) for g in (1, 2, 3))
    number, unit = part(SIZE_ONLY, 1), part(SIZE_ONLY, 2)
    count = part(COUNT_ONLY, 1)
    one = F.lit(1)
    nothing = _struct(F.lit(None).cast(SIZE_TYPE), F.lit(None).cast("string"), one, F.lit(True))
    return (
        F.when(~text.rlike(r"(?U)\d"), nothing)
        .when(pack != "", found(_base_value(pack_number, pack_unit), _base_unit(pack_unit), pack.try_cast("int")))
        .when((number != "") & (count != ""), found(_base_value(number, unit), _base_unit(unit), count.try_cast("int")))
        .when(number != "", found(_base_value(number, unit), _base_unit(unit), one))
        .when(count != "", found(count.try_cast(SIZE_TYPE), F.lit(COUNT_UNIT), one))
        .otherwise(nothing)
    )


def extract_size(title: Column) -> Column:
    """Struct(size_value, size_unit, pack_quantity, size_ok) read from a title.

    Tried in order: ``N x SIZE UNIT``; SIZE UNIT with a count suffix; SIZE UNIT; count alone.
    ``size_ok`` is false when a number was found that does not fit its type. The title goes through
    a one-element array, so that it is computed once and the plan does not repeat its expression.
    """
    return F.transform(F.array(F.coalesce(title, F.lit(""))), _parse)[0]


def total_size(size_value: Column, pack_quantity: Column) -> Column:
    return F.coalesce(size_value, F.lit(0)) * pack_quantity


def is_weight_or_volume(size_unit: Column) -> Column:
    return F.coalesce(size_unit.isin("G", "ML"), F.lit(False))


def unit_price(price: Column, size_value: Column, size_unit: Column, pack_quantity: Column) -> Column:
    """Price per kg or litre for weights and volumes, per piece otherwise; null without a size."""
    amount = F.nullif(size_value, F.lit(0)) * pack_quantity
    scale = F.when(is_weight_or_volume(size_unit), F.lit(1000)).otherwise(F.lit(1)).cast("decimal(5,0)")
    return F.try_divide(price, amount / scale)


def unit_label(size_unit: Column) -> Column:
    return F.when(size_unit == "ML", "L").when(size_unit == "G", "kg").otherwise("adet")
