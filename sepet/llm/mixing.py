"""Mixing sources to target weights: hash-random order, range buckets, prefix sums, a cut at each exact budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

BUCKET_ROWS = 1_000


def source_targets(
    per_source: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, get the weights in turn. Together they get ``share`` times all
    sizes. A target stops at ``most`` times its source's size and what is above is dealt to the others by
    weight until none is above: the sources ordered by size over weight are filled up to a common level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int"))
    full = F.lit(most).cast("bigint") * F.col("source_size")
    ranked = per_source.select("source", "source_size", weight.cast("bigint").alias("w"), full.alias("full"))
    level = Window.orderBy((F.col("full") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*",
        (F.lit(float(share)) * F.sum("source_size").over(every)).alias("budget"),
        F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_before"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    ).select("*", ((F.col("budget") - F.col("full_before")) / F.col("w_left")).alias("level"))
    # The first source that the level does not fill fixes the level for itself and all after it.
    free = F.when(F.col("level") * F.col("w") < F.col("full"), F.col("level"))
    first = F.first(free, ignorenulls=True).over(every)
    target = F.least(F.coalesce(first * F.col("w"), F.col("full").cast("double")), F.col("full").cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(
    rows: DataFrame,
    source: str,
    size: str,
    key: Column,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    bucket_rows: int = BUCKET_ROWS,
    sizes: DataFrame | None = None,
    sizes_column: str | None = None,
) -> DataFrame:
    """Every row of ``rows`` with ``source_size``, ``target`` and ``taken``, the part of ``size`` the mix takes.

    ``key`` is a 32 digit hex string, random but fixed for the row. Rows are ordered by it inside their source.
    Keys are uniform, so equal ranges of them hold about equal numbers of rows: a source is cut into as many
    ranges as it needs for ``bucket_rows`` rows each, every range is sorted and summed on its own, and range
    totals give each range its start. Whole epochs are taken while the budget (the target rounded) allows, then
    rows in order until the budget is used up; the last row gives just what is missing.

    Null sources are one source; null sizes count as 0; a source of size 0 takes nothing. Rows that tie in
    key and size are interchangeable. An empty table gives an empty result. ``sizes`` may give the
    same rows in a form that is cheaper to read, with the size in ``sizes_column``. Columns of ``rows`` may have any names;
    those named as a new column (case-blind) are replaced.
    """
    light = (rows if sizes is None else sizes).select(
        col(source).alias("source"),
        F.coalesce(col(sizes_column or size), F.lit(0)).cast("bigint").alias("size"),
        key.alias("key"),
    )
    counted = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    largest = counted.agg(F.max("n")).first()[0] or 0
    ranges = max(1, math.ceil(largest / bucket_rows))
    place = lambda k: F.floor(F.conv(F.substring(k, 1, 8), 16, 10).cast("bigint") * ranges / F.lit(2**32)).cast("int")
    targets = source_targets(counted.select("source", "source_size"), weights, share, most)
    sums = light.groupBy("source", place(F.col("key")).alias("range")).agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("start"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("its_source"), F.col("range").alias("its_range"), "start", "source_size", "target"
    )
    # The row is one column, so that no name of its own can clash with those below.
    keyed = rows.select(
        F.struct("*").alias("row"), col(source).alias("source"), F.coalesce(col(size), F.lit(0)).cast("bigint").alias("size"), key.alias("key")
    ).withColumn("range", place(F.col("key")))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("range") == F.col("its_range")))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    new = {"source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("bigint")}
    return placed.select(
        *[F.col("row")[c].alias(c) for c in rows.columns if c.lower() not in new], *[value.alias(c) for c, value in new.items()]
    )
