"""Ranking and joining when one group may hold a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, settle_partitions

TASK_ROWS = 2_000_000
#: Ranges that large groups are dealt to at most, so that tasks do not outgrow what they do.
MOST_RANGES = 2_000


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint behind a row count; beyond the bound the join is left to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(df: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys with more than ``task_rows`` rows, and the salts each one needs.

    At most rows / task_rows keys come back, whatever the data.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > task_rows)
        .select(*keys, F.ceil(F.col("_n") / task_rows).cast("int").alias("_salts"))
    )


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    task_rows: int = TASK_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose ``many`` side may have hot keys: hot keys are spread over several tasks.

    Rows of a hot key get a salt on the ``many`` side and are repeated once per salt on the ``one``
    side; every other key has the single salt 0. ``how`` may be inner, left, left_semi or left_anti.
    ``hot`` gives the hot keys where they are known already.
    """
    hot = settle(hot_keys(many, keys, task_rows) if hot is None else hot)
    if hot.isEmpty():
        return many.join(one, list(keys), how)
    hot = broadcast_if_small(hot)
    spread = F.pmod(F.xxhash64(*many.columns), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    salted = many.join(hot, list(keys), "left").withColumn("_salt", spread).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    repeated = one.join(hot, list(keys), "left").withColumn("_salt", copies).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def rank_in_groups(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    sizes: DataFrame,
    rank: str = "rank",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Dense 1..n numbering inside each group by a total order.

    ``sizes`` gives (group, n) and is small. Groups that fit one task use a window. Larger ones are
    range-partitioned over the whole order, so that a group spans many tasks; each row's number is
    its place in its partition plus the rows of its group in the partitions before. Partitions hold about ``task_rows`` rows,
    more where that would take over ``MOST_RANGES`` of them.
    """
    by_group = Window.partitionBy(group).orderBy(*order)
    large = sizes.filter(F.col("n") > task_rows).select(group, "n")
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return df.withColumn(rank, F.row_number().over(by_group).cast("bigint"))
    keys = broadcast_if_small(large.select(group))
    small_part = df.join(keys, [group], "left_anti").withColumn(
        rank, F.row_number().over(by_group).cast("bigint")
    )
    ranged = settle_partitions(
        df.join(keys, [group], "left_semi")
        .repartitionByRange(min(math.ceil(total / task_rows), MOST_RANGES), F.col(group), *order)
        .sortWithinPartitions(F.col(group), *order)
    )
    # The id grows by one inside a partition and by 2^33 from one partition to the next.
    placed = ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_id", 33)
    )
    pieces = placed.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(broadcast_if_small(starts), [group, "_part"]).withColumn(
        rank, (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("bigint")
    )
    return small_part.unionByName(numbered.select(*df.columns, rank))
