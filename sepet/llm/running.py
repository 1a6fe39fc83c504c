"""Positions and running sums over a total order of a whole table, without a task that sees it all."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle_partitions

#: Rows that one task sorts, where shuffle partitions do not make it fewer.
TASK_ROWS = 1_000_000


def running_totals(df: DataFrame, order: Sequence[str], value: str, task_rows: int = TASK_ROWS) -> tuple[DataFrame, int, int]:
    """(``df`` with ``place`` and ``before``, rows, sum of ``value``).

    ``place`` counts the rows before a row in the order of the columns ``order`` (nulls first), ``before`` adds up their
    ``value``, a bigint without nulls. Rows that tie in the whole order follow each other in some order. Columns of
    ``df`` must not be named ``place``, ``before`` or with a leading underscore. An empty table gives an empty
    result and zeros.

    Rows are range-partitioned over the order, so that equal keys may span tasks only where ``order`` tells them apart;
    each range is summed on its own and starts where the ranges before it end. One row per range is broadcast.
    """
    spark = df.sparkSession
    rows = df.count()
    parts = max(1, math.ceil(rows / task_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in order]
    # Fixed by a reliable checkpoint: bounds of ranges are sampled, a second computation might cut elsewhere.
    ranged = settle_partitions(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    # The id grows by one inside a partition and by 2^33 from one partition to the next.
    placed = ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sums = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
    )
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .select(
            *df.columns,
            (F.col("_rows_before") + F.col("_id") - F.col("_first")).cast("bigint").alias("place"),
            (F.col("_sum_before") + F.col("_inside")).cast("bigint").alias("before"),
        )
    )
    return numbered, rows, sums.agg(F.sum("_sum")).first()[0] or 0
