"""Sharding along a Hilbert curve over several metadata dimensions, so that every shard is narrow in each of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import col, fresh_name
from .running import TASK_ROWS, running_totals

SHARDS = 16
#: Levels of a dimension are 2 to this power.
BITS = 5
LAWS = ("bytes", "rows")


@lru_cache(8)
def curve_states(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of the curve at ``state * 2 ** dims + corner``, flattened; it starts in state 0.

    A cell of the grid is walked through corner by corner in the order of a Gray code, turned and mirrored by the
    state of the cell, so that consecutive cells are always neighbours. Bit k of ``corner`` is the bit of
    dimension k. Only states that can be reached are numbered.
    """
    full = (1 << dims) - 1
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & full
    gray = [k ^ (k >> 1) for k in range(1 << dims)]
    trailing = lambda k: (~k & (k + 1)).bit_length() - 1  # ones at the end
    enter = [0] + [gray[2 * ((k - 1) // 2)] for k in range(1, 1 << dims)]
    along = [0] + [trailing(k - 1 if k % 2 == 0 else k) % dims for k in range(1, 1 << dims)]
    number, states, digits, after = {(0, 0): 0}, [(0, 0)], [], []
    for mirror, axis in states:  # grows while it is walked
        for corner in range(1 << dims):
            digit = gray.index(turn(corner ^ mirror, dims - (axis + 1) % dims))
            then = (mirror ^ turn(enter[digit], axis + 1), (axis + along[digit] + 1) % dims)
            if then not in number:
                number[then] = len(states)
                states.append(then)
            digits.append(digit)
            after.append(number[then])
    return digits, after


def curve_index(levels: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the curve of a cell given by one level, 0 to 2 ** bits - 1, per dimension."""
    dims = len(levels)
    digits, after = curve_states(dims)
    corner = lambda bit: sum(
        (F.shiftleft(F.shiftright(level.cast("bigint"), bit).bitwiseAND(F.lit(1)), k) for k, level in enumerate(levels)), F.lit(0)
    ).cast("bigint")
    digit, then = F.array(*map(F.lit, digits)), F.array(*map(F.lit, after))

    def step(done: Column, at: Column) -> Column:
        place = (done["state"] * (1 << dims) + at + 1).cast("int")
        return F.struct(
            (done["index"] * (1 << dims) + F.element_at(digit, place)).alias("index"),
            F.element_at(then, place).cast("bigint").alias("state"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).cast("bigint").alias("state"))
    return F.aggregate(F.array(*[corner(b) for b in reversed(range(bits))]), start, step, lambda done: done["index"])


def level_of(df: DataFrame, dim: str, bits: int = BITS, task_rows: int = TASK_ROWS) -> Column:
    """The level of a column of ``df``: the share of rows with a smaller value, in 2 ** bits steps; null is smallest.

    Values are counted with map-side combine and counts added up in order. What comes to the driver is the least
    value of each level, 2 ** bits rows at most.
    """
    counts = df.groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    summed, _, total = running_totals(settle(counts), ["value"], "n", task_rows)
    if not total:
        return F.lit(0)
    level = F.expr(f"cast(before * {1 << bits} div {total} as int)")
    least = summed.filter("value is not null").groupBy(level.alias("level")).agg(F.min("value").alias("value"))
    found = least.orderBy("level").collect()
    if not found:
        return F.lit(0)
    values, levels = F.array(*[F.lit(r["value"]) for r in found]), F.array(*[F.lit(r["level"]) for r in found])
    below = F.size(F.filter(values, lambda v: v <= F.col(dim)))
    return F.when(F.col(dim).isNull(), F.lit(0)).otherwise(F.element_at(levels, below))


def curve_shards(
    df: DataFrame,
    dims: Sequence[str],
    size: Column,
    tie: Sequence[str] = (),
    shards: int = SHARDS,
    bits: int = BITS,
    law: str = "bytes",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(row, curve, shard, slot) for every row of ``df``: the row as a struct, its place on the curve, its shard and
    its place in the shard, from 0 without gaps.

    Rows are ordered along the curve over the levels of ``dims`` (columns of any ordered type; a null has the lowest
    level), then by the columns ``tie``, and cut into ``shards`` runs: of sizes that differ by less than one row's
    ``size`` at each cut (law ``bytes``; sizes are at least 1, null counts as 1), or of row counts at most one apart
    (``rows``). Rows that tie in all of these are interchangeable, so repeated rows may be cut apart. A hot cell of
    the curve, even one that holds all rows, spans as many tasks as any other rows. With fewer rows than shards
    some shards stay empty; an empty table gives an empty result. Names of columns do not matter.
    """
    assert law in LAWS
    given = df.select(
        F.struct("*").alias("row"),
        *[col(c).alias(f"d{k}") for k, c in enumerate(dims)],
        *[col(c).alias(f"t{k}") for k, c in enumerate(tie)],
        F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("bigint").alias("size"),
    )
    cell = [level_of(given, f"d{k}", bits, task_rows) for k in range(len(dims))]
    keys = [f"t{k}" for k in range(len(tie))]
    # The number tells rows apart that tie in everything else, so that no range is larger than others.
    on = given.select("row", "size", *keys, curve_index(cell, bits).alias("curve"), F.monotonically_increasing_id().alias("number"))
    placed, rows, total = running_totals(on, ["curve", *keys, "number"], "size", task_rows)
    most = {"rows": ("place", rows), "bytes": ("before", total)}[law]
    at = F.expr(f"cast({most[0]} * {shards} div {max(1, most[1])} as int)")
    cut = placed.select("row", "curve", "place", at.alias("shard"))
    # At most ``shards`` rows.
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))
    return cut.join(F.broadcast(first), "shard").select("row", "curve", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, path: str, dims: Sequence[str], size: Column, **options) -> None:
    """Write whole rows as Parquet, a folder per shard, in the order of the curve; a column beyond those of ``df``
    names the shard. Readers that filter on any of ``dims`` skip files by their least and largest values."""
    name = fresh_name(df, "shard")[0]
    found = curve_shards(df, dims, size, **options).withColumnRenamed("shard", "_shard_")
    # Sorted here: what the writer would sort by the shard alone loses the order inside it.
    done = found.repartition("_shard_", F.floor(F.col("slot") / TASK_ROWS)).sortWithinPartitions("_shard_", "slot")
    done.select("row.*", F.col("_shard_").alias(name)).write.partitionBy(name).parquet(path)
