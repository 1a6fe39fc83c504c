"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

# Fixed values of the contracts: a word is a run of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def fresh_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z in lower case. ``bytes.split`` and ``bytes.lower`` know ASCII only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), two bigint columns; component is the smallest node
    reachable.

    Large-star and small-star by turns: edges are hung on the smallest neighbour until nothing changes, in
    rounds that grow with the logarithm of the largest component. Only minima per node are aggregated, with
    map-side combine, so a node with very many edges is no bottleneck. Every round is a written table.
    """
    now = settle(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        small = small.select("a", F.col("low").alias("b")).unionByName(
            small.filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        now = settle(small.distinct())
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
