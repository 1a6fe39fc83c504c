"""Deals: unit prices ranked inside a category's dominant unit family, outliers capped.

All categories are handled in one pass; a single one is a filter on ``category_id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import COUNT_FAMILY, COUNT_UNIT, OUTLIER_FACTOR, WEIGHT_OR_VOLUME
from ..functions.size import is_weight_or_volume, total_size, unit_price
from ..session import settle
from .bucketed import offer_keys
from .category import keyword_category
from .skew import TASK_ROWS, broadcast_if_small, rank_in_groups

OFFER_COLUMNS = [
    "category_id",
    "master_key",
    "canonical_title",
    "brand",
    "source",
    "external_id",
    "price",
    "image_url",
    "product_url",
    "size_unit",
    "family",
    "total_size",
    "price_per_unit",
]
LINKS = ("image_url", "product_url")


def _tie_keys() -> list[Column]:
    return [F.col("source"), F.col("external_id")]


def deals_offers(masters: DataFrame, products: DataFrame, category_id: int | None = None) -> DataFrame:
    """Listings with a unit price, of all categorised masters or of one category.

    Masters without a usable size are dropped before the join. Links that the products come without are left out.
    """
    chosen = masters.filter(
        F.col("category_id").isNotNull()
        & F.col("size_value").isNotNull()
        & (F.col("size_value") != 0)
        & (F.col("pack_quantity") != 0)
    )
    if category_id is not None:
        chosen = chosen.filter(F.col("category_id") == category_id)
    keys = offer_keys(masters, products)
    chosen = chosen.select(*keys, "canonical_title", "brand", "category_id", "size_value", "size_unit", "pack_quantity")
    links = [c for c in LINKS if c in products.columns]
    linked = products.select(*keys, "source", "external_id", "price", *links)
    size_columns = [F.col("size_value"), F.col("size_unit"), F.col("pack_quantity")]
    return (
        linked.join(chosen, keys)
        .withColumn("total_size", total_size(F.col("size_value"), F.col("pack_quantity")))
        .withColumn("price_per_unit", unit_price(F.col("price"), *size_columns))
        .filter(F.col("price_per_unit").isNotNull())
        .withColumn(
            "family",
            F.when(is_weight_or_volume(F.col("size_unit")), WEIGHT_OR_VOLUME).when(
                F.col("size_unit") == COUNT_UNIT, COUNT_FAMILY
            ),
        )
        .select(*[c for c in OFFER_COLUMNS if c in links or c not in LINKS])
    )


def deals_for_text(masters: DataFrame, products: DataFrame, keyword_map: DataFrame, q: str) -> DataFrame:
    """Offers of the category that a search text stands for; empty when it stands for none."""
    wanted = keyword_category(q_frame(masters, q), keyword_map).select("category_id").filter("category_id is not null")
    return deals_offers(masters.join(F.broadcast(wanted), "category_id", "left_semi"), products)


def q_frame(like: DataFrame, q: str) -> DataFrame:
    return like.sparkSession.range(1).select(F.lit(q).alias("search_term"))


def size_ranges(folded: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(category_id, total_size, n) with ``part``, the number of the range of (category_id, total_size) a row lies in;
    ranges hold about ``task_rows`` rows, whatever the categories hold."""
    parts = math.ceil(folded.count() / task_rows)
    if parts <= 1:
        return folded.withColumn("part", F.lit(0))
    # Written with its number: bounds of ranges are sampled, a second computation might cut elsewhere.
    return settle(folded.repartitionByRange(parts, "category_id", "total_size").withColumn("part", F.spark_partition_id()))


def upper_medians(ranged: DataFrame, halves: DataFrame) -> DataFrame:
    """(category_id, median_size): the first size up to which there are more than ``half`` listings.

    Sums per range tell in which range of a category it lies; only that range is looked at row by row.
    """
    before = Window.partitionBy("category_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("category_id", "part").agg(F.sum("n").alias("inside"))
    placed = sums.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0))).join(halves, "category_id")
    holds = (F.col("before") <= F.col("half")) & (F.col("half") < F.col("before") + F.col("inside"))
    chosen = placed.filter(holds).select("category_id", "part", "before", "half")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("category_id").orderBy("total_size"))
    inside = ranged.join(broadcast_if_small(chosen), ["category_id", "part"]).withColumn("upto", upto)
    return inside.groupBy("category_id").agg(F.min(F.when(F.col("upto") > F.col("half"), F.col("total_size"))).alias("median_size"))


def family_stats(offers: DataFrame, outlier_factor: int = OUTLIER_FACTOR, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per category: listings per family, primary family, upper median size and outlier cap.

    Listings are folded to (category, family, size, n) first, and the median is looked for in one range of sizes, so
    that no task sees the listings, or all the sizes, of a large category.
    """
    folded = settle(
        offers.filter(F.col("family").isNotNull())
        .groupBy("category_id", "family", "total_size")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_family = lambda name: F.sum(F.when(F.col("family") == name, F.col("n")).otherwise(0))
    unit = F.when(F.col("n_weight") >= F.col("n_count"), WEIGHT_OR_VOLUME).otherwise(COUNT_FAMILY)
    totals = settle(
        folded.groupBy("category_id")
        .agg(in_family(WEIGHT_OR_VOLUME).alias("n_weight"), in_family(COUNT_FAMILY).alias("n_count"))
        .withColumn("primary_unit", unit)
        .withColumn("half", F.floor(F.greatest("n_weight", "n_count") / 2))
    )
    main = folded.join(broadcast_if_small(totals.select("category_id", "primary_unit")), "category_id").filter(
        F.col("family") == F.col("primary_unit")
    )
    ranged = size_ranges(main.select("category_id", "total_size", "n"), task_rows)
    medians = upper_medians(ranged, totals.select("category_id", "half"))
    return (
        totals.drop("half")
        .join(medians, "category_id", "left")
        .select("category_id", "primary_unit", "n_weight", "n_count", "median_size")
        .withColumn("cap", F.col("median_size") * outlier_factor)
    )


def split_sections(offers: DataFrame, stats: DataFrame) -> DataFrame:
    """Offers with their section: primary (capped) or other; outliers are dropped."""
    primary = F.col("family") == F.col("primary_unit")
    kept = ~primary | (F.col("cap") == 0) | (F.col("total_size") <= F.col("cap"))
    return (
        offers.filter(F.col("family").isNotNull())
        .join(broadcast_if_small(stats.select("category_id", "primary_unit", "cap")), "category_id")
        .filter(kept)
        .withColumn("section", F.when(primary, "primary").otherwise("other"))
        .drop("cap")
    )


def deals_ranked(sections: DataFrame, stats: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Primary offers numbered by unit price inside their category.

    ``stats`` should be settled; it tells which categories are too large for one task.
    """
    sizes = stats.select("category_id", F.greatest("n_weight", "n_count").alias("n"))
    order = [F.col("price_per_unit"), *_tie_keys()]
    return rank_in_groups(sections.filter(F.col("section") == "primary"), "category_id", order, sizes, task_rows=task_rows)


def deals_other_units(sections: DataFrame) -> DataFrame:
    """Offers of the family that is not compared, by unit price, not numbered."""
    return sections.filter(F.col("section") == "other").orderBy("category_id", "price_per_unit", *_tie_keys())


def deals(masters: DataFrame, products: DataFrame, category_id: int | None = None) -> DataFrame:
    """The whole answer: primary offers with rank, other offers without, told apart by ``section``.

    The joined offers are written once and read by the statistics and by both sections.
    """
    offers = settle(deals_offers(masters, products, category_id))
    stats = settle(family_stats(offers))
    sections = split_sections(offers, stats)
    other = sections.filter(F.col("section") == "other").withColumn("rank", F.lit(None).cast("bigint"))
    return deals_ranked(sections, stats).unionByName(other)


def deals_top(sections: DataFrame, k: int = 3) -> DataFrame:
    """The k best primary offers per category; each map task forwards at most k rows per category."""
    order = Window.partitionBy("category_id").orderBy("price_per_unit", *_tie_keys())
    return (
        sections.filter(F.col("section") == "primary")
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= k)
    )


def deals_brand_facet(sections: DataFrame) -> DataFrame:
    return (
        sections.filter((F.col("section") == "primary") & (F.col("brand") != ""))
        .select("category_id", "brand")
        .distinct()
        .orderBy("category_id", "brand")
    )


def deals_filter_sort(
    sections: DataFrame, stats: DataFrame, chosen_brands: Iterable[str] = (), sort_by: str = "unitPrice"
) -> DataFrame:
    """Primary offers of the chosen brands (none chosen: all) and all other offers, both sorted.

    Rank is counted after the brand filter, and only when sorting by unit price.
    """
    chosen = list(chosen_brands)
    wanted = F.col("brand").isin(chosen) if chosen else F.lit(True)
    kept = sections.filter((F.col("section") == "other") | wanted)
    if sort_by in ("price", "priceDesc"):
        ranked = kept.withColumn("rank", F.lit(None).cast("bigint"))
    else:
        other = kept.filter(F.col("section") == "other").withColumn("rank", F.lit(None).cast("bigint"))
        ranked = deals_ranked(kept, stats).unionByName(other)
    return ranked.orderBy("category_id", *sort_order(sort_by))


def sort_order(sort_by: str = "unitPrice") -> list[Column]:
    """Order of the offers of a category: primary before other, then by the sort word."""
    key = {"price": F.col("price").asc(), "priceDesc": F.col("price").desc()}.get(sort_by, F.col("price_per_unit").asc())
    return [F.desc("section"), key, *_tie_keys()]


def deals_places(found: DataFrame, sort_by: str = "unitPrice", task_rows: int = TASK_ROWS) -> DataFrame:
    """Found offers with ``place``, their number in their category in the order of the sort word."""
    sizes = settle(found.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")))
    return rank_in_groups(found, "category_id", sort_order(sort_by), sizes, "place", task_rows)
