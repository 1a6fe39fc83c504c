"""Catalogue queries over masters and products."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import PENDING
from ..functions.text import brand_key, lower_text
from ..session import settle
from .bucketed import offer_keys
from .skew import TASK_ROWS, broadcast_if_small, rank_in_groups, salted_join


def brands(masters: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct non-empty brands of masters with at least one listing, sorted."""
    linked = products.filter(F.col("master_key").isNotNull()).select("master_key").distinct()
    return (
        masters.filter(F.col("brand").isNotNull() & (F.col("brand") != ""))
        .join(linked, "master_key", "left_semi")
        .select("brand")
        .distinct()
        .orderBy("brand")
    )


def product_offers(masters: DataFrame, products: DataFrame, master_key: str | int | None = None) -> DataFrame:
    """Listings of a master (or of all), cheapest first."""
    if master_key is not None:
        masters = masters.filter(F.col("master_key") == F.lit(master_key))
        products = products.filter(F.col("master_key") == F.lit(master_key))
    keys = offer_keys(masters, products)
    return (
        products.join(masters.select(*keys, "canonical_title"), keys)
        .select("master_key", "canonical_title", "source", "external_id", "price", "image_url", "product_url")
        .orderBy("master_key", "price", "source", "external_id")
    )


def cheapest_offer_flag(products: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Mark the first offer by price of each master.

    The minimum is folded before the shuffle and joined back, where a window would gather a
    popular master in one task; masters with very many offers are salted. Products are written
    once, since both sides come from them.
    """
    linked = settle(products.filter(F.col("master_key").isNotNull()))
    place = F.struct("price", "source", "external_id")
    first = settle(linked.groupBy("master_key").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")))
    hot = first.filter(F.col("_n") > task_rows).select(
        "master_key", F.ceil(F.col("_n") / task_rows).cast("int").alias("_salts")
    )
    joined = salted_join(linked, first.drop("_n"), ["master_key"], task_rows=task_rows, hot=hot)
    return joined.withColumn("is_cheapest", place == F.col("_first")).drop("_first")


def text_filter(masters: DataFrame, q: str | None) -> DataFrame:
    """Masters whose title or brand contains the trimmed text, case-blind; blank keeps all."""
    if q is None or not q.strip():
        return masters
    needle = lower_text(F.lit(q.strip()))
    return masters.filter(
        F.contains(lower_text(F.col("canonical_title")), needle) | F.contains(lower_text(F.col("brand")), needle)
    )


def brand_filter(masters: DataFrame, brand: str | None) -> DataFrame:
    if brand is None or not brand.strip():
        return masters
    return masters.filter(brand_key(F.col("brand")) == brand_key(F.lit(brand)))


def price_having(grouped: DataFrame, min_price: Decimal | None, max_price: Decimal | None) -> DataFrame:
    """Inclusive bounds on a master's lowest price."""
    if min_price is not None:
        grouped = grouped.filter(F.col("lowest_price") >= F.lit(min_price))
    if max_price is not None:
        grouped = grouped.filter(F.col("lowest_price") <= F.lit(max_price))
    return grouped


def sort_keys(sort: str | None) -> list[Column]:
    """Sort word to order; name up by default and for unknown words. The key makes it total."""
    first = {
        "price_desc": F.col("lowest_price").desc(),
        "price_asc": F.col("lowest_price").asc(),
        "name_desc": F.col("canonical_title").desc(),
    }.get(sort, F.col("canonical_title").asc())
    return [first, F.col("master_key").asc()]


def product_search(
    masters: DataFrame,
    products: DataFrame,
    q: str | None = None,
    brand: str | None = None,
    sort: str | None = None,
    min_price: Decimal | None = None,
    max_price: Decimal | None = None,
) -> DataFrame:
    """Masters with lowest price, number of listings and one image.

    Listings are folded per master before the join: one row per master crosses it. With a text or a
    brand given, listings of other masters are left out before they are folded.
    """
    chosen = brand_filter(text_filter(masters, q), brand).select("master_key", "canonical_title", "brand")
    listed = products.filter(F.col("master_key").isNotNull())
    if any(x and x.strip() for x in (q, brand)):
        chosen = settle(chosen)
        listed = listed.join(broadcast_if_small(chosen.select("master_key")), "master_key", "left_semi")
    per_master = (
        listed
        .groupBy("master_key")
        .agg(
            F.min("price").alias("lowest_price"),
            F.count(F.lit(1)).alias("offer_count"),
            F.max("image_url").alias("image_url"),
        )
    )
    return chosen.join(price_having(per_master, min_price, max_price), "master_key").orderBy(*sort_keys(sort))


def category_counts(categories: DataFrame, masters: DataFrame) -> DataFrame:
    """Root categories with their number of masters, empty ones left out, in display order."""
    counted = masters.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("product_count"))
    return (
        categories.filter(F.col("parent_id").isNull())
        .join(counted, "id", "left")
        .filter(F.col("product_count") > 0)
        .orderBy("display_order", "id")
        .select("id", "name", "slug", "icon", "product_count")
    )


def review_pending(queue: DataFrame, categories: DataFrame) -> DataFrame:
    """Pending review entries with the suggested category's name, best score first."""
    names = categories.select(F.col("id").alias("suggested_id"), F.col("name").alias("suggested_category"))
    return (
        queue.filter(F.col("status") == PENDING)
        .join(broadcast_if_small(names), "suggested_id", "left")
        .select("id", "raw_text", "score", "suggested_category", "suggested_id")
        .orderBy(F.desc("score"), "id")
    )


def search_places(found: DataFrame, sort: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Found masters with ``place``, their number in the order of the sort word."""
    alone = found.withColumn("_all", F.lit(0))
    sizes = settle(alone.groupBy("_all").agg(F.count(F.lit(1)).alias("n")))
    return rank_in_groups(alone, "_all", sort_keys(sort), sizes, "place", task_rows).drop("_all")
