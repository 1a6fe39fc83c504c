"""Table maintenance: upsert, links, category fill-in, raw map, review queue, run counts.

Each operator maps old table and changes to the new table; the caller writes it as a new version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import APPROVED, PENDING, REJECTED
from ..functions.keys import stable_key_md5

PRODUCT_KEY = ["source", "external_id"]
PRODUCT_COLUMNS = [
    "source",
    "external_id",
    "title",
    "image_url",
    "price",
    "regular_price",
    "product_url",
    "source_category",
    "last_updated",
    "master_key",
]
PRODUCT_SCHEMA = (
    "source string, external_id long, title string, image_url string, price decimal(18,2), "
    "regular_price decimal(18,2), product_url string, source_category string, last_updated timestamp, "
    "master_key string"
)
QUEUE_SCHEMA = "id long, raw_text string, suggested_id int, score double, status string"

_REPLACED = ["title", "image_url", "price", "regular_price", "source_category", "last_updated"]


def arrival() -> Column:
    """The order in which listings are handled: run, then term, source and place in the feed."""
    return F.struct("run_ts", "seq")


def upsert_latest(products: DataFrame | None, listings: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Merge listings into products by (source, external_id); the last listing wins.

    ``product_url`` stays as first inserted and the master link is kept. One aggregation with
    map-side combine, so a key that repeats in a third of all rows is folded before the shuffle.
    ``columns`` are those wanted besides the key and the link (none given: all); rows are sorted and
    shuffled with them alone, since Spark leaves no field out of a struct that it aggregates.
    """
    wanted = set(PRODUCT_COLUMNS if columns is None else (*PRODUCT_KEY, *columns, "master_key"))
    replaced = [c for c in _REPLACED if c in wanted] or ["price"]
    new = listings.select(
        *PRODUCT_KEY,
        F.struct(*[c if c != "last_updated" else F.col("run_ts").alias(c) for c in replaced]).alias("_row"),
        "product_url",
        F.lit(None).cast("string").alias("master_key"),
        F.struct(F.lit(1).alias("is_new"), F.col("run_ts").alias("ts"), F.col("seq")).alias("_at"),
    )
    if products is not None:
        no_seq = F.lit(None).cast(listings.schema["seq"].dataType)
        old = products.select(
            *PRODUCT_KEY,
            F.struct(*replaced).alias("_row"),
            "product_url",
            "master_key",
            F.struct(F.lit(0).alias("is_new"), F.col("last_updated").alias("ts"), no_seq.alias("seq")).alias("_at"),
        )
        new = old.unionByName(new)
    return (
        new.groupBy(*PRODUCT_KEY)
        .agg(
            F.max_by("_row", "_at").alias("_row"),
            # A struct keeps a first url that is null from being passed over.
            F.min_by(F.struct("product_url"), "_at").alias("_first"),
            F.max("master_key").alias("master_key"),
        )
        .select(*PRODUCT_KEY, "_row.*", "_first.product_url", "master_key")
        .select(*[c for c in PRODUCT_COLUMNS if c in wanted])
    )


def link_update(products: DataFrame, links: DataFrame) -> DataFrame:
    """Set the master of each linked product; products without a new link keep the old one."""
    new = links.select(*PRODUCT_KEY, F.col("master_key").alias("_new"))
    return products.join(new, PRODUCT_KEY, "left").withColumn(
        "master_key", F.coalesce("_new", "master_key")
    ).drop("_new")


def fill_category_once(masters: DataFrame, matches: DataFrame) -> DataFrame:
    """Give a master without category the first category that a matched listing brought.

    ``matches`` has master_key, category_id, run_ts and seq.
    """
    first = (
        matches.filter(F.col("category_id").isNotNull())
        .groupBy("master_key")
        .agg(F.min_by("category_id", arrival()).alias("_first"))
    )
    return masters.join(first, "master_key", "left").withColumn(
        "category_id", F.coalesce("category_id", "_first")
    ).drop("_first")


def rawmap_append(raw_map: DataFrame, accepted: DataFrame) -> DataFrame:
    """Remember accepted raw text -> category; texts already mapped stay as they are."""
    new = accepted.groupBy("raw_text").agg(F.min("category_id").alias("category_id"))
    return raw_map.unionByName(new.join(raw_map, "raw_text", "left_anti"))


def review_enqueue(queue: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Queue (raw text, best category, score) as pending unless the text is queued in any status."""
    new = (
        doubtful.groupBy("raw_text")
        .agg(F.max_by(F.struct("category_id", "score"), F.struct("score", -F.col("category_id"))).alias("best"))
        .join(queue, "raw_text", "left_anti")
        .select(
            stable_key_md5(F.col("raw_text")).alias("id"),
            "raw_text",
            F.col("best.category_id").alias("suggested_id"),
            F.col("best.score").alias("score"),
            F.lit(PENDING).alias("status"),
        )
    )
    return queue.unionByName(new)


def _decided(queue: DataFrame, decisions: DataFrame, action: str) -> DataFrame:
    ids = decisions.filter(F.col("action") == action).select("id").distinct()
    return queue.join(ids.withColumn("_hit", F.lit(True)), "id", "left")


def review_approve(queue: DataFrame, raw_map: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approve entries: suggestions go to the raw map, one row per text. Returns (queue, raw map)."""
    marked = _decided(queue, decisions, "approve")
    accepted = marked.filter(F.col("_hit") & F.col("suggested_id").isNotNull()).select(
        "raw_text", F.col("suggested_id").alias("category_id")
    )
    return _set_status(marked, APPROVED), rawmap_append(raw_map, accepted)


def review_reject(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    return _set_status(_decided(queue, decisions, "reject"), REJECTED)


def _set_status(marked: DataFrame, status: str) -> DataFrame:
    return marked.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def run_counts(appearances: DataFrame) -> DataFrame:
    """Fetched, saved-and-matched and failed listings per run and source.

    ``appearances`` has run_ts, source and ``matched`` (false or null for dropped listings).
    """
    ok = F.coalesce("matched", F.lit(False))
    return appearances.groupBy("run_ts", "source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(ok).alias("saved"), F.count_if(~ok).alias("failed")
    )
