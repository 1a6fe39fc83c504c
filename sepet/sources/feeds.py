"""From landed feed documents to listings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layouts import ACTIVE, FIELDS, LAYOUTS, PRICE, Layout

FEED_SCHEMA = (
    "run_ts timestamp, source string, search_term string, term_pos int, source_pos int, payload string"
)
_BAD = "_bad"
_TYPES = {"external_id": "bigint", "price": PRICE, "regular_price": PRICE}
_FEED = ["run_ts", "source", "search_term", "term_pos", "source_pos"]


def read_feeds(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Landed feeds of any built-in format; folders by source are pruned when only some are asked."""
    return spark.read.schema(FEED_SCHEMA).format(kind).load(path)


def write_feeds(feeds: DataFrame, path: str, kind: str = "parquet") -> None:
    feeds.write.format(kind).mode("append").partitionBy("source").save(path)


def parse_feeds(feeds: DataFrame, layout: Layout) -> DataFrame:
    """Listings of one shop, with ``reason`` set on what has to go to quarantine.

    The failure unit is the item; a document that cannot be read yields one row.
    """
    own = feeds.filter(F.col("source") == layout.source)
    payload = "payload"
    if layout.search is not None:
        payload = "_found"
        own = layout.search(own, "payload", payload)
    opened = own.withColumn("_doc", layout.envelope.parse(F.col(payload)))
    items, readable = layout.envelope.items(F.col("_doc")), layout.envelope.readable(F.col("_doc"))
    # A payload that is null, or a search that found nothing, gives no document.
    readable = (F.col(payload).isNotNull() if layout.search is None else F.lit(True)) & readable
    opened = opened.select(*_FEED, "payload", items.alias("_items"), readable.alias("_readable")).withColumn(
        "_why",
        F.when(~F.col("_readable"), "not readable").when(
            F.lit(layout.missing_is_error) & F.col("_items").isNull(), "no product list"
        ),
    )
    # A readable document without list leaves no row, one with a fault leaves one.
    items = F.when(F.col("_why").isNotNull(), F.array(F.col("payload"))).otherwise(F.col("_items"))
    schema = f"{layout.item}, {_BAD} string"
    # Parsed before they are dealt to rows: a filter on what is in an item would be pushed below and parse it again.
    read = F.transform(items, lambda t: F.struct(t.alias("text"), F.from_json(t, schema, {"columnNameOfCorruptRecord": _BAD}).alias("item")))
    exploded = opened.select(*_FEED, "_why", F.posexplode(read).alias("pos", "one"))
    parsed = exploded.select(*_FEED, "_why", "pos", "one.text", F.col("one.item").alias("_item"))
    item = F.col("_item")
    broken = item.isNull() | item[_BAD].isNotNull()
    if layout.keep is not None:
        parsed = parsed.filter(F.col("_why").isNotNull() | broken | layout.keep(item))
    made = layout.columns(item)
    values = [made.get(f, F.lit(None)).cast(_TYPES.get(f, "string")).alias(f) for f in FIELDS]
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in layout.required])
    return (
        parsed.select(*_FEED, "pos", "text", "_why", broken.alias("_broken"), *values)
        .withColumn(
            "reason",
            F.coalesce("_why", F.when(F.col("_broken"), "item not readable"), F.when(incomplete, "item incomplete")),
        )
        .drop("_why", "_broken")
    )


def good_listings(parsed: DataFrame) -> DataFrame:
    """The listing record: where it was seen, in which order, and its fields."""
    return parsed.filter(F.col("reason").isNull()).select(
        "source",
        "search_term",
        "run_ts",
        F.struct("term_pos", "source_pos", F.col("pos").cast("bigint").alias("pos")).alias("seq"),
        *FIELDS,
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select(*_FEED, "pos", "text", "reason")


def union_parsed(feeds: DataFrame, sources: Iterable[str] = ACTIVE) -> DataFrame:
    """All sources x search terms as one set, good and bad."""
    return reduce(DataFrame.unionByName, [parse_feeds(feeds, LAYOUTS[s]) for s in sources])


def feed_union(feeds: DataFrame, sources: Iterable[str] = ACTIVE) -> tuple[DataFrame, DataFrame]:
    """(listings, quarantine) of the given sources; order is term, source, place in the list."""
    parsed = union_parsed(feeds, sources)
    return good_listings(parsed), quarantine(parsed)
