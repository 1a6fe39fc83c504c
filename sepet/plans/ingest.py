"""One ingest run: feeds to listings, products, masters, raw map and review queue."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.category import distinct_texts
from ..operators.maintain import link_update, rawmap_append, review_enqueue, run_counts, upsert_latest
from ..operators import postings
from ..operators.match import match_products, prepare_masters
from ..session import settle, settling
from ..sources.feeds import good_listings, quarantine, union_parsed
from ..sources.layouts import ACTIVE
from .store import TableStore


def ingest_run(
    feeds: DataFrame,
    products: DataFrame | None,
    masters: DataFrame | None,
    raw_map: DataFrame,
    queue: DataFrame,
    categories: DataFrame,
    keyword_map: DataFrame,
    sources: Iterable[str] = ACTIVE,
    **options,
) -> dict[str, DataFrame]:
    """New state of all tables, with this run's ``quarantine``, ``counts`` and ``founded`` masters."""
    parsed = settle(union_parsed(feeds, sources))
    return ingest_parsed(parsed, products, masters, raw_map, queue, categories, keyword_map, **options)


def ingest_parsed(
    parsed: DataFrame,
    products: DataFrame | None,
    masters: DataFrame | Callable[[DataFrame], DataFrame | None] | None,
    raw_map: DataFrame,
    queue: DataFrame,
    categories: DataFrame,
    keyword_map: DataFrame,
    **options,
) -> dict[str, DataFrame]:
    """``ingest_run`` on parsed feeds. State tables may be parts that hold all that the listings ask for; what comes
    back then is the new state of those parts. ``masters`` may be asked for by blocks."""
    listings = good_listings(parsed)
    matched = match_products(listings, masters, categories, keyword_map, raw_map, queue, columns=(), **options)
    texts = matched["texts"]
    accepted = texts.filter(F.col("route") == "accept").select("raw_text", "category_id")
    doubtful = texts.filter(F.col("route") == "review").select(
        "raw_text", F.col("guess_id").alias("category_id"), "score"
    )
    seen = ["run_ts", "source"]
    outcome = (
        matched["assigned"].select(*seen, F.lit(True).alias("matched"))
        .unionByName(matched["dropped"].select(*seen, F.lit(False).alias("matched")))
        .unionByName(matched["unmatched"].select(*seen, F.lit(False).alias("matched")))
    )
    return {
        "products": link_update(upsert_latest(products, listings), matched["links"]),
        "masters": matched["masters"],
        "founded": matched["founded"],
        "raw_map": rawmap_append(raw_map, accepted),
        "queue": review_enqueue(queue, doubtful),
        "guesses": matched["guesses"],
        "quarantine": quarantine(parsed),
        "counts": run_counts(outcome),
    }


def ingest_into(
    store: TableStore,
    version: int,
    feeds: DataFrame,
    categories: DataFrame,
    keyword_map: DataFrame,
    first_raw_map: DataFrame,
    first_queue: DataFrame,
    sources: Iterable[str] = ACTIVE,
    **options,
) -> None:
    """Run on the buckets of a store that the feeds touch; a committed run is not repeated."""
    if not store.begin(version):
        return
    with settling(store.spark):
        parsed = settle(union_parsed(feeds, sources))
        listings = good_listings(parsed)
        texts = settle(distinct_texts(listings))
        part = lambda name, rows: store.read(name, store.touched(name, rows))
        raw_map, queue = part("raw_map", texts), part("queue", texts)
        after = ingest_parsed(
            parsed,
            part("products", listings),
            lambda blocks: part("masters", blocks),
            first_raw_map if raw_map is None else raw_map,
            first_queue if queue is None else queue,
            categories,
            keyword_map,
            memo=part("guesses", texts),
            **options,
        )
        # What this run founded goes into the index, in the buckets of its blocks.
        founded = settle(prepare_masters(after["founded"]))
        old = {name: part(name, founded) for name in postings.TABLES}
        index = postings.merge_index(old, postings.index_masters(founded))
        store.commit(version, {**{name: df for name, df in after.items() if name != "founded"}, **index})
    store.expire()
