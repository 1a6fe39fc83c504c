"""The registered queries: one per operator, over whole sample tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import display, keys, similarity, size, text
from ..operators import bucketed, catalog, category, deals, fuzzy, maintain, match, postings
from ..session import new_shared_path, settle
from ..sources import feeds
from ..sources.layouts import ACTIVE, FIELDS
from ..streaming import ingest_stream
from . import ingest
from . import sample_views as views
from .store import TableStore

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    """Add a query under its function name; decimals leave as doubles."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(
            *[
                F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                for f in df.schema
            ]
        )

    REGISTRY[fn.__name__] = run
    return run


def _catalog(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Masters, and products with these columns only if some are given."""
    return views.masters(spark, sf_dir), views.products(spark, sf_dir, *columns)


# Catalogue

#: Columns that offers are shown with.
_LISTED = ("price", "image_url", "product_url")


@register
def brands(spark, sf_dir):
    return catalog.brands(*_catalog(spark, sf_dir))


@register
def product_offers(spark, sf_dir):
    return catalog.product_offers(*_catalog(spark, sf_dir, *_LISTED))


@register
def product_offers_bucketed(spark, sf_dir):
    """Offers out of tables in buckets, masters with more than four listings in parts."""
    return catalog.product_offers(*bucketed.save_in_buckets(*_catalog(spark, sf_dir, *_LISTED), buckets=8, task_rows=4))


@register
def product_search(spark, sf_dir):
    return catalog.product_search(*_catalog(spark, sf_dir, "price", "image_url"))


@register
def search_text_filter(spark, sf_dir):
    return catalog.product_search(*_catalog(spark, sf_dir, "price", "image_url"), q=" WIDGET ")


@register
def search_brand_filter(spark, sf_dir):
    return catalog.product_search(*_catalog(spark, sf_dir, "price", "image_url"), brand="Brand#7")


@register
def search_price_having(spark, sf_dir):
    return catalog.product_search(*_catalog(spark, sf_dir, "price", "image_url"), min_price=Decimal("200"), max_price=Decimal("900.50"))


@register
def search_sort(spark, sf_dir):
    found = catalog.product_search(*_catalog(spark, sf_dir, "price", "image_url"), q="gear", sort="price_desc")
    return found.select("master_key", "canonical_title", "lowest_price")


def _search_order(spark: SparkSession, sf_dir: str, sort: str | None) -> DataFrame:
    found = catalog.search_places(catalog.product_search(*_catalog(spark, sf_dir, "price", "image_url"), sort=sort), sort)
    return found.select("master_key", "canonical_title", "lowest_price", "place")


@register
def search_order_price_asc(spark, sf_dir):
    return _search_order(spark, sf_dir, "price_asc")


@register
def search_order_price_desc(spark, sf_dir):
    return _search_order(spark, sf_dir, "price_desc")


@register
def search_order_name_asc(spark, sf_dir):
    return _search_order(spark, sf_dir, None)


@register
def search_order_name_desc(spark, sf_dir):
    return _search_order(spark, sf_dir, "name_desc")


@register
def category_counts(spark, sf_dir):
    return catalog.category_counts(views.categories(spark), views.masters(spark, sf_dir))


@register
def review_pending(spark, sf_dir):
    return catalog.review_pending(views.review_queue(spark, sf_dir), views.categories(spark))


@register
def cheapest_offer_flag(spark, sf_dir):
    return catalog.cheapest_offer_flag(views.products(spark, sf_dir, "price")).select(
        "master_key", "source", "external_id", "price", "is_cheapest"
    )


#: Bounds so small that the ways for very large groups are taken on the sample tables too.
SMALL_TASK, NO_FOLD = 500, 0


@register
def cheapest_offer_flag_salted(spark, sf_dir):
    flagged = catalog.cheapest_offer_flag(views.products(spark, sf_dir, "price"), task_rows=2)
    return flagged.select("master_key", "source", "external_id", "price", "is_cheapest")


# Unit prices and deals


@register
def unit_price(spark, sf_dir):
    offers = deals.deals_offers(*_catalog(spark, sf_dir, "price"))
    return offers.select(
        "source", "external_id", "total_size", F.round(F.col("price_per_unit").cast("double"), 6).alias("price_per_unit")
    )


@register
def unit_label(spark, sf_dir):
    return views.masters(spark, sf_dir).select("master_key", size.unit_label(F.col("size_unit")).alias("unit_label"))


@register
def price_display(spark, sf_dir):
    queue = views.review_queue(spark, sf_dir)
    shown = views.products(spark, sf_dir, "price").select(
        F.concat_ws("/", "source", F.col("external_id").cast("string")).alias("item"),
        display.price_display(F.col("price")).alias("shown"),
    )
    return shown.unionByName(
        queue.select(F.concat(F.lit("review/"), F.col("id").cast("string")).alias("item"), display.percent_display(F.col("score")).alias("shown"))
    )


def _sections(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Offers by section, and statistics; the offers are written once, with these columns only if some are given."""
    offers = deals.deals_offers(*_catalog(spark, sf_dir, "price"))
    offers = settle(offers.select(*columns) if columns else offers)
    stats = settle(deals.family_stats(offers))
    return deals.split_sections(offers, stats), stats


_DEAL = ["category_id", "source", "external_id", "canonical_title", "brand", "price", "size_unit", "total_size", "price_per_unit", "family"]
_OFFER = ["category_id", "source", "external_id", "canonical_title", "brand", "price", "size_unit"]


def _offer(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*_OFFER, "total_size", F.round(F.col("price_per_unit").cast("double"), 6).alias("price_per_unit"), *more)


@register
def deals_offers(spark, sf_dir):
    return _offer(deals.deals_offers(*_catalog(spark, sf_dir, *_LISTED)), "master_key", "image_url", "product_url")


@register
def deals_offers_bucketed(spark, sf_dir):
    stored = bucketed.save_in_buckets(*_catalog(spark, sf_dir, *_LISTED), buckets=8, task_rows=4)
    return _offer(deals.deals_offers(*stored), "master_key", "image_url", "product_url")


@register
def deals_by_text(spark, sf_dir):
    return _offer(deals.deals_for_text(*_catalog(spark, sf_dir, "price"), views.keyword_map(spark), "Gizmo"))


@register
def deals_family_split(spark, sf_dir):
    stats = deals.family_stats(deals.deals_offers(*_catalog(spark, sf_dir, "price")))
    return stats.select("category_id", "primary_unit", "n_weight", "n_count")


@register
def deals_median_cap(spark, sf_dir):
    stats = deals.family_stats(deals.deals_offers(*_catalog(spark, sf_dir, "price")))
    return stats.select("category_id", "median_size", "cap")


@register
def deals_median_split(spark, sf_dir):
    """The same with sizes dealt to ranges of a few rows."""
    stats = deals.family_stats(deals.deals_offers(*_catalog(spark, sf_dir, "price")), task_rows=20)
    return stats.select("category_id", "median_size", "cap")


@register
def deals_ranked(spark, sf_dir):
    return _offer(deals.deals_ranked(*_sections(spark, sf_dir, *_DEAL)), "rank")


@register
def deals_ranked_split(spark, sf_dir):
    return _offer(deals.deals_ranked(*_sections(spark, sf_dir, *_DEAL), task_rows=SMALL_TASK), "rank")


@register
def deals_other_units(spark, sf_dir):
    return _offer(deals.deals_other_units(_sections(spark, sf_dir, *_DEAL)[0]))


@register
def deals_by_category(spark, sf_dir):
    return _offer(deals.deals(*_catalog(spark, sf_dir, "price")), "section", "primary_unit", "rank")


@register
def deals_brand_facet(spark, sf_dir):
    return deals.deals_brand_facet(_sections(spark, sf_dir, "category_id", "family", "total_size", "brand")[0])


@register
def deals_filter_sort(spark, sf_dir):
    sections, stats = _sections(spark, sf_dir, *_DEAL)
    return _offer(deals.deals_filter_sort(sections, stats, ["Brand#3", "Brand#7", "Unknown"]), "section", "rank")


def _sorted_deals(spark: SparkSession, sf_dir: str, sort_by: str) -> DataFrame:
    found = deals.deals_filter_sort(*_sections(spark, sf_dir, *_DEAL), sort_by=sort_by)
    return _offer(deals.deals_places(found, sort_by), "section", "place")


@register
def deals_sort_price(spark, sf_dir):
    return _sorted_deals(spark, sf_dir, "price")


@register
def deals_sort_price_desc(spark, sf_dir):
    return _sorted_deals(spark, sf_dir, "priceDesc")


@register
def deals_top3(spark, sf_dir):
    return _offer(deals.deals_top(_sections(spark, sf_dir, *_DEAL)[0]), "rank")


# Text


@register
def normalize_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@register
def tokenize(spark, sf_dir):
    tokens = views.table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@register
def tokenize_title(spark, sf_dir):
    tokens = text.tokenize_title(F.concat_ws(" ", "brand", "title", "raw_category"), F.col("brand"))
    return views.titles(spark, sf_dir).select("p_partkey", F.array_join(tokens, " ").alias("tokens"))


@register
def alias_expand(spark, sf_dir):
    renamed = F.replace(F.replace(F.col("title"), F.lit("gear"), F.lit("Kalem")), F.lit("rod"), F.lit("kalem"))
    return views.titles(spark, sf_dir).select("p_partkey", text.alias_expand(renamed).alias("title"))


@register
def extract_size(spark, sf_dir):
    sized = views.titles(spark, sf_dir).withColumn("_size", size.extract_size(F.col("title")))
    return sized.select("p_partkey", "title", "_size.size_value", "_size.size_unit", "_size.pack_quantity")


@register
def default_brand(spark, sf_dir):
    return views.titles(spark, sf_dir).select("p_partkey", text.default_brand(F.col("brand")).alias("brand"))


# Similarity and categories


def _vocabulary(df: DataFrame) -> DataFrame:
    return df.select(F.explode(text.tokenize(F.col("text"))).alias("token")).distinct()


@register
def fuzzy_token_join(spark, sf_dir):
    texts = _vocabulary(views.table(spark, sf_dir, "documents"))
    return fuzzy.fuzzy_token_join(texts, _vocabulary(views.table(spark, sf_dir, "benchmark")))


@register
def token_set_score(spark, sf_dir):
    listings = views.listings(spark, sf_dir).withColumn("master_key", F.col("external_id").cast("string"))
    named = views.masters(spark, sf_dir).select("master_key", "canonical_title")
    brand = text.default_brand(F.col("brand"))
    return (
        listings.join(named, "master_key")
        .select(
            "source",
            "seq.pos",
            text.tokenize_title(F.col("canonical_title"), brand).alias("first"),
            text.tokenize_title(F.col("title"), brand).alias("second"),
        )
        .select(
            "source",
            "pos",
            F.round(similarity.token_set_score(F.col("first"), F.col("second"), True), 9).alias("score"),
        )
    )


@register
def keyword_category(spark, sf_dir):
    found = category.keyword_category(views.listings(spark, sf_dir), views.keyword_map(spark))
    return found.select("source", "seq.pos", "search_term", "category_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(category.distinct_texts(views.listings(spark, sf_dir)))


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.category_best_guess(_texts(spark, sf_dir), views.categories(spark))


def _resolved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.resolve_texts(
        _texts(spark, sf_dir), views.categories(spark), views.raw_map(spark), views.queue_seed(spark)
    )


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.resolve_category(
        views.listings(spark, sf_dir), views.keyword_map(spark), settle(_resolved_texts(spark, sf_dir))
    )


@register
def raw_category_lookup(spark, sf_dir):
    return category.raw_category_lookup(_texts(spark, sf_dir), views.raw_map(spark))


@register
def rejected_anti(spark, sf_dir):
    return category.rejected_anti(_texts(spark, sf_dir), views.queue_seed(spark))


@register
def category_best_guess(spark, sf_dir):
    return _guesses(spark, sf_dir).withColumn("score", F.round("score", 9))


@register
def category_route(spark, sf_dir):
    return category.category_route(_guesses(spark, sf_dir)).select("raw_text", "category_id", "route")


@register
def resolve_category(spark, sf_dir):
    return _resolved(spark, sf_dir).select("source", "seq.pos", "keyword_id", "resolved_id", "category_id")


@register
def false_positive_filter(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "source", "seq.pos", "category_id", category.is_false_positive().alias("dropped")
    )


# Table maintenance


def _product_columns(df: DataFrame) -> DataFrame:
    seen = F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated")
    return df.select(
        "source", "external_id", "title", "price", "regular_price", "image_url", "source_category", "product_url", seen
    )


@register
def upsert_latest(spark, sf_dir):
    listings = views.listings(spark, sf_dir)
    turn = F.lit("2000-01-01").cast("timestamp")
    before = maintain.upsert_latest(None, listings.filter(F.col("run_ts") < turn))
    return _product_columns(maintain.upsert_latest(before, listings.filter(F.col("run_ts") >= turn)))


@register
def link_update(spark, sf_dir):
    key = F.col("external_id").cast("string")
    stored = views.products(spark, sf_dir, "price").withColumn(
        "master_key", F.when(F.col("external_id") % 3 == 0, F.concat(F.lit("old-"), key))
    )
    links = stored.filter(F.col("price") < 500).select("source", "external_id", key.alias("master_key"))
    return maintain.link_update(stored, links).select("source", "external_id", "master_key")


@register
def fill_category_once(spark, sf_dir):
    masters = views.masters(spark, sf_dir).withColumn(
        "category_id", F.when(F.col("brand") == "Unknown", F.col("category_id"))
    )
    matches = views.listings(spark, sf_dir).select(
        F.col("external_id").cast("string").alias("master_key"),
        F.when(F.col("seq.source_pos") % 4 > 0, F.col("seq.source_pos") % 7 + 1).alias("category_id"),
        "run_ts",
        "seq",
    )
    return maintain.fill_category_once(masters, matches).select("master_key", "category_id")


@register
def rawmap_append(spark, sf_dir):
    accepted = _resolved_texts(spark, sf_dir).filter(F.col("route") == "accept")
    return maintain.rawmap_append(views.raw_map(spark), accepted.select("raw_text", "category_id"))


@register
def review_enqueue(spark, sf_dir):
    doubtful = _resolved_texts(spark, sf_dir).filter(F.col("route") == "review")
    doubtful = doubtful.select("raw_text", F.col("guess_id").alias("category_id"), "score")
    return maintain.review_enqueue(views.queue_seed(spark), doubtful).withColumn("score", F.round("score", 9))


def _decisions(queue: DataFrame) -> DataFrame:
    action = F.when(F.col("id") % 3 == 0, "reject").when(F.col("id") % 2 == 0, "approve")
    return queue.select("id", action.alias("action")).filter(F.col("action").isNotNull())


@register
def review_approve(spark, sf_dir):
    queue = views.review_queue(spark, sf_dir)
    after, mapped = maintain.review_approve(queue, views.raw_map(spark), _decisions(queue))
    return after.select("raw_text", F.col("suggested_id").alias("category_id"), "status").unionByName(
        mapped.select("raw_text", "category_id", F.lit("in raw map").alias("status"))
    )


@register
def review_reject(spark, sf_dir):
    queue = views.review_queue(spark, sf_dir)
    return maintain.review_reject(queue, _decisions(queue)).select("id", "raw_text", "status")


@register
def run_counts(spark, sf_dir):
    seen = _resolved(spark, sf_dir).withColumn("matched", ~category.is_false_positive())
    return maintain.run_counts(seen).withColumn("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"))


# Entity matching


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.prepare_listings(views.listings(spark, sf_dir))


@register
def candidate_blocking(spark, sf_dir):
    stored = match.prepare_masters(views.stored_masters(spark, sf_dir))
    found = match.candidate_blocking(_prepared(spark, sf_dir), stored)
    return found.select("source", "seq.pos", "n_candidates", "oldest_master")


@register
def best_match(spark, sf_dir):
    stored = match.prepare_masters(views.stored_masters(spark, sf_dir))
    found = match.best_match(_prepared(spark, sf_dir), stored)
    return found.select("source", "seq.pos", "master_key", F.round("score", 9).alias("score"))


@register
def best_match_joined(spark, sf_dir):
    stored = match.prepare_masters(views.stored_masters(spark, sf_dir))
    found = match.best_match(_prepared(spark, sf_dir), stored, fold_bytes=NO_FOLD)
    return found.select("source", "seq.pos", "master_key", F.round("score", 9).alias("score"))


@register
def best_match_indexed(spark, sf_dir):
    """Out of the token index that a store keeps of its masters, half of them added to it later."""
    stored = match.prepare_masters(views.stored_masters(spark, sf_dir))
    store = TableStore(spark, new_shared_path(spark, "index"))
    for version, half in enumerate((stored.filter("pmod(xxhash64(master_key), 2) = 0"), stored.filter("pmod(xxhash64(master_key), 2) = 1")), 1):
        half = settle(half)
        old = {name: store.read(name, store.touched(name, half)) for name in postings.TABLES}
        store.commit(version, postings.merge_index(old, postings.index_masters(half)))
    found = postings.best_match_indexed(_prepared(spark, sf_dir), {name: store.read(name) for name in postings.TABLES})
    return found.select("source", "seq.pos", "master_key", F.round("score", 9).alias("score"))


@register
def assign_masters_joined(spark, sf_dir):
    found = match.assign_masters(_prepared(spark, sf_dir), fold_bytes=NO_FOLD)
    return found.select("source", "seq.pos", "master_key", "founds")


@register
def assign_masters(spark, sf_dir):
    found = match.assign_masters(_prepared(spark, sf_dir))
    return found.select("source", "seq.pos", "master_key", "founds")


@register
def assign_masters_stored(spark, sf_dir):
    """A second run: the masters that the listings of the first years left, then the listings after."""
    listings, turn = views.listings(spark, sf_dir), F.lit("1996-01-01").cast("timestamp")
    first = match.assign_masters(match.prepare_listings(listings.filter(F.col("run_ts") < turn)))
    stored = settle(match.new_masters(first.withColumn("category_id", F.lit(None).cast("int"))))
    later = match.prepare_listings(listings.filter(F.col("run_ts") >= turn))
    found = match.assign_masters(later, match.prepare_masters(stored))
    return found.select("source", "seq.pos", "master_key", "founds")


@register
def match_products(spark, sf_dir):
    found = match.match_products(
        views.listings(spark, sf_dir),
        None,
        views.categories(spark),
        views.keyword_map(spark),
        views.raw_map(spark),
        views.queue_seed(spark),
        columns=(),
    )
    links = found["links"].select(
        F.lit("link").alias("kind"),
        F.concat_ws("/", "source", F.col("external_id").cast("string")).alias("item"),
        "master_key",
        F.lit(None).cast("int").alias("category_id"),
    )
    return links.unionByName(
        found["masters"].select(F.lit("master").alias("kind"), F.col("canonical_title").alias("item"), "master_key", "category_id")
    )


# Feeds


def _listed(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    found, _ = feeds.feed_union(views.raw_feed(spark, sf_dir, sources), sources)
    return found.select("source", "search_term", F.col("seq.pos").alias("pos"), *FIELDS)


@register
def feed_flatten_nested(spark, sf_dir):
    return _listed(spark, sf_dir, "migros", "macrocenter", "mion", "marketfiyati", "evidea")


@register
def feed_root_or_data_array(spark, sf_dir):
    return _listed(spark, sf_dir, "cagrimarket")


@register
def feed_find_array(spark, sf_dir):
    return _listed(spark, sf_dir, "hakmarexpress")


@register
def array_first_field(spark, sf_dir):
    found = _listed(spark, sf_dir, "migros", "marketfiyati", "evidea")
    return found.select("source", "search_term", "pos", "image_url", "price")


@register
def array_last_field(spark, sf_dir):
    return _listed(spark, sf_dir, "hakmarexpress").select("external_id", "source_category")


@register
def array_key_lookup(spark, sf_dir):
    return _listed(spark, sf_dir, "evidea").select("search_term", "pos", "external_id")


@register
def minor_units_price(spark, sf_dir):
    found = _listed(spark, sf_dir, "migros", "macrocenter", "mion")
    return found.select("source", "external_id", "price", "regular_price")


@register
def regular_price_fallback(spark, sf_dir):
    found = _listed(spark, sf_dir, "hakmarexpress", "evidea", "cagrimarket", "marketfiyati")
    return found.select("source", "search_term", "pos", "price", "regular_price")


@register
def stable_key_md5(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", keys.stable_key_md5(F.col("text")).alias("stable_key"))


@register
def slug_url(spark, sf_dir):
    links = _listed(spark, sf_dir, "marketfiyati").select(F.lit("url").alias("kind"), "product_url")
    texts = views.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), text.slug(F.col("text")).alias("product_url"))
    return links.unionByName(texts)


@register
def url_template(spark, sf_dir):
    found = _listed(spark, sf_dir, "migros", "macrocenter", "mion", "hakmarexpress")
    return found.select("source", "external_id", "product_url")


@register
def feed_quarantine(spark, sf_dir):
    parsed = feeds.union_parsed(views.raw_feed(spark, sf_dir), views.FEED_SOURCES)
    return parsed.select("source", "search_term", "pos", F.coalesce("reason", F.lit("good")).alias("outcome"))


@register
def feed_union(spark, sf_dir):
    found, _ = feeds.feed_union(views.raw_feed(spark, sf_dir, ACTIVE))
    return found.select("source", "seq.term_pos", "seq.source_pos", "seq.pos", "external_id", "title", "price")


# Whole runs


@register
def ingest_run(spark, sf_dir):
    state = ingest.ingest_run(
        views.raw_feed(spark, sf_dir, ACTIVE),
        None,
        None,
        views.raw_map(spark),
        views.queue_seed(spark),
        views.categories(spark),
        views.keyword_map(spark),
    )
    named = state["masters"].select("master_key", "category_id")
    return state["products"].join(named, "master_key").select(
        "source", "external_id", "title", "price", "product_url", "master_key", "category_id"
    )


@register
def stream_ingest(spark, sf_dir):
    """Landed feeds through the whole run, as micro-batches into a store."""
    landing = new_shared_path(spark, "landing")
    views.raw_feed(spark, sf_dir, ACTIVE).write.parquet(landing)
    store = TableStore(spark, new_shared_path(spark, "stream-ingest"))
    ingest_stream.stream_ingest(
        ingest_stream.feed_stream(spark, landing),
        store,
        views.categories(spark),
        views.keyword_map(spark),
        views.raw_map(spark),
        views.queue_seed(spark),
        once=True,
    ).awaitTermination()
    named = store.read("masters").select("master_key", "category_id")
    return store.read("products").join(named, "master_key").select(
        "source", "external_id", "title", "price", "product_url", "master_key", "category_id"
    )


@register
def stream_upsert(spark, sf_dir):
    store = TableStore(spark, new_shared_path(spark, "stream-upsert"))
    schema = views.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest_stream.stream_upsert(views.event_listings(events), store, once=True).awaitTermination()
    return _product_columns(store.read("products")).drop("image_url")
