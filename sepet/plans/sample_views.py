"""The shop domain derived from the sample tables, whole tables throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.size import extract_size
from ..functions.text import default_brand
from ..operators.maintain import upsert_latest

NOUNS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")

CATEGORIES = """VALUES
    (1, 'Economy', 'economy', 'e', CAST(NULL AS INT), 3), (2, 'Small', 'small', 's', NULL, 1),
    (3, 'Medium', 'medium', NULL, NULL, 2), (4, 'Promo', 'promo', 'p', NULL, 6),
    (5, 'Standard', 'standard', 't', NULL, 5), (6, 'Large', 'large', NULL, NULL, 4),
    (7, 'Economy Bolt', 'economy-bolt', 'b', 1, 7), (8, 'Unused', 'unused', 'u', NULL, 8)"""
CATEGORY_COLUMNS = "id, name, slug, icon, parent_id, display_order"
KEYWORDS = "VALUES ('widget', 1), ('gizmo', 2), ('bolt', 3), ('gear', 4), ('ring', 5), ('rod', 6)"
RAW_MAP = "VALUES ('ring', 5), ('bolt', 3), ('plate', 2)"
QUEUE = """VALUES
    (901, 'gear', CAST(NULL AS INT), 0.5D, 'Rejected'), (902, 'economy rod', 1, 0.5D, 'Rejected'),
    (903, 'small gizmo', 2, 0.5D, 'Pending')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({CATEGORIES}) AS t({CATEGORY_COLUMNS})")


def keyword_map(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({KEYWORDS}) AS t(keyword, category_id)")


def raw_map(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({RAW_MAP}) AS t(raw_text, category_id)")


def queue_seed(spark: SparkSession) -> DataFrame:
    return spark.sql(
        f"SELECT CAST(id AS BIGINT) AS id, raw_text, suggested_id, score, status FROM ({QUEUE}) "
        "AS t(id, raw_text, suggested_id, score, status)"
    )


def _noun() -> Column:
    return F.get(F.split("p_name", " "), F.lit(1))


def _spelling(which: Column) -> Column:
    """Shops spell the same part in five ways."""
    return (
        F.when(which == 0, F.col("p_name"))
        .when(which == 1, F.concat("p_name", F.lit("s")))
        .when(which == 2, F.replace(F.col("p_name"), F.lit("i"), F.lit("y")))
        .when(which == 3, F.concat_ws(" ", "p_name", F.lower("p_type")))
        .otherwise(F.concat(F.upper("p_name"), F.lit(" Classic")))
    )


def _size_text() -> Column:
    step = F.col("p_size") % 5 + 1
    hundreds = (step * 100).cast("string")
    kind = F.col("p_partkey") % 6
    return (
        F.when(kind == 0, F.concat(F.lit(" "), hundreds, F.lit(" gr")))
        .when(kind == 1, F.concat(F.lit(" "), step.cast("string"), F.lit(",5 lt")))
        .when(kind == 2, F.concat(F.lit(" 12 x "), hundreds, F.lit(" Ml")))
        .when(kind == 3, F.concat(F.lit(" "), hundreds, F.lit(" Gr 25'li")))
        .when(kind == 4, F.concat(F.lit(" "), hundreds, F.lit(" adet")))
        .otherwise(F.lit(""))
    )


def _brand() -> Column:
    return F.when(F.col("p_partkey") % 50 == 0, F.lit(" ")).otherwise(F.col("p_brand"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One title per part: p_partkey, title, brand, raw_category."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(_spelling(F.col("p_partkey") % 5), _size_text()).alias("title"),
        _brand().alias("brand"),
        F.col("p_type").alias("raw_category"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item is one appearance of a part in the feed of a shop (its supplier)."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # Whole cents, so that no rounding rule is involved.
    price = F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) div CAST(l_quantity AS BIGINT)").cast("decimal(16,0)") / F.lit(100).cast("decimal(3,0)")
    text = F.concat_ws(" ", "p_type", _noun())
    kind = F.col("l_partkey") % 7
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("shop_"), F.col("l_suppkey").cast("string")).alias("source"),
        F.col("l_partkey").alias("external_id"),
        F.initcap(_noun()).alias("search_term"),
        F.col("l_shipdate").cast("timestamp").alias("run_ts"),
        F.struct(
            (F.array_position(F.array(*[F.lit(n) for n in NOUNS]), _noun()) - 1).cast("int").alias("term_pos"),
            F.col("l_suppkey").cast("int").alias("source_pos"),
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("pos"),
        ).alias("seq"),
        F.concat(_spelling(F.col("l_suppkey") % 5), _size_text()).alias("title"),
        _brand().alias("brand"),
        F.concat_ws("/", F.lit("http://img"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("image_url"),
        price.cast("decimal(18,2)").alias("price"),
        (price * 2).cast("decimal(18,2)").alias("regular_price"),
        F.when(kind == 0, F.col("p_type"))
        .when(kind == 1, text)
        .when(kind == 2, F.concat_ws(" ", "p_type", "p_name"))
        .when(kind == 3, F.lit("  "))
        .when(kind == 4, _noun())
        .when(kind == 5, F.concat(F.lit("  "), F.upper(_noun()), F.lit(" ")))
        .alias("source_category"),
        F.concat(F.lit("http://shop/"), F.col("l_suppkey").cast("string"), F.lit("?o="), F.col("l_orderkey").cast("string")).alias("product_url"),
    )


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One master per part; the category is the one named like the part's type.

    Parts are few bytes but much work, since every title is parsed: they are dealt to tasks by key, where one task would
    read a file of millions.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition("p_partkey")
    named = categories(spark).select(F.lower("name").alias("_type"), F.col("id").alias("category_id"))
    title = F.concat(F.col("p_name"), _size_text())
    return (
        parts.select(
            F.col("p_partkey").cast("string").alias("master_key"),
            title.alias("canonical_title"),
            default_brand(_brand()).alias("brand"),
            extract_size(title).alias("_size"),
            F.lower("p_type").alias("_type"),
        )
        .join(F.broadcast(named), "_type", "left")
        .select("master_key", "canonical_title", "brand", "_size.size_value", "_size.size_unit", "_size.pack_quantity", "category_id")
    )


def products(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Newest state of every listing, linked to the master of its part; only with ``columns`` besides, if some are given."""
    return upsert_latest(None, listings(spark, sf_dir), columns or None).withColumn("master_key", F.col("external_id").cast("string"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per labelled document: status by the two labels, score from the id."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        key.alias("id"),
        F.concat(F.lit("text "), key.cast("string")).alias("raw_text"),
        F.when(key % 9 > 0, (key % 9).cast("int")).alias("suggested_id"),
        ((key % 46 + 40) / 100).alias("score"),
        F.when(F.col("quality") == 0, "Rejected").when(F.col("toxic") == 1, "Approved").otherwise("Pending").alias("status"),
    )


def stored_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masters as an earlier run left them, founded in the order of their keys."""
    seq = F.struct(F.lit(0).alias("term_pos"), F.lit(0).alias("source_pos"), F.col("master_key").cast("long").alias("pos"))
    return masters(spark, sf_dir).withColumn(
        "founded_order", F.struct(F.lit("1970-01-01").cast("timestamp").alias("run_ts"), seq.alias("seq"))
    )


PAGE = 24
FEED_SOURCES = ("migros", "macrocenter", "marketfiyati", "hakmarexpress", "mion", "cagrimarket", "evidea")


def _feed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the fields that feed items are made of."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key,
        (key - key % PAGE).cast("long").alias("first_key"),
        F.concat(_spelling(key % 5), _size_text()).alias("title"),
        F.when(key % 50 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 5 != 3, F.col("p_type")).alias("category"),
        F.when(key % 7 != 0, F.concat(F.lit("http://img/"), key.cast("string"))).alias("image"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"),
    )


def _field(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), text)


def _object(*fields: Column) -> Column:
    """A JSON object out of fields; null ones are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _quoted(col: Column) -> Column:
    """JSON string; titles hold no quotes or backslashes."""
    return F.concat(F.lit('"'), col, F.lit('"'))


def _amount(cents: Column) -> Column:
    return (cents.cast("decimal(16,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").cast("string")


def _item(source: str) -> Column:
    key, cents = F.col("p_partkey"), F.col("cents")
    bad = key % 97 == 96
    minor = F.when(bad, F.lit('"n/a"')).otherwise(cents.cast("string"))
    price = F.when(bad, F.lit('"n/a"')).otherwise(_amount(cents))
    named = lambda col: _object(_field("name", _quoted(col)))
    name = _field("name", _quoted(F.col("title")))
    part_slug = _quoted(F.concat(F.lit("part-"), key.cast("string")))
    image = _quoted(F.col("image"))
    old = F.when(key % 3 == 0, F.lit("null")).when(key % 3 == 1, _amount(cents + 500))
    number = _field("id", key.cast("string"))
    if source in ("migros", "macrocenter", "mion"):
        images = F.concat(F.lit("["), F.coalesce(_object(_field("urls", _object(_field("PRODUCT_DETAIL", image)))), F.lit("")), F.lit("]"))
        images = F.when(F.col("image").isNull(), F.lit("[]")).otherwise(images)
        more = [] if source == "mion" else [_field("brand", named(F.col("brand"))), _field("category", named(F.col("category")))]
        return _object(
            number, name, *more, _field("images", images), _field("shownPrice", minor),
            _field("regularPrice", (cents + 500).cast("string")), _field("prettyName", part_slug),
        )
    if source == "marketfiyati":
        depot = lambda text: _object(_field("price", text))
        depots = F.when(key % 11 == 0, F.lit("[]")).otherwise(
            F.concat(F.lit("["), depot(price), F.lit(","), depot(_amount(cents + 900)), F.lit("]"))
        )
        return _object(
            _field("id", _quoted(F.concat(F.lit("M"), key.cast("string")))), _field("title", _quoted(F.col("title"))),
            _field("brand", _quoted(F.col("brand"))), _field("imageUrl", image),
            _field("main_category", _quoted(F.col("category"))), _field("productDepotInfoList", depots),
        )
    if source == "hakmarexpress":
        kinds = F.concat(F.lit("["), named(F.lit("Gida")), F.lit(","), named(F.col("category")), F.lit("]"))
        kinds = F.coalesce(F.when(F.col("category").isNotNull(), kinds), F.lit("[]"))
        product = _object(
            number, name, _field("imageUrl", image), _field("brand", F.coalesce(named(F.col("brand")), F.lit("null"))),
            _field("barcode", _quoted(F.concat(F.lit("869"), key.cast("string")))), _field("categories", kinds),
            _field("price", price), _field("oldPrice", old), _field("slug", part_slug),
        )
        return F.when(key % 13 == 12, F.lit('{"ad":true}')).otherwise(_object(_field("product", product)))
    if source == "cagrimarket":
        link = _field("url", _quoted(F.concat(F.lit("http://c/"), key.cast("string"))))
        return _object(
            F.when(key % 19 != 0, number), name, link, _field("price", price), _field("oldPrice", old), _field("image", image)
        )
    value = F.when(key % 17 == 0, F.lit("abc")).otherwise(key.cast("string"))
    pair = lambda n, v: _object(_field("name", _quoted(F.lit(n))), _field("value", _quoted(v)))
    marks = F.when(key % 23 == 0, F.concat(F.lit("["), pair("color", F.lit("mavi")), F.lit("]"))).otherwise(
        F.concat(F.lit("["), pair("color", F.lit("mavi")), F.lit(","), pair("pk", value), F.lit(","), pair("pk", F.lit("5")), F.lit("]"))
    )
    images = F.when(F.col("image").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("["), image, F.lit("]")))
    return _object(
        _field("code", _quoted(F.concat(F.lit("K"), key.cast("string")))), name,
        _field("url", _quoted(F.concat(F.lit("http://e/"), key.cast("string")))), _field("price", price),
        _field("oldPrice", old), _field("images", images), _field("attributes", marks),
    )


def _document(source: str, items: Column) -> Column:
    page = F.col("first_key") / PAGE
    array = F.concat(F.lit("["), items, F.lit("]"))
    wrap = lambda before, after: F.concat(F.lit(before), array, F.lit(after))
    if source in ("migros", "macrocenter"):
        return wrap('{"data":{"storeProductInfos":', "}}")
    if source == "mion":
        return wrap('{"data":{"searchInfo":{"storeProductInfos":', "}}}")
    if source == "marketfiyati":
        return wrap('{"content":', "}")
    if source == "hakmarexpress":
        shallow = wrap('{"component":"product-list","products":', "}")
        deep = wrap('{"z":{"blocks":[{"component":"banner"},[{"component":"product-list","products":', '}]]},"a":{"component":"product-list","products":[]}}')
        return F.when(page % 2 == 0, shallow).otherwise(deep)
    if source == "cagrimarket":
        return F.when(page % 3 == 0, array).when(page % 3 == 1, wrap('{"data":', "}")).otherwise(wrap('{"rows":', "}"))
    return wrap('{"results":{"products":{"data":', "}}}")


def raw_feed(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] = FEED_SOURCES) -> DataFrame:
    """Every part offered by every source, in pages of 24 items, as the shops' JSON documents."""
    parts = _feed_parts(spark, sf_dir)
    made = None
    for source in sources:
        # A page holds at most PAGE items, whatever the table's size.
        pages = (
            parts.select("first_key", F.struct("p_partkey", _item(source).alias("text")).alias("item"))
            .groupBy("first_key")
            .agg(F.array_sort(F.collect_list("item")).alias("items"))
        )
        feed = pages.select(
            F.lit("2024-01-01").cast("timestamp").alias("run_ts"),
            F.lit(source).alias("source"),
            F.concat(F.lit("page "), F.col("first_key").cast("string")).alias("search_term"),
            F.col("first_key").cast("int").alias("term_pos"),
            F.lit(FEED_SOURCES.index(source)).alias("source_pos"),
            _document(source, F.array_join(F.transform("items", lambda i: i["text"]), ",")).alias("payload"),
        )
        made = feed if made is None else made.unionByName(feed)
    return made


def event_listings(events: DataFrame) -> DataFrame:
    """Events as listings: the type is the source, the user the item, the value the price."""
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.col("event_type").alias("source"),
        F.col("user_id").alias("external_id"),
        F.lit("event").alias("search_term"),
        F.col("ts").cast("timestamp").alias("run_ts"),
        F.struct(F.lit(0).alias("term_pos"), F.lit(0).alias("source_pos"), F.col("event_id").alias("pos")).alias("seq"),
        F.concat(F.lit("k "), k).alias("title"),
        F.lit(None).cast("string").alias("image_url"),
        F.col("value").cast("decimal(18,2)").alias("price"),
        F.col("value").cast("decimal(18,2)").alias("regular_price"),
        F.when(k.cast("int") % 2 == 0, F.lit("even")).alias("source_category"),
        F.concat(F.lit("http://event/"), F.col("event_id").cast("string")).alias("product_url"),
    )
