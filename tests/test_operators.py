from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sepet import session
from sepet.operators import category, deals, maintain


def listings(spark, rows):
    """rows: (source, id, run day, pos, title, price, raw category, term)."""
    df = spark.createDataFrame(
        rows, "source string, external_id long, day string, pos long, title string, price double, source_category string, search_term string"
    )
    return df.select(
        "source",
        "external_id",
        F.col("day").cast("timestamp").alias("run_ts"),
        F.struct(F.lit(0).alias("term_pos"), F.lit(0).alias("source_pos"), "pos").alias("seq"),
        "title",
        F.lit(None).cast("string").alias("image_url"),
        F.col("price").cast("decimal(18,2)").alias("price"),
        F.col("price").cast("decimal(18,2)").alias("regular_price"),
        F.concat(F.lit("u/"), F.col("pos").cast("string")).alias("product_url"),
        "source_category",
        "search_term",
    )


def products_of(df):
    return {(r["source"], r["external_id"]): (r["title"], r["product_url"], r["master_key"]) for r in df.collect()}


def test_upsert(spark):
    first = listings(spark, [("a", 1, "2024-01-01", 1, "x", 1.0, None, "t"), ("a", 1, "2024-01-01", 2, "y", 1.0, None, "t"), ("b", 1, "2024-01-01", 3, "z", 1.0, None, "t")])
    second = listings(spark, [("a", 1, "2024-01-02", 9, "new", 2.0, None, "t"), ("c", 5, "2024-01-02", 8, "c", 2.0, None, "t")])
    once = maintain.upsert_latest(None, first)
    assert products_of(once) == {("a", 1): ("y", "u/1", None), ("b", 1): ("z", "u/3", None)}
    linked = maintain.link_update(once, spark.createDataFrame([("a", 1, "m")], "source string, external_id long, master_key string"))
    twice = maintain.upsert_latest(linked, second)
    want = {("a", 1): ("new", "u/1", "m"), ("b", 1): ("z", "u/3", None), ("c", 5): ("c", "u/8", None)}
    assert products_of(twice) == want
    assert products_of(maintain.upsert_latest(twice, second)) == want
    assert products_of(maintain.upsert_latest(None, first.unionByName(second))) == {k: (*v[:2], None) for k, v in want.items()}


@pytest.fixture(scope="module")
def lookups(spark):
    named = "VALUES (1, 'Su'), (2, 'Çay'), (3, 'Kahve')"
    return {
        "categories": spark.sql(f"SELECT * FROM ({named}) AS t(id, name)"),
        "raw_map": spark.sql("SELECT * FROM (VALUES ('içecek', 1)) AS t(raw_text, category_id)"),
        "queue": spark.sql("SELECT * FROM (VALUES (7L, 'yeşil çay', 2, 0.5D, 'Rejected')) AS t(id, raw_text, suggested_id, score, status)"),
        "keywords": spark.sql("SELECT * FROM (VALUES ('çay', 2), ('su', 1)) AS t(keyword, category_id)"),
    }


def test_category_chain(spark, lookups):
    raws = ["Çay", " Siyah Çay ", "Dökme Siyah Çay", "Deterjan", "YEŞİL ÇAY", "İçecek", "  ", None, "!!"]
    rows = [("a", i, "2024-01-01", i, "x", 1.0, raw, "Çay") for i, raw in enumerate(raws)]
    seen = listings(spark, rows)
    texts = category.resolve_texts(category.distinct_texts(seen), lookups["categories"], lookups["raw_map"], lookups["queue"])
    routes = {r["raw_text"]: r["route"] for r in texts.collect()}
    assert routes == {
        "çay": "accept", "siyah çay": "review", "dökme siyah çay": "none", "deterjan": "none",
        "yeşil çay": "rejected", "içecek": "mapped", "!!": "none",
    }
    found = category.resolve_category(seen, lookups["keywords"], texts)
    got = {r["external_id"]: r["category_id"] for r in found.collect()}
    assert got == {0: 2, 1: None, 2: None, 3: None, 4: None, 5: 1, 6: 2, 7: 2, 8: None}
    kept, dropped = category.false_positive_filter(found)
    assert [r["external_id"] for r in dropped.collect()] == [5] and kept.count() == 8


def test_review_queue(spark, lookups):
    doubtful = spark.sql("SELECT * FROM (VALUES ('siyah çay', 2, 0.5D), ('yeşil çay', 2, 0.5D)) AS t(raw_text, category_id, score)")
    queue = maintain.review_enqueue(lookups["queue"], doubtful)
    again = maintain.review_enqueue(queue, doubtful)
    assert sorted(r["raw_text"] for r in again.collect()) == ["siyah çay", "yeşil çay"]
    key = queue.filter("status = 'Pending'").first()["id"]
    decisions = spark.createDataFrame([(key, "approve"), (key, "approve")], "id long, action string")
    after, mapped = maintain.review_approve(queue, lookups["raw_map"], decisions)
    assert {r["raw_text"]: r["status"] for r in after.collect()} == {"siyah çay": "Approved", "yeşil çay": "Rejected"}
    assert {(r[0], r[1]) for r in mapped.collect()} == {("içecek", 1), ("siyah çay", 2)}
    _, same = maintain.review_approve(after, mapped, decisions)
    assert same.count() == 2


def test_deals_case(spark):
    masters = spark.createDataFrame(
        [
            ("a", "A", "X", Decimal(500), "ML", 12, 1), ("b", "B", "Y", Decimal(5000), "ML", 1, 1),
            ("c", "C", "X", Decimal(19000), "ML", 1, 1), ("d", "D", "", Decimal(48), "ADET", 1, 1),
            ("e", "E", "X", None, None, 1, 1), ("f", "F", "X", Decimal(5), "G", 1, None),
        ],
        "master_key string, canonical_title string, brand string, size_value decimal(18,4), size_unit string, pack_quantity int, category_id int",
    )
    prices = [("a", 90), ("b", 50), ("c", 95), ("d", 96), ("e", 10), ("f", 1)]
    products = spark.createDataFrame(
        [("s", i, m, Decimal(p), None, "u") for i, (m, p) in enumerate(prices)],
        "source string, external_id long, master_key string, price decimal(18,2), image_url string, product_url string",
    )
    rows = deals.deals(masters, products).collect()
    assert {r["master_key"]: (r["section"], r["rank"], int(r["price_per_unit"])) for r in rows} == {
        "b": ("primary", 1, 10), "a": ("primary", 2, 15), "d": ("other", None, 2),
    }
    offers = deals.deals_offers(masters, products)
    stats = deals.family_stats(offers)
    row = stats.first()
    assert (row["primary_unit"], row["median_size"], row["cap"]) == ("weight_or_volume", 6000, 18000)
    sections = deals.split_sections(offers, stats)
    assert [(r["category_id"], r["brand"]) for r in deals.deals_brand_facet(sections).collect()] == [(1, "X"), (1, "Y")]
    only_x = deals.deals_filter_sort(sections, stats, ["X"]).collect()
    assert [(r["master_key"], r["rank"]) for r in only_x] == [("a", 1), ("d", None)]
    dear = deals.deals_filter_sort(sections, stats, [], "priceDesc").collect()
    assert [(r["master_key"], r["rank"]) for r in dear] == [("a", None), ("b", None), ("d", None)]
    words = spark.sql("SELECT * FROM (VALUES ('su', 1)) AS t(keyword, category_id)")
    assert deals.deals_for_text(masters, products, words, "SU").count() == 4
    assert deals.deals_for_text(masters, products, words, "tea").count() == 0


@pytest.mark.parametrize("weights,counts,primary,median", [([1, 2, 3, 4], [], "weight_or_volume", 3), ([1, 2], [5, 6], "weight_or_volume", 2), ([1], [5, 6, 7], "count", 6)])
def test_family_and_upper_median(spark, weights, counts, primary, median):
    rows = [(1, "weight_or_volume", Decimal(x)) for x in weights] + [(1, "count", Decimal(x)) for x in counts]
    offers = spark.createDataFrame(rows, "category_id int, family string, total_size decimal(18,4)")
    row = deals.family_stats(offers).first()
    assert (row["primary_unit"], row["median_size"], row["cap"]) == (primary, median, median * 3)


def test_many_resolved_texts_are_joined_with_salts(spark, lookups):
    """A third of the listings carry one text, a third none; the way for many texts gives what a broadcast gives."""
    rows = [("s", k, "su" if k % 7 else "yok", [" Çay ", None, f"metin {k % 50}"][k % 3], f"t{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "source string, external_id long, search_term string, source_category string, title string")
    texts = session.settle(category.resolve_texts(session.settle(category.distinct_texts(df)), lookups["categories"], lookups["raw_map"], lookups["queue"]))
    columns = ["external_id", "keyword_id", "resolved_id", "category_id"]
    few = category.resolve_category(df, lookups["keywords"], texts).select(columns)
    many = category.resolve_category(df, lookups["keywords"], texts, task_rows=50, most_texts=3).select(columns)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 600
    assert "SortMergeJoin" in many._jdf.queryExecution().sparkPlan().toString() or "_salt" in many._jdf.queryExecution().sparkPlan().toString()
