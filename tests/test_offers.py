"""Offers of very popular masters, and sizes of very large categories."""

import random

import pytest
from pyspark.sql import functions as F

from sepet.operators import bucketed, catalog, deals


@pytest.fixture(scope="module")
def tables(spark):
    """A master that a third of all products are linked to; some have none."""
    masters = spark.range(60).select(
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("master_key"), F.lit("t").alias("canonical_title"), F.lit("b").alias("brand"),
        (F.col("id") % 3).cast("int").alias("category_id"), (F.col("id") + 1).cast("decimal(18,4)").alias("size_value"),
        F.lit("ML").alias("size_unit"), F.lit(1).alias("pack_quantity"),
    )
    key = F.when(F.col("id") % 3 == 0, "m7").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("m"), (F.col("id") % 60).cast("string")))
    products = spark.range(3_000).select(
        F.lit("s").alias("source"), F.col("id").alias("external_id"), key.alias("master_key"), (F.col("id") % 97).cast("decimal(18,2)").alias("price"),
        F.lit("i").alias("image_url"), F.lit("u").alias("product_url"),
    )
    return masters, products


@pytest.fixture
def no_broadcast(spark):
    """As for tables that are too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(df):
    return sorted(map(str, df.collect()))


def below_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("SortMergeJoin") :]


def test_offers_in_buckets_join_without_exchange(tables, no_broadcast):
    stored = bucketed.save_in_buckets(*tables, buckets=8, task_rows=100)
    offers, found = catalog.product_offers(*stored), deals.deals_offers(*stored)
    for df in (offers, found):
        assert "Exchange" not in below_join(df)
    assert rows(offers) == rows(catalog.product_offers(*tables))
    assert rows(found) == rows(deals.deals_offers(*tables))
    one = catalog.product_offers(*stored, master_key="m7")
    assert one.count() == tables[1].filter("master_key = 'm7'").count() > 900


def test_listings_of_a_popular_master_lie_in_several_buckets(tables):
    _, products = bucketed.save_in_buckets(*tables, buckets=8, task_rows=100)
    placed = products.filter("master_key = 'm7'").select(F.input_file_name().alias("file")).groupBy("file").count().collect()
    assert len(placed) >= 4 and max(r["count"] for r in placed) < 0.5 * sum(r["count"] for r in placed)
    others = products.filter("master_key <> 'm7'").agg(F.max(bucketed.SALT)).first()[0]
    assert others == 0


def test_median_of_a_category_that_holds_nearly_all_sizes(spark):
    rng = random.Random(1)
    sizes = [(1, "weight_or_volume", k) for k in rng.sample(range(100_000), 4_000)] + [(1, "weight_or_volume", 77)] * 900
    sizes += [(c, "count", k) for c in (2, 3) for k in range(c * 10)] + [(3, "weight_or_volume", 5)]
    offers = spark.createDataFrame(sizes, "category_id int, family string, n long").select("category_id", "family", F.col("n").cast("decimal(18,4)").alias("total_size"))
    stats = {r["category_id"]: (r["primary_unit"], r["median_size"]) for r in deals.family_stats(offers, task_rows=200).collect()}
    first = sorted(s for c, _, s in sizes if c == 1)
    assert stats == {1: ("weight_or_volume", first[len(first) // 2]), 2: ("count", 10), 3: ("count", 15)}
    folded = offers.groupBy("category_id", "total_size").agg(F.count(F.lit(1)).alias("n"))
    ranged = deals.size_ranges(folded, 200)
    # What one task sorts, and what the last step reads of the large category.
    held = [r["count"] for r in ranged.groupBy("category_id", "part").count().collect()]
    assert max(held) < 600 and sum(held) > 4_000
    whole = {r["category_id"]: (r["primary_unit"], r["median_size"]) for r in deals.family_stats(offers).collect()}
    assert whole == stats


def test_buckets_grow_with_the_products(tables, no_broadcast, monkeypatch):
    """Their number is a least one: no task reads a share of all products that stays the same."""
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 100)
    masters, products = bucketed.save_in_buckets(*tables, buckets=2, task_rows=20)
    placed = products.select(F.input_file_name().alias("file")).groupBy("file").count().collect()
    assert len(placed) > 10 and max(r["count"] for r in placed) < products.count() / 5
    found = catalog.product_offers(masters, products)
    assert "Exchange" not in below_join(found) and rows(found) == rows(catalog.product_offers(*tables))
