"""Products are folded with the columns that a query uses, and with no others."""

import pytest
from pyspark.sql import functions as F

from sepet.operators.maintain import PRODUCT_COLUMNS, upsert_latest
from sepet.plans import queries, sample_views

SF_DIR = "/root/testdata/sf0.001"
LINKED = ["source", "external_id", "price", "master_key"]
USED = {
    "cheapest_offer_flag": LINKED,
    "cheapest_offer_flag_salted": LINKED,
    "product_offers": ["source", "external_id", "image_url", "price", "product_url", "master_key"],
    "deals_by_category": LINKED,
    "deals_offers": ["source", "external_id", "image_url", "price", "product_url", "master_key"],
    "product_search": ["source", "external_id", "image_url", "price", "master_key"],
    "deals_ranked": LINKED,
    "deals_by_text": LINKED,
    "unit_price": LINKED,
    "search_price_having": ["source", "external_id", "image_url", "price", "master_key"],
    "search_order_price_asc": ["source", "external_id", "image_url", "price", "master_key"],
}


@pytest.mark.parametrize("name", sorted(USED))
def test_only_used_columns_are_folded(spark, monkeypatch, name):
    folded = []

    def seen(*args):
        folded.append(upsert_latest(*args))
        return folded[-1]

    monkeypatch.setattr(sample_views, "upsert_latest", seen)
    queries.REGISTRY[name](spark, SF_DIR)
    assert [df.columns for df in folded] == [USED[name]]
    left_out = [c for c in ("title", "image_url", "product_url") if c not in USED[name]]
    plan = folded[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not [c for c in left_out if f" AS {c}#" in plan or f"{c}, " in plan]


@pytest.mark.parametrize("columns", [["price"], ["product_url"], ["last_updated", "image_url"], []])
def test_columns_of_the_upsert(spark, columns):
    listings = sample_views.listings(spark, SF_DIR)
    # Few keys, so that they repeat, and links that are null at first or at last.
    listings = listings.withColumn("external_id", F.col("external_id") % 5).withColumn("source", F.lit("s"))
    listings = listings.withColumn("product_url", F.when(F.col("seq.pos") % 2 == 0, F.col("product_url")))
    turn = F.lit("1995-01-01").cast("timestamp")
    before = upsert_latest(None, listings.filter(F.col("run_ts") < turn))
    before = before.withColumn("master_key", F.col("external_id").cast("string"))
    whole = upsert_latest(before, listings.filter(F.col("run_ts") >= turn))
    some = upsert_latest(before, listings.filter(F.col("run_ts") >= turn), columns)
    wanted = [c for c in PRODUCT_COLUMNS if c in {"source", "external_id", "master_key", *columns}]
    assert some.columns == wanted
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*wanted).collect()))
    assert some.count() == 5
