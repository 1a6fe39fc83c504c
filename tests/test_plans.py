"""Plans keep the shape that scales."""

import os

import pytest

from sepet.operators import catalog, deals, match
from sepet.plans import sample_views as views
from sepet.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["assign_masters", "best_match", "candidate_blocking", "category_best_guess", "fuzzy_token_join"])
def test_no_pairwise_join(spark, name):
    text = plan(REGISTRY[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["deals_top3", "product_search", "cheapest_offer_flag", "upsert_latest", "tokenize"])
def test_no_python_in_the_plan(spark, name):
    text = plan(REGISTRY[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert plan(REGISTRY["deals_top3"](spark, SF_DIR)).count("WindowGroupLimit") == 2


def test_scan_reads_what_it_needs(spark):
    text = plan(views.masters(spark, SF_DIR))
    assert "p_retailprice" not in text
    found = plan(catalog.product_search(views.masters(spark, SF_DIR), views.products(spark, SF_DIR), brand="Brand#7"))
    assert "l_tax" not in found and "l_discount" not in found


def test_stored_tables_are_filtered_in_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    views.masters(spark, SF_DIR).write.parquet(str(tmp_path / "m"))
    views.products(spark, SF_DIR).write.parquet(str(tmp_path / "p"))
    masters, products = spark.read.parquet(str(tmp_path / "m")), spark.read.parquet(str(tmp_path / "p"))
    text = plan(deals.deals_offers(masters, products, category_id=3))
    assert "EqualTo(category_id,3)" in text and "source_category" not in text
    assert "EqualTo(master_key,7)" in plan(catalog.product_offers(masters, products, "7"))


def test_parsing_happens_on_distinct_titles(spark):
    listings = match.prepare_listings(views.listings(spark, SF_DIR))
    assert "regexp_extract" not in plan(listings)
