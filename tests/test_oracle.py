"""Registered queries against their check SQL. ``SEPET_CHECK=all`` runs every query."""

import os
import subprocess
import sys

import pytest
from check import compare, connect

import __spark_entry__ as spark_entry
from sepet.plans.oracle import SQL
from sepet.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = [
    "deals_by_category",
    "product_search",
    "tokenize",
    "extract_size",
    "fuzzy_token_join",
    "run_counts",
    "assign_masters",
    "match_products",
    "feed_quarantine",
    "stream_upsert",
]
NAMES = list(spark_entry.queries()) if os.environ.get("SEPET_CHECK") == "all" else CHOSEN

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok is not False, note
    assert ok or name not in REGISTRY, f"{name} has no SQL"


def test_every_query_has_check_sql():
    assert set(REGISTRY) == set(SQL) and REGISTRY.keys() <= spark_entry.queries().keys()


@pytest.mark.parametrize("absent", ["corpus_pipeline", "sepet.llm", "xxhash"])
def test_entry_stands_without_the_optional_parts(absent):
    """A fresh interpreter in which a module cannot be imported."""
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(spark_entry.__file__)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(REGISTRY)), str(len(SQL))]


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).limit(1).count() == 1
