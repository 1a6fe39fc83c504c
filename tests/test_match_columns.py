import json

from sepet.operators import match
from sepet.plans import sample_views as views
from sepet.session import SPLIT_CONF, bound_splits

SF_DIR = "/root/testdata/sf0.001"


def widths(spark, monkeypatch, **options):
    """Columns of the tables that matching writes, and what it returns, as text."""
    seen = []
    settle = match.settle
    monkeypatch.setattr(match, "settle", lambda df: (seen.append(df.columns), settle(df))[1])
    listings = views.listings(spark, SF_DIR)
    found = match.match_products(listings, None, views.categories(spark), views.keyword_map(spark), views.raw_map(spark), views.queue_seed(spark), **options)
    rows = {k: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in found[k].collect()) for k in ("masters", "founded", "links", "texts")}
    return seen, rows, found


def test_only_what_is_asked_for_is_written(spark, monkeypatch):
    _, every, wide = widths(spark, monkeypatch)
    written, few, light = widths(spark, monkeypatch, columns=("price",))
    assert few == every
    for columns in written:
        assert not {"product_url", "image_url", "regular_price", "own_key", "search_term"} & set(columns)
    keys = ["source", "external_id", "run_ts", "seq", "price", "category_id"]
    for name in ("assigned", "dropped", "unmatched"):
        rows = [sorted(map(tuple, found[name].select(*keys).collect()), key=str) for found in (wide, light)]
        assert rows[0] == rows[1]
    of = ["source", "external_id", "seq", "master_key", "founds", "ord"]
    rows = [sorted(map(tuple, found["assigned"].select(*of).collect()), key=str) for found in (wide, light)]
    assert rows[0] == rows[1] and len(rows[0]) > 0


def test_tasks_read_bounded_splits(spark):
    before = spark.conf.get(SPLIT_CONF)
    try:
        for now, after in (("128m", str(match.SPLIT_BYTES)), ("1m", "1m")):
            spark.conf.set(SPLIT_CONF, now)
            bound_splits(spark, match.SPLIT_BYTES)
            assert spark.conf.get(SPLIT_CONF) == after
    finally:
        spark.conf.set(SPLIT_CONF, before)
