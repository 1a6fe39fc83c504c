import hashlib
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sepet.sources.feeds import FEED_SCHEMA, feed_union
from sepet.sources.layouts import LAYOUTS
from sepet.sources import tree

STORE = (
    '{"id":11,"name":"Doğa Su 12 x 500 Ml","brand":{"name":"Doğa"},"category":{"name":"Su"},'
    '"images":[{"urls":{"PRODUCT_DETAIL":"http://x/1.jpg"}}],"shownPrice":8995,"regularPrice":9995,"prettyName":"doga-su"}'
)
PAYLOADS = {
    "migros": '{"data":{"storeProductInfos":[%s]}}' % STORE,
    "macrocenter": '{"data":{"storeProductInfos":[%s,{"id":12},{"name":"x"},{"id":13,"shownPrice":"9"},{"id":14,"brand":null}]}}' % STORE,
    "mion": '{"data":{"searchInfo":{"storeProductInfos":[%s]}}}' % STORE,
    "marketfiyati": '{"content":[{"id":"1A2B","title":"Doğa Su 5 Lt","brand":"Doğa","imageUrl":"http://x/2.jpg","main_category":"İçecek","productDepotInfoList":[{"price":42.50},{"price":44.00}]},{"id":"Z","title":null}]}',
    "hakmarexpress": '{"page":{"blocks":[{"component":"banner"},{"component":"product-list","products":[{"product":{"id":7,"name":"Doğa Çay 2 Gr 25\'li","imageUrl":"http://x/3.jpg","brand":{"name":"Doğa"},"barcode":"8690000000007","categories":[{"name":"Gıda"},{"name":"Çay"}],"price":50.0,"oldPrice":null,"slug":"doga-cay"}},{"ad":true}]}]}}',
    "cagrimarket": '[{"id":3,"name":"Makarna 500 Gr","url":"http://x/m","price":20.0,"oldPrice":25.0,"image":"http://x/4.jpg"}]',
    "evidea": '{"results":{"products":{"data":[{"code":"K1","name":"Fincan 6 Adet","url":"http://x/f","price":99.0,"oldPrice":null,"images":["http://x/5.jpg"],"attributes":[{"name":"color","value":"mavi"},{"name":"pk","value":"4711"},{"name":"pk","value":"5"}]},{"code":"K2","name":"x","url":"u","price":1,"attributes":[{"name":"pk","value":"abc"}]}]}}}',
}
KEY = struct.unpack("<q", hashlib.md5(b"1A2B").digest()[:8])[0]
EXPECTED = {
    "migros": (11, "89.95", "99.95", "Su", "https://www.migros.com.tr/doga-su"),
    "macrocenter": (11, "89.95", "99.95", "Su", "https://www.macrocenter.com.tr/doga-su"),
    "mion": (11, "89.95", "99.95", None, "https://www.mion.com.tr/urun/doga-su"),
    "marketfiyati": (KEY, "42.50", "42.50", "İçecek", "https://marketfiyati.org.tr/detay/1A2B/doga-su-5-lt"),
    "hakmarexpress": (7, "50.00", "50.00", "Çay", "https://www.hakmarexpress.com.tr/doga-cay"),
    "cagrimarket": (3, "20.00", "25.00", None, "http://x/m"),
    "evidea": (4711, "99.00", "99.00", None, "http://x/f"),
}


def feeds(spark, payloads):
    rows = [(s, "su", i, 0, p) for i, (s, p) in enumerate(payloads)]
    df = spark.createDataFrame(rows, "source string, search_term string, source_pos int, term_pos int, payload string")
    return df.withColumn("run_ts", F.lit("2024-01-01").cast("timestamp")).select(*[f.split()[0] for f in FEED_SCHEMA.split(", ")])


@pytest.fixture(scope="module")
def parsed(spark):
    listings, bad = feed_union(feeds(spark, PAYLOADS.items()), list(LAYOUTS))
    return listings.collect(), bad.collect()


@pytest.mark.parametrize("source", EXPECTED)
def test_expected_listing(parsed, source):
    first = next(r for r in parsed[0] if r["source"] == source and r["seq"]["pos"] == 0)
    got = tuple(first[c] for c in ("external_id", "price", "regular_price", "source_category", "product_url"))
    want = EXPECTED[source]
    assert got == (want[0], Decimal(want[1]), Decimal(want[2]), want[3], want[4])


def test_rows_kept_and_dropped(parsed):
    listings, bad = parsed
    by_source = {s: sorted(r["external_id"] for r in listings if r["source"] == s) for s in LAYOUTS}
    assert by_source["macrocenter"] == [11, 12, 14]
    assert by_source["evidea"] == [0, 4711]
    assert by_source["hakmarexpress"] == [7]
    assert len(by_source["marketfiyati"]) == 2
    twelve = next(r for r in listings if r["external_id"] == 12)
    assert (twelve["title"], twelve["price"], twelve["product_url"], twelve["brand"]) == ("", 0, "", None)
    assert sorted((r["source"], r["pos"], r["reason"]) for r in bad) == [
        ("macrocenter", 2, "item incomplete"),
        ("macrocenter", 3, "item not readable"),
    ]


def test_bad_documents(spark):
    payloads = [
        ("migros", "not json"),
        ("migros", '{"other":1}'),
        ("migros", '{"data":{"storeProductInfos":[]}}'),
        ("mion", '{"data":{}}'),
        ("marketfiyati", '{"x":[]}'),
        ("hakmarexpress", '{"component":"banner"}'),
        ("hakmarexpress", "{product-list"),
        ("cagrimarket", '{"data":[{"id":1,"price":2}]}'),
        ("cagrimarket", '{"rows":[{"id":1}]}'),
        ("evidea", '{"results":{}}'),
    ]
    listings, bad = feed_union(feeds(spark, payloads), list(LAYOUTS))
    assert [(r["source"], r["external_id"]) for r in listings.collect()] == [("cagrimarket", 1)]
    assert sorted((r["source"], r["reason"]) for r in bad.collect()) == [
        ("hakmarexpress", "not readable"),
        ("marketfiyati", "no product list"),
        ("migros", "not readable"),
        ("mion", "no product list"),
    ]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r["i"]: r["found"] for r in tree.find_list(df, "text", "found").collect()}


def test_first_list_goes_in_document_order(spark):
    part = '{"component":"product-list","products":[%d]}'
    texts = [
        '{"z":{"a":[{"component":"product-list","products":3},{"component":"product-list","products":[1]}]},"a":{"component":"product-list","products":[2]}}',
        '{"component":"product-list"}',
        "{",
        # Deeper but earlier; then an object before what it holds.
        '{"b":[[[%s]]],"a":%s}' % (part % 1, part % 2),
        '{"x":%s,"component":"product-list","products":[9,%s]}' % (part % 1, part % 2),
        # Texts that look like JSON are no nodes, and a text is no list.
        '{"a":"{\\"component\\":\\"product-list\\",\\"products\\":[1]}","b":%s}' % (part % 2),
        '[{"component":"product-list","products":"[1]"},"[]",%s]' % (part % 3),
        '{"component":["product-list"],"products":[1]}',
        # An escape hides the name.
        '{"a":{"component":"product\\u002dlist","products":[4]}}',
        None,
        "",
        '"product-list"',
        "[" * 11 + part % 5 + "]" * 11,
    ]
    want = ["[1]", None, "", "[1]", '[9,{"component":"product-list","products":[2]}]', "[2]", "[3]", None, "[4]", None, "", None, "[5]"]
    assert found(spark, texts) == dict(enumerate(want))


def test_each_document_is_parsed_once_and_in_the_jvm(spark):
    for source in LAYOUTS:
        listings, _ = feed_union(feeds(spark, [(source, PAYLOADS[source])]), [source])
        plan = listings._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        # The envelope, and each item; the two shapes of one feed are two readers, of which a row takes one.
        assert plan.count("from_json(") == {"cagrimarket": 3}.get(source, 2), source
