"""State in buckets: a run rewrites what its keys fall into, and nothing else; a broken run is finished or repeated."""

import json

import pytest
from pyspark.sql import functions as F

from sepet.operators import category, match
from sepet.operators.postings import TABLES as INDEX
from sepet.plans.ingest import ingest_into
from sepet.plans.store import KEYS, TableStore
from sepet.sources.feeds import FEED_SCHEMA
from sepet.streaming.ingest_stream import stream_upsert


def feeds(spark, day, items):
    """One payload of (id, title, brand, category)."""
    rows = [
        {"id": k, "name": name, "brand": {"name": brand}, "category": {"name": raw}, "shownPrice": 100, "regularPrice": 100, "prettyName": f"p-{k}"}
        for k, name, brand, raw in items
    ]
    payload = json.dumps({"data": {"storeProductInfos": rows}})
    df = spark.createDataFrame([("migros", "su", 0, 0, payload)], "source string, search_term string, term_pos int, source_pos int, payload string")
    return df.withColumn("run_ts", F.lit(day).cast("timestamp")).select(*[f.split()[0] for f in FEED_SCHEMA.split(", ")])


@pytest.fixture
def tables(spark):
    categories = spark.sql("SELECT * FROM (VALUES (1, 'Su'), (2, 'Çay')) AS t(id, name)")
    keywords = spark.sql("SELECT * FROM (VALUES ('deterjan', 1)) AS t(keyword, category_id)")
    raw_map = spark.sql("SELECT CAST('' AS STRING) AS raw_text, 0 AS category_id WHERE false")
    queue = spark.sql("SELECT 0L AS id, '' AS raw_text, 0 AS suggested_id, 0D AS score, '' AS status WHERE false")
    return categories, keywords, raw_map, queue


def files(root, name):
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (root / name).glob("bucket=*")}


DAY1 = [(k, f"Doğa Ürün{k} Su {k} Lt", f"marka{k}", f"Yeni Su {k}") for k in range(1, 60)]
DAY2 = [(7, "Doğa Ürün7 Su 7 Lt", "marka7", "Yeni Su 7")]


def test_one_key_rewrites_one_bucket_of_each_table(spark, tmp_path, tables, monkeypatch):
    store = TableStore(spark, str(tmp_path), buckets=16)
    ingest_into(store, 1, feeds(spark, "2024-01-01", DAY1), *tables)
    assert store.read("products").count() == 59 and store.read("masters").count() == 59
    before = {name: files(tmp_path, name) for name in KEYS}
    scored, guess = [], category.category_best_guess
    monkeypatch.setattr(category, "category_best_guess", lambda texts, found: scored.append(texts.count()) or guess(texts, found))
    assert all(len(before[name]) > 8 for name in ("products", "masters", "queue"))
    ingest_into(store, 2, feeds(spark, "2024-01-02", DAY2), *tables)
    for name in KEYS:
        after = files(tmp_path, name)
        changed = [b for b in after if after[b] != before[name].get(b)]
        # All 59 texts are in the queue, none is mapped: the raw map has no rows at all. No master is new to the index.
        assert len(changed) == (0 if name in ("raw_map", *INDEX) else 1), name
    assert store.read("products").filter("external_id = 7").first()["last_updated"].day == 2
    assert store.read("masters").count() == 59
    # The text's guess was known; with other categories it is not.
    assert scored == [0] and store.read("guesses").count() == 59
    categories, *others = tables
    ingest_into(store, 3, feeds(spark, "2024-01-03", DAY2), categories.unionByName(spark.sql("SELECT 3 AS id, 'Kahve' AS name")), *others)
    assert scored == [0, 1] and store.read("guesses").count() == 59
    # A run that is committed already does nothing, whatever it is given.
    now = {name: files(tmp_path, name) for name in KEYS}
    ingest_into(store, 2, feeds(spark, "2024-01-03", DAY1), *tables)
    assert now == {name: files(tmp_path, name) for name in KEYS}
    # Another writer may think of another number of buckets: that of the first run stays.
    other = TableStore(spark, str(tmp_path), buckets=3)
    assert other.touched("products", spark.sql("SELECT 'migros' AS source, 7L AS external_id")) == store.touched(
        "products", spark.sql("SELECT 'migros' AS source, 7L AS external_id")
    )


@pytest.mark.parametrize("dies_after", [0, 1])
def test_a_run_that_dies_while_putting_in_place_is_finished(spark, tmp_path, monkeypatch, dies_after):
    keys = {"t": ("id",), "u": ("id",)}
    one = spark.range(20).withColumn("v", F.lit("old"))
    two = spark.range(5, 30).withColumn("v", F.lit("new"))
    store = TableStore(spark, str(tmp_path), keys, buckets=4)
    store.commit(1, {"t": one, "u": one})
    write = TableStore._write

    def dying(self, version, tables):
        for name in list(tables)[:dies_after]:
            write(self, name, spark.read.schema(tables[name]).parquet(f"{self.root}/staged/version={version}/{name}"))
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(TableStore, "_put_in_place", dying)
        with pytest.raises(RuntimeError, match="lost"):
            store.commit(2, {"t": two, "u": two})
    assert store.version() == 1 and store.read("u").filter("v = 'new'").isEmpty()
    assert store.read("t").filter("v = 'new'").isEmpty() == (dies_after == 0)
    # The next writer finishes the run from its copy, whatever it came to do.
    again = TableStore(spark, str(tmp_path), keys)
    assert not again.begin(2) and again.version() == 2
    for name in keys:
        assert sorted(again.read(name).collect()) == sorted(two.collect())
    assert list((tmp_path / "staged").iterdir()) == []


def test_a_run_that_dies_while_writing_aside_changes_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), {"t": ("id",)}, buckets=4)
    store.commit(1, {"t": spark.range(10)})
    with pytest.raises(Exception, match="stop"):
        store.commit(2, {"t": spark.range(20).select(F.when(F.col("id") > 15, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))})
    assert store.begin(2) and store.read("t").count() == 10
    store.commit(2, {"t": spark.range(5)})
    # Only buckets that have rows are replaced.
    left = {r[0] for r in store.read("t").collect()}
    assert set(range(5)) <= left <= set(range(10))


def test_streamed_listings_touch_their_buckets_and_versions_expire(spark, tmp_path):
    root, landing = tmp_path / "state", tmp_path / "landing"
    store = TableStore(spark, str(root), buckets=8)
    listing = spark.range(40).select(
        F.lit("a").alias("source"), F.col("id").alias("external_id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("image_url"),
        F.lit(1).cast("decimal(18,2)").alias("price"), F.lit(1).cast("decimal(18,2)").alias("regular_price"), F.lit("u").alias("product_url"),
        F.lit("c").alias("source_category"), F.lit("2024-01-01").cast("timestamp").alias("run_ts"),
        F.struct(F.lit(0).alias("term_pos"), F.lit(0).alias("source_pos"), F.col("id").alias("pos")).alias("seq"),
    )

    def land(df, day):
        df.withColumn("run_ts", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(landing))
        stream = spark.readStream.schema(listing.schema).parquet(str(landing))
        stream_upsert(stream, store, once=True).awaitTermination()

    land(listing, "2024-01-01")
    first = files(root, "products")
    for day in range(2, 8):
        land(listing.filter("external_id = 11").withColumn("title", F.lit(f"t{day}")), f"2024-01-0{day}")
    last = files(root, "products")
    assert sum(first[b] != last[b] for b in last) == 1 and store.version() == 7
    assert [r["title"] for r in store.read("products").filter("title <> 't'").collect()] == ["t7"]
    assert sorted(p.name for p in (root / "commits").iterdir()) == ["version=5", "version=6", "version=7"]


def test_stored_masters_are_not_tokenised_again(spark, tmp_path, tables):
    store = TableStore(spark, str(tmp_path), buckets=4)
    ingest_into(store, 1, feeds(spark, "2024-01-01", DAY1[:5]), *tables)
    stored = store.read("masters", [1])
    explained = match.prepare_masters(stored)._jdf.queryExecution().toString()
    # Block and token set are read; titles are not, and only the asked bucket's files are.
    physical = explained.split("== Physical Plan ==")[1]
    assert "regexp" not in explained and "canonical_title" not in physical and "PartitionFilters: [isnotnull(bucket" in physical
    # What is stored is what would be made of the titles.
    plain = store.read("masters").drop("block", "sig")
    assert match.prepare_masters(plain).exceptAll(match.prepare_masters(store.read("masters"))).isEmpty()
