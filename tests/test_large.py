"""What holds for large data and several machines: no silent loss, no narrow types, no blow-up."""

import random

import pytest
from pyspark.sql import functions as F

from sepet import session
from sepet.functions.text import brand_key
from sepet.operators import catalog, fuzzy, match, skew
from sepet.plans.store import TableStore


class _Cluster:
    """As much of a session as ``shared_dir`` looks at, on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)
    _Cluster.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)


@pytest.mark.parametrize("task_rows", [10, 1000])
def test_ranks_are_bigint(spark, task_rows):
    df = spark.range(100).select(F.lit(1).alias("g"), "id")
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert dict(skew.rank_in_groups(df, "g", [F.col("id")], sizes, task_rows=task_rows).dtypes)["rank"] == "bigint"


def test_store_takes_only_a_missing_path_for_empty(spark, tmp_path):
    assert TableStore(spark, f"{tmp_path}/none").version() is None
    store = TableStore(spark, f"{tmp_path}/other")
    # What a run leaves that dies before its row is written is no version.
    (tmp_path / "other" / "commits" / "version=4" / "_temporary").mkdir(parents=True)
    assert store.version() is None

    class Broken:
        @property
        def sparkContext(self):
            raise PermissionError("no right to read")

    with pytest.raises(PermissionError):
        TableStore(Broken(), "x").version()


def test_brands_are_equal_whatever_the_case(spark):
    rows = spark.createDataFrame([("PİNAR ",), ("pinar",), ("Pinar",)], "b string")
    assert rows.select(brand_key(F.col("b"))).distinct().count() == 1
    masters = spark.createDataFrame([("m1", "t", "PİNAR"), ("m2", "t", "other")], "master_key string, canonical_title string, brand string")
    assert [r["master_key"] for r in catalog.brand_filter(masters, "pinar").collect()] == ["m1"]


def test_order_of_search_results(spark):
    masters = spark.createDataFrame([(f"m{k}", f"t{k * 7 % 5}", "b") for k in range(10)], "master_key string, canonical_title string, brand string")
    products = spark.createDataFrame([(f"m{k}", k * 3 % 10, None) for k in range(10)], "master_key string, price int, image_url string")
    keys = {
        "price_asc": lambda r: (r["lowest_price"], r["master_key"]),
        "price_desc": lambda r: (-r["lowest_price"], r["master_key"]),
        "name_desc": lambda r: (-int(r["canonical_title"][1:]), r["master_key"]),
        "unknown": lambda r: (r["canonical_title"], r["master_key"]),
        None: lambda r: (r["canonical_title"], r["master_key"]),
    }
    for sort, key in keys.items():
        found = catalog.product_search(masters, products, sort=sort)
        rows = found.collect()
        assert rows == sorted(rows, key=key)
        for task_rows in (3, 1000):
            places = catalog.search_places(found, sort, task_rows).collect()
            assert [r["place"] for r in sorted(places, key=key)] == list(range(1, 11))


def _edits(word, rng, n):
    for _ in range(n):
        k = rng.randrange(len(word))
        word = rng.choice([word[:k] + word[k + 1 :], word[:k] + "z" + word[k:], word[:k] + "z" + word[k + 1 :]])
    return word


def test_long_words_within_two_edits_are_found(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([15, 17, 24, 31, 33, 35, 48, 70]))) for _ in range(120)]
    near = [(w, _edits(w, rng, k % 3)) for k, w in enumerate(words)]
    left = spark.createDataFrame([(a,) for a, _ in near], "token string")
    right = spark.createDataFrame([(b,) for _, b in near], "token string")
    found = {tuple(r) for r in fuzzy.fuzzy_token_join(left, right).collect()}
    assert set(near) <= found


def _candidates(spark, n):
    codes = spark.range(n).select(F.concat(F.lit("commonpart"), F.lpad(F.conv(F.xxhash64("id").bitwiseAND(2**44 - 1).cast("string"), 10, 16), 11, "0")).alias("token"))
    a = codes.select("token", F.explode(fuzzy._signatures(F.col("token"), True)).alias("s"))
    b = codes.select("token", F.explode(fuzzy._signatures(F.col("token"), False)).alias("s"))
    return a.join(b.withColumnRenamed("token", "other"), "s").filter("token <> other").count()


def test_codes_with_a_common_beginning_give_few_candidates(spark):
    assert _candidates(spark, 2_000) <= 400 and _candidates(spark, 4_000) <= 800


def test_masters_of_untouched_blocks_are_not_compared(spark, monkeypatch):
    stored = spark.createDataFrame(
        [(f"m{k}", f"Makarna {k} burgu 500 Gr", f"brand{k}", 500.0, "G", 1, k) for k in range(6)],
        "master_key string, canonical_title string, brand string, v double, size_unit string, pack_quantity int, pos long",
    ).select(
        "master_key", "canonical_title", "brand", F.col("v").cast("decimal(18,4)").alias("size_value"), "size_unit", "pack_quantity",
        F.struct(F.lit("2020-01-01").cast("timestamp").alias("run_ts"), F.struct(F.lit(0).alias("term_pos"), F.lit(0).alias("source_pos"), "pos").alias("seq")).alias("founded_order"),
    )
    new = spark.createDataFrame(
        [("a", 1, "Makarna burgu 500 Gr", "brand2"), ("a", 2, "Bulgur 1 KG", "brand9")],
        "source string, external_id long, title string, brand string",
    ).select("*", F.lit("2024-01-01").cast("timestamp").alias("run_ts"), F.struct(F.lit(0).alias("term_pos"), F.lit(0).alias("source_pos"), F.col("external_id").alias("pos")).alias("seq"))
    seen = []
    fold = match._fold_blocks
    monkeypatch.setattr(match, "_fold_blocks", lambda shapes, threshold: seen.append({(r["block"], r["asked"]) for r in shapes.collect()}) or fold(shapes, threshold))
    out = match.assign_masters(match.prepare_listings(new), match.prepare_masters(stored)).collect()
    assert {r["external_id"]: (r["master_key"] == "m2", r["founds"]) for r in out} == {1: (True, False), 2: (False, True)}
    assert len({b for b, _ in seen[0]}) == 2 and sum(a for _, a in seen[0]) == 2


def test_settled_tables_of_a_run_go_with_it(spark, tmp_path):
    with session.settling(spark):
        kept = session.settle(spark.range(5))
        folder = kept.inputFiles()[0].rsplit("/", 2)[0]
        assert kept.count() == 5
    from pathlib import Path

    assert not Path(folder.removeprefix("file:").replace("//", "/")).exists()
    store = TableStore(spark, str(tmp_path))
    for version in range(1, 7):
        store.commit(version, {"t": spark.range(version)})
    store.expire(keep=2)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["version=5", "version=6"] and store.read("t").count() == 6
