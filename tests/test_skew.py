from pyspark.sql import functions as F

from sepet.operators import skew


def numbers(spark, n=2000):
    """A third of all rows share one key, and many share their value."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("g"),
        (F.col("id") * 7919 % 40).alias("v"),
        "id",
    )


def test_rank_by_ranges_equals_window(spark):
    df = numbers(spark)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("v").desc(), F.col("id")]
    plain = {tuple(r) for r in skew.rank_in_groups(df, "g", order, sizes).select("id", "rank").collect()}
    ranged = skew.rank_in_groups(df, "g", order, sizes, task_rows=100)
    assert {tuple(r) for r in ranged.select("id", "rank").collect()} == plain
    sizes_seen = ranged.groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("rank").alias("d"))
    assert all(r["n"] == r["m"] == r["d"] for r in sizes_seen.collect())


def test_salted_join_equals_join(spark):
    df = numbers(spark)
    one = spark.range(40).select(F.col("id").cast("int").alias("g"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, df.join(one, ["g"], how).collect()))
        got = skew.salted_join(df, one, ["g"], how, task_rows=50)
        assert sorted(map(str, got.collect())) == want, how


def test_hot_keys_are_few(spark):
    hot = skew.hot_keys(numbers(spark), ["g"], 100).collect()
    assert [(r["g"], r["_salts"]) for r in hot] == [(0, 7)]


def test_broadcast_only_below_the_bound(spark):
    small = spark.range(10)
    assert "ResolvedHint" in skew.broadcast_if_small(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in skew.broadcast_if_small(small, 9)._jdf.queryExecution().analyzed().toString()


def test_ranges_do_not_grow_without_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_RANGES", 7)
    df = numbers(spark)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("v").desc(), F.col("id")]
    ranged = skew.rank_in_groups(df, "g", order, sizes, task_rows=20)
    dealt = ranged.filter("g = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert 1 < dealt <= 7
    plain = skew.rank_in_groups(df, "g", order, sizes)
    assert sorted(map(str, ranged.select("id", "rank").collect())) == sorted(map(str, plain.select("id", "rank").collect()))
