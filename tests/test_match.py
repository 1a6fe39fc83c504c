import random

import pytest
from plain_rules import agree, assign, score
from pyspark.sql import functions as F

from sepet.operators import match
from sepet.operators.fuzzy import fuzzy_token_join

WORDS = (
    "makarna makarma makarnalar spaghetti spagetti cay cayi cayir sut sutlu kahve kahvesi peynir peyniri peynirr "
    "zeytinyagi zeytinyagli zetinyagi limon limonn nane deterjan deterjani cokolatalibiskuvi cokolatalibiskuvisi "
    "cokolatalibiskivu abcdefghijklmnopqrst abcdefghijklmnopqrts abcdefghijklmnopqrstu bcdefghijklmnopqrst"
).split()


def items(rng, n, blocks, most, blank=0.03):
    out = []
    for i in range(n):
        size = 0 if rng.random() < blank else rng.randint(1, most)
        tokens = []
        for _ in range(size):
            w = rng.choice(WORDS)
            if w not in tokens:
                tokens.append(w)
        out.append((f"b{rng.randrange(blocks)}", i, tokens))
    return out


def at(df, day):
    seq = F.struct(F.lit(0).alias("term_pos"), F.lit(0).alias("source_pos"), F.col("i").alias("pos"))
    return df.withColumn("run_ts", F.lit(day).cast("timestamp")).withColumn("seq", seq)


def as_listings(spark, rows):
    """Brand alone makes the block; words come back as the token set."""
    data = [("shop", i, b, " ".join(t), i) for b, i, t in rows]
    df = at(spark.createDataFrame(data, "source string, external_id long, brand string, title string, i long"), "2024-01-01")
    return match.prepare_listings(df).withColumn("own_key", F.concat(F.lit("k"), F.col("i").cast("string")))


def as_masters(spark, rows):
    data = [(b, f"m{i}", " ".join(t), i) for b, i, t in rows]
    df = at(spark.createDataFrame(data, "brand string, master_key string, canonical_title string, i long"), "2023-01-01")
    size = [F.lit(None).cast("decimal(18,4)").alias("size_value"), F.lit(None).cast("string").alias("size_unit")]
    return match.prepare_masters(
        df.select("*", *size, F.lit(1).alias("pack_quantity"), F.struct("run_ts", "seq").alias("founded_order"))
    )


def test_fuzzy_join_finds_all_pairs(spark):
    rng = random.Random(3)
    words = set(WORDS)
    for w in WORDS:
        for _ in range(6):
            letters = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(letters))
                action = rng.randrange(3)
                if action == 0 and len(letters) > 1:
                    del letters[at]
                elif action == 1:
                    letters.insert(at, rng.choice("abck"))
                else:
                    letters[at] = rng.choice("abck")
            words.add("".join(letters))
    df = spark.createDataFrame([(w,) for w in sorted(words)], "token string")
    got = {tuple(r) for r in fuzzy_token_join(df, df).collect()}
    assert got == {(a, b) for a in words for b in words if agree(a, b)}


def check(spark, rows, stored, **options):
    expected = assign(
        [(b, f"k{i}", t) for b, i, t in rows], [(b, f"m{i}", t) for b, i, t in stored]
    )
    masters = as_masters(spark, stored) if stored else None
    got = match.assign_masters(as_listings(spark, rows), masters, **options).select("own_key", "master_key", "founds").collect()
    assert {r[0]: r[1] for r in got} == expected
    assert {r[0] for r in got if r[2]} == {k for k, m in expected.items() if k == m}


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_blocks_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = items(rng, 300, 12, 4)
    check(spark, rows, items(rng, 20, 14, 3, blank=0.1))
    check(spark, rows, [])


@pytest.mark.parametrize("seed,blank", [(4, 0.0), (5, 0.03)])
def test_joined_blocks_equal_the_loop(spark, seed, blank):
    rng = random.Random(seed)
    rows = items(rng, 160, 2, 5, blank)
    check(spark, rows, [], fold_bytes=0, first_batch=8, task_rows=40)


def test_joined_blocks_with_stored_masters(spark):
    rng = random.Random(6)
    rows = items(rng, 120, 3, 4, 0.05)
    check(spark, rows, items(rng, 25, 3, 3, 0.0), fold_bytes=0, first_batch=16)
    check(spark, rows, items(rng, 25, 3, 3, 0.2), fold_bytes=1_000, first_batch=16)


def test_matching_order_case(spark):
    three = [("p", 0, ["a1x", "b1x"]), ("p", 1, ["a1x", "b1x", "c1x"]), ("p", 2, ["c1x", "b1x"])]
    two = [("q", 3, ["a1x", "b1x", "c1x", "d1x"]), ("q", 4, ["a1x", "b1x", "c1x"])]
    got = match.assign_masters(as_listings(spark, three + two)).filter("founds").collect()
    assert sorted(r["own_key"] for r in got) == ["k0", "k1", "k2", "k3"]


@pytest.mark.parametrize("fold_bytes", [0, 100_000])
def test_best_match_equals_the_loop(spark, fold_bytes):
    rng = random.Random(8)
    rows, stored = items(rng, 120, 3, 4, 0.05), items(rng, 60, 3, 4, 0.03)
    found = match.best_match(as_listings(spark, rows), as_masters(spark, stored), fold_bytes=fold_bytes)
    got = {r["own_key"]: (r["master_key"], r["score"]) for r in found.collect()}
    for b, i, t in rows:
        best = (None, 0.0)
        for c, j, m in stored:
            s = score(m, t, True)
            if b == c and s > best[1]:
                best = (f"m{j}", s)
        assert got[f"k{i}"] == (best if best[1] >= 0.7 else (None, None))


def test_result_does_not_depend_on_partitions(spark):
    rows = as_listings(spark, items(random.Random(9), 200, 5, 4))
    once = {tuple(r) for r in match.assign_masters(rows.repartition(1)).select("own_key", "master_key").collect()}
    again = {tuple(r) for r in match.assign_masters(rows.repartition(7)).select("own_key", "master_key").collect()}
    assert once == again
