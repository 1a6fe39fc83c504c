"""Large blocks: candidates when all tokens are common, and rounds along a chain."""

import random

from plain_rules import assign
from pyspark.sql import functions as F
from test_match import as_listings, as_masters, check

from sepet.operators import match


def words(rng, n):
    """Words of which no two agree."""
    return ["".join(rng.choice("abcdefghijklmnoprstuvyz") for _ in range(12)) for _ in range(n)]


def shapes(spark, rng, n, vocabulary, size=8):
    made = {" ".join(rng.sample(vocabulary, size)) for _ in range(n)}
    return spark.createDataFrame([("b", s) for s in sorted(made)], "block string, sig string")


def test_candidates_of_common_tokens_grow_with_the_shapes(spark):
    """Every token stands in 32 of 1,000 shapes, then in 64 of 4,000: twice as many, so that pairs by single tokens
    would grow eightfold."""
    rng = random.Random(1)
    found = {}
    for n, size in ((1_000, 250), (4_000, 500)):
        df = shapes(spark, rng, n, words(rng, size))
        found[n] = match.candidate_pairs(df, df).filter("sig <> l_sig").count()
    assert found[4_000] <= 4.5 * found[1_000] and found[4_000] <= match.FEW * 4_000


def test_few_candidates_where_every_token_stands_in_a_tenth_of_all_shapes(spark):
    rng = random.Random(2)
    df = shapes(spark, rng, 1_500, words(rng, 80))
    assert match.candidate_pairs(df, df).filter("sig <> l_sig").count() <= 20 * 1_500


def test_wide_keys_lose_no_pair(spark, monkeypatch):
    rng = random.Random(3)
    stems = words(rng, 14)
    vocabulary = [*stems, *[w[:-1] for w in stems], *[w + "x" for w in stems]]
    rows = [("b", k, rng.sample(vocabulary, rng.randint(1, 9))) for k in range(150)]
    for few in (0, 4):  # by cost alone, mixed
        monkeypatch.setattr(match, "FEW", few)
        check(spark, rows, [], fold_bytes=0)


def rounds_of(monkeypatch):
    calls = []
    decide = match._decide
    pairs = match.match_pairs
    settled = match.DataFrame.mapInArrow
    monkeypatch.setattr(match.DataFrame, "mapInArrow", lambda self, f, *a, **k: (calls.append("round") if f is decide else None) or settled(self, f, *a, **k))
    monkeypatch.setattr(match, "match_pairs", lambda *a, **k: calls.append("pairs") or pairs(*a, **k))
    return calls


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Titles of ten words out of a row of 2,009: each matches the one before and the one after."""
    row = words(random.Random(4), 2_009)
    chain = [("b", k, row[k : k + 10]) for k in range(2_000)]
    calls = rounds_of(monkeypatch)
    out = match.assign_masters(as_listings(spark, chain), fold_bytes=0, first_batch=4_096).select("own_key", "master_key").collect()
    # Every second title founds; the next one joins it.
    assert {r["own_key"]: r["master_key"] for r in out} == {f"k{k}": f"k{k - k % 2}" for k in range(2_000)}
    assert len(calls) < 20
    # The plain loop says so, on a part of it.
    assert assign([(b, f"k{k}", t) for b, k, t in chain[:60]]) == {f"k{k}": f"k{k - k % 2}" for k in range(60)}


def test_a_chain_over_many_ranges(spark, monkeypatch):
    row = words(random.Random(5), 300)
    batch = spark.createDataFrame([("b", " ".join(row[k : k + 10]), k) for k in range(290)], "block string, sig string, ord long")
    calls = rounds_of(monkeypatch)
    found = match._independent(batch, 0.7, task_edges=4).join(batch, ["block", "sig"])
    assert sorted(r["ord"] for r in found.collect()) == list(range(0, 290, 2))
    # 4 + 8 + 16 + ... edges a task.
    assert calls.count("round") <= 8


def test_best_match_reads_masters_in_batches_of_any_size(spark):
    rng = random.Random(6)
    row = words(rng, 300)
    stored = [("b", k, row[k : k + 10]) for k in range(0, 280, 2)]
    asked = [("b", k, row[k : k + 10]) for k in range(1, 280, 2)]
    found = match.best_match(as_listings(spark, asked), as_masters(spark, stored), fold_bytes=0)
    assert {r["own_key"]: r["master_key"] for r in found.collect()} == {f"k{k}": f"m{k - 1}" for k in range(1, 280, 2)}
    assert found.filter(F.col("score") < 0.8).isEmpty()
