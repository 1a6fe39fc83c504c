import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sepet.llm import hard_negatives
from sepet.llm.hard_negatives import Want, cluster_anchors, mine_negatives, walk

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("lab", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("label", "anchor", "score", "ident", "x", "number", "want")]
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA)


def run(df, step=10, **options):
    found = mine_negatives(df, "v", F.col("lab"), "vec_id", F.col("vec_id") % step == 0, **options)
    return [tuple(r) for r in found.collect()]


def plain(rows, step=10, positives=5, negatives=10):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            q = tuple(int(np.floor(256 * x)) for x in v)
            ok[i, label, q] = None
    out = []
    for i, label, q in ok:
        if i % step:
            continue
        score = lambda r: sum(a * b for a, b in zip(q, r[2]))
        near = sorted((-score(r), r[0], r[1]) for r in ok if r[0] != i and len(r[2]) == len(q))
        for s, p, _ in [n for n in near if n[2] == label][:positives]:
            fit = [n for n in near if n[2] != label and 30 * -s <= 100 * -n[0] <= 90 * -s][:negatives]
            out += [(i, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(rng, n, width=8, labels=4, noise=0.4):
    centres = rng.standard_normal((labels, width)) + 0.8
    return [(k, (centres[k % labels] + noise * rng.standard_normal(width)).tolist(), k % labels) for k in range(n)]


@pytest.mark.parametrize("block_values", [100, 500_000])
def test_against_all_scores(spark, block_values):
    rng = np.random.default_rng(1)
    rows = vectors(rng, 400) + vectors(rng, 60, width=5)
    rows += [(1_000, None, 1), (1_010, [1.0] * 8, None), (1_020, [1.0, None] + [1.0] * 6, 1), (1_030, [float("nan")] * 8, 1), (1_040, [float("inf")] * 8, 1)]
    rows += [(1_050, [0.0] * 8, 1), (1_060, [], 1), (None, [1.0] * 8, 2), *rows[20:60], (30, [0.5] * 8, 3)]
    random.Random(1).shuffle(rows)
    got = run(frame(spark, rows), block_values=block_values)
    assert sorted(got) == plain(rows) and len(got) > 500


def test_ties_and_one_vector_in_most_rows(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 80, width=4, noise=1.0)
    one = rows[3][1]
    rows += [(k, one, k % 3) for k in range(100, 400)]
    assert sorted(run(frame(spark, rows))) == plain(rows)


def test_rows_that_leave_the_tasks_do_not_grow_with_the_lots(spark):
    """Anchors are the same; with eight times as many lots hardly more rows are found in them."""
    rng = np.random.default_rng(5)
    data = [(i, np.floor(256 * np.array(v)).astype(int).tolist(), label) for i, v, label in vectors(rng, 4_000, noise=1.0)]
    rows = spark.createDataFrame([(i, label, v) for i, v, label in data], "ident long, label long, v array<long>")
    x = np.array([v for _, v, _ in data[:40]])
    clusters = cluster_anchors(x, np.array([d[2] for d in data[:40]]), np.arange(40), np.arange(40))
    wants = [[Want(m, False, -np.inf, np.inf, (int(k), 0)) for m, k in enumerate(c.numbers)] for c in clusters]
    made = {}
    for parts in (8, 64):
        lots = rows.repartition(parts, "ident")
        seen = []
        search = hard_negatives._ranked
        hard_negatives._ranked = lambda r, c, w, top: seen.append(r.mapInArrow(hard_negatives._search(c, w, top), "number long, want long, ident long, score long").count()) or search(r, c, w, top)
        try:
            found = hard_negatives._first(lots, clusters, wants, 10)
            assert found.count() == 400
        finally:
            hard_negatives._ranked = search
        made[parts] = seen[-1]
    assert made[64] < 2 * made[8] and made[64] < 64 * 400 / 4


def test_large_numbers(spark):
    rows = [(k, [1e5 * (k + 1), -3e5 * (k % 7), 2e5 + k], k % 2) for k in range(60)]
    assert sorted(run(frame(spark, rows))) == plain(rows)


def test_empty_and_no_anchor(spark):
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []
    assert run(frame(spark, [(10, [1.0], 1), (11, [1.0], 2)])) == []


def test_lists_end_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = 40 * rng.standard_normal((20, 16))
    rows = np.floor(centres[np.arange(6_000) % 20] + 5 * rng.standard_normal((6_000, 16))).astype(np.int64)
    labels, idents = np.arange(6_000) % 3, np.arange(6_000)
    total = 0
    for c in cluster_anchors(rows[:200], labels[:200], idents[:200], np.arange(200), 10):
        for top, same in ((5, True), (10, False)):
            wants = [Want(m, same, -np.inf, np.inf, ()) for m in range(len(c.numbers))]
            found, scored = walk(c, wants, rows, labels, idents, top)
            total += scored
            for m, (r, s) in enumerate(found):
                every = rows @ c.vectors[m]
                fit = np.flatnonzero(((labels == c.labels[m]) == same) & (idents != c.idents[m]))
                want = fit[np.lexsort((idents[fit], -every[fit]))[:top]]
                assert r.tolist() == want.tolist() and s.tolist() == every[want].tolist()
    assert total < 2 * 200 * 6_000 / 2
