import numpy as np
import pytest
from pyspark.sql import types as T

from sepet.llm import rp_forest
from sepet.llm.rp_forest import link_vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType()), T.StructField("rep", T.StringType())])


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "x", "y") for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok)]
    links, root = [0] * len(vectors), list(range(len(vectors)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in range(len(vectors))}


def found(df):
    return {r["ident"]: (r["n_links"], r["component"]) for r in link_vectors(df, "v", "vec_id").collect()}


def clusters(rng, width, groups, noise):
    out = []
    for size in groups:
        centre = rng.standard_normal(width)
        out += [(centre / np.linalg.norm(centre) + noise * rng.standard_normal(width)).astype(np.float32).tolist() for _ in range(size)]
    return out


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = clusters(rng, 24, [1] * 60 + [2] * 20 + [30], 0.02)
    vectors += [vectors[0]] * 4 + [vectors[61]] * 3
    vectors += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    vectors += [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1e-30, 0.0]]
    assert found(frame(spark, vectors)) == brute(vectors)


def test_large_leaves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "BLOCK", 16)
    monkeypatch.setattr(rp_forest, "SAMPLE_LEAF", 8)
    rng = np.random.default_rng(2)
    vectors = clusters(rng, 16, [70, 40] + [1] * 150, 0.03)
    assert found(frame(spark, vectors)) == brute(vectors)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    # Pairs near the threshold, where separation by a split is likeliest.
    base = rng.standard_normal((900, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((900, 32))
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    vectors = np.concatenate((base, 0.96 * base + np.sqrt(1 - 0.96**2) * side)).astype(np.float32)
    got = found(frame(spark, vectors.tolist()))
    want = brute([v.tolist() for v in vectors])
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())


def test_no_rows(spark):
    assert found(frame(spark, [])) == {}


@pytest.mark.parametrize("ids", [[None, None, 4], [4, 4, 4]])
def test_null_and_repeated_ids(spark, ids):
    out = link_vectors(frame(spark, [[1.0, 0.0]] * 3, ids), "v", "vec_id").collect()
    assert [r["n_links"] for r in out] == [2, 2, 2] and {r["component"] for r in out} == {4}
