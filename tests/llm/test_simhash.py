import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sepet.llm import simhash
from sepet.llm.common import star_components
from sepet.llm.simhash import fingerprint, fingerprint_links, golay_keys, near_duplicates, nearest_codeword

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {f: find(f) for f in fps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint(odd_texts):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "é", "c\x0bd"]) for _ in range(n)) for n in range(40)]
    for t in [*texts, *odd_texts[:6]]:
        assert fingerprint(None if t is None else t.encode()) == signed(plain_fingerprint(t))
    assert fingerprint(b"") == fingerprint(None) == 0


def test_code_is_perfect():
    assert set(np.bincount(nearest_codeword(), minlength=4096)) == {2048}


def test_near_fingerprints_share_a_key():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**63), 2**63 - 1, 3_000, dtype=np.int64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, k % 4, replace=False):
            y[k] ^= np.uint64(1 << int(b)).astype(np.int64)
    left, right = [{}, {}], [{}, {}]
    for fps, into in ((x, left), (y, right)):
        for row, key, side in zip(*golay_keys(fps), strict=True):
            into[side].setdefault(row, set()).add(key)
    assert all(left[0][k] & right[1][k] and left[1][k] & right[0][k] for k in range(len(x)))


@pytest.mark.parametrize("block_rows", [3, 4_096])
def test_links_connect_all_near_fingerprints(spark, block_rows):
    rng = random.Random(6)
    fps = set()
    for _ in range(30):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            fps.add(signed(at))
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = fingerprint_links(df, block_rows=block_rows)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 64 for r in links.collect())
    found = {r["node"]: r["component"] for r in star_components(links).collect()}
    assert {f: found.get(f, f) for f in fps} == plain_components(fps)


def test_large_group_gives_few_edges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 5_000)
    near = [1 << a | 1 << b for a in range(40) for b in range(a)]  # within two bits of 0, so linked by 0
    df = spark.createDataFrame([(f,) for f in [0, *near]], "fp bigint")
    links = fingerprint_links(df)
    assert links.count() < 200 * len(near)
    assert {r["component"] for r in star_components(links).collect()} == {0}


def test_components_of_documents(docs_of, odd_texts):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(200)]
    texts = list(odd_texts)
    for k in range(40):
        own = list(base) if k % 2 else [rng.choice(words) for _ in range(60)]
        own[k] = "changed"
        texts.append(" ".join(own))
    rows = {r["ident"]: r for r in near_duplicates(docs_of(texts, clash=True), "text", "doc_id").collect()}
    fps = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    roots = plain_components(set(fps.values()))
    first = {}
    for k in fps:
        first.setdefault(roots[fps[k]], k)
    assert {k: r["component"] for k, r in rows.items()} == {k: first[roots[fps[k]]] for k in fps}


def test_null_and_repeated_ids_and_no_rows(docs_of):
    out = near_duplicates(docs_of([(None, "a b c d", "s"), (None, "a b c d", "s"), (5, "x y z", "s"), (5, "x y z", "s")]), "text", "doc_id")
    assert sorted((str(r["ident"]), str(r["component"])) for r in out.collect()) == [("5", "5")] * 2 + [("None", "None")] * 2
    assert near_duplicates(docs_of([]), "text", "doc_id").count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert star_components(chain).agg(F.max("component"), F.count("*")).first()[:] == (0, 301)
