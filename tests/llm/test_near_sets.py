import random

import corpus_pipeline as pipeline
import numpy as np
import pytest

from sepet.llm import near_sets
from sepet.llm.near_sets import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """The smallest index that links of similarity 0.8 reach."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) / union >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [find(k) for k in range(len(texts))]


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def changed(rng, words, n):
    """``n`` words far from each other changed: each is in five shingles."""
    words = list(words)
    for k in range(n):
        words[10 + k * (len(words) // max(1, n + 1))] = f"new{rng.random()}"
    return words


def test_stage_drops_planted_near_copies(spark, docs_of):
    rng = random.Random(2)
    texts, near, far = [], [], []
    for k in range(40):
        base = prose(rng, 400)
        # 1 to 8 of 400 words changed: similarity 0.975 to 0.816; 11 and more: under 0.77.
        for n, into in ((k % 8 + 1, near), (11 + k % 4, far)):
            into.append(len(texts) + (1 if into is near else 2))
            (base_copy := changed(rng, base, n))
            texts += [" ".join(base)] * (into is near) + [" ".join(base_copy)]
    got = {r["doc_id"] for r in pipeline.simhash_dedup(spark, docs_of(texts), "").collect()}
    want = {k for k, c in enumerate(brute(texts)) if c == k}
    assert got == want and len(texts) - len(want) >= 40


@pytest.mark.parametrize("block", [3, 256])
def test_components_against_brute_force(docs_of, monkeypatch, odd_texts, block):
    monkeypatch.setattr(near_sets, "BLOCK_DOCS", block)
    rng = random.Random(3)
    texts = list(odd_texts)
    family = prose(rng, 200)
    for k in range(30):  # a large group, partly linked by chains alone
        family = changed(rng, family, 1) if k % 3 else family
        texts.append(" ".join(changed(rng, family, k % 4)))
    for _ in range(10):
        base = prose(rng, 120)
        texts += [" ".join(base), " ".join(changed(rng, base, rng.randrange(4)))]
    rows = near_copies(docs_of(texts, clash=True), "text", "doc_id").collect()
    got = {r["node"]: r["component"] for r in rows}
    assert [got.get(k, k) for k in range(len(texts))] == brute(texts)


def test_keys_meet_at_the_bound():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(2_000):
        x = np.unique(rng.integers(0, 2**63, 180, dtype=np.uint64))
        a, b = x[rng.permutation(180)[:162]], x
        b = np.concatenate((a[:144], x[~np.isin(x, a)]))  # 144 of 180 shared: 0.8
        missed += not (near_sets.band_keys(a) == near_sets.band_keys(b)).any()
    assert missed <= 3


def test_null_and_repeated_ids_and_no_rows(docs_of):
    text = " ".join(prose(random.Random(1), 50))
    out = near_copies(docs_of([(None, text, "s"), (4, text, "s"), (5, text, "s"), (5, "x y z", "s"), (7, "x  Y z", "s"), (8, "q", "s")]), "text", "doc_id")
    assert sorted((r["node"], r["component"]) for r in out.collect()) == [(4, 4), (5, 4), (7, 4)]
    assert near_copies(docs_of([]), "text", "doc_id").count() == 0
