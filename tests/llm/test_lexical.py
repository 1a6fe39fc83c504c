import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sepet.llm import lexical
from sepet.llm.lexical import Item, Lot, search_items, search_lot, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("" if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def plain(docs, items, top):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item, text in set(items):
        scores = []
        for doc, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, k in Counter(words(text)).items() if t in c
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out |= {(item, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scores)[:top], 1)}
    return out


def corpus(rng, n, vocabulary=200, length=40):
    weights = [1 / (k + 1) for k in range(vocabulary)]
    return [" ".join(rng.choices([f"w{k}" for k in range(vocabulary)], weights, k=rng.randrange(length))) for _ in range(n)]


def table(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} string, terms string, n string, score string, item string, rank string")


def run(spark, docs, items, top=20):
    pad = ("x",) * 5
    found = search_items(
        table(spark, [(*r, *pad) for r in docs], ("doc_id", "text")), "text", "doc_id",
        table(spark, [(*r, *pad) for r in items], ("item_id", "text")), "text", "item_id", top,
    )
    return [tuple(r) for r in found.collect()]


def test_terms():
    text = "Ab-c d_é1\x00Ünï É漢字\x7f.Z9 "
    assert [t.decode() for t in terms_of(text.encode())] == words(text)


@pytest.mark.parametrize("block_items", [1, 5_000])
def test_against_plain_scores(spark, odd_texts, monkeypatch, block_items):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block_items)
    rng = random.Random(2)
    docs = list(enumerate(odd_texts + corpus(rng, 300)))
    docs += docs[40:60] + [(None, t) for _, t in docs[60:64]] + [(7, "w5 w6 other")]
    items = [(0, "w0 w0 W150 nothere"), (1, None), (2, ""), (3, " ".join(f"w{k}" for k in range(0, 200, 2))), (4, "lorem É 漢字 a"), (4, "w7 w8"), (5, "w9"), (5, "w9")]
    got = run(spark, docs, items)
    assert set(got) == plain(docs, items, 20) and len(got) == len(set(got))


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a b")], []) == []
    assert run(spark, [(1, None), (2, " . ")], [(1, "a")]) == []


def test_ties_go_by_ident(spark):
    docs = [(k, "same text") for k in range(60, 0, -1)] + [(k, "other") for k in range(100, 200)]
    assert [r[2] for r in sorted(run(spark, docs, [(1, "text")]))] == list(range(1, 21))


def lot_of(texts, vocabulary):
    counts = [Counter(words(t)) for t in texts]
    lists = [[[vocabulary[t] for t in c if t in vocabulary] for c in counts], [[k for t, k in c.items() if t in vocabulary] for c in counts]]
    n = [sum(c.values()) for c in counts]
    columns = [pa.array(range(len(texts))), pa.array(n), *[pa.array(x, pa.list_(pa.int32())) for x in lists]]
    return Lot(pa.table(columns, ["doc", "n", "terms", "counts"]), len(texts), sum(n)), counts


@pytest.mark.parametrize("n_terms", [5, 100])
def test_search_stops_safely(n_terms):
    rng = random.Random(4)
    texts = [t or "w0" for t in corpus(rng, 5_000, 400)]
    vocabulary = {f"w{k}": k for k in range(400)}
    lot, counts = lot_of(texts, vocabulary)
    df = Counter(t for c in counts for t in c)
    terms = [0, 1, *rng.sample(range(3, 400), n_terms - 2)]
    weights = np.array([math.floor(1000 * math.log((2 * 5_000 + 2) / (2 * df[f"w{k}"] + 1))) for k in terms], np.int64)
    item = Item(1, np.array(terms), np.ones(n_terms, np.int64), weights)
    best, scores, scored = search_lot(lot, item, 20, 1)
    m = [75 + 25 * sum(c.values()) * 5_000 // sum(map(len, (t.split() for t in texts))) for c in counts]
    every = {d: sum(w * ((10**9 * c[f"w{k}"]) // (1000 * c[f"w{k}"] + 12 * m[d])) for k, w in zip(terms, weights.tolist()) if f"w{k}" in c) for d, c in enumerate(counts)}
    least = sorted(every.values())[-20]
    assert dict(zip(best.tolist(), scores.tolist())) == {d: s for d, s in every.items() if s >= least}
    # Most documents hold a term of the item, and few of them are scored.
    assert scored < sum(s > 0 for s in every.values()) / 2
    assert len(search_lot(lot, item, 20, least + 1)[0]) < 20
