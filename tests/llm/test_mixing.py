import random

import pytest
from pyspark.sql import functions as F

from sepet.llm.common import word_count
from sepet.llm.mixing import mix_sources


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling in rounds: what is above a cap is dealt again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            out[s] += part[s]
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                open_.discard(s)
    return out


def run(df, **options):
    rows = df.withColumn("_n", word_count(F.col("text")))
    return mix_sources(rows, "source", "_n", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), **options)


@pytest.mark.parametrize("bucket_rows", [1, 7, 1000])
def test_budgets(docs_of, bucket_rows):
    rng = random.Random(5)
    names = ["a", "b", "c", "d", "é", None]
    rows = [(k, "w " * rng.randrange(0, 40), names[min(int(rng.expovariate(0.6)), 5)]) for k in range(400)]
    out = run(docs_of(rows), bucket_rows=bucket_rows).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert len({r["target"] for r in mine}) == 1 and abs(mine[0]["target"] - want[s]) < 1e-6
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["_n"] for r in mine)
        # One row at most is cut: all others are taken as often as there are whole epochs, or once more.
        assert sum(r["_n"] > 0 and r["taken"] % r["_n"] != 0 for r in mine) <= 1
    again = run(docs_of(rows), bucket_rows=bucket_rows).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_odd_rows(docs_of, odd_texts):
    rows = [(k % 7 or None, t, None if k % 2 else "s") for k, t in enumerate(odd_texts * 2)]
    out = run(docs_of(rows)).collect()
    assert len(out) == len(rows)
    for s in (None, "s"):
        mine = [r for r in out if r["source"] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 0.5)


def test_no_words_and_no_rows(docs_of):
    assert [r["taken"] for r in run(docs_of([None, "", " "])).collect()] == [0, 0, 0]
    assert run(docs_of([])).count() == 0


def test_clashing_columns(docs_of):
    df = docs_of(["a b", "c d e"], clash=True)
    assert set(df.columns) <= set(run(df).columns) and run(df).count() == 2


def test_any_names(docs_of):
    rows = [(k, "w " * (k % 5), f"s{k % 3}") for k in range(40)]
    plain = {r["doc_id"]: r["taken"] for r in run(docs_of(rows)).collect()}
    df = docs_of(rows)
    for name in ("_mix_s", "_mix_size", "_MIX_TOTAL", "_mix_start", "_mix_target", "Target", "row", "range", "start", "key", "its_source", "before", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    out = run(df)
    assert {r["doc_id"]: r["taken"] for r in out.collect()} == plain
    assert [c for c in out.columns if c.lower() == "target"] == ["target"]
    assert out.filter("_mix_s <> 'x' or `a.b` <> 'x' or `row` <> 'x' or before <> 'x'").isEmpty()
