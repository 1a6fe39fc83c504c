import random

import numpy as np
import pytest

from sepet.llm import toxicity as tox

INSULTS = ["blorgface", "snivelrat", "grumwit", "drabskull"]


def plain_kernel(a, b):
    """Sums over all pairs of bounded subsequences."""

    def parts(word):
        symbols, _ = tox._symbols([word])
        s = symbols[: len(word) + 2].tolist()
        out = {}
        for k in range(len(s)):
            for gaps in tox._GAPS:
                if k + gaps[-1] < len(s):
                    key = tuple(s[k + g] for g in gaps)
                    out[key] = out.get(key, 0.0) + tox.DECAY ** (gaps[-1] + 1 - tox.ORDER)
        return out

    x, y = parts(a), parts(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (tox._norms([a])[0] * tox._norms([b])[0])


def test_kernel_and_margins_against_plain_sums():
    words = ["idle", "i.d.l.e", "a", "", "éàü", "lidle", "addled", "x1#y"]
    got = tox.kernel(words, words)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want) and np.linalg.eigvalsh(got).min() > -1e-9
    machine = tox.train(["grumwit", "grumwits", "grumwit!"], ["table", "window", "water", "grim"])
    table = machine.table()
    values = tox.margins(words, table, machine.offset)
    share = []
    for w in words:
        rows, numbers, weights = tox.explicit([w])
        share.append(float((weights * table[numbers]).sum()) + machine.offset)
    assert np.allclose(values, share, atol=1e-4)


def corpus(seed, rows):
    rng = random.Random(seed)
    syllables = ["ta", "ren", "mo", "li", "sar", "den", "ko", "vi", "pul", "ne"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    out = []
    for k in range(rows):
        words = [word() for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS))
        out.append((k, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def machine(spark):
    df = spark.createDataFrame(corpus(1, 400), "doc_id bigint, text string, toxic int")
    return tox.learn_toxicity(df, "text", "toxic", "doc_id")


def test_held_out_accuracy(spark, machine):
    rows = corpus(2, 300)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    score = {r["ident"]: r["score"] for r in tox.score_toxicity(df, "text", "doc_id", machine).collect()}
    wrong = sum((score[i] >= tox.CUT) != (y == 1) for i, _, y in rows)
    assert wrong <= 6


@pytest.mark.parametrize(
    "insult", ["blorgface", "blorg-face", "b.l.o.r.g.f.a.c.e", "blorxgface", "BLORGFACE!!", "b l o r g f a c e", "blorgfaces", "g*r*u*m*w*i*t"]
)
def test_gapped_and_inserted_insults(spark, machine, insult):
    text = f"taren moli sarden kovi {insult} pulne taren"
    clean = "taren moli sarden kovi pulne taren face gru moral"
    df = spark.createDataFrame([(1, text), (2, clean)], "doc_id bigint, text string")
    score = {r["ident"]: r["score"] for r in tox.score_toxicity(df, "text", "doc_id", machine).collect()}
    assert score[1] > 0.5 > score[2]


def test_odd_texts(docs_of, odd_texts, machine):
    out = tox.score_toxicity(docs_of(odd_texts, clash=True), "text", "doc_id", machine).collect()
    assert len(out) == len(odd_texts) and all(0.0 <= r["score"] <= 1.0 for r in out)
    assert {r["ident"] for r in out if r["passage"] is None} == {0, 1, 2}


def test_nothing_to_learn_from(spark, docs_of):
    one = spark.createDataFrame([(1, "a b", 0), (2, "c", None)], "doc_id bigint, text string, toxic int")
    assert tox.learn_toxicity(one, "text", "toxic", "doc_id") is None
    assert [r["score"] for r in tox.score_toxicity(docs_of(["x", None]), "text", "doc_id", None).collect()] == [0.0, 0.0]
    assert tox.sample_labels(one, "doc_id", "toxic").count() == 1
