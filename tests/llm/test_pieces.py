import os
import random
import subprocess
import sys

import pytest

from sepet.llm.pieces import MODEL, Encoder, decode_pieces, encode_pieces, split

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="public vocabulary not here")


@pytest.fixture(scope="module")
def coder():
    return Encoder()


def every_path(v, text):
    out = []

    def go(at, ids, score):
        if at == len(text):
            out.append((score, tuple(ids)))
        for end in range(at + 1, min(len(text), at + v.longest) + 1):
            edge = v.edge(text, at, end)
            if edge:
                go(end, [*ids, *edge[0]], score + edge[1])

    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


def test_n_best_against_every_path(coder):
    rng = random.Random(3)
    for _ in range(150):
        text = " " * rng.randrange(3) + "".join(rng.choice("thenadi é▁x漢\t\n") for _ in range(rng.randrange(1, 8)))
        want = [s for s, _ in every_path(coder.v, f" {text}")[:3]]
        got = coder.n_best(text)
        assert [round(s, 5) for s, _ in got] == [round(s, 5) for s in want]
        assert all(coder.v.decode(ids).decode() == text for _, ids in got)
        assert coder.best(text) == got[0][1]
        for chunk in split(text):
            paths = every_path(coder.v, chunk)
            assert [round(s, 5) for s, _ in coder.v.n_best(chunk, 4)] == [round(s, 5) for s, _ in paths[:4]]


def test_round_trip_and_losses(docs_of, odd_texts, coder):
    texts = [*odd_texts, "▁ literal", "  two  spaces ", "tab\tand\r\nline", "\U0001f600 smile"]
    out = encode_pieces(docs_of(texts, clash=True), "text", "doc_id", alternatives=True)
    rows = {r["ident"]: r for r in out.collect()}
    assert len(rows) == len(texts) and all(r["restored"] for r in rows.values())
    assert rows[0]["ids"] == [] and rows[1]["ids"] == []
    for k, t in enumerate(texts):
        if t and len(t) < 100:
            found = coder.n_best(t)
            assert [round(x, 5) for x in rows[k]["losses"]] == [round(found[0][0] - s, 5) for s, _ in found]
            assert rows[k]["n_best"] == [p for _, p in found] and rows[k]["ids"] == found[0][1]
    back = {r["ident"]: r["text"] for r in decode_pieces(out, "ids", "ident").collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}


def test_forgetting_changes_nothing(coder, monkeypatch):
    from sepet.llm import pieces

    texts = ["one two three", "four five", "one five six"] * 3
    want = [coder.best(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBER", 2)
    other = Encoder()
    assert [other.best(t) for t in texts] == want


def test_no_rows_and_null_pieces(spark, docs_of):
    assert encode_pieces(docs_of([]), "text", "doc_id").count() == 0
    assert decode_pieces(spark.createDataFrame([(1, None)], "i bigint, ids array<int>"), "ids", "i").first()["text"] is None


def test_pieces_are_about_those_of_the_library(coder):
    """Scores are logarithms of shares, not ranks: whole words stay whole."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "the international organisation of information and the development of national education in the United States"
    own, theirs = coder.best(text), model.encode(text)
    assert model.id_to_piece(coder.best("international")[0]) == "▁international"
    assert len(own) <= 1.1 * len(theirs)
    real = [s for t, k in coder.v.piece.items() if t.strip(" ") for s in [coder.v.score[k]]]
    assert sum(2.718281828459045**s for s in real) == pytest.approx(1.0)


def test_memory_of_texts_of_new_words_is_bounded():
    """Four thousand texts of 600 words, a tenth of them new, in a process of its own."""
    code = """
import random, resource
from sepet.llm.pieces import Encoder

coder, rng = Encoder(), random.Random(1)
often = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for lot in range(4):
    texts = [" ".join(f"n{lot}x{k}w{i}" if i % 10 == 0 else rng.choice(often) for i in range(600)) for k in range(1_000)]
    coder.learn(texts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 64
