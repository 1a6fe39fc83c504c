import collections
import random

import numpy as np
import pytest

from sepet.llm import suffix_dedup
from sepet.llm.suffix_dedup import SuffixSorter, anchors, remove_repeats


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + window] for b in raw for k in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, y in zip(b, gone) if not y)))
    return out


def found(df, **options):
    rows = remove_repeats(df, "text", "doc_id", **options).collect()
    return {r["ident"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}


def texts_with_repeats(seed, size=40):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(30, 160))) for _ in range(6)]
    texts = []
    for _ in range(size):
        parts = []
        for _ in range(rng.randrange(5)):
            own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80)))
            passage = rng.choice(shared)
            cut = rng.randrange(len(passage))
            parts += [own, passage[cut:] if rng.random() < 0.3 else passage]
        texts.append("".join(parts))
    return texts + ["a" * 500, "ab" * 200, None, "", "short", texts[0], texts[0]]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_brute_force(docs_of, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    texts = texts_with_repeats(3)
    got = found(docs_of(texts, clash=True), window=50, gram=16)
    assert got == dict(enumerate(brute(texts, 50)))


def test_production_window_and_pieces(docs_of, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(900))
    texts = ["x" + passage + "y", passage[:500] + "tail", "z" * 10 + passage[300:], passage[:199], "1" * 199, "2" * 201]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 7)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    pieces = [x.tolist() for x in anchors(data)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 17)
    whole = [x.tolist() for x in anchors(data)]
    assert pieces[:3] == whole[:3]
    assert found(docs_of(texts)) == dict(enumerate(brute(texts, 200)))


def test_equal_and_null_ids(docs_of):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(300))
    rows = [(1, text, "s"), (1, "q" * 10 + text[:150], "s"), (None, text, "s"), (None, "own", "s")]
    out = remove_repeats(docs_of(rows), "text", "doc_id", window=100, gram=32).collect()
    want = brute([r[1] for r in rows], 100)
    assert sorted((str(r["ident"]), r["n_removed"]) for r in out) == sorted((str(r[0]), w[1]) for r, w in zip(rows, want))


def test_no_rows(docs_of):
    assert found(docs_of([])) == {}


def test_suffix_sort():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(360)
    klass = np.sort(rng.integers(0, 5, 360))
    order = SuffixSorter(data, 40).sort(starts, klass)
    for k in range(5):
        mine = order[klass == k].tolist()
        assert mine == sorted(starts[klass == k].tolist(), key=lambda s: (data[s : s + 40].tobytes(), s))


def test_colliding_hashes_are_noticed(monkeypatch):
    data = np.frombuffer(b"abcdXbcdYbcdabcd", np.uint8)
    sorter = SuffixSorter(data, 4)
    monkeypatch.setattr(sorter.hashes, "of", lambda start, length: np.zeros(len(start), np.uint64))
    assert sorter.repeated(np.array([0, 4, 8, 12]), np.zeros(4, np.int64)).tolist() == [0, 12]


@pytest.mark.parametrize("task_rows", [20, 2_000_000])
def test_copies_of_a_string_under_a_hot_anchor_meet_in_no_task(docs_of, monkeypatch, task_rows):
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = own(90)
    texts = [own(60) + passage + own(60) for _ in range(120)] + [passage, own(70)]
    sort, mark = suffix_dedup._sort_runs, getattr(suffix_dedup, "repeated_strings", None)

    def watched(window):
        def run(batches):
            kept = list(batches)
            groups = collections.Counter(g for b in kept for g in b.column(0).to_pylist())
            assert max(groups.values(), default=0) <= 50
            yield from sort(window)(iter(kept))

        return run

    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 50)
    monkeypatch.setattr(suffix_dedup, "_sort_runs", watched)
    monkeypatch.setattr(suffix_dedup, "repeated_strings", lambda strings: mark(strings, task_rows), raising=False)
    assert found(docs_of(texts), window=50, gram=16) == dict(enumerate(brute(texts, 50)))


def test_many_texts_of_one_id(docs_of):
    """Texts that stand nowhere else stay whole, whatever other rows of their id lose."""
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    own, twice = [text() for _ in range(300)], [text() for _ in range(300)]
    rows = [(7, t, "s") for t in own + twice] + [(k, t, "s") for k, t in enumerate(twice, 100)]
    out = remove_repeats(docs_of(rows), "text", "doc_id").collect()
    kept = sorted(bytes(r["kept"]).decode() for r in out if r["ident"] == 7)
    assert kept == sorted(own + [""] * 300)
