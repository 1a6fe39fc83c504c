"""Blocks folded with look-ups, against plain loops, and how much they compare."""

import random

import pytest
from plain_rules import agree, assign, score
from test_match import WORDS, items

from sepet.operators import fold


def spelled(rng, words, letters="abck"):
    out = set(words)
    for w in words:
        for _ in range(8):
            new = list(w)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(new) + 1)
                action = rng.randrange(3)
                if action == 0 and len(new) > 1:
                    new[at : at + 1] = []
                elif action == 1:
                    new.insert(at, rng.choice(letters))
                else:
                    new[at : at + 1] = rng.choice(letters)
            out.add("".join(new))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_words_find_all_that_agree(seed):
    rng = random.Random(seed)
    short = ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 14) for _ in range(6)]
    for some in (spelled(rng, WORDS), spelled(rng, short, "ab")):
        rng.shuffle(some)
        words = fold.Words()
        number = {w: words.add(w) for w in some}
        for a in some:
            assert {words.words[k] for k in words.near[number[a]]} == {b for b in some if agree(a, b)}, a


@pytest.mark.parametrize("seed", range(6))
def test_records_equal_the_loop(seed):
    rng = random.Random(seed)
    sets = list(dict.fromkeys(tuple(t) for _, _, t in items(rng, 150, 1, 5, 0.03)))
    fixed = [k < 12 for k in range(len(sets))]
    asked = [not f or rng.random() < 0.5 for f in fixed]
    named = [("b", k, list(s)) for k, s in enumerate(sets)]
    led = assign(named[12:], named[:12])
    leaders = [k for k in range(len(sets)) if fixed[k] or led[k] == k]
    want = {}
    for k in range(len(sets)):
        best, want[k] = 0.0, []
        for l in leaders:
            s = score(sets[l], sets[k], True)
            if s >= 0.7 and s > best:
                best = s
                want[k].append((l, s))
    assert dict(fold.fold([list(s) for s in sets], fixed, asked, 0.7)) == {k: r for k, r in want.items() if asked[k]}


def test_comparisons_grow_with_the_shapes_and_not_with_their_square(monkeypatch):
    """Titles of eight words, of which two are in every title and the others in four."""
    counted = {}
    for n in (200, 800):
        rng = random.Random(n)
        own = ["".join(rng.choice("abcdefghijklmnoprstuvyz") for _ in range(10)) for _ in range(n * 6 // 4)]
        sets = [["organik", "paket", *rng.sample(own, 6)] for _ in range(n)]
        calls = []
        real, real_score = agree, fold.Block.score
        monkeypatch.setattr(fold, "agree", lambda a, b: calls.append(1) or real(a, b))
        monkeypatch.setattr(fold.Block, "score", lambda *a: calls.append(1) or real_score(*a))
        assert len(list(fold.fold(sets, [False] * n, [True] * n, 0.7))) == n
        monkeypatch.undo()
        counted[n] = len(calls)
    assert counted[800] <= 6 * counted[200] and counted[800] < 20 * 800
