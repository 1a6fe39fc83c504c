"""Blocks that fit a task, folded shape by shape: the sequential loop, with look-ups in place of comparisons.

Which words of a block agree is found once, through shared keys. A shape then meets only the leaders that hold enough
words agreeing with its own, and only these are scored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.similarity import EDIT_MIN_LENGTH, EDIT_ONE_MAX_LENGTH, MAX_SUFFIX


def _near(a: str, b: str, most: int) -> bool:
    """Whether ``most`` edits, two at most, turn one word into the other."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    a, b = a[same:], b[same:]
    if not a or not b:
        return len(a) + len(b) <= most
    return most > 0 and (_near(a[1:], b[1:], most - 1) or _near(a[1:], b, most - 1) or _near(a, b[1:], most - 1))


def agree(a: str, b: str) -> bool:
    """As ``tokens_agree``: equal; or root plus a short suffix; or a small spelling variant of a word long enough."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    gap = len(long) - len(short)
    if gap <= MAX_SUFFIX and long.startswith(short):
        return True
    return len(short) >= EDIT_MIN_LENGTH and gap <= 2 and _near(a, b, 1 if len(short) <= EDIT_ONE_MAX_LENGTH else 2)


def _parts(length: int, n: int) -> list[tuple[int, int]]:
    """(start, end) of ``n`` parts of a word of this length."""
    ends = [length * i // n for i in range(n + 1)]
    return list(zip(ends, ends[1:], strict=False))


class Words:
    """Words by number, and for each the set of those that agree with it, itself included.

    A root shares itself with its longer forms. A word within one edit shares one of two parts, within two edits one of three:
    what lies before a whole part moves it, and the rest of the difference in length lies behind it.
    """

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.near: list[set[int]] = []
        self.keys: defaultdict[tuple, list[int]] = defaultdict(list)

    def add(self, word: str) -> int:
        if word in self.number:
            return self.number[word]
        k = self.number[word] = len(self.words)
        self.words.append(word)
        self.near.append({k})
        found = {self.number[r] for i in range(1, MAX_SUFFIX + 1) if i <= len(word) and (r := word[:-i]) in self.number}
        for key in ((word,), *self._sought(word)):
            if key in self.keys:
                found.update(self.keys[key])
        for o in found:
            if agree(word, self.words[o]):
                self.near[k].add(o)
                self.near[o].add(k)
        for key in self._own(word):
            self.keys[key].append(k)
        return k

    @staticmethod
    def _own(word: str) -> Iterator[tuple]:
        for i in range(1, min(MAX_SUFFIX, len(word)) + 1):
            yield (word[:-i],)
        size = len(word)
        if EDIT_MIN_LENGTH <= size <= EDIT_ONE_MAX_LENGTH + 1:
            yield from ((size, 2, i, word[a:b]) for i, (a, b) in enumerate(_parts(size, 2)))
        if size > EDIT_ONE_MAX_LENGTH:
            yield from ((size, 3, i, word[a:b]) for i, (a, b) in enumerate(_parts(size, 3)))

    @staticmethod
    def _sought(word: str) -> Iterator[tuple]:
        """Keys of the words within the edits allowed."""
        for size in range(max(EDIT_MIN_LENGTH, len(word) - 2), len(word) + 3):
            if len(word) < EDIT_MIN_LENGTH:
                return
            gap, most = len(word) - size, 1 if min(size, len(word)) <= EDIT_ONE_MAX_LENGTH else 2
            if abs(gap) > most:
                continue
            for i, (a, b) in enumerate(_parts(size, most + 1)):
                for move in (0,) if i == 0 else (gap,) if i == most else range(-2, 3):
                    if a + move >= 0 and b + move <= len(word) and abs(move) + abs(gap - move) <= most:
                        yield size, most + 1, i, word[a + move : b + move]


class Block:
    """Shapes of a block in order, and the leaders among them."""

    def __init__(self, sets: list[list[str]], threshold: float):
        words = Words()
        self.sets = [[words.add(w) for w in s] for s in sets]
        self.near, self.threshold = words.near, threshold
        self.leaders: list[int] = []
        self.blank: list[int] = []
        self.posted: defaultdict[int, list[int]] = defaultdict(list)

    def lead(self, i: int) -> None:
        self.leaders.append(i)
        if not self.sets[i]:
            self.blank.append(i)
        for w in self.sets[i]:
            self.posted[w].append(i)

    def score(self, leader: int, i: int) -> float:
        """As ``token_set_score``, of sets that are not empty."""
        free, matched = list(self.sets[i]), 0
        for w in self.sets[leader]:
            near = self.near[w]
            for o in free:
                if o in near:
                    free.remove(o)
                    matched += 1
                    break
        return matched / (len(self.sets[leader]) + len(self.sets[i]) - matched)

    def matches(self, i: int) -> Iterator[tuple[int, float]]:
        """Leaders that reach the threshold, in any order. An empty set matches everything."""
        own = self.sets[i]
        yield from ((l, 1.0) for l in (self.blank if own else self.leaders))
        held: Counter[int] = Counter()
        for w in set().union(*(self.near[w] for w in own)):
            if w in self.posted:
                held.update(self.posted[w])
        for leader, n in held.items():
            most = min(n, len(own))
            if most / (len(self.sets[leader]) + len(own) - most) >= self.threshold:
                score = self.score(leader, i)
                if score >= self.threshold:
                    yield leader, score

    def records(self, i: int) -> list[tuple[int, float]]:
        """Leaders in order that score above all before."""
        kept: list[tuple[int, float]] = []
        for leader, score in sorted(self.matches(i)):
            if not kept or score > kept[-1][1]:
                kept.append((leader, score))
        return kept


def fold(sets: list[list[str]], fixed: list[bool], asked: list[bool], threshold: float) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """Records of the shapes asked for, as numbers of shapes. Whoever is fixed leads, and whoever matches no leader before."""
    block = Block(sets, threshold)
    for i, always in enumerate(fixed):
        if always or next(block.matches(i), None) is None:
            block.lead(i)
    return ((i, block.records(i)) for i, wanted in enumerate(asked) if wanted)


def fold_rows(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, sig, records) out of rows (block, sig, tokens, ord, key, fixed, asked) sorted by block and order. ``tokens`` is the
    set as UTF-8, apart from each other by spaces. Rows of one block at a time are held, beside a batch."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        blocks = rows.column("block").combine_chunks()
        starts = np.flatnonzero(np.concatenate(([True], pc.not_equal(blocks.slice(1), blocks.slice(0, len(blocks) - 1)).to_numpy(zero_copy_only=False))))
        sets = [s.decode("utf-8", "surrogateescape").split(" ") if s else [] for s in rows.column("tokens").to_pylist()]
        fixed, asked = rows.column("fixed").to_pylist(), rows.column("asked").to_pylist()
        of, ends, leaders, scores = [], [0], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)], strict=True):
            for i, records in fold(sets[a:b], fixed[a:b], asked[a:b], threshold):
                of.append(a + i)
                leaders += [a + leader for leader, _ in records]
                scores += [score for _, score in records]
                ends.append(len(leaders))
        at = pa.array(leaders, pa.int64())
        first = [rows.column(c).combine_chunks().take(at) for c in ("ord", "key")]
        records = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*first, pa.array(scores, pa.float64())], ["ord", "key", "score"]))
        of = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays([blocks.take(of), rows.column("sig").combine_chunks().take(of), records], ["block", "sig", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            blocks = rows.column("block").combine_chunks()
            last = rows.num_rows - int(pc.sum(pc.equal(blocks, blocks[-1])).as_py())
            if last:
                yield done(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield done(held)

    return run
