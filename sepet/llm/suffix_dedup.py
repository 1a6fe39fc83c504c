"""Suffix-array dedup: bytes inside long strings that stand anywhere else, found by hash-compared suffix sorting.

Sorting all suffixes of a corpus would shuffle many times its bytes. Here each string of ``WINDOW`` bytes is
filed under its anchor, the first of its ``GRAM``-byte grams with the smallest hash. Equal strings have equal
anchors at equal offsets, so only strings under equal anchors are ever compared: nothing is missed. Neighbouring
strings mostly share their anchor, so a row per anchor (about one in 77 bytes) stands for a run of strings.
Runs equal as a whole are found by digest; what remains, runs that are equal in part, is decided by sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import TASK_ROWS, salted_join
from ..session import settle
from .common import col

WINDOW = 200
GRAM = 48
#: Strings of a document whose anchors are found at once.
PIECE = 1 << 17
#: Bytes of runs sorted at once in a task.
SORT_BYTES = 1 << 20
#: Under an anchor with more runs than this, strings are compared by digest and not sorted.
HOT_RUNS = 20_000

_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 20_240_607


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Polynomial hashes of all substrings of a buffer, from hashes of its beginnings (modulo 2^64)."""

    _bytes = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64)
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes._up) <= n:
            Hashes._up = _powers(_BASE, 2 * n + 2)
            Hashes._down = _powers(pow(_BASE, -1, 1 << 64), 2 * n + 2)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._bytes[data] * self._up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self._down[start]

    def grams(self, length: int) -> np.ndarray:
        """Mixed hashes of all substrings of one length."""
        h = (self.sums[length:] - self.sums[:-length]) * self._down[: len(self.sums) - length]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: (first start, last start, anchor, hash of the anchor's gram).

    The anchor depends on the string's bytes alone. Long documents are read in pieces; a run that goes on
    across a border is one run.
    """
    wide = window - gram + 1
    bits = np.uint64(PIECE.bit_length() + 1)
    low = np.uint64((1 << int(bits)) - 1)
    found = []
    for base in range(0, len(data) - window + 1, PIECE):
        grams = Hashes(data[base : base + PIECE + window - 1]).grams(gram)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        count = len(grams) - wide + 1
        least = np.minimum(least[:count], least[wide - size : wide - size + count])
        at = (least & low).astype(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        first, last, place = base + cut, base + np.append(cut[1:], count) - 1, base + at[cut]
        hashes = grams[at[cut]].view(np.int64)
        if found and found[-1][2][-1] == place[0]:
            first[0] = found[-1][0][-1]
            found[-1] = [x[:-1] for x in found[-1]]
        found.append([first, last, place, hashes])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pack(first: np.ndarray, last: np.ndarray, anchor: np.ndarray, tag: np.ndarray | int) -> np.ndarray:
    """A run in one number: 16 bits of the row's tag, 32 of its start, 8 each of its length and the anchor's offset."""
    return (np.int64(tag) << np.int64(48)) | (first << np.int64(16)) | ((last - first) << np.int64(8)) | (anchor - first)


def unpack(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor's offset)."""
    first = (run >> np.int64(16)) & np.int64(0xFFFFFFFF)
    return first, first + ((run >> np.int64(8)) & np.int64(255)), run & np.int64(255)


def _anchor_rows(window: int, gram: int):
    """Runs of texts: one row for all equal runs of a lot of texts, the first with its place, others in ``rest``."""
    names = ["gram", "digest", "ident", "run", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for ident, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py()
                if len(raw) < window:
                    continue
                first, last, place, grams = anchors(np.frombuffer(raw, np.uint8), window, gram)
                digest = hashlib.blake2b
                whole = b"".join([digest(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + window).tolist(), strict=True)])
                rows.append((grams, np.frombuffer(whole, np.int64), np.full(len(first), ident), pack(first, last, place, tag)))
                size += len(first)
                if size > 50_000:
                    yield folded(rows)
                    rows, size = [], 0
            if rows:
                yield folded(rows)

    def folded(rows: list[tuple]) -> pa.RecordBatch:
        grams, digests, idents, runs = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((digests, grams))
        grams, digests, idents, runs = grams[order], digests[order], idents[order], runs[order]
        new = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (digests[1:] != digests[:-1]))))
        many = np.diff(np.append(new, len(grams)))
        rest: list[bytes | None] = [None] * len(new)
        for k in np.flatnonzero(many > 1).tolist():
            at = slice(new[k] + 1, new[k] + many[k])
            rest[k] = np.stack((idents[at], runs[at]), 1).tobytes()
        return pa.RecordBatch.from_arrays([*(pa.array(x[new]) for x in (grams, digests, idents, runs)), pa.array(rest, pa.binary())], names)

    return run


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of ``rest``, one row each."""
    for batch in batches:
        both = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
        for at in range(0, len(both), 50_000):
            part = both[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["ident", "run"])


class SuffixSorter:
    """Merge sort of string starts by their first ``window`` bytes, inside classes, all classes at once.

    Two suffixes are compared by their common extension: a binary search over hashes of beginnings finds its
    length, the byte after it decides. Neighbours that agree over the whole window are verified byte by byte.
    """

    def __init__(self, data: np.ndarray, window: int):
        self.data, self.window = data, window
        self.hashes = Hashes(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.window, np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.hashes.of(x, middle) == self.hashes.of(y, middle)
            low, high = np.where(same & open_, middle, low), np.where(same | ~open_, high, middle - 1)

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.extension(x, y)
        end = len(self.data) - 1
        return (n < self.window) & (self.data[np.minimum(x + n, end)] < self.data[np.minimum(y + n, end)])

    def sort(self, starts: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """``starts`` sorted within equal ``klass``, which is sorted already."""
        cut = np.flatnonzero(np.concatenate(([True], klass[1:] != klass[:-1])))
        size = np.diff(np.append(cut, len(klass)))
        begin, count = np.repeat(cut, size), np.repeat(size, size)
        place = np.arange(len(starts)) - begin
        out = starts.copy()
        width = 1
        while True:
            active = np.flatnonzero(count > width)
            if not len(active):
                return out
            own = out[active]
            at, b, n = place[active], begin[active], count[active]
            pair = at // (2 * width) * (2 * width)
            left = at - pair < width
            other = np.where(left, pair + width, pair)
            stop = np.minimum(np.where(left, pair + 2 * width, pair + width), n)
            low, high = np.minimum(other, stop), stop.copy()
            first = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                theirs, mine = out[b[open_] + middle], own[open_]
                # Equal ones of the left run stay before those of the right.
                l_ = left[open_]
                before = self.less(np.where(l_, theirs, mine), np.where(l_, mine, theirs))
                before = np.where(l_, before, ~before)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            rank = low - first
            inside = at - pair - np.where(left, 0, width)
            out[b + pair + inside + rank] = own
            width *= 2

    def repeated(self, starts: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """Those starts whose string stands at another start of their class as well."""
        order = self.sort(starts, klass)
        next_to = np.flatnonzero(klass[1:] == klass[:-1])
        x, y = order[next_to], order[next_to + 1]
        equal = self.extension(x, y) == self.window
        views = np.lib.stride_tricks.sliding_window_view(self.data, self.window)
        x, y = x[equal], y[equal]
        for at in range(0, len(x), 20_000):
            if (views[x[at : at + 20_000]] != views[y[at : at + 20_000]]).any():
                return self._plain(starts, klass)
        return np.unique(np.concatenate((x, y)))

    def _plain(self, starts: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """The same by comparing bytes, for data on which the hashes collide."""
        seen: dict[tuple[int, bytes], list[int]] = {}
        for s, k in zip(starts.tolist(), klass.tolist(), strict=True):
            seen.setdefault((k, self.data[s : s + self.window].tobytes()), []).append(s)
        return np.array(sorted(s for many in seen.values() if len(many) > 1 for s in many), np.int64)


def _cut_runs(window: int):
    """Bytes of the runs to be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for ident, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                for w in wanted.as_py():
                    first, last, _ = (int(x) for x in unpack(np.int64(w["run"])))
                    rows.append((w["gram"], ident, w["run"], w["alone"], raw[first : last + window]))
                    size += last + window - first
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "ident", "run", "alone", "raw"]
        )

    return run


def _string_digests(window: int):
    """Every string of the runs as 128 bits of digest, for anchors with too many runs to be sorted together."""
    names = ["high", "low", "ident", "run", "alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for ident, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                for w in wanted.as_py():
                    first, last, _ = (int(x) for x in unpack(np.int64(w["run"])))
                    tag = w["run"] & ~0xFFFFFFFFFFFF
                    for s in range(first, last + 1):
                        both = hashlib.blake2b(raw[s : s + window], digest_size=16).digest()
                        high, low = (int.from_bytes(x, "little", signed=True) for x in (both[:8], both[8:]))
                        rows.append((high, low, ident, tag | s << 16, w["alone"]))
                    if len(rows) > 50_000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (*(pa.int64(),) * 4, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def repeated_strings(strings: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(ident, run) of those rows marked ``alone`` whose digest (high, low) another row has as well.

    Digests are counted with map-side combine and marked by a join, which deals a digest of very many rows to
    several places. ``strings`` is read twice.
    """
    keys = ["high", "low"]
    counts = settle(strings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = counts.filter(F.col("n") > task_rows).select(*keys, F.ceil(F.col("n") / task_rows).cast("int").alias("_salts"))
    marked = strings.filter("alone").select(*keys, "ident", "run")
    return salted_join(marked, counts.select(*keys), keys, "left_semi", task_rows, hot).select("ident", "run")


def _sort_runs(window: int):
    """Sorts the strings of runs group by group; rows come ordered by group, an unfinished one waits for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield from sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from sort(held)

    def sort(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        group, ident, runs = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        alone = np.array([r[3] for r in rows])
        first, last, offset = unpack(runs)
        data = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8)
        sizes = np.fromiter((len(r[4]) for r in rows), np.int64, len(rows))
        base = np.cumsum(sizes) - sizes
        count = last - first + 1
        row = np.repeat(np.arange(len(rows)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        # Strings are equal only at the same distance from equal anchors.
        number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))[row]
        klass = number * 512 + (offset[row] - step) + 256
        order = np.argsort(klass, kind="stable")
        klass, starts, row = klass[order], (base[row] + step)[order], row[order]
        pair = klass[1:] == klass[:-1]
        many = np.concatenate(([False], pair)) | np.concatenate((pair, [False]))
        if not many.any():
            return
        hit = SuffixSorter(data, window).repeated(starts[many], klass[many])
        owner = np.searchsorted(base, hit, "right") - 1
        mine = alone[owner]
        hit, owner = hit[mine], owner[mine]
        if not len(hit):
            return
        new = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1]))))
        end = np.append(new[1:], len(hit)) - 1
        who = owner[new]
        begin = first[who] + hit[new] - base[who]
        tag = runs[who] & ~np.int64(0xFFFFFFFFFFFF)
        found = tag | (begin << np.int64(16)) | ((hit[end] - hit[new]) << np.int64(8))
        yield pa.RecordBatch.from_arrays([pa.array(ident[who]), pa.array(found)], ["ident", "run"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                begin = end = np.zeros(0, np.int64)
                if runs.is_valid:
                    first, last, _ = unpack(runs.values.to_numpy())
                    order = np.argsort(first, kind="stable")
                    first, reach = first[order], np.maximum.accumulate(last[order] + window)
                    new = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
                    begin, end = first[new], reach[np.append(new[1:], len(first)) - 1]
                edges = [0, *np.stack((begin, end), 1).ravel().tolist(), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                spans = [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                out.append((len(raw), int((end - begin).sum()), len(begin), spans, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["ident", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def remove_repeats(df: DataFrame, text: str, ident: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(ident, n_bytes, n_removed, n_spans, spans, kept) for every row of ``df``: its text as UTF-8 bytes without
    those covered by a string of ``window`` bytes that also starts anywhere else, in this or another row.

    Null texts count as empty. Repeated rows repeat each other's strings, so both lose them. Texts shorter than
    the window stay. An empty table gives an empty result. Rows are told apart by 79 bits of digests of ident and
    text, so equal or null idents do no harm.

    Text is shuffled to meet the runs to be cut from it and the spans to be removed; all else are rows of some
    numbers. Equal runs of one lot of texts, as periodic texts have them, are one row. Groups that one anchor gathers are
    sorted in memory-bounded batches; under anchors with more than ``HOT_RUNS`` runs the strings are counted by
    128-bit digest instead, so that no task holds all copies of a string.
    """
    assert gram <= window <= gram + 255
    raw: Column = F.coalesce(col(text).cast("binary"), F.lit(b""))
    # A row's name: 64 bits, and 15 more that leave the numbers of its runs positive, out of its ident and a digest of its
    # whole text. Rows of one name are equal in both, so they lose the same.
    digest = df.select(col(ident).cast("bigint").alias("own"), raw.alias("raw")).withColumn("digest", F.md5("raw"))
    docs = digest.select(
        "own", F.xxhash64("own", "digest").alias("ident"), F.shiftrightunsigned(F.xxhash64("digest", F.lit(1), "own"), 49).cast("bigint").alias("tag"), "raw"
    )
    runs = docs.select("ident", "tag", "raw").mapInArrow(
        _anchor_rows(window, gram), "gram bigint, digest bigint, ident bigint, run bigint, rest binary"
    )
    same = Window.partitionBy("gram").orderBy("digest")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = runs.select(
        "ident", "gram", "run", "rest",
        F.coalesce(F.lag("digest").over(same) == F.col("digest"), F.lit(False)).alias("again"),
        (F.col("rest").isNotNull() | F.coalesce(F.lead("digest").over(same) == F.col("digest"), F.lit(False))).alias("more"),
        (F.first("digest").over(whole) != F.last("digest").over(whole)).alias("mixed"),
        (F.count(F.lit(1)).over(whole) > HOT_RUNS).alias("hot"),
    )
    judged = settle(judged.filter("again or more or mixed"))
    row_tag = F.shiftright("run", 48).alias("tag")
    rest = judged.filter("rest is not null").select("rest").mapInArrow(_unfold, "ident bigint, run bigint")
    full = judged.filter("again or more").select("ident", "run").unionByName(rest)
    texts = docs.select("ident", "tag", "raw")

    def wanted(which: DataFrame) -> DataFrame:
        asked = which.select("ident", row_tag, F.struct("gram", "run", (~F.col("more")).alias("alone")).alias("w"))
        asked = asked.groupBy("ident", "tag").agg(F.collect_list("w").alias("wanted"))
        return texts.join(asked.hint("shuffle_hash"), ["ident", "tag"]).select("ident", "raw", "wanted")

    parts = judged.filter("mixed and not again")
    cut = wanted(parts.filter("not hot")).mapInArrow(_cut_runs(window), "grp bigint, ident bigint, run bigint, alone boolean, raw binary")
    part = cut.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sort_runs(window), "ident bigint, run bigint")
    hot = parts.filter("hot")
    if not hot.isEmpty():
        digests = wanted(hot).mapInArrow(_string_digests(window), "high bigint, low bigint, ident bigint, run bigint, alone boolean")
        part = part.unionByName(repeated_strings(settle(digests)))
    spans = full.unionByName(part).select("ident", row_tag, "run").groupBy("ident", "tag").agg(F.collect_set("run").alias("runs"))
    joined = docs.join(spans.hint("shuffle_hash"), ["ident", "tag"], "left")
    return joined.select("own", "raw", "runs").mapInArrow(
        _remove(window),
        "ident bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary",
    )
