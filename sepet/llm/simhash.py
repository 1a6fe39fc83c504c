"""SimHash near-dedup: 64-bit fingerprints, linked at 3 or fewer differing bits through Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import broadcast_if_small
from ..session import settle
from .common import col, star_components

SHINGLE = 3
MOST_BITS = 3
#: Rows of one key that a task compares; larger groups are cut into blocks that meet in pairs.
BLOCK_ROWS = 4_096
#: Pairs compared at once.
CHUNK = 1_000_000

# The generator polynomial of the perfect binary Golay code [23, 12, 7], and its length.
GENERATOR, LENGTH = 0b110001110101, 23
#: First bit and width of the segments of a fingerprint; the last is shorter and padded with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text (repeats count), as a signed 64-bit number; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        raw = np.array(hashes[at : at + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str, ident: str, shingle: int = SHINGLE) -> DataFrame:
    """(ident, fp) for every row of ``df``. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["ident", "fp"])

    return df.select(col(ident).cast("bigint").alias("ident"), col(text).cast("binary").alias("t")).mapInArrow(
        run, "ident bigint, fp bigint"
    )


@lru_cache(1)
def nearest_codeword() -> np.ndarray:
    """For every 23-bit word the index of the only codeword within 3 bits of it."""
    m = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        words ^= np.where(m >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0)).astype(np.uint32)
    singles = (1 << np.arange(LENGTH, dtype=np.uint32)).astype(np.uint32)
    errors = {0} | {int(a ^ b ^ c) for a in singles for b in singles for c in singles}
    errors |= {int(a ^ b) for a in singles for b in singles}
    table = np.zeros(1 << LENGTH, np.uint16)
    for e in errors:
        table[words ^ np.uint32(e)] = m
    return table


def _near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment word: its own codeword, and the codewords of all words within one bit, as (row, index)
    without repeats: one where the word lies within two bits of its codeword, else six."""
    table = nearest_codeword()
    flips = np.concatenate(([0], 1 << np.arange(LENGTH))).astype(np.uint32)
    ball = np.sort(table[words.astype(np.uint32)[:, None] ^ flips[None, :]], axis=1)
    new = np.ones(ball.shape, bool)
    new[:, 1:] = ball[:, 1:] != ball[:, :-1]
    rows, _ = np.nonzero(new)
    return table[words], rows, ball[new]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of fingerprints.

    Two fingerprints that differ in three bits at most have two segments in which they differ in one bit at
    most. For each pair of segments (a, b), side 0 lists the codewords near its a with its own codeword of b,
    side 1 its own codeword of a with the codewords near its b; such fingerprints meet in a key of both sides.
    """
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    near = [_near(p) for p in parts]
    rows, keys, sides = [], [], []
    for k, (a, b) in enumerate(PAIRS):
        (own_a, rows_a, near_a), (own_b, rows_b, near_b) = near[a], near[b]
        base = np.int64(k) << 24
        rows += [rows_a, rows_b]
        keys += [
            base | near_a.astype(np.int64) << 12 | own_b[rows_a].astype(np.int64),
            base | own_a[rows_b].astype(np.int64) << 12 | near_b.astype(np.int64),
        ]
        sides += [np.zeros(len(rows_a), np.int8), np.ones(len(rows_b), np.int8)]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(all_fps), 20_000):
            fps = all_fps[at : at + 20_000]
            rows, keys, sides = golay_keys(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int32)), pa.array(sides), pa.array(fps[rows])], ["key", "side", "fp"]
            )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values reduced to (value, smallest value reachable by these links), where they differ."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _close(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= bits) & (x != y)


def _compare(group: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the two sides of every group; rows are sorted by group and side."""
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    first, last = cut[:-1], cut[1:]
    ones = np.concatenate(([0], np.cumsum(side, dtype=np.int64)))
    right = ones[last] - ones[first]
    left = last - first - right
    keep = (left > 0) & (right > 0)
    first, left, right = first[keep], left[keep], right[keep]
    pairs = left * right
    total = np.concatenate(([0], np.cumsum(pairs)))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1)
        if to == at + 1 and pairs[at] > CHUNK:
            lo, mid = first[at], first[at] + left[at]
            ys = fp[mid : mid + right[at]]
            rows = max(1, CHUNK // len(ys))
            for k in range(lo, mid, rows):
                xs = fp[k : min(mid, k + rows)]
                i, j = np.nonzero(_close(xs[:, None], ys[None, :], bits))
                if len(i):
                    yield forest(xs[i], ys[j])
        else:
            n = pairs[at:to]
            g = np.repeat(np.arange(at, to), n)
            k = np.arange(len(g)) - np.repeat(total[at:to] - total[at], n)
            x, y = fp[first[g] + k // right[g]], fp[first[g] + left[g] + k % right[g]]
            hit = _close(x, y, bits)
            if hit.any():
                yield forest(x[hit], y[hit])
        at = to


def linker(bits: int):
    """Compares the rows of sorted partitions group by group, carrying an unfinished group to the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1], "left"))
            held = [x[end:] for x in now]
            if end:
                yield from links([x[:end] for x in now])
        if held is not None and len(held[0]):
            yield from links(held)

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in _compare(*rows, bits):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, bits: int = MOST_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column ``fp``) differing in ``bits`` (3 at most) or fewer.

    Every fingerprint gets about 32 keys. Rows of a key are compared both sides against each other inside a
    task and only a spanning forest of the links found is returned, so a group of very many near copies gives
    as many rows as it has members. Keys with more than ``block_rows`` rows are cut into blocks by hash, and
    each pair of blocks is a group of its own.
    """
    assert 0 <= bits <= MOST_BITS
    keyed = fps.select("fp").mapInArrow(_expand, "key int, side tinyint, fp bigint")
    hot = settle(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
        .select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = keyed.join(broadcast_if_small(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.select("key", "side", "fp", "blocks", own.alias("own"), other.alias("other"))
    pair = F.when(F.col("side") == 0, F.col("own") * F.col("blocks") + F.col("other")).otherwise(
        F.col("other") * F.col("blocks") + F.col("own")
    )
    # A block pair is part of the key: both fit into one bigint.
    grouped = cut.select((F.col("key").cast("bigint") * F.lit(1 << 32) + pair.cast("bigint")).alias("g"), "side", "fp")
    return grouped.repartition("g").sortWithinPartitions("g", "side").mapInArrow(linker(bits), "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str, ident: str, shingle: int = SHINGLE, bits: int = MOST_BITS) -> DataFrame:
    """(ident, fp, component) for every row of ``df``: the smallest ident that its fingerprint reaches over links.

    Texts without words have fingerprint 0 and are linked like any other; a null ident is never a component
    unless all of its component are null. Copies are one fingerprint, compared once. An empty table gives an
    empty result.
    """
    prints = settle(with_fingerprint(df, text, ident, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("ident").alias("first")))
    nodes = star_components(fingerprint_links(distinct, bits))
    placed = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    roots = placed.groupBy("root").agg(F.min("first").alias("component"))
    known = settle(placed.join(roots, "root").select("fp", "component"))
    return prints.join(known, "fp").select("ident", "fp", "component")
