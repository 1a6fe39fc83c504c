"""Near copies by Jaccard similarity of word shingles: keys of least hashes give candidates, sets decide.

SimHash keys cannot stand for a similarity of 0.8: there two fingerprints differ in about ten of 64 bits, and a
Golay key of 24 bits is shared by few such pairs. Here a key is ``ROWS`` least hashes, so that a pair at 0.8 shares
one of ``BANDS`` keys with 1 - (1 - 0.8^5)^24 = 99.99 percent; what shares a key is compared on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import broadcast_if_small
from ..session import settle
from .common import col, star_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Documents, and shingles, that are compared with each other at once; larger groups are cut into blocks.
BLOCK_DOCS = 256
BLOCK_SHINGLES = 1 << 19

_RNG = np.random.default_rng(20_240_611)
_FLIPS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles hashed at once.
_CHUNK = 2_048


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a shorter text is one shingle, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    return np.unique(np.array(hashes, np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of the least values of its rows."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, ((shingles[at : at + _CHUNK, None] ^ _FLIPS) * _FACTORS).min(0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    few, many = sorted((len(a), len(b)))
    if few < similarity * many - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (few + many - both) - 1e-9


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys = [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), shingle)
                digests.append(_digest(found))
                keys.append(band_keys(found))
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["ident", "digest", "keys"])

    return run


def _sets(shingle: int):
    """The sets of candidates. An ident may have other texts as well: those are told apart by their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for text, *row in zip(batch.column(0), *(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                found = shingle_set(text.as_py(), shingle)
                if _digest(found) == row[1]:
                    rows.append((row[0], row[2], row[3], len(found), found.tobytes()))
                    size += len(found)
                if size > 1_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        names = ["node", "group", "keys", "n", "shingles"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def linked(nodes: list[int], keys: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest over nodes whose sets are similar. Only sets that share a key, and that nothing links yet, are compared."""
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            low, high = (x, y) if nodes[x] <= nodes[y] else (y, x)
            root[high] = low

    first: dict[int, int] = {}
    for k, node in enumerate(nodes):
        union(k, first.setdefault(node, k))
    unlike: set[tuple[int, int]] = set()
    for band in range(keys.shape[1]):
        order = np.argsort(keys[:, band], kind="stable")
        cut = np.flatnonzero(np.diff(keys[order, band])) + 1
        for members in np.split(order, cut):
            clusters: list[list[int]] = []
            for d in members.tolist() if len(members) > 1 else []:
                mine, others = [], []
                for cluster in clusters:
                    same = find(cluster[0]) == find(d)
                    for e in cluster if not same else ():
                        if (e, d) in unlike or (d, e) in unlike:
                            continue
                        if similar(sets[d], sets[e], similarity):
                            union(d, e)
                            same = True
                            break
                        unlike.add((d, e))
                    if same and not mine:
                        mine = cluster
                    elif same:
                        mine += cluster
                    else:
                        others.append(cluster)
                mine.append(d)
                clusters = [mine, *others]
    return [(nodes[k], nodes[find(k)]) for k in range(len(nodes)) if nodes[find(k)] != nodes[k]]


def _compare(similarity: float):
    """Links inside each group of sorted partitions; an unfinished group waits for more rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and row[:2] != held[-1][:2]:
                    yield from links(held)
                    held = []
                held.append(row)
        if held:
            yield from links(held)

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        keys = np.array([r[3] for r in rows], np.int64)
        found = linked([r[2] for r in rows], keys, [np.frombuffer(r[4], np.uint64) for r in rows], similarity)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def set_links(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that connect nodes of one ``group`` whose sets are similar; ``sets`` is read several times.

    Groups of more than a block are cut into blocks by hash. Blocks are linked by themselves; then one node of
    each cluster found so far; then, where a group is still more than one cluster, whatever is not in its largest
    is compared with all blocks. So a group of very many near copies is read a few times, and nothing is left out.
    """
    node_hash = F.xxhash64("node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("bigint")
    run = lambda rows: settle(
        rows.select("group", "part", "node", "keys", "shingles").repartition("group", "part").sortWithinPartitions("group", "part")
        .mapInArrow(_compare(similarity), "a bigint, b bigint")
    )
    dealt = lambda rows, sizes: rows.join(broadcast_if_small(sizes), "group").withColumn("part", F.pmod(node_hash, F.col("blocks")))
    sizes = settle(sets.groupBy("group").agg(blocks.alias("blocks")))
    found = run(dealt(sets, sizes))
    large = settle(sizes.filter("blocks > 1"))
    if large.isEmpty():
        return found
    rest = settle(dealt(sets, large))

    def clusters(edges: DataFrame) -> DataFrame:
        nodes = star_components(edges)
        return rest.join(nodes, "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component")

    heads = settle(clusters(found).filter("cluster = node").drop("blocks", "part", "cluster"))
    found = found.unionByName(run(dealt(heads, settle(heads.groupBy("group").agg(blocks.alias("blocks"))))))
    placed = settle(clusters(found))
    counts = settle(placed.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")))
    open_ = settle(
        counts.groupBy("group").agg(F.max_by("cluster", F.struct("docs", "cluster")).alias("main"), F.count(F.lit(1)).alias("clusters"))
        .filter("clusters > 1").select("group", "main")
    )
    if open_.isEmpty():
        return found
    outside = counts.join(broadcast_if_small(open_), "group").filter("cluster <> main").groupBy("group", "main").agg(
        F.ceil(F.greatest(F.sum("docs") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("bigint").alias("chunks")
    )
    again = placed.join(broadcast_if_small(settle(outside)), "group")
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
    own = again.withColumn("part", F.explode(F.transform(everywhere, lambda c: F.col("part") * F.col("chunks") + c)))
    guests = again.filter("cluster <> main").withColumn("chunk", chunk).withColumn("home", F.col("part"))
    guests = guests.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).filter("part <> home")
    guests = guests.withColumn("part", F.col("part") * F.col("chunks") + F.col("chunk"))
    names = ["group", "part", "node", "keys", "shingles"]
    return found.unionByName(run(own.select(*names).unionByName(guests.select(*names))))


def near_copies(df: DataFrame, text: str, ident: str, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) for every ident of ``df`` that has a near copy: the smallest ident that links reach.

    Two texts are linked whose sets of shingles have a Jaccard similarity of ``similarity`` or more. Rows with one
    ident are one node. Texts without words are equal. Equal sets are one, compared once; null idents are left out.
    """
    rows = df.select(col(ident).cast("bigint").alias("ident"), col(text).cast("binary").alias("t")).filter("ident is not null")
    known = settle(rows.mapInArrow(_describe(shingle), "ident bigint, digest binary, keys array<bigint>"))
    distinct = settle(known.groupBy("digest").agg(F.min("ident").alias("node"), F.first("keys").alias("keys")))
    copies = known.join(distinct.select("digest", "node"), "digest").filter("ident <> node")
    keyed = distinct.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    stars = keyed.join(shared, "key").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    groups = star_components(stars).select("node", F.col("component").alias("group"))
    wanted = settle(distinct.join(groups, "node").select("node", "digest", "group", "keys"))
    texts = rows.withColumnRenamed("ident", "node").join(broadcast_if_small(wanted), "node")
    sets = settle(
        texts.select("t", "node", "digest", "group", "keys")
        .mapInArrow(_sets(shingle), "node bigint, group bigint, keys array<bigint>, n bigint, shingles binary")
    )
    edges = set_links(sets, similarity).unionByName(copies.select(F.col("ident").alias("a"), F.col("node").alias("b")))
    return star_components(edges)
