"""Embedding near-dedup by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import col, star_components
from .simhash import forest

THRESHOLD = 0.95
TREES = 8
#: Rows on both sides of a split are the middle tenth by their projection.
SPILL = 0.05
LEAF = 256
#: Bound of the sample that the upper levels are fitted on, and the least sample rows of a leaf.
SAMPLE = 65_536
SAMPLE_LEAF = 32
#: Bound of the sample in numbers: wide vectors are fewer.
SAMPLE_VALUES = 8_000_000
#: Vectors of one component that a task compares with each other.
BLOCK = 2_048


def direction(tree: int, node: int, width: int, level: int = 0) -> np.ndarray:
    """The random direction of a node; the same in every task."""
    return np.random.default_rng([tree, node, width, level]).standard_normal(width)


@dataclass
class Tree:
    """Bounds of the overlap of every inner node; children of k are 2k and 2k + 1, the root is 1."""

    number: int
    level: int = 0
    bounds: dict[int, tuple[float, float]] = field(default_factory=dict)

    def grow(self, x: np.ndarray, leaf: int, node: int = 1) -> list[tuple[int, np.ndarray]]:
        """Split the rows of ``x`` down to leaves of at most ``leaf`` rows: (node, rows)."""
        done, open_ = [], [(node, np.arange(len(x)))]
        while open_:
            at, rows = open_.pop()
            if len(rows) > leaf:
                p = x[rows] @ direction(self.number, at, x.shape[1], self.level)
                low, high = np.quantile(p, (0.5 - SPILL, 0.5 + SPILL))
                left, right = rows[p <= high], rows[p >= low]
                if len(left) < len(rows) and len(right) < len(rows):
                    self.bounds[at] = (float(low), float(high))
                    open_ += [(2 * at, left), (2 * at + 1, right)]
                    continue
            done.append((at, rows))
        return done

    def leaves(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) of ``x`` in the tree as it is."""
        done, open_ = [], [(1, np.arange(len(x)))]
        while open_:
            at, rows = open_.pop()
            if at not in self.bounds or not len(rows):
                if len(rows):
                    done.append((at, rows))
                continue
            p = x[rows] @ direction(self.number, at, x.shape[1], self.level)
            low, high = self.bounds[at]
            open_ += [(2 * at, rows[p <= high]), (2 * at + 1, rows[p >= low])]
        return done


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of equal width as rows of length 1 in double precision; widths of all."""
    widths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), widths


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of unit vectors) for every width."""
    flat, widths = _unit(column)
    begin = np.cumsum(widths) - widths
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        x = flat[begin[rows][:, None] + np.arange(width)]
        x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_forest(sample: pa.Array, trees: int = TREES, leaf: int = SAMPLE_LEAF) -> dict[int, list[Tree]]:
    """The upper levels of the trees by vector width."""
    out = {}
    for _, x in _matrices(sample):
        grown = [Tree(t) for t in range(trees)]
        for tree in grown:
            tree.grow(x, leaf)
        out[x.shape[1]] = grown
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (first column, in order); an unfinished group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for table in _pieces(batches):
        if table.num_rows:
            keys = table.column(0).to_numpy()
            yield table, np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))


def _array(table: pa.Table, k: int) -> pa.Array:
    column = table.column(k)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _assign(model: dict[int, list[Tree]], trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column(1)):
                # A width that the sample lacks has one leaf per tree.
                for tree in model.get(x.shape[1], [Tree(t) for t in range(trees)]):
                    found = tree.leaves(x)
                    index = rows[np.concatenate([r for _, r in found])]
                    leaf = np.concatenate([np.full(len(r), at, np.int64) for at, r in found])
                    key = (leaf * 4_096 + tree.number) * 65_536 + x.shape[1] % 65_536
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), batch.column(0).take(pa.array(index)), batch.column(1).take(pa.array(index))], ["leaf", "rep", "v"]
                    )

    return run


def _link(threshold: float):
    """Edges between the vectors of a leaf, as a spanning forest; large leaves are split further first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in _groups(batches):
            reps = table.column(1).to_numpy()
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for rows, x in _matrices(_array(table, 2).slice(a, b - a)):
                    number = int(table.column(0)[a].as_py() // 65_536 % 4_096)
                    own = reps[a:b][rows]
                    for _, part in Tree(number, level=1).grow(x, LEAF):
                        for at in range(0, len(part), 1_024):
                            i, j = np.nonzero(x[part[at : at + 1_024]] @ x[part].T >= threshold)
                            i += at
                            apart = i < j
                            if apart.any():
                                p, q = forest(own[part[i[apart]]], own[part[j[apart]]])
                                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    return run


def _count(threshold: float):
    """For pairs of blocks (group: one pair): how many rows link to each vector, copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in _groups(batches):
            reps, copies, second = (table.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                total = np.zeros(b - a, np.int64)
                for rows, x in _matrices(_array(table, 4).slice(a, b - a)):
                    n, right = copies[a:b][rows], second[a:b][rows]
                    # One block with itself, or the first block with the second.
                    left, other = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(rows)),) * 2
                    for at in range(0, len(left), 1_024):
                        part = left[at : at + 1_024]
                        hit = x[part] @ x[other].T >= threshold
                        if right.any():
                            total[rows[other]] += n[part] @ hit
                        else:
                            hit[np.arange(len(part)), at + np.arange(len(part))] = False
                        total[rows[part]] += hit @ n[other]
                yield pa.RecordBatch.from_arrays([pa.array(reps[a:b]), pa.array(total)], ["rep", "links"])

    return run


def link_vectors(
    df: DataFrame, vector: str, ident: str, threshold: float = THRESHOLD, trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """(ident, n_links, component) for every row of ``df``: how many other rows its vector links with directly
    (cosine of at least ``threshold`` in double precision), and the smallest ident reachable over links.

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; vectors of
    different widths do not link. Equal vectors are one, compared once and counted as often as they stand. An
    empty table gives an empty result.

    The upper levels of the trees are fitted on a sample of at most ``sample`` distinct vectors and
    ``SAMPLE_VALUES`` numbers, taken by hash; every vector is filed, in each tree in one or more leaves. A leaf
    that gathers more rows than the sample foretold is split on by its own rows. Leaves give spanning forests, not pairs; connected components follow.
    Links are then counted inside components, where all of them are, block against block. A large component
    is cut into blocks, so that no task holds it whole.
    """
    value = col(vector).cast("array<double>")
    rows = df.select(col(ident).cast("bigint").alias("ident"), value.alias("v"))
    good = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0.0),
        F.lit(False),
    )
    rows = rows.withColumn("v", F.when(good, F.col("v")))
    reps = settle(
        rows.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("ident").alias("first"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    widest = reps.agg(F.max(F.size("v"))).first()[0] or 1
    bound = max(1, min(sample, SAMPLE_VALUES // widest))
    drawn = reps.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(bound).select("v").toArrow()
    model = fit_forest(_array(drawn.combine_chunks(), 0), trees) if drawn.num_rows else {}
    filed = reps.select("rep", "v").mapInArrow(_assign(model, trees), "leaf bigint, rep bigint, v array<double>")
    edges = filed.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_link(threshold), "a bigint, b bigint")
    nodes = settle(star_components(edges))
    sizes = nodes.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = reps.join(nodes, reps["rep"] == nodes["node"]).join(sizes, "component")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("bigint")).cast("int")
    pairs = (
        member.select("component", "rep", "n", "v", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
            "rep", "n", (F.col("own") > F.col("other")).alias("second"), "v",
        )
    )
    counted = (
        pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(_count(threshold), "rep bigint, links bigint")
        .groupBy("rep").agg(F.sum("links").alias("links"))
    )
    roots = reps.join(nodes, reps["rep"] == nodes["node"]).groupBy("component").agg(F.min("first").alias("root"))
    placed = nodes.join(roots, "component").select(F.col("node").alias("rep"), "root")
    known = settle(
        reps.join(placed, "rep", "left").join(counted, "rep", "left").select(
            F.col("v").alias("rv"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "first").alias("component"),
        )
    )
    return rows.join(known, F.col("v") == F.col("rv"), "left").select(
        "ident",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "ident").alias("component"),
    )
