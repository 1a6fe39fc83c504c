"""Hard negatives by lists that the anchors of a cluster share, sorted once by an angular upper bound."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, settle_partitions
from .common import col

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative scores between these percentages of the positive.
LOW, HIGH = 30, 90
#: Rows (and numbers in them) whose lists are sorted together, rows of a task, numbers in a block of anchors, anchors of a
#: cluster.
LOT_ROWS, LOT_VALUES, TASK_ROWS, BLOCK_VALUES, CLUSTER = 8_192, 4_000_000, 131_072, 2_000_000, 32
#: One in so many rows is walked first.
PILOT = 8
#: Rounds of k-means; the first and the longest step along a list.
ROUNDS, STEP, LONGEST = 4, 256, 4_096
#: Slack for rounding, in radians and relative.
SLACK, GRAIN = 1e-6, 1e-9


@dataclass
class Want:
    """Rows that member ``member`` of a cluster looks for: of its label or of others, with scores in [low, high]."""

    member: int
    same: bool
    low: float
    high: float
    key: tuple


@dataclass
class Cluster:
    """Anchors of equal width around a direction, none of them further from it than ``angle``."""

    center: np.ndarray
    angle: float
    vectors: np.ndarray
    lengths: np.ndarray
    labels: np.ndarray
    idents: np.ndarray
    numbers: np.ndarray


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def cluster_anchors(vectors: np.ndarray, labels: np.ndarray, idents: np.ndarray, numbers: np.ndarray, size: int = CLUSTER) -> list[Cluster]:
    """Clusters of directions by k-means that starts from evenly spaced rows; the same for the same rows."""
    lengths = _lengths(vectors)
    unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    k = -(-len(unit) // size)
    centers = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, unit)
        norm = _lengths(sums)[:, None]
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    nearest = np.argmax(unit @ centers.T, axis=1)
    out = []
    for c in np.unique(nearest).tolist():
        rows = np.flatnonzero(nearest == c)
        # A vector of length 0 has no direction and scores 0 with all.
        cosines = (unit[rows] @ centers[c])[lengths[rows] > 0]
        angle = float(np.arccos(np.clip(cosines.min(), -1, 1))) if len(cosines) else 0.0
        out.append(Cluster(centers[c], angle, vectors[rows], lengths[rows], labels[rows], idents[rows], numbers[rows]))
    return out


def shared_list(cluster: Cluster, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows by the most that any member of the cluster can score with them for a length of 1."""
    cosine = (rows @ cluster.center) / np.where(lengths > 0, lengths, 1)
    apart = np.arccos(np.clip(cosine, -1, 1)) - cluster.angle - SLACK
    bound = lengths * (np.cos(np.maximum(apart, 0)) + GRAIN)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(
    cluster: Cluster, wants: list[Want], rows: np.ndarray, labels: np.ndarray, idents: np.ndarray, top: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each want the ``top`` first rows (score down, ident up) as (rows, scores), and how many rows were scored.

    Members go along the shared list together. A want is done, for certain, once the bound of the next row is below
    what it still takes: its lowest score, or that of its last row when it has ``top`` of them.
    """
    order, bound = shared_list(cluster, rows, _lengths(rows))
    exact = float(np.abs(cluster.vectors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1] < 2**53
    a, b = (x.astype(np.float64) if exact else x for x in (cluster.vectors, rows))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in wants]
    floor = np.array([w.low for w in wants], np.float64)
    reach = cluster.lengths[[w.member for w in wants]]
    at, step, scored = 0, STEP, 0
    while at < len(order):
        open_ = np.flatnonzero(reach * bound[at] >= floor)
        if not len(open_):
            break
        part = order[at : at + step]
        members, place = np.unique([wants[w].member for w in open_], return_inverse=True)
        scores = a[members] @ b[part].T
        scores = np.rint(scores).astype(np.int64) if exact else scores
        scored += scores.size
        own = labels[part][None, :] == cluster.labels[members][:, None]
        other = idents[part][None, :] != cluster.idents[members][:, None]
        for w, m in zip(open_.tolist(), place.tolist(), strict=True):
            want, s = wants[w], scores[m]
            hit = np.flatnonzero((s >= floor[w]) & (s <= want.high) & other[m] & (own[m] == want.same))
            if not len(hit):
                continue
            if len(hit) > top:
                hit = hit[s[hit] >= np.partition(s[hit], len(hit) - top)[len(hit) - top]]
            r, t = np.concatenate((found[w][0], part[hit])), np.concatenate((found[w][1], s[hit]))
            first = np.lexsort((idents[r], -t))[:top]
            found[w] = r[first], t[first]
            if len(first) == top:
                floor[w] = max(floor[w], float(t[first[-1]]))
        at, step = at + step, min(2 * step, LONGEST)
    return found, scored


def _matrices(batches: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(idents, labels, vectors) of the rows of each width."""
    table = pa.Table.from_batches(batches).combine_chunks()
    if not table.num_rows:
        return
    idents, labels = (table.column(k).to_numpy() for k in (0, 1))
    column = table.column(2).chunk(0)
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    widths = np.diff(offsets)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield idents[rows], labels[rows], flat[offsets[rows][:, None] + np.arange(width)]


def _search(clusters: list[Cluster], wants: list[list[Want]], top: int):
    """What every want finds in each lot of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(lot: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for idents, labels, rows in _matrices(lot):
                for cluster, own in zip(clusters, wants, strict=True):
                    if own and cluster.vectors.shape[1] == rows.shape[1]:
                        found, _ = walk(cluster, own, rows, labels, idents, top)
                        hits = [(*w.key, i, s) for w, (r, t) in zip(own, found, strict=True) for i, s in zip(idents[r].tolist(), t.tolist(), strict=True)]
                        if hits:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], ["number", "want", "ident", "score"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, LOT_ROWS):
                waiting.append(batch.slice(at, LOT_ROWS))
                if sum(b.num_rows for b in waiting) >= LOT_ROWS or sum(b.column(2).flatten().nbytes for b in waiting) >= 8 * LOT_VALUES:
                    yield from search(waiting)
                    waiting = []
        if waiting:
            yield from search(waiting)

    return run


def _ranked(rows: DataFrame, clusters: list[Cluster], wants: list[list[Want]], top: int) -> DataFrame:
    found = rows.select("ident", "label", "v").mapInArrow(_search(clusters, wants, top), "number bigint, want bigint, ident bigint, score bigint")
    order = Window.partitionBy("number", "want").orderBy(F.col("score").desc(), "ident")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _first(rows: DataFrame, clusters: list[Cluster], wants: list[list[Want]], top: int) -> DataFrame:
    """(number, want, ident, score, rank): the first ``top`` rows of every want over all lots.

    A part of the rows, by hash, goes first. The score of a want's last row there is one that its last row of all reaches, so
    the walks over all rows take nothing below it: about ``PILOT * top`` rows a want leave their tasks, however many
    lots there are. One number per want comes to the driver.
    """
    part = _ranked(rows.filter(F.pmod(F.xxhash64("ident", F.lit(PILOT)), F.lit(PILOT)) == 0), clusters, wants, top)
    floors = {(r["number"], r["want"]): r["score"] for r in part.filter(F.col("rank") == top).collect()}
    raised = [[replace(w, low=max(w.low, floors.get(w.key, w.low))) for w in own] for own in wants]
    return _ranked(rows, clusters, raised, top)


def mine_negatives(
    df: DataFrame,
    vector: str,
    label: Column,
    ident: str,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) for the rows where ``anchor`` holds.

    Components become floor(scale * x); scores are integer inner products, higher ones come first, ties by smaller
    ident. A positive is one of the first ``positives`` rows of the anchor's label and another ident; its negatives are the
    first ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive. Exact: every row is
    scored or certified, by its angle, to come too late.

    Rows with a null ident, label or vector, an empty vector, or a null or non-finite component take no part. Rows that
    are equal in ident, label and vector are one row; rows that share an ident but differ are rows of their own. Vectors
    of different widths are not compared. An empty table gives an empty result. Other columns are not read.

    Anchors are taken in blocks, by hash, of about ``block_values`` numbers; rows stay where they are, in lots by hash.
    """
    rows = df.select(
        col(ident).cast("bigint").alias("ident"),
        label.cast("bigint").alias("label"),
        col(vector).cast("array<double>").alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter(
        F.col("ident").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("x") > 0)
        & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    n = rows.count()
    parts = max(math.ceil(n / TASK_ROWS), min(math.ceil(n / LOT_ROWS), df.sparkSession.sparkContext.defaultParallelism), 1)
    # Equal rows share the hash of their ident, so they meet without another shuffle.
    lots = settle_partitions(
        rows.select("ident", "label", "anchor", F.transform("x", lambda x: F.floor(x * float(scale))).alias("v"))
        .repartition(parts, "ident")
        .dropDuplicates(["ident", "label", "v"])
    )
    anchors = lots.filter("anchor").select("ident", "label", "v")
    values = anchors.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = math.ceil(values / block_values)
    done = [_mine_block(lots, anchors.filter(F.pmod(F.xxhash64("ident", "label", "v"), F.lit(blocks)) == b), positives, negatives, low, high) for b in range(blocks)]
    if not done:
        return df.sparkSession.createDataFrame([], "anchor bigint, positive bigint, rank int, negative bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, done)


def _mine_block(lots: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    clusters, number = [], 0
    drawn = anchors.orderBy("ident", "label", "v").toArrow().to_batches()
    for idents, labels, vectors in _matrices(drawn) if drawn else ():
        clusters += cluster_anchors(vectors, labels, idents, np.arange(number, number + len(idents)))
        number += len(idents)
    near = [[Want(m, True, -np.inf, np.inf, (int(k), 0)) for m, k in enumerate(c.numbers)] for c in clusters]
    # As many rows as the block has positives.
    first = _first(lots, clusters, near, positives).collect()
    chosen: dict[int, list] = {}
    for row in sorted(first, key=lambda r: (r["number"], r["rank"])):
        chosen.setdefault(row["number"], []).append((row["ident"], row["score"]))
    bands = [
        [
            Want(m, False, -(-low * p // 100), high * p // 100, (int(k), w))
            for m, k in enumerate(c.numbers)
            for w, (_, p) in enumerate(chosen.get(int(k), ()))
            if low * p <= high * p
        ]
        for c in clusters
    ]
    names = {int(k): int(i) for c in clusters for k, i in zip(c.numbers, c.idents, strict=True)}
    known = [(k, w, names[k], i, p) for k, own in chosen.items() for w, (i, p) in enumerate(own)]
    spark = lots.sparkSession
    wanted = spark.createDataFrame(known, "number bigint, want bigint, anchor bigint, positive bigint, positive_score bigint")
    found = _first(lots, clusters, bands, negatives)
    return settle(
        found.join(F.broadcast(wanted), ["number", "want"]).select(
            "anchor", "positive", "rank", F.col("ident").alias("negative"), "positive_score", F.col("score").alias("negative_score")
        )
    )
