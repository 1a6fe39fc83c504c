"""Ranked lexical search: documents are grouped by which of an item's terms they hold, and groups are scored in the
order of the most they can reach."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import col

TOP = 20
#: Documents that are grouped together, and those of the best groups scored at once.
LOT, STEP = 16_384, 128
#: Bound of the terms (repeats included) and of the items searched for in one pass over the documents.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 5_000

# Fixed values of the contract: letters, digits and all beyond ASCII form terms, A-Z in lower case.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_FOLD).split()


@dataclass
class Item:
    """A query: its terms as numbers in the block's vocabulary, and the weight of each times its repeats."""

    ident: int | None
    terms: np.ndarray
    repeats: np.ndarray
    weights: np.ndarray | None = None


def _blocks(items: DataFrame, ident: str, text: str) -> Iterator[tuple[dict[bytes, int], list[Item]]]:
    """Vocabulary and items, block by block; each block is bounded."""
    vocabulary: dict[bytes, int] = {}
    block: list[Item] = []
    held = 0
    rows = items.select(col(ident).cast("bigint").alias("i"), col(text).cast("binary").alias("t")).distinct()
    for row in rows.toLocalIterator():
        counts = Counter(terms_of(None if row["t"] is None else bytes(row["t"])))
        if block and (held + len(counts) > BLOCK_TERMS or len(block) >= BLOCK_ITEMS):
            yield vocabulary, block
            vocabulary, block, held = {}, [], 0
        numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
        block.append(Item(row["i"], np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))
        held += len(counts)
    if block:
        yield vocabulary, block


def _postings(vocabulary: dict[bytes, int]):
    """Number of terms of each document, and how often it holds each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            n, ends, terms, counts = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                n.append(len(words))
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc", "n", "terms", "counts"])

    return run


class Lot:
    """Postings of some documents by term. ``impact`` is a document's share of a score for a weight of 1."""

    def __init__(self, table: pa.Table, documents: int, length: int):
        self.ids = table.column(0)
        self.size = table.num_rows
        n = table.column(1).to_numpy()
        lists = [table.column(k).combine_chunks() for k in (2, 3)]
        terms, counts = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        held = np.diff(lists[0].offsets.to_numpy())
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(self.size), held)[order]
        # Fixed values of the contract.
        m = 100 - 25 + (25 * n * documents) // length
        tf = counts[order]
        self.impact = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[self.docs])
        sorted_terms = terms[order]
        self.known, start = np.unique(sorted_terms, return_index=True)
        self.bounds = np.append(start, len(sorted_terms))
        self.most = np.maximum.reduceat(self.impact, start) if len(start) else np.zeros(0, np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(documents in order, impacts, largest impact)"""
        at = int(np.searchsorted(self.known, term))
        if at == len(self.known) or self.known[at] != term:
            return None
        part = slice(self.bounds[at], self.bounds[at + 1])
        return self.docs[part], self.impact[part], int(self.most[at])


def search_lot(lot: Lot, item: Item, top: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, documents scored): the best documents of a lot, all that can be among the ``top`` best of it
    and score ``least`` or more, ties included.

    One bitmap per term, turned into one mask per document; equal masks are a group. No document scores more than its
    mask allows: the sum of the largest shares of its terms. Groups are taken by that bound, and none that
    follows matters once it is below the score of the ``top``-th best document.
    """
    parts = [(w, p) for t, w in zip(item.terms.tolist(), item.weights.tolist(), strict=True) if w and (p := lot.postings(t))]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not parts:
        return none
    bits = np.zeros((-(-len(parts) // 64) * 64, lot.size), bool)
    for k, (_, (docs, _, _)) in enumerate(parts):
        bits[k, docs] = True
    masks = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)
    if masks.shape[1] == 1:
        groups, group = np.unique(masks[:, 0], return_inverse=True)
    else:
        groups, group = np.unique(masks, axis=0, return_inverse=True)
        group = group.reshape(-1)
    holds = np.unpackbits(groups.reshape(len(groups), -1).view(np.uint8), axis=1, bitorder="little", count=len(parts))
    bound = holds.astype(np.int64) @ np.array([w * most for w, (_, _, most) in parts], np.int64)
    order = np.argsort(-bound, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_group = np.argsort(place[group], kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(groups))[order])
    bound = bound[order]
    best, scores, done, at = *none[:2], 0, 0
    floor = max(1, least)
    while at < len(bound) and bound[at] >= floor:
        # The next groups that may matter, enough of them for a step.
        upto = min(int(np.searchsorted(ends, done + STEP)) + 1, int(np.searchsorted(-bound, -floor, "right")))
        docs = np.sort(by_group[done : ends[upto - 1]])
        total = np.zeros(len(docs), np.int64)
        for weight, (held, impact, _) in parts:
            where = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            hit = held[where] == docs
            total[hit] += weight * impact[where[hit]]
        good = total >= floor
        best, scores = np.concatenate((best, docs[good])), np.concatenate((scores, total[good]))
        done, at = int(ends[upto - 1]), upto
        if len(scores) >= top:
            floor = max(floor, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
            keep = scores >= floor
            best, scores = best[keep], scores[keep]
    return best, scores, done


def _best(items: list[Item], documents: int, length: int, top: int):
    """The best documents of each item among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        waiting: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            if not table.num_rows:
                return
            lot = Lot(table, documents, length)
            for item, mine in zip(items, held, strict=True):
                least = -mine[top - 1][0] if len(mine) >= top else 1
                docs, scores, _ = search_lot(lot, item, top, least)
                ids = lot.ids.take(pa.array(docs)).to_pylist()
                # Higher scores first, then smaller ids, those without one last.
                mine += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids, strict=True)]
                mine.sort()
                del mine[top:]

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= LOT:
                search()
        if waiting:
            search()
        rows = [(k, items[k].ident, None if no else i, -s) for k, mine in enumerate(held) for s, no, i in mine]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            ["number", "item", "doc", "score"],
        )

    return run


def search_items(
    docs: DataFrame, text: str, ident: str, items: DataFrame, item_text: str, item_ident: str, top: int = TOP
) -> DataFrame:
    """(item, rank, doc, score): the ``top`` best documents of each item with a score above 0, best first.

    The score of a document is the sum over an item's terms, repeats included, of the term's weight times its share
    (see ``Lot``). Weights and the mean length come from all documents that hold a term at all. Equal scores go
    by smaller ident, a null one last. Null and empty texts hold no term: such documents are found by no
    item, such items find nothing. Rows that repeat an ident are documents of their own; rows of ``items`` that are
    equal are one, and items that share an ident but not the text are ranked each by itself. No documents or no items
    give no rows. Only the named columns are read.

    Documents are read once per block of items; a block is bounded by ``BLOCK_TERMS`` and ``BLOCK_ITEMS``. What is
    written of a document is its terms that some item has. Each task keeps ``top`` documents per item.
    """
    read = docs.select(col(ident).cast("bigint").alias("doc"), col(text).cast("binary").alias("t"))
    found = []
    for vocabulary, block in _blocks(items, item_ident, item_text):
        postings = settle(
            read.mapInArrow(_postings(vocabulary), "doc bigint, n bigint, terms array<int>, counts array<int>").filter("n > 0")
        )
        documents, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        # At most as many rows as the block has terms.
        holding = np.zeros(len(vocabulary), np.int64)
        for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            holding[term] = df
        for item in block:
            df = holding[item.terms].tolist()
            weights = [math.floor(1_000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in df]
            item.weights = np.array(weights, np.int64) * item.repeats
        best = postings.mapInArrow(_best(block, documents, length, top), "number int, item bigint, doc bigint, score bigint")
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        found.append(settle(ranked.select("item", "rank", "doc", "score")))
    if not found:
        return docs.sparkSession.createDataFrame([], "item bigint, rank int, doc bigint, score bigint")
    return reduce(DataFrame.unionByName, found)
