"""SentencePiece encoding and decoding: n-best segmentations over the piece lattice, and exact decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

#: Public vocabulary file; the path is a parameter of every operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Distinct chunks a task remembers; beyond it starts anew.
REMEMBER = 60_000
#: Texts, and characters of these, that are read at once; chunks that are segmented at once.
LOT_TEXTS, LOT_CHARS, LOT_CHUNKS = 1_000, 4_000_000, 5_000
#: Chunks longer than this are segmented one by one.
LONG = 24
#: A character without a piece costs this much more than the rarest piece.
UNKNOWN_PENALTY = 10.0
#: Of Zipf's law, as measured on natural text.
ZIPF_SHIFT = 2.7

# A chunk is a run of spaces with the word after it, or one line end. No piece reaches across its borders.
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_SPACE = "▁"


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback, as text with plain spaces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.piece: dict[str, int] = {}
        self.score = np.zeros(model.get_piece_size())
        self.byte_id = [0] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(_SPACE, " ")
                self.bytes_of.append(text.encode())
                self.piece[text] = k
                self.score[k] = model.get_score(k)
                if " " in text.lstrip(" ") or "\n" in text:
                    raise ValueError(f"piece {piece!r} reaches across chunks")
        # The model's own scores are the order of its merges, which says how frequent pieces are but not by how much: their
        # sums prefer many common fragments to one piece. By Zipf's law a piece of rank r has a share of about 1 / (r + shift),
        # so a score is the logarithm of that, normalised to shares of all pieces.
        real = {k: -self.score[k] for t, k in self.piece.items() if t.strip(" ")}
        share = np.log(sum(1 / (r + ZIPF_SHIFT) for r in real.values())) if real else 0.0
        for k, rank in real.items():
            self.score[k] = -np.log(rank + ZIPF_SHIFT) - share
        self.lowest = min((self.score[k] for k in real), default=0.0)
        # Runs of spaces are marked as user-defined, far below all others; the longest has the highest score.
        for text, k in self.piece.items():
            if k not in real:
                self.score[k] = self.lowest - 1.0 + 1e-3 * len(text)
        self.unknown = self.lowest - UNKNOWN_PENALTY
        self.longest = max(map(len, self.piece), default=1)

    def edge(self, text: str, start: int, end: int) -> tuple[tuple[int, ...], float] | None:
        """Pieces and score of ``text[start:end]`` as one edge of the lattice."""
        part = text[start:end]
        k = self.piece.get(part)
        if k is not None:
            return (k,), float(self.score[k])
        if end - start == 1:
            return tuple(self.byte_id[b] for b in part.encode("utf-8", "surrogatepass")), self.unknown
        return None

    def forward(self, text: str) -> list[float]:
        """Viterbi scores: the best segmentation of every beginning of ``text``."""
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                e = self.edge(text, start, end)
                if e is not None and best[start] + e[1] > best[end]:
                    best[end] = best[start] + e[1]
        return best

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations, best first.

        A-star from the end of the lattice to its start. What remains before a node is exactly its forward
        score, so paths leave the queue in the order of their full scores, and none of the n best passes a node
        that n better ones have left already. Ties go in the order of their making.
        """
        before = self.forward(text)
        left = [n] * (len(text) + 1)
        queue = [(-before[-1], 0, len(text), 0.0, None)]
        made = 0
        found: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(found) < n:
            _, _, at, after, path = heapq.heappop(queue)
            if not left[at]:
                continue
            left[at] -= 1
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    edge, path = path
                    ids += edge
                found.append((after, tuple(ids)))
                continue
            for start in range(max(0, at - self.longest), at):
                e = self.edge(text, start, at)
                if e is not None:
                    made += 1
                    heapq.heappush(queue, (-(before[start] + e[1] + after), made, start, e[1] + after, (e[0], path)))
        return found

    def raw(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[k] for k in ids])

    def decode(self, ids) -> bytes:
        """The text of pieces, without the leading space that encoding adds."""
        return self.raw(ids)[1:]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _MIX
    return h ^ (h >> np.uint64(29))


class Chunks:
    """Best segmentation of many distinct chunks at once, and by how much their second best is worse.

    Chunks of one length form a matrix of characters. Forward scores come column by column from all pieces that
    end there, backward scores likewise. The second best path is the best one over an edge off the best path.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        texts = list(vocabulary.piece)
        hashes = np.zeros(len(texts), np.uint64)
        for k, t in enumerate(texts):
            h = np.zeros(1, np.uint64)
            for c in t:
                h = _step(h, np.array([ord(c) + 1], np.uint64))
            hashes[k] = h[0]
        # Two tables by different bits of the hash; what collides in the first is in the second.
        self.slots = []
        left = np.arange(len(texts))
        for shift in (44, 24):
            at = (hashes[left] >> np.uint64(shift)) & np.uint64((1 << 20) - 1)
            _, one = np.unique(at, return_index=True)
            slots = np.full(1 << 20, -1, np.int32)
            slots[at[one]] = left[one]
            self.slots.append((np.uint64(shift), slots))
            left = np.delete(left, one)
        assert not len(left)
        self.hashes = hashes
        self.ids = np.array([vocabulary.piece[t] for t in texts], np.int32)
        codes = np.full((len(texts), vocabulary.longest), -1, np.int32)
        for row, t in enumerate(texts):
            codes[row, : len(t)] = [ord(c) for c in t]
        self.codes = codes

    def _pieces(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For every (start, length) the piece numbers of all rows, or -1; found by hash and verified."""
        rows, width = chars.shape
        found = {}
        for start in range(width):
            h = np.zeros(rows, np.uint64)
            for n in range(1, min(self.v.longest, width - start) + 1):
                h = _step(h, chars[:, start + n - 1].astype(np.uint64) + np.uint64(1))
                ids = np.full(rows, -1, np.int32)
                for shift, slots in self.slots:
                    at = slots[(h >> shift) & np.uint64((1 << 20) - 1)]
                    hit = np.flatnonzero((at >= 0) & (self.hashes[at] == h))
                    if len(hit):
                        hit = hit[(self.codes[at[hit], :n] == chars[hit, start : start + n]).all(1)]
                        ids[hit] = self.ids[at[hit]]
                if (ids >= 0).any():
                    found[start, n] = ids
        return found

    def _matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        width = len(texts[0])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width).astype(np.int32)
        found = self._pieces(chars)
        rows = len(texts)
        edges: dict[tuple[int, int], np.ndarray] = {}
        for (start, n), ids in found.items():
            edges[start, n] = np.where(ids >= 0, self.v.score[ids], -np.inf)
        for start in range(width):
            known = edges.get((start, 1))
            edges[start, 1] = np.full(rows, self.v.unknown) if known is None else np.where(np.isneginf(known), self.v.unknown, known)
        ahead = np.full((width + 1, rows), -np.inf)
        ahead[0] = 0
        came = np.zeros((width + 1, rows), np.int64)
        for end in range(1, width + 1):
            for n in range(min(end, self.v.longest), 0, -1):
                w = edges.get((end - n, n))
                if w is not None:
                    better = ahead[end - n] + w > ahead[end]
                    ahead[end] = np.where(better, ahead[end - n] + w, ahead[end])
                    came[end] = np.where(better, n, came[end])
        after = np.full((width + 1, rows), -np.inf)
        after[width] = 0
        for start in range(width - 1, -1, -1):
            for n in range(1, min(width - start, self.v.longest) + 1):
                w = edges.get((start, n))
                if w is not None:
                    after[start] = np.maximum(after[start], w + after[start + n])
        on = np.zeros((width + 1, rows), bool)  # nodes of the best path
        on[width] = True
        for end in range(width, 0, -1):
            for n in range(1, min(end, self.v.longest) + 1):
                on[end - n] |= on[end] & (came[end] == n)
        second = np.full(rows, -np.inf)
        for (start, n), w in edges.items():
            off = ~(on[start + n] & (came[start + n] == n))
            second = np.maximum(second, np.where(off, ahead[start] + w + after[start + n], -np.inf))
        # Pieces of the best path by the node where they end: -1 no node of it, -2 a character without a piece.
        path = np.full((rows, width), -1, np.int32)
        for end in range(1, width + 1):
            for n in range(1, min(end, self.v.longest) + 1):
                here = np.flatnonzero(on[end] & (came[end] == n))
                if len(here):
                    ids = found.get((end - n, n))
                    path[here, end - 1] = -2 if ids is None else np.where(ids[here] >= 0, ids[here], -2)
        counts = (path != -1).sum(1)
        flat = path[path != -1]
        odd = np.flatnonzero((path == -2).any(1))
        if len(odd):
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for r in odd.tolist():
                ids = []
                for end in np.flatnonzero(path[r] != -1).tolist():
                    k = int(path[r, end])
                    ids += [k] if k >= 0 else [self.v.byte_id[b] for b in texts[r][end].encode("utf-8", "surrogatepass")]
                parts[r], counts[r] = np.array(ids, np.int32), len(ids)
            flat = np.concatenate(parts)
        return flat, counts, ahead[width], ahead[width] - second

    def segment(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The chunks in the order of the results, their pieces one after another, the numbers of pieces, the
        scores and the distances of the second best (inf: none)."""
        by_width: dict[int, list[str]] = {}
        for t in texts:
            by_width.setdefault(len(t), []).append(t)
        order: list[str] = []
        found = []
        for width, same in by_width.items():
            order += same
            if width > LONG:
                for t in same:
                    best = self.v.n_best(t, 2)
                    gap = best[0][0] - best[1][0] if len(best) > 1 else np.inf
                    ids = np.array(best[0][1], np.int32)
                    found.append((ids, np.array([len(ids)]), np.array([best[0][0]]), np.array([gap])))
            else:
                found += [self._matrix(same[at : at + LOT_CHUNKS]) for at in range(0, len(same), LOT_CHUNKS)]
        return (order, *(np.concatenate(x) for x in zip(*found, strict=True)))


class Encoder:
    """n-best segmentations of texts. Chunks are segmented once while they are remembered."""

    def __init__(self, path: str = MODEL, n: int = N_BEST):
        self.v = Vocabulary(path)
        self.chunks = Chunks(self.v)
        self.n = n
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.names: list[str] = []
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.lists: dict[str, list] = {}

    def learn(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of every text as numbers. Chunks are kept once as texts, since those of a whole lot take more than all else."""
        if len(self.at) > REMEMBER:
            self._forget()
        numbers = []
        known = len(self.names)
        for text in texts:
            chunks = split(text)
            new = set(chunks).difference(self.at)
            self.at.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
            self.names += new
            numbers.append(np.fromiter(map(self.at.__getitem__, chunks), np.int32, len(chunks)))
        if len(self.names) > known:
            order, ids, count, score, gap = self.chunks.segment(self.names[known:])
            # Back into the order of the numbers; the pieces stay where they are.
            place = np.empty(len(order), np.int64)
            place[np.fromiter(map(self.at.__getitem__, order), np.int64, len(order)) - known] = np.arange(len(order))
            self.first = np.concatenate((self.first, (len(self.ids) + np.cumsum(count) - count)[place]))
            self.ids, self.count = np.concatenate((self.ids, ids)), np.concatenate((self.count, count[place]))
            self.score, self.gap = np.concatenate((self.score, score[place])), np.concatenate((self.gap, gap[place]))
        return numbers

    def _alternatives(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """Losses and pieces of the n best segmentations of a chunk; the first is the one that stands for it, ties or not."""
        if chunk not in self.lists:
            k = self.at[chunk]
            own = tuple(self.ids[self.first[k] : self.first[k] + self.count[k]].tolist())
            found = self.v.n_best(chunk, self.n)
            others = [(found[0][0] - s, p) for s, p in found if p != own]
            self.lists[chunk] = [(0.0, own), *others[: self.n - 1]]
        return self.lists[chunk]

    def encode(self, at: np.ndarray) -> tuple[np.ndarray, float, list[float], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """For a text's chunks as numbers: pieces of the best segmentation, its score, the losses of the n best (the first is 0), and for each of these
        its changes: (place, number, pieces) says which pieces of the best give way to which.

        The lattice of a text is the chain of its chunks' lattices. Beyond the best, only the n - 1 chunks whose
        second best loses least can differ: any other change loses as much as those n - 1 changes each.
        """
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[at] - ends + count, count) + np.arange(count.sum())]
        gaps = self.gap[at]
        few = min(self.n - 1, len(at))
        paths: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        if few:
            near = np.flatnonzero(gaps <= np.partition(gaps, few - 1)[few - 1])
            for k in near[np.argsort(gaps[near], kind="stable")][:few].tolist():
                if np.isfinite(gaps[k]):
                    _, *others = self._alternatives(self.names[at[k]])
                    both = [*paths, *((a + b, {**changed, k: p}) for a, changed in paths for b, p in others)]
                    paths = heapq.nsmallest(self.n, both, key=lambda x: x[0])
        changes = [[(int(ends[k] - count[k]), int(count[k]), changed[k]) for k in sorted(changed)] for _, changed in paths]
        return ids, float(self.score[at].sum()), [loss for loss, _ in paths], changes

    def restores(self, ids: np.ndarray, changes: list[list[tuple]], text: str) -> bool:
        """Whether decoding gives the text back, whichever of the changes are made."""
        exact = lambda a, n, p: self.v.raw(p) == self.v.raw(ids[a : a + n].tolist())
        return self.v.decode(ids.tolist()) == text.encode("utf-8", "surrogatepass") and all(exact(*c) for made in changes for c in made)

    def best(self, text: str) -> list[int]:
        return self.n_best(text)[0][1]

    def n_best(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text with their scores, best first."""
        ids, score, losses, changes = self.encode(*self.learn([text]))
        return [(score - loss, change(ids, made).tolist()) for loss, made in zip(losses, changes, strict=True)]


def change(ids: np.ndarray, made: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    """Pieces after changes, which are in the order of their places."""
    parts, done = [], 0
    for at, n, pieces in made:
        parts += [ids[done:at], np.array(pieces, np.int32)]
        done = at + n
    return np.concatenate([*parts, ids[done:]]) if made else ids


@lru_cache(2)
def encoder(path: str, n: int) -> Encoder:
    """One per Python worker: what it remembers serves the worker's next tasks."""
    return Encoder(path, n)


def split(text: str) -> list[str]:
    """Chunks of a text with the leading space that encoding adds; none for an empty text."""
    return _CHUNK.findall(f" {text}") if text else []


def encode_pieces(df: DataFrame, text: str, ident: str, n: int = N_BEST, model: str = MODEL, alternatives: bool = False) -> DataFrame:
    """(ident, ids, score, losses, restored, changes) for every row of ``df``, and with ``alternatives`` the ``n_best``.

    ``ids`` are the pieces of the best segmentation, ``losses`` by how much the n best fall short of it (fewer where there
    are fewer), ``restored`` whether decoding each of them gives the text back. ``changes`` says for each of the n best where
    it differs: in place of ``n`` pieces of the best, from the piece ``at`` on, stand ``ids``, the best's own list being
    empty. That is the n best in full without writing each out; ``n_best`` writes out the pieces of all of them, best first, one
    list for a text without pieces. Nulls and empty texts have no pieces. Rows are encoded each by itself, so
    repeated ones are repeated; an empty table gives an empty result. Whole texts are read in small batches; a task remembers
    a bounded number of chunks.
    """

    names_of = ("at", "n", "ids")
    change_type = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, n)
        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            at = 0
            while at < len(column):
                texts, size = [], 0
                while at + len(texts) < len(column) and size < LOT_CHARS and len(texts) < LOT_TEXTS:
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                ids, scores, losses, restored, changes, lists = [], [], [], [], [], []
                for t, chunks in zip(texts, coder.learn(texts), strict=True):
                    best, score, lost, made = coder.encode(chunks)
                    ids.append(best)
                    scores.append(score)
                    losses.append(lost)
                    restored.append(coder.restores(best, made, t))
                    changes.append(made)
                    if alternatives:
                        lists.append([change(best, m) for m in made])
                columns = {
                    "ident": names.slice(at, len(texts)),
                    "ids": pa.array(ids, pa.list_(pa.int32())),
                    "score": pa.array(scores, pa.float64()),
                    "losses": pa.array(losses, pa.list_(pa.float64())),
                    "restored": pa.array(restored, pa.bool_()),
                    "changes": pa.array([[[dict(zip(names_of, c, strict=True)) for c in m] for m in made] for made in changes], change_type),
                }
                if alternatives:
                    columns["n_best"] = pa.array(lists, pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_pydict(columns)
                at += len(texts)

    return df.select(col(ident).cast("bigint").alias("ident"), col(text).cast("string").alias("t")).mapInArrow(
        run,
        "ident bigint, ids array<int>, score double, losses array<double>, restored boolean, "
        "changes array<array<struct<at:int,n:int,ids:array<int>>>>" + ", n_best array<array<int>>" * alternatives,
    )


def decode_pieces(df: DataFrame, ids: str, ident: str, model: str = MODEL) -> DataFrame:
    """(ident, text) from pieces; null pieces give null, none give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(model, N_BEST).v
        for batch in batches:
            texts = [
                None if not x.is_valid else vocabulary.decode(x.as_py()).decode("utf-8", "surrogatepass")
                for x in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["ident", "text"])

    return df.select(col(ident).cast("bigint").alias("ident"), col(ids).cast("array<int>").alias("ids")).mapInArrow(
        run, "ident bigint, text string"
    )
