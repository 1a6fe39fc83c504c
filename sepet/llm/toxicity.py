"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

A document is judged by its passages: every word, every word without the marks inside it, and every run of single
letters written apart. What counts is the worst of them and how many are bad, in number and in share. The kernel of two passages sums over the subsequences of ``ORDER`` characters that
both contain inside ``SPAN`` characters; gaps and inserted characters cost a factor ``DECAY`` each. The span is
bounded, so subsequences number a fixed set, and the decision of the machine, a sum of kernels with landmarks,
is the same as one weight per subsequence: passages are scored by table look-ups in time linear in their length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import col

ORDER, SPAN, DECAY = 4, 7, 0.6
LANDMARKS = 256
#: Bounds of what is learned from: labelled rows of either class, and passages of either class.
SAMPLE_ROWS = 10_000
SAMPLE_PASSAGES = 4_000
PENALTY = 4.0
#: Grams that tell toxic rows: so many times as frequent there, and unlikely to be so by chance.
GRAM, GRAM_RATIO = 5, 5.0
#: Margins from which passages are counted.
LEVELS = (0.0, 0.5, 1.0)
REMEMBER = 400_000
CUT = 0.7

# Letters a-z, one symbol for digits, one for ASCII marks, some for all other characters, two for the borders.
_LETTERS, _OTHERS = 26, 11
_DIGIT, _MARK, _OTHER = 27, 28, 29
_START, _END = _OTHER + _OTHERS, _OTHER + _OTHERS + 1
ALPHABET = _END + 1
_GAPS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]


def _symbols(passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passages as symbols with borders, ``SPAN`` zeros after each, and where each begins."""
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    begin = np.cumsum(sizes + 2 + SPAN) - (sizes + 2 + SPAN)
    out = np.zeros(int((sizes + 2 + SPAN).sum()), np.int32)
    code = np.frombuffer("".join(passages).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    symbol = np.where(code >= 128, _OTHER + code % _OTHERS, _MARK)
    symbol = np.where((code >= 97) & (code <= 122), code - 96, symbol)
    symbol = np.where((code >= 48) & (code <= 57), _DIGIT, symbol)
    out[np.repeat(begin + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(code))] = symbol
    out[begin], out[begin + sizes + 1] = _START, _END
    return out, begin


def _subsequences(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For every gap pattern: the subsequence that begins at each place (0: none), and its weight."""
    n = len(symbols) - SPAN + 1
    for gaps in _GAPS:
        number, whole = np.zeros(n, np.int32), np.ones(n, bool)
        for g in gaps:
            part = symbols[g : g + n]
            number = number * ALPHABET + part
            whole &= part > 0
        yield np.where(whole, number, 0), DECAY ** (gaps[-1] + 1 - ORDER)


def _norms(passages: list[str]) -> np.ndarray:
    """A positive scale by length: the root of the summed squared weights of all subsequences in a passage."""
    sizes = np.fromiter(map(len, passages), np.int64, len(passages)) + 2
    squares = sum(np.maximum(sizes - g[-1], 0) * DECAY ** (2 * (g[-1] + 1 - ORDER)) for g in _GAPS)
    return np.sqrt(squares + 4.0)  # the addend keeps very short passages small


def explicit(passages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The feature vectors of passages as (row, subsequence, value), scaled."""
    symbols, begin = _symbols(passages)
    rows, numbers, values = [], [], []
    norm = _norms(passages)
    for number, weight in _subsequences(symbols):
        at = np.flatnonzero(number)
        row = np.searchsorted(begin, at, "right") - 1
        rows.append(row)
        numbers.append(number[at].astype(np.int64))
        values.append(weight / norm[row])
    return tuple(np.concatenate(x) for x in (rows, numbers, values))


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The matrix of kernels of two lists of passages."""
    rows, numbers, values = explicit(right)
    known, column = np.unique(numbers, return_inverse=True)
    table = np.zeros((len(known), len(right)))
    np.add.at(table, (column, rows), values)
    out = np.zeros((len(left), len(right)))
    for base in range(0, len(left), 500):
        rows, numbers, values = explicit(left[base : base + 500])
        at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
        hit = known[at] == numbers if len(known) else np.zeros(len(at), bool)
        dense = np.zeros((len(left[base : base + 500]), len(known)))
        np.add.at(dense, (rows[hit], at[hit]), values[hit])
        out[base : base + 500] = dense @ table
    return out


@dataclass
class Machine:
    """Weights per subsequence, the offset, and the logistic weights of a document's ``evidence``."""

    numbers: np.ndarray
    weights: np.ndarray
    offset: float
    logistic: np.ndarray | None = None

    def table(self) -> np.ndarray:
        out = np.zeros(ALPHABET**ORDER, np.float32)
        out[self.numbers] = self.weights
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.logistic is None:
            return 1.0 / (1.0 + np.exp(-np.clip(evidence[:, 0], -50, 50)))
        return 1.0 / (1.0 + np.exp(-np.clip(evidence @ self.logistic[:-1] + self.logistic[-1], -50, 50)))


def margins(passages: list[str], table: np.ndarray, offset: float) -> np.ndarray:
    """Decision values of passages."""
    if not passages:
        return np.zeros(0)
    symbols, begin = _symbols(passages)
    total = np.zeros(len(symbols), np.float32)
    for number, weight in _subsequences(symbols):
        total[: len(number)] += np.float32(weight) * table[number]
    return np.add.reduceat(total.astype(np.float64), begin) / _norms(passages) + offset


def train(toxic: list[str], clean: list[str]) -> Machine:
    """Squared-hinge support vector machine on the Nystroem features of passages, by Newton steps.

    Toxic passages come most frequent first; landmarks are spread over both lists."""
    x = [*toxic, *clean]
    y = np.concatenate((np.ones(len(toxic)), -np.ones(len(clean))))
    half = LANDMARKS // 2
    spread = lambda many, n: [many[k] for k in np.unique(np.linspace(0, len(many) - 1, min(n, len(many))).astype(int))]
    landmarks = [*spread(toxic, half), *spread(clean, half)]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.column_stack((kernel(x, landmarks) @ root, np.ones(len(x))))
    cost = PENALTY * np.where(y > 0, len(y) / (2 * len(toxic)), len(y) / (2 * len(clean)))
    ridge = np.ones(z.shape[1])
    ridge[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(50):
        short = y * (z @ w) < 1
        zs = z[short] * cost[short, None]
        new = np.linalg.solve(np.diag(ridge) + zs.T @ z[short], zs.T @ y[short])
        if np.array_equal(y * (z @ new) < 1, short):
            w = new
            break
        w = new
    share = root @ w[:-1]
    rows, numbers, values = explicit(landmarks)
    known, at = np.unique(numbers, return_inverse=True)
    return Machine(known, np.bincount(at, values * share[rows], len(known)), float(w[-1]))


def _squeezed(word: str) -> str:
    return "".join([c for c in word if c.isalnum()])


class Judge:
    """Largest margin of the passages of texts. Words are scored once while they are remembered."""

    def __init__(self, machine: Machine):
        self.table, self.offset = machine.table(), machine.offset
        self.at: dict[str, int] = {}
        self.value = np.zeros(0)

    def learn(self, words: Iterable[str]) -> None:
        if len(self.at) > REMEMBER:
            self.at, self.value = {}, np.zeros(0)
        new = list(set(words).difference(self.at))
        found = []
        for base in range(0, len(new), 20_000):
            part = new[base : base + 20_000]
            value = margins(part, self.table, self.offset)
            bare = [(k, s) for k, w in enumerate(part) if not w.isalnum() and len(s := _squeezed(w)) < len(w)]
            if bare:
                rows = np.array([k for k, _ in bare])
                value[rows] = np.maximum(value[rows], margins([s for _, s in bare], self.table, self.offset))
            found.append(value)
        if found:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.value = np.concatenate((self.value, *found))

    def evidence(self, words: list[str]) -> tuple[list[float], str | None]:
        """Largest margin, numbers and shares of passages above each level (logarithms); the worst passage."""
        if not words:
            return [-1.0] + [0.0] * (2 * len(LEVELS)), None
        value = self.value[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]
        k = int(value.argmax())
        out = [float(value[k])]
        for level in LEVELS:
            n = int((value > level).sum()) if out[0] > level else 0
            out += [math.log1p(n), math.log1p(1000 * n / len(words))]
        return out, words[k]


def passages(text: str | None) -> list[str]:
    """Words of a text in lower case, and runs of three or more single characters written apart."""
    words = (text or "").lower().split()
    size = np.fromiter(map(len, words), np.int64, len(words))
    one = np.concatenate(([False], size == 1, [False]))
    turn = np.flatnonzero(one[1:] != one[:-1])
    return words + ["".join(words[a:b]) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True) if b - a >= 3]


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w] if len(w) <= GRAM else [w[k : k + GRAM] for k in range(len(w) - GRAM + 1)]


def _texts(batches: Iterator[pa.RecordBatch], k: int = 0) -> Iterator[tuple[pa.RecordBatch, int, list[str | None]]]:
    """Texts of batches in bounded lots: (batch, first row, texts)."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, size = [], 0
            while at + len(texts) < batch.num_rows and size < 4_000_000 and len(texts) < 1_000:
                texts.append(batch.column(k)[at + len(texts)].as_py())
                size += len(texts[-1] or "")
            yield batch, at, texts
            at += len(texts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, at, texts in _texts(batches):
        count: list[Counter] = [Counter(), Counter()]
        for toxic, text in zip(batch.column(1).slice(at, len(texts)).to_pylist(), texts, strict=True):
            count[toxic].update({g for w in set(passages(text)) for g in _grams(w)})
        rows = [(g, count[1][g], count[0][g]) for g in {*count[0], *count[1]}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["gram", "toxic", "clean"])


def _pick_words(telling: set[str]):
    """Words of toxic rows with a telling gram, and words of clean rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, texts in _texts(batches):
            words: list[set[str]] = [set(), set()]
            for toxic, text in zip(batch.column(1).slice(at, len(texts)).to_pylist(), texts, strict=True):
                words[toxic].update(passages(text))
            found = [w for w in words[1] if not telling.isdisjoint(_grams(w))]
            both = [*found, *words[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([1] * len(found) + [0] * len(words[0]), pa.int32())], ["word", "toxic"]
            )

    return run


def _score(machine: Machine, names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(machine)
        for batch, at, texts in _texts(batches):
            split = [passages(t) for t in texts]
            judge.learn(w for words in split for w in words)
            found = [judge.evidence(words) for words in split]
            evidence = np.array([e for e, _ in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(at, len(texts)),
                    pa.array([e for e, _ in found], pa.list_(pa.float64())),
                    pa.array(machine.probability(evidence)),
                    pa.array([w for _, w in found], pa.string()),
                ],
                [names, "evidence", "score", "passage"],
            )

    return run


def _calibrate(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights, the constant last, with targets drawn in by the class sizes, by Newton steps."""
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    target = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.column_stack((evidence, np.ones(len(evidence))))
    ridge = np.full(x.shape[1], 0.05)
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn_toxicity(rows: DataFrame, text: str, toxic: str, key: str) -> Machine | None:
    """A machine from labelled rows; None where a class is missing or nothing tells toxic rows.

    At most ``SAMPLE_ROWS`` rows of either class are read, chosen by the hash of ``key``; rows with a null label
    are left out and equal texts count once. A toxic row does not say which of its passages is toxic: grams of
    ``GRAM`` characters far more frequent in toxic rows mark them. The first machine learns from those against
    words of clean rows; the second also from the clean words that the first judged worst.
    """
    sample = rows.filter(col(toxic).isin(0, 1)).select(col(text).cast("string").alias("t"), col(toxic).cast("int").alias("y"), F.xxhash64(col(key)).alias("h"))
    sample = settle(sample.groupBy(F.md5("t").alias("m")).agg(F.first("t").alias("t"), F.max("y").alias("y"), F.min("h").alias("h")).select("t", "y", "h"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    pairs = sample.select("t", "y")
    counted = settle(
        pairs.mapInArrow(_count_grams, "gram string, toxic bigint, clean bigint").groupBy("gram").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("n"))
    )
    kinds = counted.filter("p + n >= 2").count()
    ratio = (F.col("p") / F.lit(n1)) / ((F.col("n") + 0.5) / F.lit(n0))
    sure = F.col("p") * F.log(ratio) >= 1.5 * math.log(20 * max(2, kinds))
    telling = counted.filter((ratio >= GRAM_RATIO) & sure).orderBy(F.desc("p"), "gram").limit(SAMPLE_PASSAGES)
    telling = {r["gram"] for r in telling.select("gram").collect()}
    if not telling:
        return None
    words = settle(
        pairs.mapInArrow(_pick_words(telling), "word string, toxic int")
        .groupBy("word")
        .agg(F.min("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows"))
    )
    some = lambda df, *order: [r["word"] for r in df.orderBy(*order, F.xxhash64("word"), "word").limit(SAMPLE_PASSAGES).collect()]
    bad, good = some(words.filter("toxic = 1"), F.desc("rows")), some(words.filter("toxic = 0"))
    if not bad or not good:
        return None
    first = train(bad, good)
    single = words.filter("toxic = 0").select("word", F.col("word").alias("key")).mapInArrow(
        _score(first, "key"), "key string, evidence array<double>, score double, passage string"
    )
    hard = [r["key"] for r in single.orderBy(F.desc(F.get("evidence", 0)), "key").limit(SAMPLE_PASSAGES).select("key").collect()]
    machine = train(bad, sorted({*good, *hard}))
    judged = pairs.mapInArrow(_score(machine, "y"), "y int, evidence array<double>, score double, passage string").select("y", "evidence").toArrow()
    machine.logistic = _calibrate(np.array(judged.column("evidence").to_pylist()), judged.column("y").to_numpy())
    return machine


def sample_labels(labels: DataFrame, ident: str, toxic: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(ident, toxic) of at most ``rows`` rows of either class, by the hash of ident: small enough to broadcast."""
    known = labels.filter(col(toxic).isin(0, 1) & col(ident).isNotNull()).groupBy(col(ident).alias("ident")).agg(F.max(col(toxic)).cast("int").alias("toxic"))
    part = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("ident"), "ident").limit(rows)
    return settle(part(1).unionByName(part(0)))


def score_toxicity(df: DataFrame, text: str, ident: str, machine: Machine | None) -> DataFrame:
    """(ident, evidence, score, passage) for every row of ``df``: the probability of label 1, and the worst passage.

    Whole texts are read in bounded lots. Texts without words have no passage and the least evidence. Without a
    machine every score is 0.
    """
    rows = df.select(col(text).cast("string").alias("t"), col(ident).cast("bigint").alias("ident"))
    if machine is None:
        return rows.select("ident", F.array(F.lit(-1.0)).alias("evidence"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("passage"))
    return rows.mapInArrow(_score(machine, "ident"), "ident bigint, evidence array<double>, score double, passage string")
