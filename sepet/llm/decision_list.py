"""Quality rules as a decision list learned by sequential covering from labelled statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import WORD, col, fresh_name

# Fixed values of the contract; its symbols are #*$%&|<>.
LEAST_WORDS = 50
REPEAT_SHARE = 50

BINS = 16
MAX_RULES = 12
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.9
#: A rule must be right on this many labelled rows of the pruning part at least.
LEAST_COVER = 3


def _repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in the array ``words``."""
    n = F.size(words) - 2
    # Windows are compared by a 64-bit hash inside one text.
    windows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    # The one-element array binds the sorted windows to a name, so that they are computed once.
    covered = F.flatten(
        F.transform(
            F.array(F.sort_array(windows)),
            lambda s: F.flatten(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(s) - 1),
                        lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"]))
                        | (F.get(s, k + 1)["h"] == F.get(s, k)["h"]),
                    ),
                    lambda k: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.get(s, k)["i"] + j),
                )
            ),
        )
    )
    # The two windows that the end cuts short differ from all others, as nulls are hashed too.
    some = F.size(F.array_distinct(hashes)) < F.size(words)
    return F.when(n < 2, 0).when(some, F.size(F.array_distinct(covered))).otherwise(0).cast("bigint")


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the statistics of its texts, all bigint: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, and for the rules n_upper (ASCII capitals), n_distinct (distinct words) and n_lines. Built-in functions inside one row only; null counts as empty, repeated rows
    are rows like others, an empty table gives an empty result. Columns of the same names (case-blind) are replaced."""
    rows = df.drop(*STATISTICS)
    its_words, its_lines, its_text = fresh_name(rows, "_dl_words", "_dl_lines", "_dl_text")
    t = F.col(its_text)
    only = lambda others: F.length(F.regexp_replace(t, others, "")).cast("bigint")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    read = rows.withColumn(its_text, F.coalesce(col(text), F.lit("")))
    read = read.withColumn(its_words, F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn(its_lines, lines)
    words = F.col(its_words)
    return read.select(
        *[col(c) for c in rows.columns],
        F.size(words).cast("bigint").alias("n_words"),
        only(r"[\x20\x09-\x0D]++").alias("word_chars"),
        only(r"[^#*$%&|<>]++").alias("n_symbols"),
        (F.size(its_lines) - F.size(F.array_distinct(its_lines))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        only(r"[^A-Z]++").alias("n_upper"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        F.size(its_lines).cast("bigint").alias("n_lines"),
    )


STATISTICS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_upper n_distinct n_lines".split()
)


def _per(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def rule_features() -> dict[str, Column]:
    """What conditions are about: shares and means, so that long texts are not told by their length alone."""
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _per("word_chars", "n_words"),
        "symbol_share": _per("n_symbols", "word_chars"),
        "dup_line_share": _per("n_dup_lines", "n_lines"),
        "repeat_share": _per("n_repeat_words", "n_words"),
        "upper_share": _per("n_upper", "word_chars"),
        "distinct_share": _per("n_distinct", "n_words"),
        "words_per_line": _per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = rule_features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, cuts: dict[str, list[float]]) -> Column:
    """The rule on binned rows: a bin is the number of thresholds below the value."""
    out = F.lit(True)
    for c in rule:
        at = cuts[c.feature].index(c.threshold)
        out = out & (F.col(c.feature) > at if c.above else F.col(c.feature) <= at)
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the condition with the best FOIL gain until no bad row is mixed with good ones or nothing gains.

    Each step is one aggregation: rows that the rule covers are counted by (feature, bin), so that all
    thresholds of all features come from features x bins counts, however many rows are labelled.
    """
    rule: Rule = ()
    names = list(cuts)
    while len(rule) < MAX_CONDITIONS:
        bins = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(n).alias("b")) for k, n in enumerate(names)]))
        counted = (
            rows.filter(_holds(rule, cuts))
            .select("bad", bins.alias("x"))
            .groupBy("x.f", "x.b")
            .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        ).collect()
        if not counted:
            return rule
        table = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
        for r in counted:
            table[names[r["f"]]][r["b"]] = [r["p"], r["n"]]
        p0, n0 = (sum(x[i] for x in table[names[0]]) for i in (0, 1))
        if p0 == 0 or n0 == 0:
            return rule
        base = math.log2(p0 / (p0 + n0))
        best, gain = None, 1e-9
        for name in names:
            p = n = 0
            for k, cut in enumerate(cuts[name]):
                p, n = p + table[name][k][0], n + table[name][k][1]
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    if pp and nn < n0:
                        g = pp * (math.log2(pp / (pp + nn)) - base)
                        if g > gain:
                            best, gain = Condition(name, above, cut), g
        if best is None:
            return rule
        rule = (*rule, best)
    return rule


def _prune(rows: DataFrame, rule: Rule, cuts: dict[str, list[float]]) -> tuple[Rule, int, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on the pruning rows, with its p and n."""
    steps = [rule[: k + 1] for k in range(len(rule))]
    sums = []
    for k, r in enumerate(steps):
        hit = F.when(_holds(r, cuts), 1).otherwise(0)
        sums += [F.sum(hit * F.col("bad")).alias(f"p{k}"), F.sum(hit * (1 - F.col("bad"))).alias(f"n{k}")]
    found = rows.agg(*sums).first()
    scored = []
    for k, r in enumerate(steps):
        p, n = found[f"p{k}"] or 0, found[f"n{k}"] or 0
        scored.append(((p - n) / (p + n) if p + n else -1.0, -k, r, p, n))
    _, _, r, p, n = max(scored, key=lambda x: x[:2])
    return r, p, n


def learn_rules(labelled: DataFrame, bad: str, key: Column, bins: int = BINS) -> list[Rule]:
    """Rules for bad rows, in order, from all rows of ``labelled`` (statistics and ``bad``, 0 or 1).

    Sequential covering: two thirds of the rows (by ``key``, a hash) grow a rule, the rest prune it. A rule that
    is right on ``LEAST_PRECISION`` of the pruning rows it covers joins the list, and what it covers is taken
    out; the first that is not ends the list. Thresholds are quantiles of the bad rows and of all rows. Rows
    with a null label are left out. No rows, or one class only, give no rules.
    """
    names = rule_features()
    rows = settle(
        labelled.filter(col(bad).isNotNull()).select(
            col(bad).cast("int").alias("bad"), (F.pmod(key, F.lit(3)) == 0).alias("prune"), *[v.alias(k) for k, v in names.items()]
        )
    )
    steps = [k / bins for k in range(1, bins)]
    found = rows.agg(
        *[F.percentile_approx(k, steps, 10_000).alias(k) for k in names],
        *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(k)), [0.0, *steps, 1.0], 10_000).alias(f"{k}_bad") for k in names],
    ).first()
    cuts = {k: sorted({*(found[k] or []), *(found[f"{k}_bad"] or [])}) for k in names}
    below = lambda k: sum((F.when(F.col(k) > c, 1).otherwise(0) for c in cuts[k]), F.lit(0))
    rows = settle(rows.select("bad", "prune", *[below(k).alias(k) for k in names]))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow(rows.filter(~F.col("prune")), cuts)
        if not rule:
            break
        rule, p, n = _prune(rows.filter("prune"), rule, cuts)
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
        rows = rows.filter(~_holds(rule, cuts))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, from 1, or 0 for none."""
    if not rules:
        return F.lit(0)
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise(0)


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with ``base_failed``, ``rule`` (0: none) and ``kept``."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    rows = stats.drop("base_failed", "rule", "kept")
    return rows.select("*", failed.alias("base_failed"), verdict(rules).cast("int").alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


__all__ = ["apply_rules", "learn_rules", "text_statistics", "verdict"]
