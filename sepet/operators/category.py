"""Category resolution: keyword map, raw-text map, fuzzy guess with a review band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CATEGORY_ACCEPT, CATEGORY_REVIEW, REJECTED
from ..functions.similarity import token_set_score
from ..functions.text import is_blank, lower_text, tokenize, trim_all
from ..session import settle
from .fuzzy import fuzzy_token_join
from .skew import TASK_ROWS, broadcast_if_small, hot_keys, salted_join

# Resolved texts that are broadcast.
MOST_TEXTS = 100_000


def raw_text(col: Column) -> Column:
    """The form in which raw categories are looked up; null when blank."""
    return F.when(~is_blank(col), lower_text(trim_all(col)))


def keyword_category(df: DataFrame, keyword_map: DataFrame, out: str = "category_id") -> DataFrame:
    """Category that the search term stands for."""
    known = keyword_map.select(F.col("keyword").alias("_keyword"), F.col("category_id").alias(out))
    return df.join(
        broadcast_if_small(known), lower_text(F.col("search_term")) == F.col("_keyword"), "left"
    ).drop("_keyword")


def raw_category_lookup(texts: DataFrame, raw_map: DataFrame) -> DataFrame:
    """Category of each raw text by exact match."""
    return texts.join(raw_map.select("raw_text", "category_id"), "raw_text", "left")


def rejected_anti(texts: DataFrame, queue: DataFrame) -> DataFrame:
    """Raw texts that a reviewer has not rejected."""
    refused = queue.filter(F.col("status") == REJECTED).select("raw_text")
    return texts.join(refused, "raw_text", "left_anti")


def _exploded(df: DataFrame, key: str) -> DataFrame:
    # A set without tokens is found under the empty token; two empty sets score 1.
    return df.select(key, F.explode_outer("tokens").alias("token")).fillna("", ["token"])


def category_best_guess(texts: DataFrame, categories: DataFrame) -> DataFrame:
    """Best scoring category for each distinct raw text; lowest id on ties; score above 0 only.

    Only categories that share an agreeing token can score, so candidates come from a token join
    and not from pairing every text with every category.
    """
    # Written once: it is read three times below.
    asked = settle(texts.select("raw_text").distinct().withColumn("tokens", tokenize(F.col("raw_text"))))
    named = categories.select(F.col("id").alias("category_id"), tokenize(F.col("name")).alias("tokens"))
    asked_tokens, named_tokens = _exploded(asked, "raw_text"), _exploded(named, "category_id")
    pairs = fuzzy_token_join(asked_tokens, named_tokens)
    by_token = pairs.join(named_tokens, pairs["token_b"] == named_tokens["token"]).select(
        F.col("token_a").alias("token"), "category_id"
    ).distinct()
    candidates = asked_tokens.join(by_token, "token").select("raw_text", "category_id").distinct()
    scored = (
        candidates.join(asked, "raw_text")
        .join(
            broadcast_if_small(named.withColumnRenamed("tokens", "_named")),
            "category_id",
        )
        .withColumn("score", token_set_score(F.col("tokens"), F.col("_named"), empty_is_compatible=False))
    )
    return (
        scored.filter(F.col("score") > 0)
        .groupBy("raw_text")
        .agg(
            F.max_by(F.struct("category_id", "score"), F.struct("score", -F.col("category_id"))).alias("best")
        )
        .select("raw_text", "best.category_id", "best.score")
    )


def category_route(
    guesses: DataFrame, accept: float = CATEGORY_ACCEPT, review: float = CATEGORY_REVIEW
) -> DataFrame:
    """Where a guess goes: accept, review or none."""
    return guesses.withColumn(
        "route",
        F.when(F.col("score") >= accept, "accept").when(F.col("score") >= review, "review").otherwise("none"),
    )


def open_texts(texts: DataFrame, raw_map: DataFrame, queue: DataFrame) -> DataFrame:
    """Raw texts that have to be guessed: neither mapped nor rejected."""
    unmapped = texts.select("raw_text").join(raw_map.filter("category_id is not null").select("raw_text"), "raw_text", "left_anti")
    return rejected_anti(unmapped, queue)


def lookup_version(categories: DataFrame) -> str:
    """A text that changes whenever a category or its name does."""
    mark = F.xxhash64("id", "name").cast("decimal(20,0)")
    count, total = categories.agg(F.count(F.lit(1)), F.sum(mark)).first()
    return f"{count}/{total}"


def guess_texts(texts: DataFrame, categories: DataFrame, memo: DataFrame | None = None) -> DataFrame:
    """(raw_text, version, category_id, score) for each of the distinct ``texts``, nulls where no category scores.

    ``memo`` holds what earlier runs found. A text found in it under the version of these categories is not scored again.
    """
    version = lookup_version(categories)
    known = None
    if memo is not None:
        known = memo.filter(F.col("version") == version).join(texts.select("raw_text"), "raw_text", "left_semi")
        texts = texts.select("raw_text").join(known.select("raw_text"), "raw_text", "left_anti")
    guessed = category_best_guess(texts, categories)
    new = texts.join(guessed, "raw_text", "left").select("raw_text", F.lit(version).alias("version"), "category_id", "score")
    return new if known is None else new.unionByName(known)


def resolve_texts(
    texts: DataFrame, categories: DataFrame, raw_map: DataFrame, queue: DataFrame, guesses: DataFrame | None = None
) -> DataFrame:
    """(raw_text, category_id, guess_id, score, route) for each of the distinct ``texts``, which should be settled.

    Routes: mapped, rejected, accept, review, none. ``category_id`` is set for mapped and accept.
    The answer depends on the four tables alone, so one pass over distinct texts gives what
    handling listing after listing gives. ``guesses`` are those of the open texts, where they are at hand.
    """
    if guesses is None:
        guesses = category_best_guess(open_texts(texts, raw_map, queue), categories)
    scored = guesses.filter("category_id is not null").select("raw_text", "category_id", "score")
    guessed = category_route(scored).withColumnRenamed("category_id", "guess_id")
    refused = queue.filter(F.col("status") == REJECTED).select("raw_text", F.lit(True).alias("_refused"))
    return (
        raw_category_lookup(texts.select("raw_text"), raw_map)
        .join(refused.dropDuplicates(["raw_text"]), "raw_text", "left")
        .join(guessed, "raw_text", "left")
        .withColumn(
            "route",
            F.when(F.col("category_id").isNotNull(), "mapped")
            .when(F.col("_refused"), "rejected")
            .otherwise(F.coalesce("route", F.lit("none"))),
        )
        .withColumn(
            "category_id", F.coalesce("category_id", F.when(F.col("route") == "accept", F.col("guess_id")))
        )
        .select("raw_text", "category_id", "guess_id", "score", "route")
    )


def distinct_texts(listings: DataFrame) -> DataFrame:
    return (
        listings.select(raw_text(F.col("source_category")).alias("raw_text"))
        .filter(F.col("raw_text").isNotNull())
        .distinct()
    )


def resolve_category(
    listings: DataFrame, keyword_map: DataFrame, resolved: DataFrame, task_rows: int = TASK_ROWS, most_texts: int = MOST_TEXTS
) -> DataFrame:
    """Add keyword_id, resolved_id and category_id to listings. ``resolved`` should be settled.

    A blank raw category falls back to the keyword; a given one never does. Up to ``most_texts`` resolved texts are
    broadcast. More are joined: a text that very many listings carry is salted by its count, and blank ones get
    keys of their own that match nothing, so that neither meets in one task.
    """
    asked = raw_text(F.col("source_category"))
    answers = resolved.select(F.col("raw_text").alias("_text"), F.col("category_id").alias("resolved_id"))
    told = keyword_category(listings, keyword_map, "keyword_id").withColumn("_blank", asked.isNull())
    if answers.limit(most_texts + 1).count() <= most_texts:
        joined = told.withColumn("_text", asked).join(F.broadcast(answers), "_text", "left")
    else:
        spread = F.concat(F.lit(" "), F.xxhash64("source", "external_id", "title").cast("string"))
        keyed = told.withColumn("_text", F.coalesce(asked, spread))
        hot = hot_keys(keyed.filter(~F.col("_blank")), ["_text"], task_rows)
        joined = salted_join(keyed, answers, ["_text"], "left", task_rows, hot)
    return joined.withColumn(
        "category_id", F.when(F.col("_blank"), F.col("keyword_id")).otherwise(F.col("resolved_id"))
    ).drop("_text", "_blank")


def is_false_positive() -> Column:
    """Raw category given, keyword known, and the two disagree."""
    disagree = F.col("resolved_id") != F.col("keyword_id")
    return F.coalesce(~is_blank(F.col("source_category")) & disagree, F.lit(False))


def false_positive_filter(resolved_listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) listings."""
    return resolved_listings.filter(~is_false_positive()), resolved_listings.filter(is_false_positive())
