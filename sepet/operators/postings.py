"""A token index of stored masters: new listings are matched by reading the entries of their own tokens.

Three tables, all by block: ``index_blocks`` has the oldest master of a block, the oldest without tokens, and how many there
are; ``index_tokens`` how many have a token; ``index_postings`` the masters under each of their tokens and each pair of
them, with all that a score needs. Masters are only ever added, so a run adds what its new masters bring.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MATCH_THRESHOLD
from ..functions.similarity import token_set_score
from ..session import settle
from .match import SHAPE, _tokens, best_records, candidates_among, file_leaders, parse_titles, with_best_master
from .skew import TASK_ROWS, broadcast_if_small

BLOCKS, TOKENS, POSTINGS = "index_blocks", "index_tokens", "index_postings"
TABLES = (BLOCKS, TOKENS, POSTINGS)
#: Tokens of a key in the index; a third would make it several times as large.
WIDTH = 2


def index_masters(masters: DataFrame) -> dict[str, DataFrame]:
    """The index of prepared masters (block, sig, ord, master_key)."""
    at = F.struct("ord", F.col("master_key").alias("key")).alias("at")
    given = masters.select("block", F.col("sig").alias("l_sig"), at)
    blocks = given.groupBy("block").agg(
        F.min("at").alias("head"), F.min(F.when(F.col("l_sig") == "", F.col("at"))).alias("blank"), F.count_if(F.col("l_sig") != "").alias("n_leaders")
    )
    held = given.filter("l_sig <> ''").withColumn("l_tokens", F.array_sort(_tokens(F.col("l_sig"))))
    held = held.withColumn("l_n", F.size("l_tokens"))
    tokens = held.select("block", F.explode("l_tokens").alias("token_b")).groupBy("block", "token_b").agg(F.count(F.lit(1)).alias("posts"))
    postings = reduce(DataFrame.unionByName, [file_leaders(held, k) for k in range(1, WIDTH + 1)])
    return {BLOCKS: blocks, TOKENS: tokens, POSTINGS: postings.select("block", "key", "l_n", "l_sig", "at")}


def merge_index(old: dict[str, DataFrame | None], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The index of two sets of masters that share none."""
    if any(old[name] is None for name in TABLES):
        return new
    blocks, tokens, postings = (old[name].unionByName(new[name]) for name in TABLES)
    return {
        BLOCKS: blocks.groupBy("block").agg(F.min("head").alias("head"), F.min("blank").alias("blank"), F.sum("n_leaders").alias("n_leaders")),
        TOKENS: tokens.groupBy("block", "token_b").agg(F.sum("posts").alias("posts")),
        # In the order of look-ups, so that readers skip what lies between.
        POSTINGS: postings.sortWithinPartitions("block", "key"),
    }


def best_match_indexed(
    listings: DataFrame, index: dict[str, DataFrame], threshold: float = MATCH_THRESHOLD, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Best stored master of each prepared listing and its score, as ``best_match`` gives them, out of the index alone.

    No stored title or token set is read but those that share a looked-up key with a listing's.
    """
    titles = settle(parse_titles(listings))
    blocks = index[BLOCKS]
    asked = settle(titles.filter("size_ok").select(*SHAPE).distinct().join(blocks, "block"))
    touched = broadcast_if_small(settle(asked.select("block").distinct()))
    tokens, postings = (index[name].join(touched, "block", "left_semi") for name in (TOKENS, POSTINGS))

    def filed(k: int, wanted: DataFrame) -> DataFrame:
        return postings.filter(F.size("key") == k).join(broadcast_if_small(wanted), ["block", "l_n"], "left_semi")

    sizes = blocks.select("block", "n_leaders").join(touched, "block", "left_semi")
    found = candidates_among(asked, tokens, sizes, filed, threshold, WIDTH)
    one = F.lit(1.0).alias("score")
    # Nothing scores above a set without tokens on either side.
    by_blank = asked.filter("sig <> '' and blank is not null").select(*SHAPE, one, F.col("blank").alias("at"))
    blanks = asked.filter("sig = ''").select(*SHAPE, one, F.col("head").alias("at"))
    scored = by_blank.unionByName(blanks)
    if found is not None:
        pairs = found.select(*SHAPE, "l_sig", "at").groupBy(*SHAPE, "l_sig").agg(F.min("at").alias("at"))
        score = token_set_score(_tokens(F.col("l_sig")), _tokens(F.col("sig")), True)
        by_shape = pairs.withColumn("score", score).filter(F.col("score") >= threshold)
        scored = scored.unionByName(by_shape.select(*SHAPE, "score", "at"))
    return with_best_master(listings, titles, best_records(scored), task_rows)
