"""Corpus cleaning as a chain of stages over ``documents``; each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sepet.llm.common import col, fresh_name, star_components, word_count
from sepet.llm.decision_list import STATISTICS, apply_rules, learn_rules, text_statistics
from sepet.llm.line_dedup import drop_boilerplate_lines
from sepet.llm.mixing import mix_sources
from sepet.llm.near_sets import SHINGLE, near_copies
from sepet.llm.pieces import encode_pieces
from sepet.llm.simhash import near_duplicates
from sepet.session import bound_batches, settle

#: A line on more than this share of a source's documents is boilerplate, on this many of them at least.
LINE_RATIO, LINE_DOCUMENTS = 0.1, 5
#: Whole texts that Python gets at once.
BATCH_TEXTS = 1_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule rejects. Rules come from those documents that have a quality label. Null and empty
    texts have no words and go; repeated rows are judged each by itself; without labels, or documents, nothing is learned
    and the base rule alone decides."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null and doc_id is not null")
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg((1 - F.min("quality")).alias("_bad"))
    judged = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    # Written once, and read for learning and for judging.
    measured = settle(text_statistics(judged, "_text").drop("_text"))
    known = measured.select(F.col("_doc.doc_id").alias("_id"), *STATISTICS).join(F.broadcast(marks) if _few(marks) else marks, "_id")
    rules = learn_rules(known, "_bad", F.crc32(F.col("_id").cast("string")))
    kept = apply_rules(measured, rules).filter("kept")
    return kept.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def _few(df: DataFrame, most: int = 1_000_000) -> bool:
    return df.limit(most + 1).count() <= most


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate in their source. Null texts stay null, documents that lose all lines
    stay with an empty text, null sources are one source, repeated rows count each; no documents give none."""
    kept, lines, dropped = fresh_name(docs, "_kept", "_lines", "_dropped")
    found = drop_boilerplate_lines(docs, "source", "text", LINE_RATIO, LINE_DOCUMENTS, kept=kept, n_lines=lines, n_dropped=dropped)
    new = {"text": F.col(kept), "n_chars": F.length(kept).cast("bigint")}
    changed = F.col(dropped) > 0
    return found.select(*[F.when(changed, new[c]).otherwise(col(c)).alias(c) if c in new else col(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Two documents are linked if the SimHash
    fingerprints of their five-word shingles, repeats included, differ in three bits or fewer, or if the Jaccard similarity of
    their sets of these is 0.8 or more, which fingerprints mostly miss below 0.95; links count over any number of steps. Rows
    that share a doc_id are one document, of which each different text stays once; those without one stay, each by itself. No
    documents give none."""
    bound_batches(spark, BATCH_TEXTS)
    digest, gone = fresh_name(docs, "_digest", "_gone")
    prints = near_duplicates(docs, "text", "doc_id", SHINGLE).filter("ident is not null")
    links = settle(prints.select(F.col("ident").alias("a"), F.col("component").alias("b")).filter("a <> b"))
    links = links.unionByName(near_copies(docs, "text", "doc_id").select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = star_components(links).filter("node <> component").select(F.col("node").alias(gone))
    named = docs.filter("doc_id is not null")
    kept = named.join(found.hint("shuffle_hash"), F.col("doc_id") == F.col(gone), "left_anti")
    once = kept.withColumn(digest, F.md5(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates(["doc_id", digest]).drop(digest)
    return once.unionByName(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per epoch. A document that a budget cuts carries in that epoch just
    the words that the budget still has room for. Documents without words are taken by no budget; rows that tie in
    doc_id and size are interchangeable; null sources are one source; no documents give none."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    whole = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("_doc"), "doc_id", "source", word_count(F.col("text")).alias("_size")
    )
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("_n")))
    mixed = mix_sources(whole, "source", "_size", key, sizes=sizes, sizes_column="_n").filter("taken > 0")
    epochs = F.explode(F.sequence(F.lit(0), F.expr("cast((taken - 1) div _size as int)")))
    taken = mixed.select("_doc", "_size", "taken", epochs.alias("_epoch"))
    room = F.least(F.col("_size"), F.col("taken") - F.col("_epoch") * F.col("_size"))
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, 1, room.cast("int")), "")
    new = {"text": part, "n_chars": F.length(part).cast("bigint")}
    old = {c: F.col("_doc")[c] for c in docs.columns}
    return taken.select(*[(F.when(room < F.col("_size"), new[c]).otherwise(old[c]) if c in new else old[c]).alias(c) for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document of the mix, repeated ones each. Null and empty texts have none; no documents give none."""
    bound_batches(spark, BATCH_TEXTS)
    return encode_pieces(docs, "text", "doc_id").select(F.col("ident").alias("doc_id"), "ids", "score", "losses", "restored")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mix),
    ("pieces", pieces),
]

#: SQL can express neither the learned rules nor fingerprints nor pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
