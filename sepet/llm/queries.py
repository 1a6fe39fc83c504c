"""The operators applied to whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import word_count
from .decision_list import apply_rules, learn_rules, text_statistics
from .hard_negatives import mine_negatives
from .hilbert import SHARDS, curve_shards
from .lexical import search_items
from .license_scan import scan_licenses
from .line_dedup import drop_boilerplate_lines, html_lines, url_host
from .mixing import mix_sources
from .pieces import encode_pieces
from .pitman_yor import score_texts
from .rp_forest import link_vectors
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .toxicity import CUT, learn_toxicity, sample_labels, score_toxicity

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of all pages, by host of the url."""
    pages = table(spark, sf_dir, "pages")
    texts = settle(pages.select("page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")))
    return drop_boilerplate_lines(texts, "host", "text").select(
        "page_id", "host", "n_lines", "n_dropped", F.md5("kept_text").alias("kept_md5")
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; the rules come from all documents with a quality label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = settle(text_statistics(docs.select("doc_id", "text"), "text").drop("text"))
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.join(marks, "doc_id").withColumn("bad", 1 - F.col("quality"))
    rules = learn_rules(labelled, "bad", F.crc32(F.col("doc_id").cast("string")))
    return apply_rules(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    docs = table(spark, sf_dir, "documents")
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return mix_sources(sized, "source", "size", key).select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by fingerprint."""
    found = near_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")
    return found.select(
        F.col("ident").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, its n best segmentations (as changes to the best) with their losses, and whether decoding each
    restores the text."""
    return encode_pieces(table(spark, sf_dir, "documents"), "text", "doc_id").select(
        F.col("ident").alias("doc_id"), "ids", "score", "losses", "restored", "changes"
    )


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"), "text", "doc_id").select(
        F.col("ident").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat in strings of 200 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), "text", "doc_id").select(
        F.col("ident").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings."""
    found = link_vectors(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return found.select(
        F.col("ident").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("ident").eqNullSafe(F.col("component")).alias("kept"),
    )


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of two thirds of the ids are learned from, the rest are held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    third = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 3
    known = sample_labels(labels.filter(third(F.col("doc_id")) != 1), "doc_id", "toxic")
    machine = learn_toxicity(docs.join(F.broadcast(known), F.col("doc_id") == F.col("ident")), "text", "toxic", "ident")
    scored = score_toxicity(docs, "text", "doc_id", machine)
    return scored.select(
        F.col("ident").alias("doc_id"),
        (third(F.col("ident")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "passage",
    )


@query
def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; six sevenths of the ids are learned from, the rest are held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), "text", "doc_id", held).select(
        F.col("ident").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of equal bytes along a Hilbert curve over source, language and size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = curve_shards(settle(light), ["source", "lang", "size"], F.col("size"), ["text_crc32", "doc_id"], SHARDS)
    return placed.select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search_items(docs, "text", "doc_id", items, "text", "item_id").select(
        F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score"
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding and its positives; a seventh of the labels is changed."""
    vectors, one = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(one % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors, "embedding", label, "vec_id", one % 100 == 0).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("negative").alias("negative_id"),
        "positive_score",
        "negative_score",
    )
