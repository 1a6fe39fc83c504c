"""Products and masters stored side by side in buckets of their join key, so that offers are read without a shuffle."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_shared_path, settle
from .skew import TASK_ROWS, broadcast_if_small

#: Tells apart the parts of a master with very many listings.
SALT = "_salt"
#: Products that a bucket holds about at most.
BUCKET_ROWS = TASK_ROWS // 2


def offer_keys(masters: DataFrame, products: DataFrame) -> list[str]:
    """What masters and products are joined on: the master, and its part where both are stored in buckets."""
    both = SALT in masters.columns and SALT in products.columns
    return ["master_key", SALT] if both else ["master_key"]


def _saved(df: DataFrame, label: str, buckets: int) -> DataFrame:
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    # Sorted and dealt as the buckets are, so that a bucket is one file and needs no sort when it is read.
    dealt = df.repartition(buckets, "master_key", SALT).sortWithinPartitions("master_key", SALT)
    writer = dealt.write.option("path", new_shared_path(spark, label)).bucketBy(buckets, "master_key", SALT)
    writer.sortBy("master_key", SALT).saveAsTable(name)
    return spark.table(name)


def save_in_buckets(
    masters: DataFrame, products: DataFrame, buckets: int, task_rows: int = TASK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(masters, products) as tables bucketed by master. Products without a master are left out.

    Listings of a master that has more than ``task_rows`` are dealt to several parts, which fall into buckets of their own; the
    master stands once for each part. Any join of the two on ``offer_keys`` has no exchange, and no task more than one
    bucket, a part of a hot master included. ``buckets`` is their least number; there are as many more as leave about
    ``BUCKET_ROWS`` products in each.
    """
    linked = products.filter(F.col("master_key").isNotNull())
    counts = settle(linked.groupBy("master_key").agg(F.count(F.lit(1)).alias("_n")))
    buckets = max(buckets, math.ceil((counts.agg(F.sum("_n")).first()[0] or 0) / BUCKET_ROWS))
    hot = counts.filter(F.col("_n") > task_rows).select("master_key", F.ceil(F.col("_n") / task_rows).cast("int").alias("_salts"))
    hot = broadcast_if_small(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    part = F.pmod(F.xxhash64("source", "external_id"), salts.cast("bigint")).cast("int")
    dealt = linked.join(hot, "master_key", "left").withColumn(SALT, part).drop("_salts")
    repeated = masters.join(hot, "master_key", "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return _saved(repeated, "masters", buckets), _saved(dealt, "products", buckets)
