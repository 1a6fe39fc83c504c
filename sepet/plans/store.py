"""State between runs, on plain Parquet: tables in hash buckets of a key, and per-run outputs in versions.

A run reads and rewrites only the buckets that its keys fall into, by Spark's dynamic partition overwrite. Since that
replaces files in place, a run first writes its new buckets aside; only when all are there it puts them in place. A
run that dies before that changed nothing, one that dies while putting in place is finished from the copy by the next
writer, and a run that is committed is not repeated.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.postings import TABLES as INDEX_TABLES
from ..session import delete_path, folder_names

#: Buckets of a new store; about a gigabyte of the largest table in each is a good choice.
BUCKETS = 16
#: What the buckets of a table go by. Masters lie by block, since that is how they are looked up.
KEYS: Mapping[str, Sequence[str]] = {
    "products": ("source", "external_id"),
    "masters": ("block",),
    "raw_map": ("raw_text",),
    "queue": ("raw_text",),
    "guesses": ("raw_text",),
    **dict.fromkeys(INDEX_TABLES, ("block",)),
}
BUCKET = "bucket"
#: An empty file in a bucket that no key has keeps the columns of a table without rows.
NO_BUCKET = -1
_MARKS = "name string, schema string"


def _dealt(df: DataFrame) -> DataFrame:
    """One file per bucket, more where a bucket is large."""
    return df.hint("rebalance", BUCKET)


class TableStore:
    """Tables named in ``keys`` are kept in buckets, others in one folder per version."""

    def __init__(self, spark: SparkSession, root: str, keys: Mapping[str, Sequence[str]] = KEYS, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = keys
        self._buckets = buckets
        self._stored_buckets: int | None = None

    def version(self) -> int | None:
        """The last committed version: the highest whose row is there."""
        found = [int(n.partition("=")[2]) for n in folder_names(self.spark, f"{self.root}/commits") if n.startswith("version=")]
        for at in sorted(found, reverse=True):
            if any(n.startswith("part-") for n in folder_names(self.spark, f"{self.root}/commits/version={at}")):
                return at
        return None

    def buckets(self) -> int:
        """The number of buckets, which never changes once there is a version."""
        if self._stored_buckets is None:
            at = self.version()
            if at is None:
                return self._buckets
            self._stored_buckets = self.spark.read.parquet(f"{self.root}/commits/version={at}").first()["buckets"]
        return self._stored_buckets

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets())).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """Buckets of a table that the keys of ``rows`` fall into: at most as many numbers as there are buckets."""
        return [r[0] for r in rows.select(self._bucket(name)).distinct().collect()]

    def read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Current state of a table, or the given buckets of it; None before the first commit that has it."""
        at = self.version()
        if at is None or (name in self.keys and name not in folder_names(self.spark, self.root)):
            return None
        if name not in self.keys:
            return self.spark.read.parquet(f"{self.root}/{name}/version={at}")
        whole = self.spark.read.parquet(f"{self.root}/{name}")
        return (whole if buckets is None else whole.filter(F.col(BUCKET).isin(list(buckets)))).drop(BUCKET)

    def begin(self, version: int) -> bool:
        """Whether a run has still to be made. Finishes an earlier one that was interrupted while putting in place."""
        at = self.version()
        for number in sorted(int(name.partition("=")[2]) for name in folder_names(self.spark, f"{self.root}/staged")):
            if at is not None and number <= at:
                delete_path(self.spark, f"{self.root}/staged/version={number}")
            elif tables := self._staged(number):
                self._put_in_place(number, tables)
                at = number
        return at is None or version > at

    def commit(self, version: int, tables: dict[str, DataFrame]) -> None:
        """Make ``tables`` the state: of a table in buckets all rows of each bucket that has any, of another table all.

        A version that is committed already stays. Buckets without rows in ``tables`` are left as they are.
        """
        if not self.begin(version):
            return
        for name, df in tables.items():
            if name not in self.keys:
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        kept = {name: df.withColumn(BUCKET, self._bucket(name)) for name, df in tables.items() if name in self.keys}
        if self.version() is None:
            # Nothing is there that could be lost, but for what a first run left that died.
            for name, df in kept.items():
                delete_path(self.spark, f"{self.root}/{name}")
                self._write(name, df)
            self._seal(version)
            return
        aside = f"{self.root}/staged/version={version}"
        for name, df in kept.items():
            _dealt(df).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{aside}/{name}")
        marks = self.spark.createDataFrame([(name, df.schema.json()) for name, df in kept.items()], _MARKS)
        marks.write.mode("overwrite").parquet(f"{aside}/marks")
        self._put_in_place(version, {name: df.schema for name, df in kept.items()})

    def _staged(self, version: int) -> dict[str, T.StructType]:
        """Tables of a version that lie aside, all of them complete; none where the run died before."""
        path = f"{self.root}/staged/version={version}"
        if "marks" not in folder_names(self.spark, path):
            return {}
        marks = self.spark.read.schema(_MARKS).parquet(f"{path}/marks").collect()
        return {r["name"]: T.StructType.fromJson(json.loads(r["schema"])) for r in marks}

    def _put_in_place(self, version: int, tables: Mapping[str, T.StructType]) -> None:
        aside = f"{self.root}/staged/version={version}"
        for name, schema in tables.items():
            self._write(name, self.spark.read.schema(schema).parquet(f"{aside}/{name}"))
        self._seal(version)
        delete_path(self.spark, aside)

    def _write(self, name: str, df: DataFrame) -> None:
        """Replace the buckets that have rows; a new table gets a file without rows that keeps its columns."""
        target = f"{self.root}/{name}"
        if f"{BUCKET}={NO_BUCKET}" not in folder_names(self.spark, target):
            self.spark.createDataFrame([], df.drop(BUCKET).schema).write.mode("overwrite").parquet(f"{target}/{BUCKET}={NO_BUCKET}")
        new = _dealt(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        new.partitionBy(BUCKET).parquet(target)

    def _seal(self, version: int) -> None:
        done = self.spark.range(1, numPartitions=1).select(F.lit(self.buckets()).cast("int").alias("buckets"))
        done.write.mode("overwrite").parquet(f"{self.root}/commits/version={version}")

    def expire(self, keep: int = 3) -> None:
        """Delete versions older than the last ``keep``, of all tables kept in versions."""
        at = self.version()
        if at is None:
            return
        for name in folder_names(self.spark, self.root):
            for version in folder_names(self.spark, f"{self.root}/{name}"):
                number = version.removeprefix("version=")
                if name != "staged" and number != version and int(number) <= at - keep:
                    delete_path(self.spark, f"{self.root}/{name}/{version}")
