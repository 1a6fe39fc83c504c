"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for laptops, tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("sepet")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and state.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a new local
    folder is made and set if all executors run on this machine inside the driver; on a cluster that
    would lose rows without an error, so there the setting must be given.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="sepet-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int) -> None:
    """Hand Python at most ``rows`` rows at once from now on; a smaller setting of the session's stays.

    Spark counts rows, not bytes: 10,000 whole texts, its default, are held by the executor and by the Python worker alike.
    Results do not depend on it. It stays set, since what a stage returns is computed later.
    """
    now = int(spark.conf.get(BATCH_CONF))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH_CONF, str(rows))


SPLIT_CONF = "spark.sql.files.maxPartitionBytes"


def bound_splits(spark: SparkSession, most: int) -> None:
    """Read files in splits of at most ``most`` bytes from now on; a smaller setting of the session's stays.

    Narrow tables pack so well that a split of Spark's default holds millions of rows, which an aggregation of texts or structs
    sorts in its task before the shuffle, and spills. Results do not depend on it. It stays set, since what is returned is
    computed later.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(SPLIT_CONF))
    if now > most:
        spark.conf.set(SPLIT_CONF, str(most))


_SCOPE: ContextVar[str | None] = ContextVar("settled tables", default=None)


@contextmanager
def settling(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at the end; what is made of them must be written before that."""
    folder = new_shared_path(spark, "run")
    before = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where there is no such folder."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(jvm_path)) if files.exists(jvm_path) else []


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: written to the shared folder and read back.

    A table rather than a checkpoint: readers prune columns, and its size is known, so Spark
    broadcasts it only when it is small.
    """
    scope = _SCOPE.get()
    path = f"{scope}/{uuid.uuid4().hex}" if scope else new_shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_partitions(df: DataFrame) -> DataFrame:
    """Like ``settle`` where partitions and the order inside them must stay: a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
