"""The repeating run as a stream over the landing folder.

Each micro-batch is one run of the store, numbered by the batch id, so a batch that is replayed after a failure changes
nothing. It reads and rewrites only the buckets that its keys fall into.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import RUN_PERIOD
from ..operators.maintain import upsert_latest
from ..plans.ingest import ingest_into
from ..plans.store import TableStore
from ..session import settle, settling
from ..sources.feeds import FEED_SCHEMA
from ..sources.layouts import ACTIVE


def feed_stream(spark: SparkSession, landing: str, kind: str = "parquet", files_per_run: int | None = None) -> DataFrame:
    """Feeds as they land."""
    reader = spark.readStream.schema(FEED_SCHEMA).format(kind)
    if files_per_run is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    return reader.load(landing)


def _start(stream: DataFrame, handle, store: TableStore, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{store.root}/progress")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=RUN_PERIOD)).start()


def stream_ingest(
    stream: DataFrame,
    store: TableStore,
    categories: DataFrame,
    keyword_map: DataFrame,
    first_raw_map: DataFrame,
    first_queue: DataFrame,
    sources: Iterable[str] = ACTIVE,
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Run the ingest on every batch of landed feeds: every six hours, or once over what is there."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_into(
            store, batch_id + 1, batch, categories, keyword_map, first_raw_map, first_queue, sources, **options
        )

    return _start(stream, handle, store, once)


def stream_upsert(stream: DataFrame, store: TableStore, once: bool = False) -> StreamingQuery:
    """Merge a stream of listings into the products of a store."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        if not store.begin(version):
            return
        with settling(store.spark):
            listings = settle(batch)
            old = store.read("products", store.touched("products", listings))
            store.commit(version, {"products": upsert_latest(old, listings)})
        store.expire()

    return _start(stream, handle, store, once)
