"""Keeping the store up to date from a folder that pages land in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexfit.schemas import PAGE
from lexfit.sources.store import append_batch


def follow_pages(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    to_records: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Take in every landed file once and add its new keys to the store.

    Each micro-batch goes through ``to_records`` (a narrow projection), keeps the first
    row per key, drops keys of earlier batches and writes its own folder. The stream's
    checkpoint fixes which files form a batch, the folder is replaced as a whole, so a
    replayed batch changes nothing. Returns the query; it ends when all is read.
    """
    pages = (
        spark.readStream.schema(PAGE)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
    )

    def add(batch: DataFrame, batch_no: int) -> None:
        append_batch(batch.sparkSession, store, to_records(batch), batch_no)

    return (
        pages.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
