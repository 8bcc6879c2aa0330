"""Structured Streaming over a folder of segment files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def apply_to_new_media(spark: SparkSession, source: str, schema: str, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Run operator on each batch of new Parquet files in source and append its rows, with the batch's number, to target.

    A file must hold whole media items, since operators work within one.  A batch that runs again after a failure overwrites its own
    folder, so no row is written twice.  Returns the running query, which ends when all files that are there have been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
