"""New and changed files of a folder, by a stream that remembers what it has seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import extension


def run_new_files(spark: SparkSession, folder: str, checkpoint: str, work: Callable[[DataFrame], None], extensions: tuple[str, ...]) -> int:
    """Hand all files not seen before to work, as (path, length, modificationTime, content); the number of batches.

    The checkpoint holds what was seen, so a run that was broken off goes on where it stood;
    work may see a batch again after a failure and has to bear that."""
    from pyspark.sql import functions as F

    seen = []

    def batch(rows: DataFrame, number: int) -> None:
        work(rows.where(extension(F.col("path")).isin(*extensions)))
        seen.append(number)

    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(seen)
