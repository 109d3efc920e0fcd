"""The document sink as a stream: each row is one update, the latest per key wins, an older one never does."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..sources.versioned import KeyedTable


def stream_source(spark: SparkSession, table: DataFrame, name: str, per_trigger: int | None = None) -> DataFrame:
    """The files of a stored table as a stream. A table may be one file beside others; a stream reads a folder, so such a file is chosen by ``name``."""
    folder, file = table.inputFiles()[0].rsplit("/", 1)
    reader = spark.readStream.schema(table.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", name) if file == name else reader).parquet(folder)


def drain(updates: DataFrame, table: KeyedTable, checkpoint: str, now: datetime, keep: int | None = None) -> DataFrame | None:
    """Merges what is there (availableNow) and returns the table; None if it never got a row. Of its versions the last ``keep`` stay, all without it.

    The table compares each update with the row that it holds, so the stream itself keeps no
    state, and documents need never expire. A batch becomes one commit that names
    its epoch: after a restart the table goes on from its last commit, and a batch that is
    repeated, since its commit came but the checkpoint's did not, is passed over.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        table.merge(batch, now, checkpoint, epoch)

    query = updates.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    if keep and table.log.latest():
        table.log.expire(keep)
    return table.read()
