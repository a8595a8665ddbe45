"""Index refresh as a stream: files arrive, each micro-batch goes through the batch operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.incremental import apply_changes
from lodestone.operators.chunking import chunk_files
from lodestone.sources.scan import accepted

FILE_SCHEMA = "file_path string, language string, size_bytes bigint, mtime_ms bigint, text string, deleted boolean"


def read_file_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of file versions ``FILE_SCHEMA`` from Parquet files that land in a folder."""
    return spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_versions(batch: DataFrame) -> DataFrame:
    """The newest row of each file; a null time is the oldest, and of equal times a deletion wins."""
    order = Window.partitionBy("file_path").orderBy(F.desc_nulls_last("mtime_ms"), F.coalesce("deleted", F.lit(False)).desc(), F.desc_nulls_last("size_bytes"), F.desc_nulls_last("text"))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def refresh(events: DataFrame, checkpoint: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], content: Sequence[str] | None = None) -> StreamingQuery:
    """Apply each micro-batch of file events to the chunks.

    ``read()`` gives the chunks as they are, ``write(chunks, batch_id)`` stores
    the new ones under the batch's number, so that a batch that is repeated after
    a failure is written to the same place. Of several versions of a file in one
    batch the latest counts; events marked deleted remove the file. With ``content``
    (kinds of files) the filters of the scan hold here too: a file that no longer
    passes them goes.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        now = latest_versions(batch)
        there = now.where("not coalesce(deleted, false)")
        fresh = chunk_files(there if content is None else accepted(there, content))
        columns = [c for c in read().columns if c != "chunk_id"]
        write(apply_changes(read(), now.select("file_path"), fresh.select(*columns)), batch_id)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
