"""Streaming ingest: new and changed files become chunks, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as file_sources
from ..sources.store import Store

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(
    spark: SparkSession,
    folder: str,
    repo: str,
    *,
    files_per_batch: int = 1000,
    extensions: tuple[str, ...] | None = None,
) -> DataFrame:
    """repo, path (below the folder), text and error of files as they appear in a folder and in those below it."""
    found = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", files_per_batch
    ).load(folder)
    path = file_sources.below(F.col("path"), folder)
    text, error = file_sources.decoded(F.col("content"))
    if extensions:
        found = found.where(file_sources.kept_path(path, extensions, file_sources.PRUNED))
    return found.select(
        F.lit(repo).alias("repo"), path.alias("path"), text.alias("text"), error.alias("error"), "modificationTime"
    )


def ingest(files: DataFrame, store: Store, checkpoint: str, *, once: bool = False):
    """Chunk a stream of files into the store. A batch that runs again writes the same rows under the same keys.

    Of a file that comes twice in a batch the latest version counts; what a shorter version has lost goes.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("repo", "path").agg(F.max_by(F.struct("text", "error"), "modificationTime").alias("x"))
        store.put_files(latest.select("repo", "path", "x.text", "x.error"))

    writer = files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
