"""Incremental indexing as a stream: each batch of changed files goes through the same difference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mosslight.functions.text import fingerprint
from mosslight.operators import incremental

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_changes(spark: SparkSession, folder: str, stored: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, glob: str = "*.md") -> StreamingQuery:
    """Watch ``folder`` and give ``apply`` the changes and files of every batch.

    ``stored`` returns the documents as they are now; a batch never removes documents, as files
    it doesn't name may well exist. Batches are applied once each in order; ``apply`` gets the
    batch's number, by which a repeated one can be told.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def on_batch(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct("modificationTime", "content"), "modificationTime").alias("x"))
        rows = latest.select("path", F.col("x.modificationTime").cast("double").alias("mtime"), fingerprint(F.col("x.content")).alias("content_hash"))
        known = stored().select("path", "mtime", "content_hash").join(rows.select("path"), "path", "left_semi")
        apply(incremental.diff(known, rows), latest.select("path", "x.content"), number)

    return files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
