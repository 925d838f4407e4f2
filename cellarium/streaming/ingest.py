"""Packages that arrive, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellarium.sources.datasource import file_entries, register
from cellarium.sources.packages import entries


def ingest_packages(arriving: DataFrame, out: str, checkpoint: str) -> None:
    """Append the members of every package of a stream (path, content) that is new to the table at out; each is read once."""
    query = entries(arriving).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def ingest_entries(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """ingest_packages() of the files in folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    ingest_packages(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xlsx").load(folder), out, checkpoint)


def ingest_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, most: int = 1000) -> int:
    """Append the members of every new file in folder to the table at out, at most so many files in a batch; how many batches there were.

    A batch is what its offsets say, so one that is run again after a failure reads the same files; each batch writes its own folder,
    batch=n, anew.
    """
    register(spark)
    seen = 0

    def batch(files: DataFrame, number: int) -> None:
        nonlocal seen
        seen += 1
        file_entries(files, folder).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arriving = spark.readStream.format("package_arrivals").option("maxFilesPerBatch", str(most)).load(folder)
    query = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()  # batch after batch in one query, until one finds nothing
    finally:
        query.stop()
    return seen
