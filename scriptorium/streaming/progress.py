"""Progress of files as a stream: each chunk that is done moves its file on; the table of progress is written now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunk_progress(events: DataFrame) -> DataFrame:
    """key, chunks_done and last of each file from events (key, chunk, at): as a stream, one state row for each file."""
    return events.groupBy("key").agg(F.max("chunk").alias("chunks_done"), F.max("at").alias("last"))


def follow(spark: SparkSession, source: str, target: str, progress: str, columns: list) -> None:
    """Read what is new in the Parquet files of `source` and append the files' changed progress to `target`, in versions.

    A batch is written under its number, so that a batch that is run again after a failure replaces itself.
    """
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rstrip("/").rpartition("/")
    alone = any(f.endswith(f"/{name}") for f in spark.read.parquet(source).inputFiles()[:1])
    reader = spark.readStream.schema(schema)
    rows = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={number}")

    query = chunk_progress(rows.select(*columns)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last version of each file's progress."""
    last = F.max_by(F.struct("chunks_done", "last"), "version").alias("x")
    return spark.read.option("basePath", target).parquet(target).groupBy("key").agg(last).select("key", "x.chunks_done", "x.last")
