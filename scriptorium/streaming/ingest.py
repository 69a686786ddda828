"""Ingest as a stream: new files of a folder, each once, with the same columns as the batch plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import normalised, tokens
from scriptorium.operators.dedup import shared_root


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, digest and tokens of each document, as batch and stream have them."""
    return docs.select("doc_id", "lang", F.md5(normalised(F.col("text")).cast("binary")).alias("digest"), tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def ingest(spark: SparkSession, source: str, target: str, progress: str, schema=None) -> None:
    """Append what is new in the Parquet files of `source` to `target` and end; `progress` remembers what was read."""
    schema = schema or spark.read.parquet(source).schema
    folder, _, name = source.rstrip("/").rpartition("/")
    alone = spark.read.parquet(source).inputFiles()[:1] and spark.read.parquet(source).inputFiles()[0].endswith(f"/{name}")
    reader = spark.readStream.schema(schema)
    docs = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(source)  # streams read folders
    query = measured(docs).writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
