"""Sinks: tables written as a whole, once, or by appending; files of outputs with an index that keeps the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_OUTPUTS = 500


def written(rows: DataFrame, path: str, kind: str = "parquet", replace: bool = True) -> None:
    """Rows in place of what is at a path, or only if nothing is there. Files appear when the whole job is done."""
    rows.write.mode("overwrite" if replace else "ignore").format(kind).save(path)


def appended(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    rows.write.mode("append").format(kind).save(path)


def saved_outputs(outputs: DataFrame, folder: str, index: str) -> None:
    """Outputs (workflow, path, body) as rows of a folder by workflow, and a line of the index for each."""
    outputs.write.mode("append").partitionBy("workflow").parquet(folder)
    appended(outputs.select("workflow", "path", F.octet_length("body").alias("size_bytes"), F.current_timestamp().alias("written_at")), index)


def newest_outputs(spark: SparkSession, index: str, most: int = MOST_OUTPUTS) -> DataFrame:
    """The newest lines of the index; older ones are no longer looked at."""
    return spark.read.parquet(index).orderBy(F.desc("written_at"), "workflow", "path").limit(most)
