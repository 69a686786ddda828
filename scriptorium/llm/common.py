"""What the training-data operators share: reading, cutting lineage, checked broadcasts, ranks, hash splits."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Character class of the white space between words: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """The whole row as one struct, so that working columns can't clash with the caller's."""
    return df.select(F.struct(*[q(c) for c in df.columns]).alias(name))


def unpacked(df: DataFrame, names: list[str], row: str = "row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in names]


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and go on from there: short lineage that survives lost executors.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session whose executors are this machine's
    own threads (tests, notebooks) gets a temporary one; a cluster, where no such folder is shared, is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


#: Bytes of texts that are handed to a worker at once: two tasks then take some tens of MB beside the JVM's heap.
BATCH_BYTES = 8 * 1024 * 1024


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after its session's batches for workers are bounded to BATCH_BYTES; a lower bound of the session stays.

    Rows may be of any length, so a bound on their number doesn't bound a worker's memory. Results don't depend on it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


#: Bytes of strings and binaries that a broadcast side may have, however few its rows are.
BROADCAST_BYTES = 64 * 1024 * 1024


def small(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if `df` is seen to have at most so many rows, and bytes in cells of any length; else Spark
    shuffles it, and AQE splits hot keys."""
    wide = [c for c, t in df.dtypes if t in ("string", "binary")]
    size = sum((F.coalesce(F.octet_length(q(c)), F.lit(0)).cast("long") for c in wide), F.lit(0).cast("long"))
    seen = df.limit(most_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= most_rows and (seen["bytes"] or 0) <= most_bytes else df


def text_of(name: str = "text") -> Column:
    return F.coalesce(q(name).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text: maximal runs of what isn't BLANK."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Global ranks from 0 without one task for all rows: range partitions, a count for each, then a rank inside each.

    The checkpoint fixes the partitions; the offsets are one row for each partition.
    """
    part = F.spark_partition_id()
    rows = cut(df.orderBy(*order)).withColumn("_part", part)
    sizes = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("_part")
    starts = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn(name, (inside - 1 + starts[F.col("_part")]).cast("long")).drop("_part")
