"""A stored index of signatures: new files are matched against all that came before without touching old texts.

Two tables of the warehouse, written once for each arrival: entries with their signatures, bucketed by place, and bands of
signatures, bucketed by band. A match joins the few new rows to the stored buckets, so only new rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.dedup import PERMUTATIONS, SIMILAR, agreement, banded_pairs, saved, signatures
from scriptorium.operators.ingestion import ordered
from scriptorium.operators.intake import ordered_pass

EXACT = 0.999


class StoredSignatures:
    """Entries (place, name, md5, signature) under a table name. Signatures that agree in `threshold` of their places share a
    band at least, so no match is lost; another threshold needs another index."""

    def __init__(self, spark: SparkSession, name: str, threshold: float = SIMILAR, buckets: int = 64):
        self.spark, self.name, self.threshold, self.buckets = spark, name, threshold, buckets
        self.count = PERMUTATIONS - int(-(-threshold * PERMUTATIONS // 1)) + 1

    def _bands(self) -> Column:
        wide = -(-PERMUTATIONS // self.count)
        return F.transform(F.sequence(F.lit(0), F.lit(self.count - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * wide + 1, F.lit(wide))))

    def _append(self, rows: DataFrame, kind: str, key: str) -> None:
        rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).mode("append").format("parquet").saveAsTable(f"{self.name}_{kind}")

    @property
    def empty(self) -> bool:
        return not self.spark.catalog.tableExists(f"{self.name}_entries")

    def drop(self) -> None:
        """Remove the index."""
        for kind in ("entries", "bands"):
            self.spark.sql(f"drop table if exists {self.name}_{kind}")

    def entries(self) -> DataFrame:
        """place, name, md5, signature of all entries; a table has to be there."""
        return self.spark.table(f"{self.name}_entries")

    def signed(self, files: DataFrame) -> DataFrame:
        """name, md5 and signature of files (name, md5, norm), written once: hashing is dear."""
        return saved(files.select("name", "md5").join(signatures(files.select("name", "norm")), "name"))

    def add(self, new: DataFrame) -> None:
        """Append new entries (name, md5, signature) in order of name, after those that are there."""
        last = None if self.empty else self.entries().agg(F.max("place").alias("p")).first()["p"]
        rows = ordered(new.select("name", "md5", "signature"), ["name", "md5"], "place").withColumn("place", F.col("place") + F.lit(-1 if last is None else last))
        rows = saved(rows)
        self._append(rows, "entries", "place")
        self._append(rows.select("place", F.explode(F.array_distinct(self._bands())).alias("band")), "bands", "band")

    def candidates(self, new: DataFrame) -> DataFrame:
        """(name, place) of new files (name, signature) and the stored entries that share a band with them."""
        asked = new.select("name", F.explode(F.array_distinct(self._bands())).alias("band"))
        return asked.join(self.spark.table(f"{self.name}_bands"), "band").select("name", "place").distinct()

    def matches(self, new: DataFrame) -> DataFrame:
        """name, match, md5, similarity and exact of each new file (name, signature) with an entry like it: the most similar
        one, of equal ones the first. Files without such an entry have no row."""
        if self.empty:
            return new.select("name", F.lit("").alias("match"), F.lit("").alias("md5"), F.lit(0.0).alias("similarity"), F.lit(False).alias("exact")).limit(0)
        stored = self.entries().select("place", F.col("name").alias("match"), "md5", F.col("signature").alias("old"))
        both = self.candidates(new).join(stored, "place").join(new.select("name", F.col("signature").alias("own")), "name")
        near = both.withColumn("similarity", agreement("own", "old")).where(F.col("similarity") >= self.threshold)
        best = near.groupBy("name").agg(F.min_by(F.struct("match", "md5", "similarity"), F.struct(-F.col("similarity"), "place")).alias("x"))
        return best.select("name", "x.match", "x.md5", "x.similarity", (F.col("x.similarity") >= EXACT).alias("exact"))

    def arrive(self, files: DataFrame) -> DataFrame:
        """name, match and similarity of files (name, md5, norm) that came together: each against the entries and against the earlier
        ones among them that stayed; those that are like nothing are added, and have no match. Decisions are by signature alone."""
        new = self.signed(files)
        keyed = saved(new.withColumn("class", F.md5(F.array_join("signature", ",").cast("binary"))))
        entries = self.entries().select("place", "name", "signature") if not self.empty else new.select(F.lit(0).cast("long").alias("place"), "name", "signature").limit(0)
        hit = saved(self.candidates(new).select("place").distinct().join(entries, "place")) if not self.empty else entries
        old = hit.withColumn("class", F.md5(F.array_join("signature", ",").cast("binary")))
        signs = saved(keyed.select("class", "signature").unionByName(old.select("class", "signature")).dropDuplicates(["class"]))
        pairs = banded_pairs(signs.select(F.col("class").alias("id"), "signature"), self.threshold)
        links = pairs.select(F.col("a").alias("class"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other"), "similarity"))
        members = keyed.select("name", "class").unionByName(old.select("name", "class"))
        none = new.select("name", "md5").limit(0)
        judged = saved(ordered_pass(new.withColumn("md5", F.col("name")).select("name", "md5"), old.select("place", "name"), none, saved(members), saved(links), none))
        self.add(new.join(judged.where("status = 'pending'").select("name"), "name", "left_semi"))
        return judged.select("name", F.col("duplicate_of").alias("match"), "similarity")
