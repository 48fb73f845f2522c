"""The segment cache as a table in place: buckets by hash, of which an upsert rewrites only those it touches.

The table lies in a folder of a file system that driver and executors share, one sub-folder a bucket. What a batch
changes is written aside first, so no file is read and replaced at once; then its buckets are swapped, and its id noted.
A batch that comes again, whether it was noted or broke off before, leaves the table as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.store import cache_upsert
from pagemill.session import kept

BUCKETS = 256


class BucketedCache:
    """A cache of segments (hash, user_id, source_text, …) under path; `buckets` stays the same for a table's life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, hash_: Column) -> Column:
        """A hash's bucket, by its first 32 bits."""
        return (F.conv(F.left(hash_, F.lit(8)), 16, 10).cast("long") % self.buckets).cast("int")

    def create(self, cache: DataFrame) -> None:
        self._write(cache.withColumn("bucket", self.bucket(F.col("hash"))), "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.repartition(self.buckets, "bucket")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def applied(self, batch_id: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/batch={batch_id}/_SUCCESS")
        return bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path))

    def upsert(self, rows: DataFrame, now: float, batch_id: int) -> list[int]:
        """store.cache_upsert in place; the buckets that were rewritten. now belongs to the batch: a replay gives the same."""
        if self.applied(batch_id):
            return []
        hash_ = X.segment_hash(F.col("source_text"), F.col("target_lang"), F.col("user_id"))
        new = kept(rows.withColumn("_bucket", self.bucket(hash_)), "upsert")
        # As many as there are buckets at most.
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
        old = self.rows().filter(F.col("bucket").isin(touched)) if touched else self.rows().filter(F.lit(False))
        merged = cache_upsert(old.drop("bucket"), new.drop("_bucket"), now)
        self._write(kept(merged.withColumn("bucket", self.bucket(F.col("hash"))), "merged"), "overwrite")
        self.spark.range(1).select(F.lit(now).alias("now")).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")
        return touched

    def upsert_stream(self, rows: DataFrame, checkpoint: str, now: float):
        """A streaming query that writes each micro-batch of rows into the cache once, replays and restarts included."""
        return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: self.upsert(df, now + i, i)).start()
