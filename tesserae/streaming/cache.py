"""A stream of scan entries kept as a cache of the newest entry per path, and windowed scan counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.duplicates import latest_entries

ENTRY = "entry_id bigint, path string, sig string, md5 string, size_bytes bigint, size array<int>, batch_id int, scanned_at timestamp_ntz"


def entry_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The entries of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` (Parquet, versions ``v=N``) at the newest entry of each path.

    Each micro-batch is merged with the last version and written as the next one;
    a repeated batch after a failure writes the same version again.  The last two
    versions are kept, which is what a repeated batch can need.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("entry_id", "path", "sig", "md5", "size_bytes", "scanned_at")
        if number:
            rows = rows.unionByName(spark.read.schema("entry_id bigint, path string, sig string, md5 string, size_bytes bigint, scanned_at timestamp_ntz").parquet(f"{target}/v={number - 1}"))
        newest = rows.where("path is not null").groupBy("path").agg(F.max(F.struct("scanned_at", "entry_id", "sig", "md5", "size_bytes")).alias("e"))
        newest.select("path", "e.*").write.mode("overwrite").parquet(f"{target}/v={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scans_per_window(entries: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """``start, scans, new_bytes`` per time window; late entries within ``late`` still count.  Works on streams and tables."""
    e = entries.where("scanned_at is not null").withColumn("at", F.col("scanned_at").cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    per = e.groupBy(F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("scans"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("new_bytes"))
    return per.select(F.col("w.start").alias("start"), "scans", "new_bytes")


__all__ = ["entry_stream", "latest_entries", "scans_per_window", "upsert"]
