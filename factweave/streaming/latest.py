"""Observations as a stream: the latest value per key, kept in a table by idempotent micro-batch upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.operators.quality import last_write


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], version: Sequence[str], buckets: int = 16) -> StreamingQuery:
    """Keep the row of the greatest version per key at ``path``; a batch run twice or late rows change nothing wrongly.

    Rows are spread over hash buckets and a batch rewrites only the buckets it touches, each as a new generation; the
    reader takes the newest of each (``current``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = last_write(batch, key, version).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        if _exists(spark, path):
            old = current(spark.read.parquet(path).where(F.col("_generation") < batch_id), keep_bucket=True)
            touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            new = last_write(old.where(F.col("_bucket").isin(touched)).unionByName(new), key, version)
        new.withColumn("_generation", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_generation", "_bucket").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a generation was written; every other failure to read must stop the stream, or old rows would be lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(not f.getPath().getName().startswith(("_temporary", ".", "_SUCCESS")) for f in fs.listStatus(folder))


def vacuum(spark: SparkSession, path: str, keep_after: int) -> None:
    """Rewrite nothing, drop generations that newer ones of their bucket replace and that are older than ``keep_after``."""
    table = spark.read.parquet(path)
    newest = table.groupBy("_bucket").agg(F.max("_generation").alias("_newest"))
    old = table.select("_bucket", "_generation").distinct().join(F.broadcast(newest), "_bucket").where((F.col("_generation") < F.col("_newest")) & (F.col("_generation") < keep_after))
    for r in old.collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_generation={r['_generation']}/_bucket={r['_bucket']}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def current(table: DataFrame, keep_bucket: bool = False) -> DataFrame:
    """The rows of the newest generation of each bucket."""
    newest = table.groupBy("_bucket").agg(F.max("_generation").alias("_generation"))
    rows = table.join(F.broadcast(newest), ["_bucket", "_generation"]).drop("_generation")
    return rows if keep_bucket else rows.drop("_bucket")


def windowed_counts(stream: DataFrame, at: str, group: str, size: str, lateness: str) -> DataFrame:
    """Rows per window and group; rows later than the watermark are left out."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, size), group).agg(F.count(F.lit(1)).alias("rows"))
