"""The same labels over streams: counts kept up to date, and event-time windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cuts import own_folder
from ..functions import text


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 4) -> DataFrame:
    """A stream of the files of a Parquet table, be it one file or a directory of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def label_counts(reviews: DataFrame) -> DataFrame:
    """Running counts of labels and verified reviews; for update or complete mode."""
    label = text.label_of(F.col("title"), F.col("text"))
    return reviews.select(label.alias("label"), F.coalesce("verified_purchase", F.lit(False)).alias("v")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("v"), 1).otherwise(0)).alias("n_verified"))


def labelled_in_scope(reviews: DataFrame, index: DataFrame) -> DataFrame:
    """Labelled reviews of a stream joined to a static style index."""
    r = reviews.select("review_id", "parent_asin", text.label_of(F.col("title"), F.col("text")).alias("label"))
    return r.join(index, "parent_asin").filter(F.col("label").isin(text.BUCKETS))


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values per tumbling window and type; events later than `late` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by `gap` without an event."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, name: str, mode: str = "complete", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there, then stop, and read what it wrote: the last result in complete mode, every
    finished row in append mode."""
    import uuid

    spark = stream.sparkSession
    base = f"{own_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        (keep(batch) if keep else batch).write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{base}/out/all") if mode == "complete" else spark.read.parquet(f"{base}/out").drop("batch")
