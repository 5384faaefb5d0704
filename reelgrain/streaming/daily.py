"""Daily tumbling counts over a stream of event files, run to the end of what is there (availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrain.storage import shared_folder


def daily_counts(events: DataFrame) -> DataFrame:
    """day, event_type, n; the same on a batch and on a stream, where late rows are taken for three days."""
    if events.isStreaming:
        events = events.withWatermark("ts", "3 days")
    by = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def daily_counts_stream(spark: SparkSession, path: str) -> DataFrame:
    """Run the stream over a folder or file of Parquet events and read back what it wrote; checkpoints are in the shared folder."""
    schema = spark.read.parquet(path).schema
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema).format("parquet")
    folder = path if not path.endswith(".parquet") or _is_folder(spark, path) else path.rsplit("/", 1)[0]
    stream = reader.option("pathGlobFilter", "*.parquet" if folder == path else path.rsplit("/", 1)[1]).load(folder)
    counts = daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")))

    def keep(batch: DataFrame, number: int) -> None:
        # update mode: the last value of a window counts
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{place}/out")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{place}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{place}/out")
    return out.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
