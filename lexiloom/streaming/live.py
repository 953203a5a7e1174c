"""Structured Streaming forms of the audit probe and the history upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.history import upsert_epoch


def probe(stream: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """Stream rows whose stripped text is a training text: a stream-static semi-join."""
    known = training.select(T.strip(F.col("text")).alias("_t")).distinct()
    return stream.withColumn("_t", T.strip(F.col("text"))).join(known, "_t", "left_semi").select(key, "text")


def event_windows(stream: DataFrame, lateness: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums by tumbling window and kind; later rows than the watermark are left out."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def maintain_history(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of epoch rows replaces those epochs in the history; versions are folders by batch, so a repeated batch writes the same one; the two latest stay."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], batch.schema)
        upsert_epoch(before, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
