"""Files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder, in micro-batches; event time is a timestamp column ``ts``."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there now, append it to files, and give back what the files hold."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle, checkpoint: str) -> None:
    """Process what is there now with one call per micro-batch."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
