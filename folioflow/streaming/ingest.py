"""Incremental ingest: new files are upserted once by key, events are appended, windows are counted with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Rows of new keys go to target, a folder per batch. A batch that is repeated after a failure replaces its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.option("basePath", target).parquet(*[f"{target}/batch={i}" for i in range(n)]).select(key) if n else None
        new = batch.dropDuplicates([key])
        (new.join(old, key, "left_anti") if n else new).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_events(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
