"""Windowed event counts and trigger streams, the same code for batch and Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stamped(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark; timestamps without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and value sums per window and type; ``late`` sets a watermark, later rows are dropped."""
    rows = _stamped(events, late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_events(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Events once per key within the watermark."""
    return _stamped(events, late).dropDuplicatesWithinWatermark(keys)


def upsert(target: str, keys: list[str], order: list[str]):
    """foreachBatch sink: per key the row that sorts last, old rows and the batch together."""
    from eventlens.operators.asof import latest

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = f"{target}/v{epoch}"
        rows = batch
        if epoch:
            rows = spark.read.parquet(f"{target}/v{epoch - 1}").unionByName(batch, allowMissingColumns=True)
        latest(rows, keys, [F.col(o).desc() for o in order]).write.mode("overwrite").parquet(path)

    return write
