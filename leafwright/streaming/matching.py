"""Streaming operators: windows over a log, matching results to tasks, last value per device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def windowed_totals(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum per key and tumbling window; rows later than `late` are dropped in append mode."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 3).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), key, "n", "total")


def match_results(tasks: DataFrame, results: DataFrame, timeout: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Tasks (task_id, submitted_at) with their result (result_id, received_at, payload) by id, or none after `timeout`.

    Results out of order wait in the join's state; those past the watermark are dropped, and so is old state.
    """
    a, b = tasks.withWatermark("submitted_at", late), results.withWatermark("received_at", late)
    on = F.expr(f"task_id = result_id AND received_at >= submitted_at AND received_at <= submitted_at + INTERVAL {timeout}")
    return a.join(b, on, "left_outer")


def last_sample(samples: DataFrame, device: str = "device_id", value: str = "used_bytes") -> DataFrame:
    """Latest value and highest value of each device (update mode)."""
    return samples.groupBy(device).agg(F.max_by(value, "ts").alias("last_used"), F.max(value).alias("peak_used"))


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and give the memory table; for tests, whose results are small."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run a stream over what its source holds now in update mode and give the last row of each key.

    Each batch writes the rows that it changed to a folder of its own, so a batch that is run again replaces itself; nothing goes to the driver, and
    state older than the watermark is dropped.
    """
    spark = df.sparkSession
    to = f"{folder.rstrip('/')}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder.rstrip('/')}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(to)
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")
