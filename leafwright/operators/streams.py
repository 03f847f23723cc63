"""Queries of the streaming operators: a file stream run to its end."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql.types import StructField, StructType, TimestampType

from leafwright.plans.lineage import ensure_checkpoint_dir
from leafwright.plans.registry import Registry
from leafwright.streaming import matching

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.query("streaming_latency", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def streaming_latency(spark, sf_dir):
    """Hourly totals of the event log as a stream in update mode, written as files; equal to the batch."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = StructType([StructField(f.name, TimestampType() if f.name == "ts" else f.dataType) for f in spark.read.parquet(path).schema])  # event time must have a zone
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(path))
    if not path.endswith(".parquet/") and _folder(path) != path:
        stream = stream.where("_metadata.file_name = 'events.parquet'")
    return matching.run_to_files(matching.windowed_totals(stream), ["window_start", "event_type"], f"{ensure_checkpoint_dir(spark)}/latency-{uuid4().hex}")


def _folder(path: str) -> str:
    """A file stream reads folders; a single file is reached by a glob."""
    return path.replace("events.parquet", "event[s].parquet")
