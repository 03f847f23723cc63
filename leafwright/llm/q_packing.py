"""Queries of problem 6: texts into containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import packing, tokens
from leafwright.plans.lineage import cut
from leafwright.sources import load


def _specs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r[0], r[1]) for r in load(spark, sf_dir, "container_specs", "spec_name", "capacity_tokens").distinct().orderBy("spec_name").collect()]  # a parameter table


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their container, for each capacity."""
    docs = tokens.with_sizes(load(spark, sf_dir, "documents", "doc_id", "text", "n_tokens"))
    return packing.pack(cut(docs), _specs(spark, sf_dir))


def container_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, fill and lower bound for each capacity."""
    return packing.report(containers(spark, sf_dir), _specs(spark, sf_dir))


def container_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for each capacity: every document once, no container over its capacity, every stored token placed."""
    specs = _specs(spark, sf_dir)
    packed = cut(containers(spark, sf_dir))
    caps = F.create_map(*[x for n, c in specs for x in (F.lit(n), F.lit(int(c or 0)).cast("long"))])
    over = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("t")).groupBy("spec_name").agg(F.count_if(F.col("t") > caps[F.col("spec_name")]).alias("overfull"))
    stored = load(spark, sf_dir, "documents", "doc_id", F.col("n_tokens").alias("stored"))
    whole = packed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("t")).join(stored, "doc_id")
    sums = whole.groupBy("spec_name").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("stored") >= 0, F.col("t"))).alias("stored_tokens"))
    return sums.join(over, "spec_name").select("spec_name", "documents", "overfull", "stored_tokens")


def queries() -> dict:
    return {"p6_containers": containers, "p6_container_report": container_report, "p6_container_check": container_check}


def oracle_sql() -> dict[str, str]:
    return {"p6_container_check": "SELECT spec_name, count(*) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(sum(n_tokens) FILTER (WHERE n_tokens >= 0) AS BIGINT) AS stored_tokens FROM container_specs, documents GROUP BY spec_name"}
