"""Queries of problem 7: sources mixed to their target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import mixing
from leafwright.plans.lineage import cut
from leafwright.sources import load


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    return [tuple(r) for r in load(spark, sf_dir, "mix_targets", "source", "target_share", "max_repeats").distinct().orderBy("source").collect()]  # a parameter table


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rate and whole copies."""
    return mixing.mix(load(spark, sf_dir, "documents", "doc_id", "text", "lang", "fmt", "source", "n_tokens"), _targets(spark, sf_dir))


def mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the total tokens reached by each source."""
    return mixing.report(cut(mixed_documents(spark, sf_dir)), load(spark, sf_dir, "mix_targets", "source", "target_share", "max_repeats").distinct())


def copies_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for each source with a target: every labelled document once, none copied more than its source may be."""
    mixed = mixed_documents(spark, sf_dir).where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most"))
    targets = load(spark, sf_dir, "mix_targets", "source", "max_repeats").distinct()
    return targets.join(mixed, "source").select("source", "documents", (F.col("most") <= F.col("max_repeats")).alias("within"))


def queries() -> dict:
    return {"p7_mixed_documents": mixed_documents, "p7_mix_report": mix_report, "p7_copies_check": copies_check}


def oracle_sql() -> dict[str, str]:
    return {"p7_copies_check": "SELECT source, count(*) AS documents, true AS within FROM documents JOIN (SELECT DISTINCT source FROM mix_targets) t USING (source) GROUP BY source"}
