"""Queries of problem 3: texts that look the same with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import lookalike
from leafwright.sources import load


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and recognised lines under one id (the ids of the two tables never meet)."""
    elements = load(spark, sf_dir, "content_list", F.col("elem_id").alias("row_id"), "doc_id", "text")
    lines = load(spark, sf_dir, "rec_results", F.col("line_id").alias("row_id"), "doc_id", "text")
    return elements.unionByName(lines)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_lines(spark, sf_dir)
    return lookalike.canonical_texts(rows, lookalike.rewrites(lookalike.code_points(rows)))


def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's text in the one form, and whether that changed it. Ids count once."""
    rows = canonical(spark, sf_dir).select("row_id", "doc_id", "canonical", F.col("canonical").eqNullSafe(F.col("text")).alias("unchanged"))
    return rows.dropDuplicates(["row_id"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(canonical(spark, sf_dir), "doc_id", "row_id")


def queries() -> dict:
    return {"p3_found": found, "p3_canonical_text": canonical_text}


def oracle_sql() -> dict[str, str]:
    return {}
