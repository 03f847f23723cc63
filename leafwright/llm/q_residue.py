"""Queries of problem 8: template residue, filler and error pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm import residue
from leafwright.sources import load


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find(load(spark, sf_dir, "documents", "doc_id", "source", "title", "text"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left when those found are taken out."""
    docs = load(spark, sf_dir, "documents", "doc_id", "source", "lang", "title", "n_chars")
    return docs.join(found(spark, sf_dir), "doc_id", "left_anti")


def queries() -> dict:
    return {"p8_found": found, "p8_clean_documents": clean_documents}


def oracle_sql() -> dict[str, str]:
    return {}
