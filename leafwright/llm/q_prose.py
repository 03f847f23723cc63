"""Queries of problem 2: text statistics and natural prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import lookalike, prose
from leafwright.sources import load


def model_of(rows: DataFrame, patterns: dict[str, str]) -> prose.Trees:
    """The trees of elements with a column text; only the sample is rewritten."""
    return prose.train(rows, text="text", form=lambda r: lookalike.canonical_texts(r, patterns))


def _elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    rows = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "element_type", "text")
    return rows, lookalike.rewrites(lookalike.code_points(rows))


def element_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and prose decision of every element. Ids count once; null texts give zeros."""
    rows, patterns = _elements(spark, sf_dir)
    return prose.score(lookalike.canonical_texts(rows.dropDuplicates(["elem_id"]), patterns), model_of(rows, patterns), ["elem_id", "doc_id", "element_type"])


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of whole documents: sums over their elements, ratios weighted by length. A document is prose if most of its characters are."""
    e = element_statistics(spark, sf_dir)
    weighted = lambda c, by: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col(by)), F.sum(by)), F.lit(0.0)).alias(c)
    ratios = [weighted(c, "n_chars") for c in ("symbol_ratio", "digit_ratio", "letter_ratio", "sentence_share", "cjk_ratio", "upper_ratio")]
    return e.groupBy("doc_id").agg(
        F.count("*").alias("elements"), F.sum("n_chars").alias("n_chars"), F.sum("n_lines").alias("n_lines"), F.sum("n_words").alias("n_words"), weighted("mean_word_length", "n_words"), weighted("common_share", "n_words"), weighted("line_end_share", "n_lines"),
        *ratios, weighted("prose_probability", "n_chars"), (F.sum(F.when(F.col("is_prose"), F.col("n_chars")).otherwise(0)) * 2 > F.sum("n_chars")).alias("is_prose"),
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, patterns = _elements(spark, sf_dir)
    wanted = lookalike.canonical_texts(rows.where((F.col("element_type") == "text") & (F.length("text") >= 80)), patterns)
    return prose.score(wanted, model_of(rows, patterns), ["elem_id"], statistics_too=False).where(~F.col("is_prose")).select("elem_id").distinct()


def queries() -> dict:
    return {"p2_found": found, "p2_element_statistics": element_statistics, "p2_document_statistics": document_statistics}


def oracle_sql() -> dict[str, str]:
    return {}
