"""Queries of problem 5: noise of scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm import lookalike, scan_noise
from leafwright.plans.lineage import cut
from leafwright.sources import load

ELEMENT = ("elem_id", "doc_id", "page_index", "reading_order", "element_type", "label", "y0", "y1")
LINE = ("line_id", "doc_id", "page_index", "region_id", "line_index")


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, scan_noise.Words]:
    """Elements and lines in the one form of look-alike texts, and the word list of both. Repeated rows stay until the results are made distinct."""
    elements = load(spark, sf_dir, "content_list", *ELEMENT, "text")
    lines = load(spark, sf_dir, "rec_results", *LINE, "text")
    patterns = lookalike.rewrites(lookalike.code_points(elements.select("text").unionByName(lines.select("text"))))
    elements = cut(lookalike.canonical_texts(elements, patterns).drop("text"))
    lines = cut(lookalike.canonical_texts(lines, patterns).drop("text"))
    return elements, lines, scan_noise.count_words(elements.select("canonical").unionByName(lines.select("canonical")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, lines, words = _prepared(spark, sf_dir)
    return scan_noise.noise_rows(cut(scan_noise.element_flags(elements, words)), cut(scan_noise.line_flags(lines, words)))


def repaired_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous, repaired paragraphs of every element and region that isn't page furniture, without the furniture between their lines."""
    elements, lines, words = _prepared(spark, sf_dir)
    flags, of_lines = cut(scan_noise.element_flags(elements, None)), cut(scan_noise.line_flags(lines, None))
    return scan_noise.paragraphs(elements.dropDuplicates(["elem_id"]), lines, flags, of_lines, words)


def queries() -> dict:
    return {"p5_found": found, "p5_paragraphs": repaired_paragraphs}


def oracle_sql() -> dict[str, str]:
    return {}
