"""Queries of problem 4: languages of documents, elements and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import language, lookalike, prose
from leafwright.llm.q_prose import model_of
from leafwright.sources import load


def _elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    rows = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "element_type", "text")
    return rows, lookalike.rewrites(lookalike.code_points(rows))


def _model(spark: SparkSession, sf_dir: str) -> language.Model:
    return language.train(load(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """(doc_id, lang_list) of the jobs, ids once; and the languages that a lang_list holds (null and unknown codes hold none)."""
    codes: dict[str, list[str]] = {}
    for code, lang in load(spark, sf_dir, "lang_codes", "code", "lang").distinct().orderBy("code", "lang").collect():  # a fixed table
        codes.setdefault(code, []).append(lang)
    table = F.create_map(*[x for c, ls in codes.items() for x in (F.lit(c), F.array(*map(F.lit, ls)))]) if codes else None
    none = F.array().cast("array<string>")
    known = F.filter(F.coalesce(F.col("lang_list"), none), lambda c: c.isNotNull())
    langs = none if table is None else F.array_distinct(F.flatten(F.transform(known, lambda c: F.coalesce(F.element_at(table, c), none))))
    jobs = load(spark, sf_dir, "parse_jobs", "doc_id", "lang_list").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.any_value("lang_list").alias("lang_list"))
    return jobs, langs


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language in every element: element, position, language, confidence. Ids count once."""
    rows, patterns = _elements(spark, sf_dir)
    rows = lookalike.canonical_texts(rows.dropDuplicates(["elem_id"]), patterns).where(F.length("canonical") > 0)
    got = language.label_texts(rows.select("elem_id", "doc_id", "canonical"), _model(spark, sf_dir))
    return got.select("elem_id", "doc_id", F.explode("spans").alias("s")).select("elem_id", "doc_id", "s.*")


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the characters of its spans, its confidence, and whether lang_list is missing, wrong or right."""
    per = spans(spark, sf_dir).groupBy("doc_id", "lang").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum((F.col("end") - F.col("start")) * F.col("confidence")).alias("sure"))
    docs = per.groupBy("doc_id").agg(F.max_by("lang", F.struct("sure", "lang")).alias("lang"), F.try_divide(F.max("sure"), F.sum("chars")).alias("confidence"))
    jobs, langs = held(spark, sf_dir)
    both = jobs.join(docs, "doc_id", "left").withColumn("held", langs)
    label = F.when(F.size("held") == 0, "missing").when(F.col("lang").isNull(), "unknown").when(F.array_contains("held", F.col("lang")), "right").otherwise("wrong")
    return both.select("doc_id", "lang", "confidence", label.alias("label"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, patterns = _elements(spark, sf_dir)
    wanted = lookalike.canonical_texts(elements.where((F.col("element_type") == "text") & (F.length("text") >= 80)).select("elem_id", "doc_id", "text"), patterns)
    got = language.label_texts(wanted, _model(spark, sf_dir)).select("elem_id", "doc_id", "canonical", "sentence_langs")
    jobs, langs = held(spark, sf_dir)
    extra = got.join(jobs, "doc_id", "left").withColumn("extra", F.array_except("sentence_langs", langs)).where(F.size("extra") > 0)
    checked = prose.score(extra.select("elem_id", "extra", "canonical"), model_of(elements, patterns), ["elem_id", "extra"], statistics_too=False).where("is_prose")
    return checked.select("elem_id", F.explode("extra").alias("lang")).distinct()


def queries() -> dict:
    return {"p4_found": found, "p4_spans": spans, "p4_document_languages": document_languages}


def oracle_sql() -> dict[str, str]:
    return {}
