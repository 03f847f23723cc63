"""Comparison of two result sets and gates over runs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators.service import parse_method
from leafwright.operators.stats import REQ, requests
from leafwright.plans.registry import Registry
from leafwright.sources import load

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def compare_status(a_chars: Column, b_chars: Column, a_tables: Column, b_tables: Column) -> Column:
    """MISSING where a side has nothing, TABLE_DIFF where only one has tables, SIZE_DIFF where sizes differ threefold, else OK."""
    ratio = F.try_divide(b_chars, a_chars)
    return F.when(a_chars.isNull() | b_chars.isNull(), "MISSING").when(a_tables != b_tables, "TABLE_DIFF").when((ratio > 0.3) & (ratio < 3.0), "OK").otherwise("SIZE_DIFF")


RUNS = """a AS (SELECT doc_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS a_chars, bool_or(coalesce(element_type = 'table', false)) AS a_tables FROM (SELECT DISTINCT ON (elem_id) * FROM content_list) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS b_chars, bool_or(contains(coalesce(text, ''), '|')) AS b_tables FROM (SELECT DISTINCT ON (line_id) * FROM rec_results) GROUP BY doc_id),
cmp AS (SELECT doc_id, a_chars, b_chars, round(b_chars / nullif(CAST(a_chars AS DOUBLE), 0), 3) AS ratio, CASE WHEN a_chars IS NULL OR b_chars IS NULL THEN 'MISSING' WHEN a_tables <> b_tables THEN 'TABLE_DIFF' WHEN b_chars / nullif(CAST(a_chars AS DOUBLE), 0) > 0.3 AND b_chars / nullif(CAST(a_chars AS DOUBLE), 0) < 3.0 THEN 'OK' ELSE 'SIZE_DIFF' END AS status FROM a FULL JOIN b USING (doc_id))"""


def compared(spark, sf_dir) -> DataFrame:
    """Each document's elements against its recognised lines."""
    a = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "element_type", "text").dropDuplicates(["elem_id"]).groupBy("doc_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("a_chars"), F.max(F.coalesce(F.col("element_type") == "table", F.lit(False))).alias("a_tables"))
    b = load(spark, sf_dir, "rec_results", "line_id", "doc_id", "text").dropDuplicates(["line_id"]).groupBy("doc_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("b_chars"), F.max(F.coalesce("text", F.lit("")).contains("|")).alias("b_tables"))
    both = a.join(b, "doc_id", "full")
    return both.select("doc_id", "a_chars", "b_chars", F.round(F.try_divide("b_chars", "a_chars"), 3).alias("ratio"), compare_status(F.col("a_chars"), F.col("b_chars"), F.col("a_tables"), F.col("b_tables")).alias("status"))


@R.query("compare_runs", f"WITH {RUNS} SELECT * FROM cmp")
def compare_runs(spark, sf_dir):
    return compared(spark, sf_dir)


@R.query("compare_summary", f"WITH {RUNS} SELECT status, count(*) AS documents FROM cmp GROUP BY status")
def compare_summary(spark, sf_dir):
    return compared(spark, sf_dir).groupBy("status").agg(F.count("*").alias("documents"))


@R.query("common_documents", "SELECT doc_id FROM content_list INTERSECT SELECT doc_id FROM rec_results")
def common_documents(spark, sf_dir):
    return load(spark, sf_dir, "content_list", "doc_id").intersect(load(spark, sf_dir, "rec_results", "doc_id"))


@R.query("baseline_hash_check", "WITH j AS (SELECT DISTINCT ON (doc_id) * FROM parse_jobs), h AS (SELECT stem, suffix, sha256(stem || coalesce(parse_method, '')) AS hash FROM j), b AS (SELECT DISTINCT stem, sha256(stem || 'auto') AS base FROM h) SELECT stem, suffix, hash = base AS same FROM h JOIN b USING (stem)")
def baseline_hash_check(spark, sf_dir):
    """Hash of each run against the baseline of its name."""
    h = load(spark, sf_dir, "parse_jobs", "doc_id", "stem", "suffix", "parse_method").dropDuplicates(["doc_id"]).select("stem", "suffix", F.sha2(F.concat("stem", F.coalesce("parse_method", F.lit(""))), 256).alias("hash"))
    base = h.select("stem", F.sha2(F.concat("stem", F.lit("auto")), 256).alias("base")).distinct()
    return h.join(base, "stem").select("stem", "suffix", (F.col("hash") == F.col("base")).alias("same"))


@R.query("gate_status", f"WITH {REQ}, n AS (SELECT count(DISTINCT shard_id) AS shards FROM shards), g AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE failed) AS errors, count(DISTINCT shard_id) AS shards_used FROM req GROUP BY ALL) SELECT day, errors, shards_used, CASE WHEN errors > 0 THEN 'invalid_error_count_nonzero' WHEN shards_used < shards THEN 'invalid_isolation_gate_failed' ELSE 'ok' END AS status, list_filter([CASE WHEN errors > 0 THEN 'error_count_nonzero=' || errors END, CASE WHEN shards_used < shards THEN 'shards_used=' || shards_used END], lambda x: x IS NOT NULL) AS failures FROM g, n")
def gate_status(spark, sf_dir):
    """Gates of each day: errors first, then isolation (every configured shard is used), with the failures as texts."""
    g = requests(spark, sf_dir, "ts", "failed", "shard_id").groupBy(F.to_date("ts").alias("day")).agg(F.count_if("failed").alias("errors"), F.countDistinct("shard_id").alias("shards_used"))
    g = g.join(F.broadcast(load(spark, sf_dir, "shards", "shard_id").agg(F.countDistinct("shard_id").alias("shards"))))  # one row
    idle = F.col("shards_used") < F.col("shards")
    fails = F.filter(F.array(F.when(F.col("errors") > 0, F.concat(F.lit("error_count_nonzero="), F.col("errors").cast("string"))), F.when(idle, F.concat(F.lit("shards_used="), F.col("shards_used").cast("string")))), lambda x: x.isNotNull())
    return g.select("day", "errors", "shards_used", F.when(F.col("errors") > 0, "invalid_error_count_nonzero").when(idle, "invalid_isolation_gate_failed").otherwise("ok").alias("status"), fails.alias("failures"))


@R.query("duplicate_outputs", "WITH j AS (SELECT DISTINCT ON (doc_id) * FROM parse_jobs) SELECT request_id, stem, count(*) AS jobs FROM j GROUP BY ALL HAVING count(*) > 1")
def duplicate_outputs(spark, sf_dir):
    """Output folders that more than one job would write."""
    return load(spark, sf_dir, "parse_jobs", "doc_id", "request_id", "stem").dropDuplicates(["doc_id"]).groupBy("request_id", "stem").agg(F.count("*").alias("jobs")).where("jobs > 1")


DIFF = "added int, removed int, lines_a int, lines_b int"


@R.query("duplicate_output_dirs", "WITH j AS (SELECT DISTINCT ON (doc_id) * FROM parse_jobs), o AS (SELECT stem || '/' || CASE WHEN lower(parse_method) IN ('ocr', 'txt') THEN lower(parse_method) ELSE 'auto' END || '/' || shard AS output_dir FROM (SELECT *, request_id % 3 AS shard FROM j)) SELECT substr(output_dir, 1, 4) AS prefix, count(*) AS jobs, count(DISTINCT output_dir) AS output_dirs, count(*) > count(DISTINCT output_dir) AS duplicated FROM o GROUP BY 1 HAVING count(*) > 1")
def duplicate_output_dirs(spark, sf_dir):
    """Jobs and output folders of each prefix of names, and whether jobs share a folder."""
    j = load(spark, sf_dir, "parse_jobs", "doc_id", "request_id", "stem", "parse_method").dropDuplicates(["doc_id"])
    out = F.concat("stem", F.lit("/"), parse_method(F.col("parse_method")), F.lit("/"), (F.col("request_id") % 3).cast("string"))
    return j.select(out.alias("output_dir")).groupBy(F.substring("output_dir", 1, 4).alias("prefix")).agg(F.count("*").alias("jobs"), F.countDistinct("output_dir").alias("output_dirs")).withColumn("duplicated", F.col("jobs") > F.col("output_dirs")).where("jobs > 1")


def line_diff(a: str | None, b: str | None) -> tuple[int, int, int, int]:
    """Lines that a unified diff without context adds and removes on the way from `a` to `b`, and the lines of both. Null is empty."""
    x, y = (a or "").splitlines(), (b or "").splitlines()
    added = removed = 0
    for tag, i, j, k, m in SequenceMatcher(None, x, y).get_opcodes():
        if tag != "equal":
            # a line that itself begins with two signs looks like a file header of the diff and isn't counted
            removed += sum(not line.startswith("--") for line in x[i:j])
            added += sum(not line.startswith("++") for line in y[k:m])
    return added, removed, len(x), len(y)


def diff_counts(a: Column, b: Column) -> Column:
    """`line_diff` as struct(added, removed, lines_a, lines_b); one pair of texts is compared at a time."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in parts:
            yield pd.DataFrame([line_diff(*(v if isinstance(v, str) else None for v in p)) for p in zip(x, y)], columns=["added", "removed", "lines_a", "lines_b"])

    return F.pandas_udf(run, f"struct<{DIFF.replace(' ', ':').replace(',:', ',')}>")(a, b)


def line_changes(a: Column, b: Column) -> Column:
    """Lines that are removed from `a` and added on the way to `b`, as struct(removed, added)."""
    d = diff_counts(a, b)
    return F.struct(d["removed"].alias("removed"), d["added"].alias("added"))


@R.query("markdown_diff")
def markdown_diff(spark, sf_dir):
    """Text of each document's elements against its recognised lines: changed lines, characters, their ratio, and whether each has a table. Null where a side is missing."""
    a = load(spark, sf_dir, "content_list", "elem_id", "doc_id", "page_index", "reading_order", "text", "html").dropDuplicates(["elem_id"]).withColumn("v", F.coalesce(F.nullif("html", F.lit("")), "text", F.lit("")))
    b = load(spark, sf_dir, "rec_results", "line_id", "doc_id", "page_index", "region_id", "line_index", "text").dropDuplicates(["line_id"]).withColumn("v", F.coalesce("text", F.lit("")))
    text = lambda t, order, name: t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "v"))), lambda x: x["v"]), "\n").alias(name))
    both = text(a, ["page_index", "reading_order", "elem_id"], "a").join(text(b, ["page_index", "region_id", "line_index", "line_id"], "b"), "doc_id", "full")
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    has = lambda c: F.lower(c).contains("<table")
    ratio = F.when(F.length("b") == 0, 0.0).otherwise(F.round(F.try_divide(F.length("a"), F.length("b")), 3))
    out = both.withColumn("d", F.when(there, diff_counts(F.col("b"), F.col("a"))))
    return out.select("doc_id", F.length("a").alias("chars_a"), F.length("b").alias("chars_b"), F.when(there, ratio).alias("ratio"), "d.added", "d.removed", has("a").alias("tables_a"), has("b").alias("tables_b"))
