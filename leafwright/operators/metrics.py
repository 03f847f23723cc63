"""Quality metrics: edit distance, character error rate, cosine, tensor differences, hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.plans.registry import Registry
from leafwright.sources import load

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
LN = "ln AS (SELECT DISTINCT ON (line_id) * FROM rec_results)"


def error_rate(truth: Column, guess: Column) -> Column:
    """Character error rate, at most 1; for an empty truth 0 if the guess is empty, else 1."""
    n = F.length(truth)
    return F.when(n == 0, F.when(F.length(guess) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(truth, guess) / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for empty, unequally long or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(good, F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))).otherwise(0.0)


PAIRS = f"""{LN}, c AS (SELECT *, coalesce(text, '') AS t FROM ln), p AS (SELECT line_id, doc_id, t, lead(t) OVER (PARTITION BY doc_id, page_index, region_id ORDER BY line_index, line_id) AS g FROM c)"""


def line_pairs(lines: DataFrame, text: Column) -> DataFrame:
    """Each line, ids once, with the next of its region: `t` and `g`."""
    w = Window.partitionBy("doc_id", "page_index", "region_id").orderBy("line_index", "line_id")
    return lines.dropDuplicates(["line_id"]).withColumn("t", text).withColumn("g", F.lead("t").over(w)).where("g IS NOT NULL")


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "rec_results", "line_id", "doc_id", "page_index", "region_id", "line_index", "text")


def _pairs(spark, sf_dir):
    """Pairs of whole texts with a letter for each byte of UTF-8, so that distances and lengths count bytes."""
    return line_pairs(_lines(spark, sf_dir), F.decode(F.encode(F.coalesce("text", F.lit("")), "utf-8"), "iso-8859-1"))


def distances(pairs: DataFrame) -> DataFrame:
    return pairs.select("line_id", F.levenshtein("t", "g").alias("distance"))


def mean_error_rates(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.round(F.avg(error_rate(F.col("t"), F.col("g"))), 9).alias("mean_cer"))


@R.query("edit_distance", f"WITH {PAIRS} SELECT line_id, CAST(levenshtein(t, g) AS INT) AS distance FROM p WHERE g IS NOT NULL")
def edit_distance(spark, sf_dir):
    """Distance in bytes of each line to the next of its region."""
    return distances(_pairs(spark, sf_dir))


@R.query("edit_distance_whole")
def edit_distance_whole(spark, sf_dir):
    """Distance in code points of whole texts, whatever their script."""
    return distances(line_pairs(_lines(spark, sf_dir), F.coalesce("text", F.lit(""))))


@R.query("cer_pairs", f"WITH {PAIRS} SELECT doc_id, count(*) AS pairs, round(avg(CASE WHEN t = '' THEN CASE WHEN g = '' THEN 0 ELSE 1 END ELSE least(1, levenshtein(t, g) / CAST(strlen(t) AS DOUBLE)) END), 9) AS mean_cer FROM p WHERE g IS NOT NULL GROUP BY doc_id")
def cer_pairs(spark, sf_dir):
    """Mean error rate in bytes of each document's lines, the next line of a region standing for the truth."""
    return mean_error_rates(_pairs(spark, sf_dir))


@R.query("cer_pairs_whole")
def cer_pairs_whole(spark, sf_dir):
    """Error rate in code points of whole texts, whatever their script."""
    return mean_error_rates(line_pairs(_lines(spark, sf_dir), F.coalesce("text", F.lit(""))))


def _neighbours(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id")


@R.query("cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@R.query("tensor_diff", "SELECT vec_id, round(max(d), 6) AS max_abs, round(sqrt(sum(d * d)), 5) AS l2, count(*) FILTER (WHERE d > 0.5) AS beyond FROM (SELECT a.vec_id, abs(unnest(CAST(a.embedding AS DOUBLE[])) - unnest(CAST(b.embedding AS DOUBLE[]))) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY vec_id")
def tensor_diff(spark, sf_dir):
    """Largest difference, Euclidean distance, and how many entries differ by more than a half."""
    d = F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    n = _neighbours(spark, sf_dir).withColumn("d", d)
    return n.select("vec_id", F.round(F.array_max("d"), 6).alias("max_abs"), F.round(F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, v: s + v * v)), 5).alias("l2"), F.size(F.filter("d", lambda v: v > 0.5)).cast("long").alias("beyond"))


@R.query("class_accuracy", "SELECT label, count(*) AS n, round(avg(CAST(label = (vec_id % 10) AS INT)), 9) AS accuracy FROM embeddings GROUP BY label")
def class_accuracy(spark, sf_dir):
    """Share of agreeing labels per class, the second labelling being a formula of the id."""
    return load(spark, sf_dir, "embeddings", "vec_id", "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("vec_id") % 10).cast("int")), 9).alias("accuracy"))


@R.query("text_hashes", "WITH el AS (SELECT DISTINCT ON (elem_id) * FROM content_list) SELECT elem_id, sha256(coalesce(text, '')) AS text_hash FROM el")
def text_hashes(spark, sf_dir):
    return load(spark, sf_dir, "content_list", "elem_id", "text").dropDuplicates(["elem_id"]).select("elem_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@R.query("repeated_hash_check", "WITH d AS (SELECT sha256(text) AS h, source, count(*) AS n FROM documents WHERE text <> '' GROUP BY ALL) SELECT h AS text_hash, count(*) AS sources, CAST(sum(n) AS BIGINT) AS copies FROM d GROUP BY h HAVING sum(n) > 1")
def repeated_hash_check(spark, sf_dir):
    """Texts that occur more than once, and under how many sources."""
    d = load(spark, sf_dir, "documents", "text", "source").where("text <> ''").groupBy(F.sha2("text", 256).alias("text_hash"), "source").agg(F.count("*").alias("n"))
    return d.groupBy("text_hash").agg(F.count("*").alias("sources"), F.sum("n").alias("copies")).where("copies > 1")


def canonical_hash(raw: Column) -> Column:
    """SHA-256 of JSON in one form: keys sorted, no blanks, letters beyond ASCII kept. Null for null and for what isn't JSON."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(_canonical)

    return F.pandas_udf(run, "string")(raw)


def _canonical(text: str | None) -> str | None:
    try:
        return None if text is None else hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    except ValueError:
        return None


@R.query("canonical_hashes", "SELECT event_id, sha256(replace(props, ' ', '')) AS hash FROM events")
def canonical_hashes(spark, sf_dir):
    """Hash of each event's properties, whatever their order and blanks."""
    return load(spark, sf_dir, "events", "event_id", "props").select("event_id", canonical_hash(F.col("props")).alias("hash"))
