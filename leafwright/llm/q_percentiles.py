"""Queries of problem 1: percentiles of the timings of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.llm import quantile_digest as qd
from leafwright.plans.lineage import cut
from leafwright.sources import load

EPS = 0.005
KEYS = ["case_name", "shard_id", "day"]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "requests", "request_id", "case_name", "shard_id", "ts", "received_at", *qd.METRICS).withColumn("day", F.to_date("ts"))


def _levels(requests: DataFrame) -> int:
    first, last = requests.agg(F.min("request_id"), F.max("request_id")).first()
    return qd.levels_for(first, last)


def timing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per case, shard and day, and of whole cases and shards merged from the days' digests."""
    requests = _requests(spark, sf_dir)
    days = cut(qd.merge(qd.build(requests, KEYS, list(qd.METRICS), "request_id", EPS), KEYS, EPS, block="_block", levels=_levels(requests)))
    parts = []
    for level, keys in (("day", KEYS), ("shard", ["case_name", "shard_id"]), ("case", ["case_name"])):
        if level == "day":
            digests = days
        elif level == "shard":
            digests = shards = qd.merge(days, keys, EPS)
        else:
            digests = qd.merge(shards, keys, EPS)
        got = qd.percentiles(digests, keys, list(qd.METRICS), EPS)
        missing = {k: F.lit(None).cast(t).alias(k) for k, t in days.select(*KEYS).dtypes if k not in keys}
        parts.append(got.select(F.lit(level).alias("level"), *[missing.get(k, F.col(k)) for k in KEYS], *[c for c in got.columns if c not in KEYS]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def late_batch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests built from on-time rows and from late rows apart (late: received on a later day), then added up per case and day."""
    requests = _requests(spark, sf_dir).withColumn("late", F.coalesce(F.to_date("received_at") > F.col("day"), F.lit(False)))
    keys = ["case_name", "day", "late"]
    batches = qd.merge(qd.build(requests, keys, list(qd.METRICS), "request_id", EPS), keys, EPS, block="_block", levels=_levels(requests))
    return qd.percentiles(qd.merge(batches, ["case_name", "day"], EPS), ["case_name", "day"], list(qd.METRICS), EPS)


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the digests count and what they leave out: valid, null, NaN, negative and infinite values per case and timing. Ids count once; rows without an id count each."""
    rows = load(spark, sf_dir, "requests", "request_id", "case_name", *qd.METRICS)
    rows = rows.where("request_id IS NOT NULL").dropDuplicates(["request_id"]).unionByName(rows.where("request_id IS NULL"))
    long = rows.select("case_name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in qd.METRICS])).alias("x")).select("case_name", "x.metric", "x.v")
    endless = F.abs("v") == float("inf")
    good = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") >= 0) & ~endless
    return long.groupBy("case_name", "metric").agg(
        F.count_if(good).alias("n_valid"),
        F.count_if(F.col("v").isNull()).alias("n_null"),
        F.count_if(F.isnan("v")).alias("n_nan"),
        F.count_if(~F.isnan("v") & (F.col("v") < 0) & ~endless).alias("n_negative"),
        F.count_if(endless).alias("n_infinite"),
    )


def bound_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles of each case keep their bound, by counting the values on either side of each; and how many values there are."""
    rows = _requests(spark, sf_dir)
    digests = qd.merge(qd.build(rows, ["case_name"], list(qd.METRICS), "request_id", EPS), ["case_name"], EPS, block="_block", levels=_levels(rows))
    got = cut(qd.percentiles(digests, ["case_name"], list(qd.METRICS), EPS).where("n > 0"))
    names = [c for c in got.columns if c.startswith("p") and c[1:2].isdigit()]
    claims = got.select(F.col("case_name").alias("_case"), F.col("metric").alias("_metric"), "n", "rank_error", *[qd.leaf_of(F.col(c)).alias(c) for c in names])
    once = rows.where("request_id IS NOT NULL").dropDuplicates(["request_id"]).unionByName(rows.where("request_id IS NULL"))
    long = once.select("case_name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in qd.METRICS])).alias("x")).select("case_name", "x.metric", qd.leaf_of(F.col("x.v")).alias("leaf")).where(F.col("leaf") != qd.leaf_of(F.lit(None)))
    both = long.groupBy("case_name", "metric", "leaf").agg(F.count("*").alias("c")).join(claims, F.col("case_name").eqNullSafe(F.col("_case")) & (F.col("metric") == F.col("_metric")))
    ok = F.lit(True)
    for name, q in zip(names, qd.QUANTILES):
        below, upto = F.sum(F.when(F.col("leaf") < F.col(name), F.col("c")).otherwise(0)), F.sum(F.when(F.col("leaf") <= F.col(name), F.col("c")).otherwise(0))
        rank, slack = q * F.max("n"), F.max("rank_error") + 1
        ok = ok & (below <= rank + slack) & (upto >= rank - slack)
    return both.groupBy("case_name", "metric").agg(F.sum("c").alias("n_valid"), (ok & (F.sum("c") == F.max("n"))).alias("within"))


def queries() -> dict:
    return {"p1_timing_percentiles": timing_percentiles, "p1_late_batches": late_batch_percentiles, "p1_value_counts": value_counts, "p1_bound_check": bound_check}


def oracle_sql() -> dict[str, str]:
    union = " UNION ALL ".join(f"SELECT case_name, '{m}' AS metric, {m} AS v FROM r" for m in qd.METRICS)
    return {
        "p1_bound_check": f"""WITH r AS (SELECT * FROM (SELECT DISTINCT ON (request_id) * FROM requests WHERE request_id IS NOT NULL) UNION ALL SELECT * FROM requests WHERE request_id IS NULL), long AS ({union})
            SELECT case_name, metric, count(*) AS n_valid, true AS within FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND NOT isinf(v) GROUP BY case_name, metric""",
        "p1_value_counts": f"""WITH r AS (SELECT * FROM (SELECT DISTINCT ON (request_id) * FROM requests WHERE request_id IS NOT NULL) UNION ALL SELECT * FROM requests WHERE request_id IS NULL), long AS ({union})
            SELECT case_name, metric, count(*) FILTER (WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND NOT isinf(v)) AS n_valid, count(*) FILTER (WHERE v IS NULL) AS n_null,
            count(*) FILTER (WHERE isnan(v)) AS n_nan, count(*) FILTER (WHERE NOT isnan(v) AND v < 0 AND NOT isinf(v)) AS n_negative, count(*) FILTER (WHERE isinf(v)) AS n_infinite FROM long GROUP BY case_name, metric"""
    }
