"""Operational statistics: stage totals, exact percentiles, shard and lock figures, balance, throughput, scaling, routing.

All of it is declarative: partial aggregation before every shuffle, and cross-row figures (imbalance, baselines)
come from one-row aggregates joined back, whose size is one row or one row a shard by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.plans.lineage import cut
from leafwright.plans.ranking import percentiles_of_counts, running
from leafwright.plans.registry import Registry
from leafwright.sources import load

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
STAGES = ("layout_ms", "ocr_ms", "table_ms", "npu_serial_ms", "cpu_only_ms", "npu_lock_wait_ms", "npu_lock_hold_ms")
TRACKED = ("layout_ms", "ocr_ms", "table_ms")
TIMINGS = ("latency_ms", "pipeline_call_ms", "route_queue_ms", "npu_serial_ms", "cpu_only_ms", "npu_lock_wait_ms")
IMBALANCE = 1.20
PAGES = "pages AS (SELECT DISTINCT ON (doc_id, page_index) * FROM page_stats)"
REQ = "req AS (SELECT DISTINCT ON (request_id) * FROM requests)"


def pages(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "page_stats").dropDuplicates(["doc_id", "page_index"])


def requests(spark, sf_dir, *columns: str) -> DataFrame:
    """Requests, ids once, only the columns asked for."""
    return load(spark, sf_dir, "requests", *dict.fromkeys(["request_id", *columns])).dropDuplicates(["request_id"])


def finite(c: Column | str) -> Column:
    """The value, or null where it is null, NaN or negative."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(v) & (v >= 0), v)


def _fin(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND {c} >= 0 THEN {c} END"


def to_us(c: Column | str) -> Column:
    """Whole microseconds of milliseconds; 0 for null, NaN and values of 0 or less."""
    v = finite(c)
    return F.coalesce(F.when(v > 0, F.floor(v * 1000.0)), F.lit(0)).cast("long")


def _us(c: str) -> str:
    return f"coalesce(CASE WHEN NOT isnan({c}) AND {c} > 0 THEN CAST(floor({c} * 1000.0::DOUBLE) AS BIGINT) END, 0)"


def total(c: Column | str, digits: int = 3) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), digits)


def moments(value: Column, prefix: str = "") -> list[Column]:
    """count, min, mean and max of a group; zeros for an empty one."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = F.sum(F.floor(value * 1000.0 + 0.5).cast("long")) / F.count(value) / 1000.0  # summed as whole microseconds, so in any order the same
    return [F.count(value).alias(prefix + "n"), zero(F.min(value)).alias(prefix + "min"), F.round(zero(F.when(F.count(value) > 0, mean)), 9).alias(prefix + "mean"), zero(F.max(value)).alias(prefix + "max")]


def summary(value: Column, prefix: str = "") -> list[Column]:
    """`moments`, and p50 and p95, as plain aggregates: for groups whose distinct values fit one task. `summarised` takes groups of any size."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return [*moments(value, prefix), *[F.round(F.coalesce(p[i], F.lit(0.0)), 6).alias(prefix + k) for i, k in enumerate(("p50", "p95"))]]


def summarised(rows: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """Exact summaries of several values per group, each under its prefix: `moments`, and p50 and p95 interpolated on rank p (n - 1).

    The rows are read once, for how often each value occurs; all figures come from these counts, and the percentiles from ordering
    them by `ranking`, so that no task holds a group.
    """
    long = rows.select(group, F.explode(F.array(*[F.struct(F.lit(p).alias("which"), v.alias("_v")) for p, v in values.items()])).alias("x")).select(group, "x.*")
    counted = cut(long.groupBy(group, "which", "_v").agg(F.count("*").alias("_n")))
    points = percentiles_of_counts(counted.where("_v IS NOT NULL"), [group, "which"], {"p50": 0.5, "p95": 0.95}).select(F.col(group).alias("_g"), F.col("which").alias("_w"), "p50", "p95")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.col("_v").isNotNull()
    n = F.coalesce(F.sum(F.when(some, F.col("_n"))), F.lit(0))
    mean = F.try_divide(F.sum(F.floor(F.col("_v") * 1000.0 + 0.5).cast("long") * F.col("_n")), n) / 1000.0  # summed as whole microseconds, so in any order the same
    first = counted.groupBy(group, "which").agg(n.alias("n"), zero(F.min("_v")).alias("min"), F.round(zero(F.when(n > 0, mean)), 9).alias("mean"), zero(F.max("_v")).alias("max"))
    both = first.join(points, F.col(group).eqNullSafe(F.col("_g")) & (F.col("which") == F.col("_w")), "left")
    names = ("n", "min", "mean", "max", "p50", "p95")
    figures = F.struct(*[F.col(k) if k in names[:4] else F.round(zero(F.col(k)), 6).alias(k) for k in names])
    wide = both.groupBy(group).agg(*[F.max(F.when(F.col("which") == p, figures)).alias(f"_f{i}") for i, p in enumerate(values)])
    return wide.select(group, *[F.col(f"_f{i}.{k}").alias(p + k) for i, p in enumerate(values) for k in names])


def _summary_sql(v: str, prefix: str = "") -> str:
    return f"count({v}) AS {prefix}n, coalesce(min({v}), 0) AS {prefix}min, round(coalesce(CAST(sum(CAST(floor({v} * 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) / CAST(count({v}) AS DOUBLE) / 1000.0::DOUBLE, 0), 9) AS {prefix}mean, coalesce(max({v}), 0) AS {prefix}max, round(coalesce(quantile_cont({v}, 0.5), 0), 6) AS {prefix}p50, round(coalesce(quantile_cont({v}, 0.95), 0), 6) AS {prefix}p95"


@R.query("stage_totals", f"WITH {PAGES} SELECT doc_id, count(*) AS pages, {', '.join(f'round(coalesce(sum({c}), 0), 3) AS {c}' for c in STAGES)} FROM pages GROUP BY doc_id")
def stage_totals(spark, sf_dir):
    """Stage times of a document, summed over its pages; missing times count nothing."""
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), *[total(c).alias(c) for c in STAGES])


@R.query("tracked_time", f"WITH {PAGES} SELECT doc_id, page_index, round({' + '.join(f'coalesce({c}, 0)' for c in TRACKED)}, 3) AS tracked_ms, round(coalesce(total_ms, 0) - ({' + '.join(f'coalesce({c}, 0)' for c in TRACKED)}), 3) AS untracked_ms FROM pages")
def tracked_time(spark, sf_dir):
    """Time of the tracked stages of a page, and what its total has beyond them. Serial, CPU and lock times overlap these."""
    t = sum((F.coalesce(c, F.lit(0.0)) for c in TRACKED[1:]), F.coalesce(TRACKED[0], F.lit(0.0)))
    return pages(spark, sf_dir).select("doc_id", "page_index", F.round(t, 3).alias("tracked_ms"), F.round(F.coalesce("total_ms", F.lit(0.0)) - t, 3).alias("untracked_ms"))


@R.query("latency_percentiles", f"WITH {REQ} SELECT case_name, {_summary_sql(_fin('latency_ms'))} FROM req GROUP BY case_name")
def latency_percentiles(spark, sf_dir):
    """Exact summary of latencies per case (the approximate one for any size is in the training-data subpackage)."""
    return summarised(requests(spark, sf_dir, "case_name", "latency_ms"), "case_name", {"": finite("latency_ms")})


@R.query("bench_summary", f"WITH {PAGES} SELECT page_index AS case_id, {', '.join(f'round(coalesce(CAST(sum(CAST(floor({c} * 1000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) / CAST(count({c}) AS DOUBLE) / 1000.0::DOUBLE, 0), 9) AS mean_{c}' for c in STAGES)}, {_summary_sql('total_ms', 'total_')} FROM pages GROUP BY page_index")
def bench_summary(spark, sf_dir):
    """Mean stage times and page latency by case; the page position stands for the case."""
    return bench_figures(pages(spark, sf_dir))


def bench_figures(rows: DataFrame) -> DataFrame:
    rows = rows.withColumnRenamed("page_index", "case_id")
    means = rows.groupBy(F.col("case_id").alias("_c")).agg(*[F.round(F.coalesce(F.try_divide(F.sum(F.floor(F.col(c) * 1000.0 + 0.5).cast("long")), F.count(c)) / 1000.0, F.lit(0.0)), 9).alias("mean_" + c) for c in STAGES])  # summed as whole microseconds, so in any order the same
    return means.join(summarised(rows, "case_id", {"total_": F.col("total_ms")}), F.col("_c").eqNullSafe(F.col("case_id"))).drop("_c")


@R.query("latency_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def latency_windows(spark, sf_dir):
    """Tumbling hours over the event log."""
    return load(spark, sf_dir, "events", "ts", "event_type", "value").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def shard_figures(req: DataFrame) -> DataFrame:
    """Requests, busy time and mean accelerator time of each shard."""
    return req.groupBy("shard_id").agg(
        F.count("*").alias("request_count"), F.count_if("failed").alias("errors"), F.sum(to_us("pipeline_call_ms")).alias("busy_us"), F.sum(to_us("npu_serial_ms")).alias("npu_busy_us"), F.sum(to_us("route_queue_ms")).alias("route_queue_us")
    ).withColumn("avg_infer_ms", F.round(F.coalesce(F.try_divide(F.col("npu_busy_us"), F.col("request_count")) / 1000.0, F.lit(0.0)), 6))


SHARDS_CTE = f"""{REQ}, sh AS (SELECT shard_id, count(*) AS request_count, count(*) FILTER (WHERE failed) AS errors, CAST(sum({_us('pipeline_call_ms')}) AS BIGINT) AS busy_us, CAST(sum({_us('npu_serial_ms')}) AS BIGINT) AS npu_busy_us, CAST(sum({_us('route_queue_ms')}) AS BIGINT) AS route_queue_us FROM req GROUP BY shard_id)"""
SHARD_COLUMNS = ("shard_id", "failed", "pipeline_call_ms", "npu_serial_ms", "route_queue_ms")


@R.query("shard_status", f"WITH {SHARDS_CTE} SELECT s.shard_id, s.device_id, s.topology, coalesce(request_count, 0) AS request_count, coalesce(errors, 0) AS errors, coalesce(busy_us, 0) AS busy_us, coalesce(npu_busy_us, 0) AS npu_busy_us, coalesce(route_queue_us, 0) AS route_queue_us, round(coalesce(npu_busy_us / CAST(request_count AS DOUBLE) / 1000.0::DOUBLE, 0), 6) AS avg_infer_ms FROM shards s LEFT JOIN sh USING (shard_id)")
def shard_status(spark, sf_dir):
    """Every configured shard with its counters; a shard without requests has zeros."""
    shards = load(spark, sf_dir, "shards", "shard_id", "device_id", "topology")
    figures = shard_figures(requests(spark, sf_dir, *SHARD_COLUMNS))
    cols = [c for c in figures.columns if c != "shard_id"]
    return shards.join(figures, "shard_id", "left").select("shard_id", "device_id", "topology", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


@R.query("lock_stats", f"WITH {PAGES} SELECT count(*) AS samples, " + ", ".join(f"CAST(sum({_us(c)}) AS BIGINT) AS {n}_total_us, max({_us(c)}) AS {n}_max_us, round(sum({_us(c)}) / CAST(count(*) AS DOUBLE) / 1000.0::DOUBLE, 6) AS {n}_avg_ms" for c, n in (("npu_lock_wait_ms", "wait"), ("npu_lock_hold_ms", "hold"))) + " FROM pages")
def lock_stats(spark, sf_dir):
    """Waiting for and holding of the accelerator lock, in whole microseconds."""
    out = []
    for c, n in (("npu_lock_wait_ms", "wait"), ("npu_lock_hold_ms", "hold")):
        out += [F.sum(to_us(c)).alias(f"{n}_total_us"), F.max(to_us(c)).alias(f"{n}_max_us"), F.round(F.sum(to_us(c)) / F.count("*") / 1000.0, 6).alias(f"{n}_avg_ms")]
    return pages(spark, sf_dir).agg(F.count("*").alias("samples"), *out)


def spread_ratio(value: Column) -> Column:
    """Largest over smallest of a group: 1 for fewer than two, infinite where only the smallest is 0."""
    lo, hi = F.min(value), F.max(value)
    return F.when(F.count(value) < 2, F.lit(1.0)).when(lo <= 0, F.when(hi > 0, F.lit(float("inf"))).otherwise(1.0)).otherwise(F.try_divide(hi, lo))


@R.query("load_imbalance", f"""WITH {SHARDS_CTE}, r AS (SELECT count(*) AS active_shards, round(max(request_count) / CAST(min(request_count) AS DOUBLE), 9) AS request_ratio, round(max(busy_us) / CAST(min(busy_us) AS DOUBLE), 9) AS busy_ratio FROM sh WHERE request_count > 0 OR busy_us > 0)
    SELECT *, request_ratio > {IMBALANCE} OR busy_ratio > {IMBALANCE} AS imbalanced FROM r""")
def load_imbalance(spark, sf_dir):
    """Whether requests or busy time are spread unevenly over the active shards."""
    active = shard_figures(requests(spark, sf_dir, *SHARD_COLUMNS)).where("request_count > 0 OR busy_us > 0")
    out = active.agg(F.count("*").alias("active_shards"), F.round(spread_ratio(F.col("request_count")), 9).alias("request_ratio"), F.round(spread_ratio(F.col("busy_us")), 9).alias("busy_ratio"))
    return out.withColumn("imbalanced", (F.col("request_ratio") > IMBALANCE) | (F.col("busy_ratio") > IMBALANCE))


@R.query("fleet_status", f"""WITH {SHARDS_CTE} SELECT s.topology, count(DISTINCT s.device_id) AS devices, count(*) AS shards, CAST(sum(request_count) AS BIGINT) AS requests, CAST(sum(request_count) - sum(errors) AS BIGINT) AS success, CAST(sum(errors) AS BIGINT) AS errors, max(busy_us) AS busiest_us, round(sum(npu_busy_us) / CAST(sum(request_count) AS DOUBLE) / 1000.0::DOUBLE, 6) AS weighted_infer_ms
    FROM shards s JOIN sh USING (shard_id) GROUP BY s.topology""")
def fleet_status(spark, sf_dir):
    """Backends of a topology as one: sums, the largest maximum, averages weighted by requests."""
    shards = load(spark, sf_dir, "shards", "shard_id", "device_id", "topology")
    both = shards.join(shard_figures(requests(spark, sf_dir, *SHARD_COLUMNS)), "shard_id")
    return both.groupBy("topology").agg(
        F.countDistinct("device_id").alias("devices"), F.count("*").alias("shards"), F.sum("request_count").alias("requests"), (F.sum("request_count") - F.sum("errors")).alias("success"), F.sum("errors").alias("errors"),
        F.max("busy_us").alias("busiest_us"), F.round(F.try_divide(F.sum("npu_busy_us"), F.sum("request_count")) / 1000.0, 6).alias("weighted_infer_ms"),
    )


@R.query("request_counters", f"WITH {REQ} SELECT CAST(ts AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE NOT failed) AS success, count(*) FILTER (WHERE failed) AS errors, CAST(sum(page_count) AS BIGINT) AS pages FROM req GROUP BY ALL")
def request_counters(spark, sf_dir):
    return requests(spark, sf_dir, "ts", "failed", "page_count").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.count_if(~F.col("failed")).alias("success"), F.count_if("failed").alias("errors"), F.sum("page_count").alias("pages"))


WAVES_CTE = f"""{REQ}, wv AS (SELECT s.topology, CAST(r.ts AS DATE) AS wave, r.* FROM req r JOIN shards s USING (shard_id)),
thr AS (SELECT topology, wave, count(*) AS requests, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000.0::DOUBLE AS elapsed_ms FROM wv GROUP BY topology, wave),
qps AS (SELECT *, CASE WHEN elapsed_ms > 0 THEN requests * 1000.0::DOUBLE / elapsed_ms ELSE 0 END AS qps FROM thr)"""


def throughput(req: DataFrame, by: list[str]) -> DataFrame:
    """Requests, elapsed time and requests per second of each wave; 0 where no time went by."""
    elapsed = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1000.0
    out = req.groupBy(*by).agg(F.count("*").alias("requests"), elapsed.alias("elapsed_ms"))
    return out.withColumn("qps", F.when(F.col("elapsed_ms") > 0, F.col("requests") * 1000.0 / F.col("elapsed_ms")).otherwise(0.0))


def _waves(spark, sf_dir, *columns):
    shards = load(spark, sf_dir, "shards", "shard_id", "topology", "device_id")
    return requests(spark, sf_dir, "ts", "shard_id", *columns).join(F.broadcast(shards), "shard_id").withColumn("wave", F.to_date("ts"))  # shards: a fixed table of 8


@R.query("wave_throughput", f"WITH {WAVES_CTE} SELECT topology, wave, requests, round(elapsed_ms, 3) AS elapsed_ms, round(qps, 9) AS qps FROM qps")
def wave_throughput(spark, sf_dir):
    return throughput(_waves(spark, sf_dir), ["topology", "wave"]).select("topology", "wave", "requests", F.round("elapsed_ms", 3).alias("elapsed_ms"), F.round("qps", 9).alias("qps"))


@R.query("wave_summary", f"WITH {REQ}, wv AS (SELECT s.topology, r.* FROM req r JOIN shards s USING (shard_id)) SELECT topology, " + ", ".join(_summary_sql(_fin(c), c + "_") for c in TIMINGS) + " FROM wv GROUP BY topology")
def wave_summary(spark, sf_dir):
    """Exact summaries of the six timings per topology."""
    return summarised(_waves(spark, sf_dir, *TIMINGS), "topology", {c + "_": finite(c) for c in TIMINGS})


SCALING_CTE = f"""{REQ}, dv AS (SELECT s.device_id AS dev, r.ts FROM req r JOIN shards s USING (shard_id) WHERE s.device_id IS NOT NULL), steps AS (SELECT unnest([1, 2, 3]) AS devices),
pick AS (SELECT dev, dense_rank() OVER (ORDER BY dev) AS nth, ts FROM dv), sc AS (SELECT devices, count(*) AS requests FROM steps JOIN pick ON nth <= devices GROUP BY devices),
eff AS (SELECT devices, requests, round(requests / CAST((SELECT requests FROM sc WHERE devices = 1) AS DOUBLE), 9) AS speedup, round(requests / CAST((SELECT requests FROM sc WHERE devices = 1) AS DOUBLE) / devices, 9) AS efficiency FROM sc)"""


def scaling(spark, sf_dir) -> DataFrame:
    """Requests served by the first one, two and three devices over the same span, speedup and efficiency against one."""
    shards = load(spark, sf_dir, "shards", "shard_id", "device_id").where("device_id IS NOT NULL")
    ranked = shards.withColumn("nth", F.dense_rank().over(Window.orderBy("device_id"))).drop("device_id")  # a fixed table of 8
    served = requests(spark, sf_dir, "shard_id").join(F.broadcast(ranked), "shard_id").groupBy("nth").count()
    steps = served.select(F.explode(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda d: d >= F.col("nth"))).alias("devices"), "count").groupBy("devices").agg(F.sum("count").alias("requests"))
    base = F.max(F.when(F.col("devices") == 1, F.col("requests"))).over(Window.partitionBy())  # three rows
    out = steps.withColumn("speedup", F.try_divide(F.col("requests"), base))
    return out.select("devices", "requests", F.round("speedup", 9).alias("speedup"), F.round(F.col("speedup") / F.col("devices"), 9).alias("efficiency"))


@R.query("scaling_efficiency", f"WITH {SCALING_CTE} SELECT * FROM eff")
def scaling_efficiency(spark, sf_dir):
    return scaling(spark, sf_dir)


@R.query("topology_rank", f"WITH {WAVES_CTE}, m AS (SELECT topology, (SELECT count(DISTINCT device_id) FROM shards s WHERE s.topology = qps.topology) AS devices, round(avg(qps), 9) AS mean_qps FROM qps GROUP BY topology) SELECT *, CAST(row_number() OVER (ORDER BY devices DESC, mean_qps DESC, topology = 'B' DESC) AS INT) AS place FROM m")
def topology_rank(spark, sf_dir):
    """Topologies by devices, then mean requests per second; B before others on a tie."""
    shards = load(spark, sf_dir, "shards", "device_id", "topology").groupBy("topology").agg(F.countDistinct("device_id").alias("devices"))
    mean = throughput(_waves(spark, sf_dir), ["topology", "wave"]).groupBy("topology").agg(F.round(F.avg("qps"), 9).alias("mean_qps"))
    w = Window.orderBy(F.col("devices").desc(), F.col("mean_qps").desc(), (F.col("topology") == "B").desc())  # a row each topology
    return mean.join(shards, "topology").withColumn("place", F.row_number().over(w))


PARTS = ("route_queue_ms", "npu_lock_wait_ms", "npu_serial_ms", "cpu_only_ms")


@R.query("bottlenecks", f"WITH {REQ}, dv AS (SELECT s.device_id AS dev, r.* FROM req r JOIN shards s USING (shard_id) WHERE s.device_id IS NOT NULL), b AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, avg({_fin(c)}) AS mean_ms, avg(CASE WHEN dev = (SELECT min(dev) FROM dv) THEN {_fin(c)} END) AS first_ms FROM dv" for c in PARTS) + ") SELECT name, round(mean_ms, 6) AS mean_ms, round(mean_ms - first_ms, 6) AS delta_ms, CAST(row_number() OVER (ORDER BY mean_ms DESC, mean_ms - first_ms DESC) AS INT) AS place FROM b")
def bottlenecks(spark, sf_dir):
    """Parts of a request by their mean time, with the difference to the first device alone."""
    r = _waves(spark, sf_dir, *PARTS).where("device_id IS NOT NULL")
    first = load(spark, sf_dir, "shards", "device_id").agg(F.min("device_id").alias("first_device"))
    r = r.join(F.broadcast(first))  # one row
    stats = r.agg(*[F.avg(finite(c)).alias("m_" + c) for c in PARTS], *[F.avg(F.when(F.col("device_id") == F.col("first_device"), finite(c))).alias("f_" + c) for c in PARTS])
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col("m_" + c).alias("mean_ms"), (F.col("m_" + c) - F.col("f_" + c)).alias("delta_ms")) for c in PARTS])).alias("x")).select("x.*")
    w = Window.orderBy(F.col("mean_ms").desc(), F.col("delta_ms").desc())  # a row each part
    return long.withColumn("place", F.row_number().over(w)).select("name", F.round("mean_ms", 6).alias("mean_ms"), F.round("delta_ms", 6).alias("delta_ms"), "place")


@R.query("pages_per_second", f"WITH {REQ} SELECT case_name, grouping(case_name) = 1 AS is_total, count(*) AS files, CAST(sum(page_count) AS BIGINT) AS pages, round(sum({_fin('latency_ms')}) / 1000.0::DOUBLE, 3) AS seconds, round(CASE WHEN sum({_fin('latency_ms')}) > 0 THEN sum(page_count) / (sum({_fin('latency_ms')}) / 1000.0::DOUBLE) END, 6) AS pages_per_s FROM req GROUP BY ROLLUP (case_name)")
def pages_per_second(spark, sf_dir):
    """Pages per second of each case and, as the rollup's row, of all."""
    t = F.sum(finite("latency_ms")) / 1000.0
    return requests(spark, sf_dir, "case_name", "page_count", "latency_ms").rollup("case_name").agg((F.grouping("case_name") == 1).alias("is_total"), F.count("*").alias("files"), F.sum("page_count").alias("pages"), F.round(t, 3).alias("seconds"), F.round(F.when(t > 0, F.sum("page_count") / t), 6).alias("pages_per_s"))


@R.query("least_inflight_route", f"""WITH {REQ}, c AS (SELECT r.request_id, s.shard_id, CAST((s.shard_id * 31 + r.request_id * 7) % 5 AS INT) AS inflight, CAST((s.shard_id - r.request_id % n + n) % n AS INT) AS distance FROM req r, shards s, (SELECT count(DISTINCT shard_id) AS n FROM shards)),
    k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY inflight, distance) AS rn FROM c) SELECT request_id, shard_id AS routed_to, inflight FROM k WHERE rn = 1""")
def least_inflight_route(spark, sf_dir):
    """Shard with the fewest requests in flight, searched round-robin from the request's start; the load is a formula of request and shard. No join: the candidates are an array."""
    r = requests(spark, sf_dir)
    ids = sorted(x[0] for x in load(spark, sf_dir, "shards", "shard_id").where("shard_id IS NOT NULL").distinct().collect())  # a fixed table of 8
    n, shard = max(1, len(ids)), F.array(*map(F.lit, ids)).cast("array<int>")
    options = F.transform(shard, lambda s: F.struct(F.pmod(s * 31 + F.col("request_id") * 7, F.lit(5)).cast("int").alias("inflight"), F.pmod(s - F.col("request_id") % n + n, F.lit(n)).cast("int").alias("distance"), s.alias("shard_id")))
    return r.select("request_id", F.array_min(options).alias("best")).select("request_id", F.col("best.shard_id").alias("routed_to"), F.col("best.inflight").alias("inflight"))


@R.query("scaling_verdict", f"WITH {SCALING_CTE}, e AS (SELECT max(CASE WHEN devices = 2 THEN efficiency END) AS e2, max(CASE WHEN devices = 3 THEN efficiency END) AS e3 FROM eff) SELECT e2, e3, CASE WHEN e2 IS NULL OR e3 IS NULL THEN 'blocked' WHEN e2 >= 0.75 AND e3 >= 0.60 THEN 'scales' WHEN e2 > 0 OR e3 > 0 THEN 'partly' ELSE 'no' END AS verdict FROM e")
def scaling_verdict(spark, sf_dir):
    """Whether two and three devices are used well enough (0.75 and 0.60)."""
    e = scaling(spark, sf_dir).agg(F.max(F.when(F.col("devices") == 2, F.col("efficiency"))).alias("e2"), F.max(F.when(F.col("devices") == 3, F.col("efficiency"))).alias("e3"))
    return e.withColumn("verdict", F.when(F.col("e2").isNull() | F.col("e3").isNull(), "blocked").when((F.col("e2") >= 0.75) & (F.col("e3") >= 0.60), "scales").when((F.col("e2") > 0) | (F.col("e3") > 0), "partly").otherwise("no"))


@R.query("late_results", f"WITH {REQ} SELECT request_id, epoch_us(received_at) - epoch_us(ts) AS delay_us, epoch_us(received_at) - epoch_us(ts) > 30000000 AS timed_out, request_id < max(request_id) OVER () - 4096 AS prunable FROM req")
def late_results(spark, sf_dir):
    """Batch form of matching results to waiting tasks: delay, the 30 s timeout, and ids old enough to forget."""
    r = requests(spark, sf_dir, "ts", "received_at")
    last = r.agg(F.max("request_id").alias("last_id"))
    delay = F.unix_micros("received_at") - F.unix_micros("ts")
    return r.join(F.broadcast(last)).select("request_id", delay.alias("delay_us"), (delay > 30_000_000).alias("timed_out"), (F.col("request_id") < F.col("last_id") - 4096).alias("prunable"))  # one row


#: Stages that make up the tracked time of a page; a table that doesn't record one counts it as 0.
TRACKED_STAGES = ("layout_ms", "ocr_ms", "table_ms", "figure_ms", "formula_ms", "unsupported_ms", "reading_order_ms")


def tracked(rows: DataFrame) -> Column:
    """Sum of the tracked stages of a page; serial, CPU and lock times overlap these and stay out."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in TRACKED_STAGES if c in rows.columns), F.lit(0.0))


@R.query("document_tracked_time", f"""WITH {PAGES}, d AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS pages, CAST(sum({_us('layout_ms')} + {_us('ocr_ms')} + {_us('table_ms')}) AS BIGINT) AS stage_us FROM pages GROUP BY doc_id),
    o AS (SELECT DISTINCT doc_id, total_pages * 1000 + doc_id % 7 * 10 AS render_us, doc_id % 11 * 100 AS output_us FROM parse_jobs) SELECT doc_id, pages, stage_us, render_us, output_us, stage_us + coalesce(render_us, 0) + coalesce(output_us, 0) AS tracked_us FROM d LEFT JOIN o USING (doc_id)""")
def document_tracked_time(spark, sf_dir):
    """Tracked time of documents. Rendering and output are known for documents alone; they are kept when pages are summed again. Their times are formulas of the job."""
    by_doc = pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(to_us("layout_ms") + to_us("ocr_ms") + to_us("table_ms")).alias("stage_us"))
    own = load(spark, sf_dir, "parse_jobs", "doc_id", "total_pages").distinct().select("doc_id", (F.col("total_pages") * 1000 + F.col("doc_id") % 7 * 10).alias("render_us"), (F.col("doc_id") % 11 * 100).alias("output_us"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return by_doc.join(own, "doc_id", "left").withColumn("tracked_us", F.col("stage_us") + zero("render_us") + zero("output_us"))


@R.query("lock_stage_totals", f"WITH {PAGES} " + " UNION ALL ".join(f"SELECT '{c}' AS stage, count(*) FILTER (WHERE {_us(c)} > 0) AS samples, CAST(sum({_us(c)}) AS BIGINT) AS total_us, max({_us(c)}) AS max_us FROM pages" for c in STAGES))
def lock_stage_totals(spark, sf_dir):
    """Samples, total and longest time of each stage under the lock, in whole microseconds."""
    long = pages(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), to_us(c).alias("us")) for c in STAGES])).alias("x")).select("x.*")
    return long.groupBy("stage").agg(F.count_if(F.col("us") > 0).alias("samples"), F.sum("us").alias("total_us"), F.max("us").alias("max_us"))


@R.query("shard_inflight", f"WITH {REQ}, t AS (SELECT max(epoch_us(ts)) - 3600000000 AS now FROM req) SELECT shard_id, count(*) FILTER (WHERE epoch_us(ts) <= now AND epoch_us(ts) + {_us('latency_ms')} > now) AS inflight FROM req, t GROUP BY shard_id")
def shard_inflight(spark, sf_dir):
    """Requests of each shard that were running an hour before the last one came."""
    r = requests(spark, sf_dir, "shard_id", "ts", "latency_ms").withColumn("at", F.unix_micros("ts"))
    now = r.agg((F.max("at") - 3_600_000_000).alias("now"))
    running_ = (F.col("at") <= F.col("now")) & (F.col("at") + to_us("latency_ms") > F.col("now"))
    return r.join(F.broadcast(now)).groupBy("shard_id").agg(F.count_if(running_).alias("inflight"))  # one row


@R.query("fleet_devices", f"WITH {SHARDS_CTE} SELECT s.topology, s.device_id, count(*) AS shards, CAST(sum(coalesce(request_count, 0)) AS BIGINT) AS samples, CAST(max(coalesce(busy_us, 0)) AS BIGINT) AS busiest_us, CAST(max(coalesce(route_queue_us, 0)) AS BIGINT) AS longest_queue_us FROM shards s LEFT JOIN sh USING (shard_id) GROUP BY ALL")
def fleet_devices(spark, sf_dir):
    """The devices of all backends as one list, with samples and the largest of their shards' figures."""
    return shard_status(spark, sf_dir).withColumn("route_queue_us", F.coalesce("route_queue_us", F.lit(0))).groupBy("topology", "device_id").agg(F.count("*").alias("shards"), F.sum("request_count").alias("samples"), F.max("busy_us").alias("busiest_us"), F.max("route_queue_us").alias("longest_queue_us"))


@R.query("result_matching", f"""WITH {REQ}, jb AS (SELECT request_id, min(submitted_at) AS first_result FROM (SELECT DISTINCT ON (doc_id) * FROM parse_jobs) GROUP BY request_id), last AS (SELECT max(request_id) AS last_id FROM req)
    SELECT r.request_id, epoch_us(j.first_result) - epoch_us(r.ts) AS wait_us, CASE WHEN j.request_id IS NULL THEN 'missing' WHEN epoch_us(j.first_result) < epoch_us(r.ts) THEN 'stale' WHEN epoch_us(j.first_result) - epoch_us(r.ts) > 30000000 THEN 'timed_out' ELSE 'matched' END AS outcome, r.request_id < last_id - 4096 AS pruned FROM req r LEFT JOIN jb j USING (request_id), last""")
def result_matching(spark, sf_dir):
    """Tasks (requests) with their first result (job) by id: matched, stale (before the task), timed out after 30 s, or missing; ids 4096 behind the last are forgotten."""
    tasks = requests(spark, sf_dir, "ts")
    results = load(spark, sf_dir, "parse_jobs", "doc_id", "request_id", "submitted_at").dropDuplicates(["doc_id"]).groupBy("request_id").agg(F.min("submitted_at").alias("first_result"), F.lit(True).alias("has"))
    last = tasks.agg(F.max("request_id").alias("last_id"))
    wait = F.unix_micros("first_result") - F.unix_micros("ts")
    outcome = F.when(F.col("has").isNull(), "missing").when(wait < 0, "stale").when(wait > 30_000_000, "timed_out").otherwise("matched")
    return tasks.join(results, "request_id", "left").join(F.broadcast(last)).select("request_id", wait.alias("wait_us"), outcome.alias("outcome"), (F.col("request_id") < F.col("last_id") - 4096).alias("pruned"))  # one row


@R.query("task_ids", f"WITH {REQ} SELECT request_id, row_number() OVER (ORDER BY ts, request_id) - 1 AS task_id FROM req")
def task_ids(spark, sf_dir):
    """Dense ids that rise in the order of arrival, numbered partition by partition."""
    return running(requests(spark, sf_dir, "ts"), [], ["ts", "request_id"], into="task_id").select("request_id", "task_id")


@R.query("bench_cases", f"WITH {PAGES}, c AS (SELECT unnest(['single_page', 'multi_page', 'ocr_only', 'table_heavy', 'full_chain']) AS case_name), t AS (SELECT c.case_name, p.doc_id, sum(CASE c.case_name WHEN 'ocr_only' THEN {_us('layout_ms')} + {_us('ocr_ms')} WHEN 'table_heavy' THEN {_us('layout_ms')} + {_us('table_ms')} WHEN 'full_chain' THEN {_us('layout_ms')} + {_us('ocr_ms')} + {_us('table_ms')} ELSE {_us('layout_ms')} END) AS us, count(*) AS pages FROM pages p, c WHERE CASE c.case_name WHEN 'single_page' THEN p.page_index = 0 WHEN 'full_chain' THEN p.page_index < 2 ELSE true END GROUP BY ALL) SELECT case_name, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(min(us) AS BIGINT) AS min_us, CAST(max(us) AS BIGINT) AS max_us, round(sum(us) / CAST(count(*) AS DOUBLE), 6) AS mean_us FROM t GROUP BY case_name")
def bench_cases(spark, sf_dir):
    """The five bench cases over recorded pages: layout of the first page, of all pages, with text, with tables, and the whole chain on two pages."""
    layout, ocr, table = to_us("layout_ms"), to_us("ocr_ms"), to_us("table_ms")
    first, two = F.col("page_index") == 0, F.col("page_index") < 2
    cases = {"single_page": F.when(first, layout), "multi_page": layout, "ocr_only": layout + ocr, "table_heavy": layout + table, "full_chain": F.when(two, layout + ocr + table)}
    long = pages(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("case_name"), v.alias("us")) for k, v in cases.items()])).alias("x")).select("doc_id", "x.*").where("us IS NOT NULL")
    per = long.groupBy("case_name", "doc_id").agg(F.sum("us").alias("us"), F.count("*").alias("pages"))
    return per.groupBy("case_name").agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.min("us").alias("min_us"), F.max("us").alias("max_us"), F.round(F.sum("us") / F.count("*"), 6).alias("mean_us"))


def _report_rows(rows: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))


@R.query("topology_report", f"""WITH {SCALING_CTE}, wv AS (SELECT s.topology, CAST(r.ts AS DATE) AS wave FROM req r JOIN shards s USING (shard_id)), w AS (SELECT topology, count(DISTINCT wave) AS waves, count(*) AS requests FROM wv GROUP BY topology),
    sd AS (SELECT topology, count(*) AS shards FROM shards GROUP BY topology), v AS (SELECT max(CASE WHEN devices = 2 THEN efficiency END) AS e2, max(CASE WHEN devices = 3 THEN efficiency END) AS e3 FROM eff)
    SELECT 'matrix' AS section, topology AS name, CAST(shards AS VARCHAR) AS value FROM sd UNION ALL SELECT 'waves', topology, CAST(waves AS VARCHAR) FROM w UNION ALL SELECT 'requests', topology, CAST(requests AS VARCHAR) FROM w UNION ALL SELECT 'scaling', CAST(devices AS VARCHAR), CAST(requests AS VARCHAR) FROM eff
    UNION ALL SELECT 'verdict', 'scaling', CASE WHEN e2 IS NULL OR e3 IS NULL THEN 'blocked' WHEN e2 >= 0.75 AND e3 >= 0.60 THEN 'scales' WHEN e2 > 0 OR e3 > 0 THEN 'partly' ELSE 'no' END FROM v""")
def topology_report(spark, sf_dir):
    """The report on topologies as rows (section, name, value): what was run, its waves and requests, scaling and the verdict."""
    sd = load(spark, sf_dir, "shards", "shard_id", "topology").groupBy("topology").agg(F.count("*").alias("shards"))
    w = _waves(spark, sf_dir).groupBy("topology").agg(F.countDistinct("wave").alias("waves"), F.count("*").alias("requests"))
    parts = [
        _report_rows(sd, "matrix", F.col("topology"), F.col("shards")), _report_rows(w, "waves", F.col("topology"), F.col("waves")), _report_rows(w, "requests", F.col("topology"), F.col("requests")),
        _report_rows(scaling(spark, sf_dir), "scaling", F.col("devices"), F.col("requests")), _report_rows(scaling_verdict(spark, sf_dir), "verdict", F.lit("scaling"), F.col("verdict")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bench_text(summary_rows: DataFrame) -> DataFrame:
    """Bench rows (case_name, documents, pages, min_us, max_us, mean_us) with a line of text and JSON of each."""
    ms = lambda c: F.format_string("%.3f ms", F.col(c) / 1000.0)
    text = F.concat("case_name", F.lit(": documents="), F.col("documents").cast("string"), F.lit(" pages="), F.col("pages").cast("string"), F.lit(" mean="), ms("mean_us"), F.lit(" min="), ms("min_us"), F.lit(" max="), ms("max_us"))
    return summary_rows.select("case_name", text.alias("text"), F.to_json(F.struct(*summary_rows.columns)).alias("json"))
