"""The service as functions over DataFrames: health, status, parsing of files, image annotation, and the figures of several backends.

Each takes rows of requests and gives rows of answers; an item that fails carries its error and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.operators import service
from leafwright.sources import files

SINGLE, MANY = "single_pipeline", "single_process_multi_device"


def resolve_shards(topology: str | None, devices: list[int], default: int = -1, found: Callable[[], list[int]] = list) -> tuple[str, list[tuple[str, int]]]:
    """Topology and (shard, device) list of a configuration: several devices make many of a single pipeline; devices count once, in order; without any, those found, else the default."""
    name = (topology or "").lower() or SINGLE
    if name == SINGLE and len(devices) > 1:
        name = MANY
    chosen = (devices or found() if name == MANY else devices[:1]) or [default]
    return name, [(f"shard_{i}", d) for i, d in enumerate(sorted(set(chosen)))]


Parse = Callable[[DataFrame], DataFrame]
#: What annotation requests may ask for.
FEATURES = ("TEXT_DETECTION", "DOCUMENT_TEXT_DETECTION")


def health(spark: SparkSession) -> dict:
    """Whether the session answers, and what runs."""
    return {"status": "healthy" if spark.range(1).count() == 1 else "unhealthy", "engine": "spark", "version": spark.version}


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.status(spark, sf_dir)


def no_text(files_: DataFrame) -> DataFrame:
    """The parser that stands in where no model is given: every file has no text."""
    return files_.select("path", F.lit("").alias("markdown"))


def process(requests: DataFrame, parse: Parse = no_text) -> DataFrame:
    """request_id, path, code, error, markdown for files (request_id, path, content): 200, or 400 for types and contents that can't be opened."""
    named = requests.withColumn("_at", F.concat_ws("/", F.col("request_id").cast("string"), "path"))
    seen = files.opened(named.select(F.col("_at").alias("path"), "content")).select(F.col("path").alias("_at"), "error")
    read = parse(named.select(F.col("_at").alias("path"), "content")).select(F.col("path").alias("_at"), "markdown")
    both = named.select("request_id", "path", "_at").join(seen, "_at", "left").join(read, "_at", "left")
    return both.select("request_id", "path", F.when(F.col("error").isNull(), 200).otherwise(400).alias("code"), "error", F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))).alias("markdown"))


def process_base64(requests: DataFrame, parse: Parse = no_text) -> DataFrame:
    """`process` for contents as base64 text."""
    return process(requests.withColumn("content", service.lenient_base64(F.col("content"))), parse)


def file_parse(requests: DataFrame, options: DataFrame | None = None, parse: Parse = no_text) -> DataFrame:
    """request_id, code, files, successful_files, results (JSON) of batches of files. The request succeeds even where all its files fail; each failure is an item.

    `options`: request_id and return_md; what isn't asked for is left out of the results.
    """
    got = process(requests, parse)
    got = got.join(options.select("request_id", "return_md"), "request_id", "left") if options is not None else got.withColumn("return_md", F.lit(True))
    item = F.struct("path", "code", "error", F.when(F.coalesce("return_md", F.lit(False)), F.col("markdown")).alias("md_content"))
    return got.groupBy("request_id").agg(F.lit(200).alias("code"), F.count("*").alias("files"), F.count_if(F.col("code") == 200).alias("successful_files"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("path", item.alias("v")))), lambda x: x["v"])).alias("results"))


def annotate(requests: DataFrame, parse: Parse = no_text, images: DataFrame | None = None) -> DataFrame:
    """request_id, position, code, status, markdown for items (request_id, position, feature, uri, content as base64): remote addresses are refused (403), unknown features, missing images and images that can't be opened are invalid (400).

    `images`: path and content of the files that local addresses may name, such as `files.documents` gives; an address that names none of them is missing.
    """
    remote = F.coalesce(F.col("uri").startswith("http://") | F.col("uri").startswith("https://"), F.lit(False))
    rows = requests.withColumn("bytes", service.lenient_base64(F.col("content")))
    if images is not None:
        plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
        found = images.dropDuplicates(["path"]).select(plain(F.col("path")).alias("_file"), F.col("content").alias("_read"))
        rows = rows.join(found, plain(F.col("uri")) == F.col("_file"), "left").withColumn("bytes", F.coalesce("bytes", "_read")).drop("_file", "_read")
    rows = rows.withColumn("code", F.when(~F.coalesce(F.col("feature").isin(*FEATURES), F.lit(False)), 400).when(F.col("content").isNull() & remote, 403).when(F.coalesce(F.length("bytes"), F.lit(0)) == 0, 400))
    path = F.concat_ws("/", F.col("request_id").cast("string"), F.concat(F.col("position").cast("string"), F.lit(".png")))
    good = process(rows.where("code IS NULL").select("request_id", path.alias("path"), F.col("bytes").alias("content")), parse).select(F.col("path").alias("_path"), F.col("code").alias("_code"), "markdown")
    out = rows.withColumn("_path", path).join(good, "_path", "left").withColumn("code", F.coalesce("code", "_code", F.lit(500)))
    name = F.when(F.col("code") == 200, "OK").when(F.col("code") == 403, "PERMISSION_DENIED").when(F.col("code") == 400, "INVALID_ARGUMENT").otherwise("INTERNAL")
    return out.select("request_id", "position", "code", name.alias("status"), "markdown")


def fleet(answers: DataFrame) -> DataFrame:
    """One row for backends' answers (backend, body as JSON): sums of requests, success and errors; a backend that didn't answer or not in JSON counts as failed, and the fleet is 502 where none answered."""
    parsed = F.from_json("body", "requests bigint, success bigint, errors bigint, per_device array<struct<shard_id:bigint,device_id:bigint,request_count:bigint>>")
    a = answers.withColumn("p", parsed).withColumn("ok", F.col("p.requests").isNotNull())
    return a.agg(F.count("*").alias("backends"), F.count_if(~F.col("ok")).alias("failed"), *[F.coalesce(F.sum(f"p.{k}"), F.lit(0)).alias(k) for k in ("requests", "success", "errors")], F.array_sort(F.flatten(F.collect_list("p.per_device"))).alias("per_device")).withColumn("code", F.when(F.col("failed") == F.col("backends"), 502).otherwise(200))  # a row for each backend
