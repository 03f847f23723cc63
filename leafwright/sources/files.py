"""Files in and out: documents by suffix, workload manifests, numpy arrays, one file a document."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from email.parser import BytesParser
from email.policy import HTTP
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.functions import raster

MANIFEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])


def documents(spark: SparkSession, folder: str, suffixes: str = "*.{pdf,PDF,png,PNG,jpg,JPG,jpeg,bmp,tiff,tif}") -> DataFrame:
    """path, content and length of the documents in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffixes).load(folder).select("path", "length", "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A workload: name, path and request fields of each item."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def batch_of(items: DataFrame, size: int) -> DataFrame:
    """The manifest repeated in its order to `size` requests, named name_i."""
    rows = items.select("name", "path", "fields").collect()  # a manifest is a parameter file
    if not rows:
        return items.limit(0)
    spark = items.sparkSession
    return spark.createDataFrame([(f"{rows[i % len(rows)]['name']}_{i}", rows[i % len(rows)]["path"], rows[i % len(rows)]["fields"]) for i in range(size)], MANIFEST)


def page_count(content: bytes | None) -> int:
    """Pages of a document: those that a PDF's page tree or page objects name, one for an image, -1 for anything else or a PDF that is locked."""
    if not content:
        return -1
    data = bytes(content)
    if data.lstrip()[:5] != b"%PDF-":
        return 1 if raster.image_size(data) else -1
    if b"/Encrypt" in data:
        return -1
    plain = [data]
    for m in STREAM.finditer(data):  # object streams hold page objects too
        try:
            plain.append(zlib.decompress(m.group(1)))
        except zlib.error:
            continue
    counts = [int(a or b) for d in plain for a, b in TREE.findall(d)]
    return max(counts) if counts else sum(len(PAGE.findall(d)) for d in plain) or -1


STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
TREE, PAGE = re.compile(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|(?<!\w)/Count\s+(\d+)[^>]*?/Type\s*/Pages\b"), re.compile(rb"/Type\s*/Page\b(?!s)")


def opened(files: DataFrame) -> DataFrame:
    """path, kind, pages, width, height, scale, error of each file. An image is one page of its own size at scale 1; what can't be opened has -1 pages and an error, and doesn't stop the others."""
    from leafwright.operators.service import source_kind

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, kind, content in zip(p.path, p.kind, p.content):
                size = raster.image_size(bytes(content)) if kind == "image" and content is not None else None
                n = page_count(content) if kind != "error" else -1
                error = f"unsupported file type: {path}" if kind == "error" else "can't be opened" if n < 0 or (kind == "image" and not size) else None
                rows.append((path, kind, -1 if error else n, *(size or (None, None)), 1.0 if size else None, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "pages", "width", "height", "scale", "error"])

    named = files.select("path", source_kind(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("kind"), "content")
    return named.mapInPandas(run, "path string, kind string, pages int, width int, height int, scale double, error string")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """The PDF files of a folder in the order of their names, each with its pages or its error."""
    return opened(documents(spark, path, "*.pdf")).orderBy("path")


def uploads(bodies: DataFrame) -> DataFrame:
    """Parts of multipart requests (request_id, content_type, body): name, filename, content of each, files before single files, each in the order sent; a body that isn't multipart has an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for rid, kind, body in zip(p.request_id, p.content_type, p.body):
                try:
                    got = list(BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + (kind or "").encode() + b"\r\n\r\n" + bytes(body or b"")).iter_parts())
                except Exception as e:  # noqa: BLE001
                    rows.append((rid, 0, None, None, None, str(e)[:200] or "not multipart"))
                    continue
                if not got:
                    rows.append((rid, 0, None, None, None, "not multipart"))
                named = [(x.get_param("name", header="content-disposition"), x.get_filename(), x.get_payload(decode=True)) for x in got]
                order = sorted(range(len(named)), key=lambda i: ({"files": 0, "file": 1}.get(named[i][0], 2), i))
                rows += [(rid, k, *named[i], None) for k, i in enumerate(order)]
            yield pd.DataFrame(rows, columns=["request_id", "part", "name", "filename", "content", "error"])

    return bodies.select("request_id", "content_type", "body").mapInPandas(run, "request_id bigint, part int, name string, filename string, content binary, error string")


def fields(parts: DataFrame) -> DataFrame:
    """The first value of each field of a request, and all of them where it is repeated."""
    text = parts.where("filename IS NULL AND name IS NOT NULL").groupBy("request_id", "name").agg(F.array_sort(F.collect_list(F.struct("part", F.col("content").cast("string").alias("v")))).alias("vs"))
    return text.select("request_id", "name", F.col("vs")[0]["v"].alias("value"), F.transform("vs", lambda x: x["v"]).alias("values"))


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSON file that holds an array or one object over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def crops(pages: DataFrame) -> DataFrame:
    """path and content of PNG files cut from pages (path, width, height, pixels as BGR bytes, x0, y0, x1, y1); boxes off the page give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, w, h, pixels, *box in p.itertuples(index=False):
                image = np.frombuffer(bytes(pixels), dtype=np.uint8).reshape(h, w, 3) if pixels is not None and len(pixels) == w * h * 3 else None
                cut_out = raster.crop(image, tuple(box)) if image is not None and all(b is not None for b in box) else None
                if cut_out is not None:
                    rows.append((path, raster.png(cut_out)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return pages.select("path", "width", "height", "pixels", "x0", "y0", "x1", "y1").mapInPandas(run, "path string, content binary")


def overlays(pages: DataFrame) -> DataFrame:
    """path and content of PNG files of pages with their boxes (array of struct cls_id, x0, y0, x1, y1) drawn in, each class in its colour."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, w, h, pixels, boxes in p.itertuples(index=False):
                image = np.frombuffer(bytes(pixels), dtype=np.uint8).reshape(h, w, 3)
                for b in boxes if boxes is not None else ():
                    k = b["cls_id"]
                    image = raster.overlay(image, (b["x0"], b["y0"], b["x1"], b["y1"]), (k * 37 % 255, k * 67 % 255, k * 97 % 255))
                rows.append((path, raster.png(image)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return pages.select("path", "width", "height", "pixels", "boxes").mapInPandas(run, "path string, content binary")


def clean_up(spark: SparkSession, folder_: str) -> bool:
    """Delete the outputs of a request, on whatever file system they are; whether there were any."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder_)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrays(files: DataFrame) -> DataFrame:
    """path, shape, dtype and values (row by row, as doubles) of numpy files; a file that isn't one has nulls and an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p.path, p.content):
                try:
                    a = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                    rows.append((path, list(a.shape), str(a.dtype), a.astype(float).ravel(order="C").tolist(), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "values", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, shape array<bigint>, dtype string, values array<double>, error string")


def write_each(df: DataFrame, path: str, content: str) -> None:
    """Write each row's `content` to the file that its `path` names. For a folder all executors share."""

    def save(rows) -> None:
        for r in rows:
            to = Path(r[path])
            to.parent.mkdir(parents=True, exist_ok=True)
            data = r[content]
            to.write_bytes(bytes(data) if isinstance(data, (bytes, bytearray)) else (data or "").encode())

    df.select(path, content).foreachPartition(save)


def kinds(files: DataFrame) -> DataFrame:
    """Files with their kind by suffix: pdf, image, or an error as a column."""
    from leafwright.operators.service import source_kind

    s = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return files.withColumn("kind", source_kind(s)).withColumn("error", F.when(F.col("kind") == "error", F.concat(F.lit("unsupported file type: "), s)))
