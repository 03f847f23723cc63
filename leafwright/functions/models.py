"""Model stages as replaceable functions: detection, recognition, table recognition, rendering.

No weights ship with the engine. A stage is given as a function from bytes to rows that is
loaded once a worker; the defaults find nothing, as a stage without a model does.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTION = "array<struct<cls_id:int,score:float,x0:float,y0:float,x1:float,y1:float>>"
RECOGNITION = "array<struct<text:string,confidence:double,x0:int,y0:int,x1:int,y1:int>>"
TABLE = "struct<kind:string,supported:boolean,cells:array<struct<r:int,c:int,row_span:int,col_span:int,x0:float,y0:float,x1:float,y1:float,content:string>>>"


def stage(load: Callable[[], Callable[[bytes], object]], result: str) -> Callable:
    """An Arrow UDF image -> `result`; `load` is called once for each worker's stream of batches. Null images give null."""
    one = result.startswith("struct")  # travels as an array of one, as only arrays can be null here

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            yield pd.Series([None if b is None else [model(bytes(b))] if one else model(bytes(b)) for b in s], index=s.index, dtype=object)

    if not one:
        return F.pandas_udf(run, result)
    return lambda c: F.get(F.pandas_udf(run, f"array<{result}>")(c), F.lit(0))


def detect(images: DataFrame, load: Callable[[], Callable] = lambda: lambda _b: [], image: str = "content") -> DataFrame:
    return images.withColumn("detections", stage(load, DETECTION)(F.col(image)))


def recognise(crops: DataFrame, load: Callable[[], Callable] = lambda: lambda _b: [], image: str = "content") -> DataFrame:
    return crops.withColumn("ocr", stage(load, RECOGNITION)(F.col(image)))


def render(files: DataFrame, pages: Callable[[bytes, int, int], list[tuple[int, int, int, bytes]]], first: int = 0, last: int = -1) -> DataFrame:
    """path, page_index, width, height, image of each file; bounds go to the renderer, a file it can't open gives no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p.path, p.content):
                try:
                    rows += [(path, *x) for x in pages(bytes(content), first, last)]
                except Exception:  # noqa: BLE001  one bad file must not stop the others
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_index", "width", "height", "image"])

    return files.select("path", "content").mapInPandas(run, "path string, page_index int, width int, height int, image binary")


MODELS = {"layout": ("layout_backbone", "layout_decoder"), "wired_table": ("table_segmenter",), "ocr": ("ocr_folder", "ocr_dictionary")}


def missing_model(stages: dict[str, bool], paths: dict[str, str]) -> str:
    """What the first enabled stage lacks, in the order layout, tables, text; empty where all is there."""
    for name, needs in MODELS.items():
        for n in needs if stages.get(name, False) else ():
            if not os.path.exists(paths.get(n, "")):
                return f"{n} not found: {paths.get(n, '')}"
    return ""


def recognise_tables(crops: DataFrame, load: Callable[[], Callable] = lambda: lambda _b: None, image: str = "content") -> DataFrame:
    """Crops with `table`: its kind, whether it is supported, and its cells. Without a recogniser none is supported."""

    def guarded() -> Callable[[bytes], object]:
        model = load()
        return lambda b: model(b) or {"kind": "UNKNOWN", "supported": False, "cells": []}

    return crops.withColumn("table", stage(guarded, TABLE)(F.col(image)))


def two_stage(load: Callable[[], tuple[Callable[[bytes], dict], Callable[[dict], list] | None]], inputs: dict[str, tuple[str, ...]]) -> Callable[[], Callable[[bytes], list]]:
    """A detector of two stages: the first gives named outputs, which the second takes under the names of its inputs, each matched by a part of its name. Without a second stage nothing is found."""

    def joined() -> Callable[[bytes], list]:
        first, second = load()

        def run(b: bytes) -> list:
            if second is None:
                return []
            got = first(b)
            return second({name: next((v for k, v in got.items() if any(p in k for p in parts)), None) for name, parts in inputs.items()})

        return run

    return joined


def segment(images: DataFrame, load: Callable[[], Callable[[bytes], np.ndarray]], image: str = "content") -> DataFrame:
    """Images with `mask`: width, height and one byte a pixel of a segmentation, whatever integers the model gives."""

    def bytes_of() -> Callable[[bytes], object]:
        model = load()

        def run(b: bytes) -> dict:
            m = np.asarray(model(b)).astype(np.uint8)
            return {"width": m.shape[1], "height": m.shape[0], "pixels": m.tobytes()}

        return run

    return images.withColumn("mask", stage(bytes_of, "struct<width:int,height:int,pixels:binary>")(F.col(image)))


def split_phases(rows: DataFrame, device: Callable[[DataFrame], DataFrame], host: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The accelerator's part and then the host's, as two operators: the first can run on few executors while the second runs on all."""
    return host(device(rows))
