"""Model stages with stand-ins, streams, configuration, and a table from pixels to grid."""

import time
from datetime import datetime, timedelta, timezone

import numpy as np
from leafwright import api
from leafwright.functions import models, raster
from leafwright.operators import metrics, pageplan, stats, tables
from leafwright.streaming import matching
from leafwright.streaming.progress import Progress


def test_table_from_pixels_to_grid():
    mask = np.zeros((240, 320), dtype=bool)
    for y in (0, 80, 160, 238):
        mask[y : y + 2] = True
    for x in (0, 100, 200, 318):
        mask[:, x : x + 2] = True
    mask[2:80, 100:102] = False  # the first row's first two cells are one
    box = raster.cell_box(raster.cells(mask))
    got = {tuple(r) for r in tables.recover_grid(box).tolist()}
    assert got == {(0, 0, 1, 2), (0, 2, 1, 1), *((r, c, 1, 1) for r in (1, 2) for c in range(3))}


def test_stages_with_stand_ins(spark):
    df = spark.createDataFrame([(1, b"ab"), (2, None)], "i int, content binary")
    got = {r.i: r for r in models.detect(models.recognise(df, lambda: lambda b: [(b.decode(), 0.5, 0, 0, 1, 1)]), lambda: lambda b: [(2, 0.9, 0.0, 0.0, float(len(b)), 1.0)]).collect()}
    assert got[1].ocr[0].text == "ab" and got[1].detections[0].x1 == 2.0 and got[2].ocr is None
    t = {r.i: r.table for r in models.recognise_tables(df).collect()}
    assert t[1].supported is False and t[1].cells == [] and t[2] is None
    load = models.two_stage(lambda: (lambda b: {"x_concat_1": len(b), "layer_norm_2": 3, "im_shape": 1}, lambda d: [(d["a"], float(d["b"]), 0.0, 0.0, 1.0, 1.0)]), {"a": ("concat",), "b": ("layer_norm",)})
    assert models.detect(df.where("i = 1"), load).first().detections[0].cls_id == 2
    assert models.detect(df.where("i = 1"), models.two_stage(lambda: (dict, None), {})).first().detections == []
    m = models.segment(df.where("i = 1"), lambda: lambda b: np.array([[0, 1], [2, 300]], dtype=np.int64)).first().mask
    assert (m.width, m.height, bytes(m.pixels)) == (2, 2, bytes([0, 1, 2, 44]))
    assert models.split_phases(df, lambda d: d.where("i = 1"), lambda d: d.select("i")).collect()[0].i == 1


def test_missing_models(tmp_path):
    (tmp_path / "m").write_text("x")
    there = {k: str(tmp_path / "m") for ks in models.MODELS.values() for k in ks}
    on = dict.fromkeys(models.MODELS, True)
    assert models.missing_model(on, there) == ""
    assert models.missing_model(on, there | {"layout_decoder": "no", "ocr_folder": "no"}).startswith("layout_decoder")
    assert models.missing_model({"ocr": False, "layout": False}, {}) == ""


def test_topologies():
    assert api.resolve_shards(None, []) == ("single_pipeline", [("shard_0", -1)])
    assert api.resolve_shards("Single_Pipeline", [3, 1, 3]) == ("single_process_multi_device", [("shard_0", 1), ("shard_1", 3)])
    assert api.resolve_shards("single_process_multi_device", [], 0, lambda: [2, 1]) == ("single_process_multi_device", [("shard_0", 1), ("shard_1", 2)])
    assert api.resolve_shards("other", [5, 4]) == ("other", [("shard_0", 5)])


def test_last_sample_and_progress(spark, tmp_path):
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(1, t, 5), (1, t + timedelta(milliseconds=200), 9), (1, t + timedelta(milliseconds=400), 7), (2, t, None)]
    spark.createDataFrame(rows, "device_id int, ts timestamp, used_bytes bigint").write.parquet(str(tmp_path / "in"))
    seen = []
    listener = Progress(lambda name, batch, n: seen.append((name, n)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("device_id int, ts timestamp, used_bytes bigint").parquet(str(tmp_path / "in"))
        got = {r.device_id: (r.last_used, r.peak_used) for r in matching.run_to_files(matching.last_sample(stream), ["device_id"], str(tmp_path / "out")).collect()}
        for _ in range(100):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert got == {1: (7, 9), 2: (None, None)} and sum(n for _name, n in seen) == 4


def test_a_stream_started_afresh_counts_afresh(spark, tmp_path):
    spark.createDataFrame([(1, datetime(2024, 1, 1, tzinfo=timezone.utc), 5)], "device_id int, ts timestamp, used_bytes bigint").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("device_id int, ts timestamp, used_bytes bigint").parquet(str(tmp_path / "in"))
    for name in ("a", "b"):
        assert matching.run_to_files(matching.last_sample(read()), ["device_id"], str(tmp_path / name)).count() == 1


BOX = "page_id bigint, box_index int, label string, category string, score_m int, x0 int, y0 int, x1 int, y1 int"
TABLE = "page_id bigint, box_index int, supported boolean, kind string, illegal boolean, empty_html boolean, html string"


def test_page_plan(spark):
    boxes = [(1, 0, "doc_title", "title", 900, 0, 0, 50, 20), (1, 1, "text", "text", 800, 500, 0, 600, 20), (1, 2, "image", "figure", 800, 500, 0, 600, 9), (1, 3, "image", "figure", 800, 10, 30, 60, 60), (1, 4, "formula", "equation", 700, 10, 60, 60, 80), (1, 5, "x", "unknown", 700, 0, 0, 9, 9), (1, 6, "table", "table", 700, 0, 50, 90, 90), (1, 7, "table", "table", 700, 0, 50, 90, 90), (1, 8, "table", "table", 700, 0, 50, 90, 90)]
    texts = spark.createDataFrame([(1, 0, "T"), (1, 1, "lost")], "page_id bigint, box_index int, text string")
    found = spark.createDataFrame([(1, 6, True, "WIRED", False, False, "<table/>"), (1, 7, True, "WIRED", False, True, "")], TABLE)
    df = spark.createDataFrame(boxes, BOX)
    got = [(r.box_index, r.element_type, r.text, r.html, r.image_path, r.skipped) for r in pageplan.elements_of(df, texts, found, 100, 100).orderBy("position").collect()]
    assert got == [
        (0, "title", "T", None, None, False), (1, "text", "", None, None, True), (6, "table", "", "<table/>", None, False), (7, "table", "[Unsupported table: empty_table_html]", None, None, True), (8, "table", "[Unsupported table: table_model_unavailable]", None, None, True),
        (3, "image", "", None, "images/page1_fig1.png", False), (4, "equation", "", None, "images/page1_eq0.png", True), (5, "unknown", "[Unsupported layout category: unknown]", None, None, True),
    ]
    off = pageplan.elements_of(df, texts, found, 100, 100, ocr=False, wired_tables=False, formulas=False, save_images=False)
    assert [(r.element_type, r.image_path) for r in off.orderBy("position").collect()] == [("image", None), ("unknown", None)]
    assert pageplan.elements_of(df.limit(0), texts, found).count() == 0


def test_canonical_hashes(spark):
    rows = [('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), ("no",), (None,)]
    got = [r.h for r in spark.createDataFrame(rows, "j string").select(metrics.canonical_hash(metrics.F.col("j")).alias("h")).collect()]
    assert got[0] == got[1] and len(got[0]) == 64 and got[2:] == [None, None]


def test_bench_text(spark):
    rows = spark.createDataFrame([("multi_page", 2, 7, 1500, 2500, 2000.0)], "case_name string, documents bigint, pages bigint, min_us bigint, max_us bigint, mean_us double")
    r = stats.bench_text(rows).first()
    assert r.text == "multi_page: documents=2 pages=7 mean=2.000 ms min=1.500 ms max=2.500 ms" and '"pages":7' in r.json
