import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafwright.functions import geometry as G
from leafwright.operators import compare, elements, layout, metrics, service, stats, tables
from leafwright.plans.arrow_groups import key_changes, whole_groups
from leafwright.sources import files
from leafwright.streaming import matching

BOX = "page_id bigint, det_pos int, cls_id int, score_m int, x0 int, y0 int, x1 int, y1 int"


def brute_nms(boxes, same=0.6, other=0.98):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[3], b[1])):
        def iou(a):
            w, h = min(a[6], b[6]) - max(a[4], b[4]) + 1, min(a[7], b[7]) - max(a[5], b[5]) + 1
            inter = max(w, 0) * max(h, 0)
            return inter / ((a[6] - a[4] + 1) * (a[7] - a[5] + 1) + (b[6] - b[4] + 1) * (b[7] - b[5] + 1) - inter)
        if all(iou(a) < (same if a[2] == b[2] else other) for a in kept):
            kept.append(b)
    return {(b[0], b[1]) for b in kept}


def test_suppression_matches_brute_force_and_keeps_other_columns(spark):
    rng = np.random.default_rng(1)
    rows = []
    for page in range(40):
        for pos in range(int(rng.integers(1, 15))):
            x, y = rng.integers(0, 60, 2)
            rows.append((page, pos, int(rng.integers(0, 3)), int(rng.integers(1, 6)), int(x), int(y), int(x + rng.integers(5, 50)), int(y + rng.integers(5, 50))))
    got = {(r.page_id, r.det_pos) for r in layout.suppress(spark.createDataFrame(rows, BOX).withColumn("keep", F.lit("x"))).collect()}
    want = set().union(*(brute_nms([r for r in rows if r[0] == p]) for p in range(40)))
    assert got == want
    assert layout.suppress(spark.createDataFrame([], BOX)).count() == 0


def test_suppression_by_hand(spark):
    rows = [(1, 0, 2, 900, 0, 0, 99, 99), (1, 1, 2, 800, 0, 0, 99, 79), (2, 0, 2, 900, 0, 0, 99, 99), (2, 1, 3, 800, 0, 0, 99, 79)]
    assert sorted((r.page_id, r.det_pos) for r in layout.suppress(spark.createDataFrame(rows, BOX)).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_page_image_is_dropped_only_beside_others(spark):
    big = (0, 0, 2383, 3500)
    df = spark.createDataFrame([(1, 0, 1, 900, *big), (1, 1, 2, 900, 0, 0, 10, 10), (2, 0, 1, 900, *big)], BOX)
    assert sorted((r.page_id, r.det_pos) for r in layout.drop_page_images(layout.categorised(df)).collect()) == [(1, 1), (2, 0)]


def test_reading_order_by_hand():
    box = np.array([(0, 0, 450, 100), (550, 0, 1000, 100), (0, 200, 450, 300), (550, 200, 1000, 300)], dtype=float)
    assert layout.reading_sequence(box, 1000, 1000) == [0, 2, 1, 3]
    box = np.array([(0, 0, 450, 100), (600, 0, 1000, 100), (500.2, 0, 500.9, 100)], dtype=float)
    assert layout.reading_sequence(box, 1000, 1000) == [0, 1]
    assert layout.reading_sequence(np.empty((0, 4)), 1000, 1000) == []


def test_grid_by_hand():
    box = np.array([(0, 0, 100, 50), (100, 0, 200, 50), (0, 50, 100, 100), (100, 50, 200, 100)], dtype=float)
    assert tables.recover_grid(box).tolist() == [[0, 0, 1, 1], [0, 1, 1, 1], [1, 0, 1, 1], [1, 1, 1, 1]]
    box = np.array([(0, 0, 200, 50), (0, 50, 100, 100), (100, 50, 200, 100)], dtype=float)
    assert tables.recover_grid(box).tolist() == [[0, 0, 1, 2], [1, 0, 1, 1], [1, 1, 1, 1]]


def test_cell_match_by_hand(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 10, 0, 20, 10)], "table_id bigint, cell_index int, x0 int, y0 int, x1 int, y1 int")
    lines = spark.createDataFrame([(1, 0, "a", 5, 0, 13, 10), (1, 1, "", 0, 0, 5, 5), (1, 2, "lost", 18, 8, 40, 30), (1, 3, None, 0, 0, 5, 5), (1, 4, "tie", 5, 0, 15, 10)], "table_id bigint, line_index int, text string, x0 int, y0 int, x1 int, y1 int")
    got = {r.line_index: (r.cell_index, round(r.share, 3)) for r in tables.match_cells(cells, lines).collect()}
    assert got == {0: (0, 0.625), 4: (0, 0.5)}


CELL = "table_id bigint, cell_index int, r int, c int, row_span int, col_span int, content string"


def test_table_html_and_validity(spark):
    ok = [(1, 0, 0, 0, 1, 2, "a<b"), (1, 1, 1, 0, 1, 1, None), (1, 2, 1, 1, 1, 1, 'x"&')]
    overlap, hole, bad = [(2, 0, 0, 0, 1, 1, ""), (2, 1, 0, 0, 1, 1, "")], [(3, 0, 0, 0, 1, 1, ""), (3, 1, 1, 1, 1, 1, "")], [(4, 0, -1, 0, 1, 1, ""), (4, 1, 0, 0, 0, 1, "")]
    df = spark.createDataFrame(ok + overlap + hole + bad, CELL)
    v = {r.table_id: (r.overlap, r.hole, r.malformed) for r in tables.validity(df).collect()}
    assert v[1] == (False, False, False) and v[2][0] and v[3][1] and v[4][2]
    html = {r.table_id: r.html for r in tables.table_html(df).collect()}
    assert html == {1: '<table border="1">\n  <tr><td colspan=2>a&lt;b</td></tr>\n  <tr><td></td><td>x&quot;&amp;</td></tr>\n</table>'}


ELEMENT = "elem_id bigint, doc_id bigint, page_index int, reading_order int, element_type string, text string, html string, image_path string, label string, x0 float, y0 float, x1 float, y1 float, confidence float, skipped boolean"


def element(i, kind, text=None, html=None, image=None, label=None, skipped=False, page=0):
    return (i, 7, page, i, kind, text, html, image, label, 1.5, 2.0, 3.0, 4.0, 0.5, skipped)


def test_markdown_rules(spark):
    rows = [element(0, "title", "T", label="doc_title"), element(1, "title", None), element(2, "text", ""), element(3, "table", "t", html="<table/>"), element(4, "table", "[Unsupported table: x]", skipped=True), element(5, "image", image="i.png"), element(6, "equation", "e"), element(7, None, "n"), element(8, "text", None, skipped=True)]
    got = [r.md for r in spark.createDataFrame(rows, ELEMENT).orderBy("elem_id").select(elements.element_markdown().alias("md")).collect()]
    assert got == ["# T\n\n", "## \n\n", "", "<table/>\n\n", "[Unsupported table: x]\n\n", "![](i.png)\n\n", "e\n\n", "n\n\n", ""]


def test_json_forms(spark):
    df = spark.createDataFrame([element(1, "text", "b", page=1), element(0, "table", "a", html="<t>")], ELEMENT)
    pages = json.loads(elements.content_list(df).first().content_list)
    assert [[e["text"] for e in p] for p in pages] == [["a"], ["b"]]
    assert list(pages[0][0]) == sorted(pages[0][0]) and pages[0][0]["html"] == "<t>" and "html" not in pages[1][0]
    middle = json.loads(elements.middle_json(df).first().middle_json)
    assert [p["page_idx"] for p in middle["pdf_info"]] == [0, 1]
    assert json.loads(elements.model_json(df).first().model_json)[0]["layout_dets"][0]["poly"] == [1, 2, 3, 2, 3, 4, 1, 4]
    assert elements.content_list(df.limit(0)).count() == 0


def test_percentile_summary_by_hand(spark):
    r = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 50)], "v double").agg(*stats.summary(stats.finite("v"))).first()
    assert (r.n, r["min"], r["mean"], r["max"], r.p50, r.p95) == (5, 10.0, 30.0, 50.0, 30.0, 48.0)
    r = spark.createDataFrame([(None,), (float("nan"),), (-1.0,)], "v double").agg(*stats.summary(stats.finite("v"))).first()
    assert (r.n, r.p50, r["mean"]) == (0, 0.0, 0.0)


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([("kitten", "sitting", [1.0, 0.0], [0.0, 1.0], [0.0, 0.0])], "a string, b string, x array<double>, y array<double>, z array<double>").select(
        metrics.error_rate(F.col("a"), F.col("b")).alias("e"), metrics.error_rate(F.lit(""), F.lit("q")).alias("one"), metrics.error_rate(F.lit(""), F.lit("")).alias("none"), metrics.cosine(F.col("x"), F.col("x")).alias("same"), metrics.cosine(F.col("x"), F.col("y")).alias("across"), metrics.cosine(F.col("x"), F.col("z")).alias("zero")
    ).first()
    assert (r.e, r.one, r.none, r.same, r.across, r.zero) == (0.5, 1.0, 0.0, 1.0, 0.0, 0.0)
    box = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15)], "ax0 int, ay0 int, ax1 int, ay1 int, bx0 int, by0 int, bx1 int, by1 int")
    assert box.select(G.iou("a", "b")).first()[0] == pytest.approx(25 / 175)


@pytest.mark.parametrize(("name", "file", "stem"), [("a/b\\c.pdf", "c.pdf", "c"), ("", "upload.bin", "upload"), ("x:y.tar.gz", "x_y.tar.gz", "x_y.tar"), (None, "upload.bin", "upload"), (".pdf", ".pdf", "document")])
def test_names(spark, name, file, stem):
    r = spark.createDataFrame([(name,)], "n string").select(service.safe_filename(F.col("n")), service.safe_stem(F.col("n"))).first()
    assert tuple(r) == (file, stem)


def test_options(spark):
    r = spark.createDataFrame([("12x", "YES", "nope", "OCR")], "i string, b string, c string, m string").select(service.parse_int(F.col("i"), 5), service.parse_bool(F.col("b"), False), service.parse_bool(F.col("c"), True), service.parse_method(F.col("m")), service.parse_int(F.lit("x"), 5), service.base_url(F.lit("http://a//"))).first()
    assert tuple(r) == (12, True, True, "ocr", 5, "http://a")
    f, last = service.page_range(F.lit(-3), F.lit(-1), F.lit(4), 2)
    assert tuple(spark.range(1).select(f, last).first()) == (0, 1)
    f, last = service.page_range(F.lit(9), F.lit(12), F.lit(4))
    assert tuple(spark.range(1).select(f, last).first()) == (None, None)


def test_line_changes(spark):
    assert tuple(spark.range(1).select(compare.line_changes(F.lit("a\nb"), F.lit("b\nc\nd"))).first()[0]) == (1, 2)


def test_groups_stay_whole():
    rows = pa.table({"k": pa.array([None, None, 1, 1, 1, 2]), "v": list(range(6))})
    assert key_changes(rows, ["k"]).tolist() == [2, 5]
    parts = list(whole_groups(iter(rows.to_batches(max_chunksize=1)), ["k"], target_rows=2))
    assert [t.column("v").to_pylist() for t, _ in parts] == [[0, 1], [2, 3, 4], [5]] or sum(t.num_rows for t, _ in parts) == 6
    assert all(len({str(k) for k in t.column("k").to_pylist()[s:e]}) == 1 for t, st in parts for s, e in zip(st, [*st[1:], t.num_rows]))


def test_stream_matching(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    spark.createDataFrame([(i, t0 + timedelta(seconds=i)) for i in range(4)], "task_id bigint, submitted_at timestamp").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, t0 + timedelta(seconds=5), "c"), (0, t0 + timedelta(seconds=2), "a"), (1, t0 + timedelta(seconds=90), "late")], "result_id bigint, received_at timestamp, payload string").write.parquet(str(tmp_path / "b"))
    read = lambda d: spark.readStream.schema(spark.read.parquet(str(tmp_path / d)).schema).parquet(str(tmp_path / d))
    got = matching.run_to_table(matching.match_results(read("a"), read("b")), "matched")
    assert {(r.task_id, r.payload) for r in got.collect() if r.payload} == {(0, "a"), (2, "c")}


def test_file_sources(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "y.npy").write_bytes(b"no array")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.arrays(files.documents(spark, str(tmp_path), "*.npy")).collect()}
    assert list(got["x.npy"].shape) == [2, 3] and got["x.npy"]["values"] == [0, 1, 2, 3, 4, 5] and got["y.npy"].error
    (tmp_path / "m.json").write_text('[{"name": "a", "path": "p", "fields": {"k": "v"}}]')
    m = files.manifest(spark, str(tmp_path / "m.json"))
    assert [r.name for r in files.batch_of(m, 3).collect()] == ["a_0", "a_1", "a_2"]
    out = str(tmp_path / "out" / "d.md")
    files.write_each(spark.createDataFrame([(out, "hello")], "path string, content string"), "path", "content")
    assert open(out).read() == "hello"


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_texts_are_measured(spark, tmp_path):
    texts = ["书记打开信件", "书记打开信", "Секретарь", "Cекретарь", "été", "ete", "", "한국어 😀", None, "plain"]
    spark.createDataFrame([(i, 1 + i // 5, 0, 0, i, t) for i, t in enumerate(texts)] * 2, "line_id bigint, doc_id bigint, page_index int, region_id int, line_index int, text string").write.parquet(f"{tmp_path}/rec_results.parquet")
    pairs = {i: (texts[i] or "", texts[i + 1] or "") for i in (0, 1, 2, 3, 5, 6, 7, 8)}
    got = {r.line_id: r.distance for r in metrics.queries()["edit_distance_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_distance(*p) for i, p in pairs.items()}
    rate = lambda t, g: min(1.0, brute_distance(t, g) / len(t)) if t else float(bool(g))
    rows = {r.doc_id: (r.pairs, r.mean_cer) for r in metrics.queries()["cer_pairs_whole"](spark, str(tmp_path)).collect()}
    assert rows == {d: (4, pytest.approx(sum(rate(*pairs[i]) for i in pairs if 1 + i // 5 == d) / 4, abs=1e-8)) for d in (1, 2)}


def test_bench_summary_holds_all_pages(spark, tmp_path):
    rows = [(d, p, *[float(p + k) for k in range(len(stats.STAGES))], float(10 * p + d)) for d in range(3) for p in range(8)]
    spark.createDataFrame(rows * 2, "doc_id bigint, page_index int, " + ", ".join(f"{c} double" for c in stats.STAGES) + ", total_ms double").write.parquet(f"{tmp_path}/page_stats.parquet")
    got = {r.case_id: (r.total_n, r.total_mean, r.mean_ocr_ms) for r in stats.queries()["bench_summary"](spark, str(tmp_path)).collect()}
    assert got == {p: (3, 10.0 * p + 1, p + 1.0) for p in range(8)}
