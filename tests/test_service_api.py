"""Files, service functions, command line: what has no SQL."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright import __main__ as cli
from leafwright import api
from leafwright.functions import raster
from leafwright.operators import compare, service
from leafwright.sources import files

PDF = b"%PDF-1.4\n1 0 obj<</Type /Catalog>>endobj 2 0 obj<</Type /Pages /Kids [3 0 R 4 0 R] /Count 2>>endobj 3 0 obj<</Type /Page>>endobj 4 0 obj<</Type/Page>>endobj"
PNG = raster.png(np.zeros((3, 5), dtype=np.uint8))


def test_page_counts():
    packed = b"%PDF-1.5\n1 0 obj<</Type /ObjStm>>stream\n" + zlib.compress(b"<</Type /Pages /Count 7>>") + b"\nendstream"
    assert files.page_count(PDF) == 2 and files.page_count(packed) == 7 and files.page_count(PNG) == 1
    assert files.page_count(PDF.replace(b"/Count 2", b"")) == 2
    assert [files.page_count(x) for x in (None, b"", b"text", b"%PDF-1.4 nothing", PDF + b"/Encrypt 9 0 R")] == [-1] * 5


def test_folder_keeps_order_and_errors(spark, tmp_path):
    for name, data in (("b.pdf", PDF), ("a.pdf", b"broken"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = files.folder(spark, str(tmp_path)).collect()
    assert [(r.path[-5:], r.pages, r.error is None) for r in got] == [("a.pdf", -1, False), ("b.pdf", 2, True)]


def test_image_is_one_page_of_its_size(spark):
    rows = [("x/a.PNG", PNG), ("b.jpg", b"no"), ("c.exe", PNG), ("d.png", None)]
    got = {r.path: r for r in files.opened(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["x/a.PNG"].pages, got["x/a.PNG"].width, got["x/a.PNG"].height, got["x/a.PNG"].scale) == (1, 5, 3, 1.0)
    assert all(got[k].error and got[k].pages == -1 for k in ("b.jpg", "c.exe", "d.png"))


def test_uploads(spark):
    def part(name, body, filename=None):
        return f'--B\r\nContent-Disposition: form-data; name="{name}"' + (f'; filename="{filename}"' if filename else "") + f"\r\n\r\n{body}\r\n"

    body = part("lang", "en") + part("file", "single", "s.pdf") + part("files", "one", "1.pdf") + part("lang", "de") + part("files", "two", "2.pdf") + "--B--\r\n"
    rows = [(1, "multipart/form-data; boundary=B", body.encode()), (2, "text/plain", b"x"), (3, None, None)]
    parts = files.uploads(spark.createDataFrame(rows, "request_id bigint, content_type string, body binary"))
    got = sorted((r.request_id, r.part, r.name, r.filename) for r in parts.where("request_id = 1").collect())
    assert [x[3] for x in got][:3] == ["1.pdf", "2.pdf", "s.pdf"]
    f = files.fields(parts).first()
    assert (f.name, f.value, f["values"]) == ("lang", "en", ["en", "de"])
    assert {r.request_id for r in parts.where("error IS NOT NULL").collect()} == {2, 3}


def test_crops_and_overlays(spark):
    page = np.arange(8 * 10 * 3, dtype=np.uint8).reshape(8, 10, 3)
    rows = [("images/page0_fig0.png", 10, 8, page.tobytes(), 2.0, 1.0, 6.0, 4.0), ("images/page0_fig1.png", 10, 8, page.tobytes(), 20.0, 1.0, 26.0, 4.0), ("none.png", 10, 8, None, 0.0, 0.0, 1.0, 1.0)]
    got = files.crops(spark.createDataFrame(rows, "path string, width int, height int, pixels binary, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [(r.path, raster.image_size(bytes(r.content))) for r in got] == [("images/page0_fig0.png", (4, 3))]
    boxes = spark.createDataFrame([("layout/page_0000_layout.png", 10, 8, page.tobytes(), [(3, 1, 1, 6, 6)])], "path string, width int, height int, pixels binary, boxes array<struct<cls_id:int,x0:int,y0:int,x1:int,y1:int>>")
    assert raster.image_size(bytes(files.overlays(boxes).first().content)) == (10, 8)


def test_outputs_are_written_and_cleaned(spark, tmp_path):
    out = tmp_path / "out" / "req_1"
    rows = [(str(out / "a" / "auto" / "a.md"), "# a"), (str(out / "a" / "auto" / "a_content_list.json"), "[]")]
    files.write_each(spark.createDataFrame(rows, "path string, body string"), "path", "body")
    assert (out / "a" / "auto" / "a.md").read_text() == "# a"
    assert files.clean_up(spark, str(out)) and not out.exists() and not files.clean_up(spark, str(out))
    (tmp_path / "f.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.json_rows(spark, str(tmp_path / "f.json"), "a int").collect()) == [1, 2]


def upper(rows):
    return rows.select("path", F.concat(F.lit("# "), "path").alias("markdown"))


REQUEST = "request_id bigint, path string, content binary"


def test_process_and_file_parse(spark):
    rows = [(1, "a.pdf", PDF), (1, "b.xyz", PDF), (2, "c.png", b"bad"), (3, "a.pdf", PDF)]
    got = {(r.request_id, r.path): (r.code, r.markdown) for r in api.process(spark.createDataFrame(rows, REQUEST), upper).collect()}
    assert got == {(1, "a.pdf"): (200, "# 1/a.pdf"), (1, "b.xyz"): (400, None), (2, "c.png"): (400, None), (3, "a.pdf"): (200, "# 3/a.pdf")}
    options = spark.createDataFrame([(1, True), (2, True), (3, False)], "request_id bigint, return_md boolean")
    batch = {r.request_id: r for r in api.file_parse(spark.createDataFrame(rows, REQUEST), options, upper).collect()}
    assert [(batch[i].code, batch[i].files, batch[i].successful_files) for i in (1, 2, 3)] == [(200, 2, 1), (200, 1, 0), (200, 1, 1)]
    assert "md_content" in json.loads(batch[1].results)[0] and "md_content" not in json.loads(batch[3].results)[0]
    b64 = spark.createDataFrame([(1, "a.pdf", " " + base64.b64encode(PDF).decode() + "\n")], "request_id bigint, path string, content string")
    assert api.process_base64(b64).first().code == 200


def test_one_bad_request_leaves_the_next_alone(spark):
    rows = [(1, "a.pdf", b"broken"), (2, "a.pdf", PDF)]
    assert {r.request_id: r.code for r in api.process(spark.createDataFrame(rows, REQUEST)).collect()} == {1: 400, 2: 200}


def test_annotate(spark):
    good = base64.b64encode(PNG).decode()
    rows = [(1, 0, "TEXT_DETECTION", None, good), (1, 1, "FACES", None, good), (1, 2, "DOCUMENT_TEXT_DETECTION", "https://example.org/x.png", None), (1, 3, "TEXT_DETECTION", None, ""), (1, 4, "TEXT_DETECTION", None, base64.b64encode(b"zz").decode()), (1, 5, None, None, None)]
    got = {r.position: (r.code, r.status) for r in api.annotate(spark.createDataFrame(rows, "request_id bigint, position int, feature string, uri string, content string"), upper).collect()}
    assert got == {0: (200, "OK"), 1: (400, "INVALID_ARGUMENT"), 2: (403, "PERMISSION_DENIED"), 3: (400, "INVALID_ARGUMENT"), 4: (400, "INVALID_ARGUMENT"), 5: (400, "INVALID_ARGUMENT")}


def test_annotate_looks_local_images_up(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(PNG)
    rows = [(1, 0, "TEXT_DETECTION", str(tmp_path / "a.png"), None), (1, 1, "TEXT_DETECTION", str(tmp_path / "b.png"), None), (1, 2, "TEXT_DETECTION", None, base64.b64encode(PNG).decode())]
    df = spark.createDataFrame(rows, "request_id bigint, position int, feature string, uri string, content string")
    got = {r.position: r.code for r in api.annotate(df, upper, files.documents(spark, str(tmp_path))).collect()}
    assert got == {0: 200, 1: 400, 2: 200}


def test_health_and_fleet(spark):
    assert api.health(spark)["status"] == "healthy"
    one = json.dumps({"requests": 5, "success": 4, "errors": 1, "per_device": [{"shard_id": 0, "device_id": 1, "request_count": 5}]})
    got = api.fleet(spark.createDataFrame([("a", one), ("b", "oops"), ("c", None)], "backend string, body string")).first()
    assert (got.backends, got.failed, got.requests, got.errors, got.code, len(got.per_device)) == (3, 2, 5, 1, 200, 1)
    assert api.fleet(spark.createDataFrame([("b", "oops")], "backend string, body string")).first().code == 502


def test_diff_counts_lines_like_a_unified_diff():
    assert compare.line_diff("a\nb\nb\nc", "a\nb\nx\nc\nd") == (2, 1, 4, 5)
    assert compare.line_diff("b\na", "a\nb") == (1, 1, 2, 2)
    assert compare.line_diff(None, "a") == (1, 0, 0, 1) and compare.line_diff("", None) == (0, 0, 0, 0)
    import difflib
    import random

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice(["x", "y", "z", "-- x", "++"]) for _ in range(rng.randrange(9))] for _ in range(2))
        d = list(difflib.unified_diff(a, b, lineterm="", n=0))
        assert compare.line_diff("\n".join(a), "\n".join(b))[:2] == (sum(x[0] == "+" and x[:3] != "+++" for x in d), sum(x[0] == "-" and x[:3] != "---" for x in d))


def test_payload_parts_are_sent_only_when_wanted(spark):
    row = spark.range(1).select(service.payload({"filename": F.lit("a"), "md_content": F.lit("# a"), "images": F.lit(None).cast("string")}, {"md_content": F.lit(False), "images": F.lit(True)}).alias("p")).first()
    assert json.loads(row.p) == {"filename": "a"}


def test_command_line(capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "layout_nms" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--tables", "x", "--out", str(tmp_path)]) == 2
    assert cli.summary([10, 20, 30, 40, 50])["p95"] == pytest.approx(48) and cli.summary([])["p50"] == 0.0
