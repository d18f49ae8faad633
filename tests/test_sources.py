"""Strict JSON, headers, projects, sinks and the stream helpers."""

import io
import json
import re
import struct
import zipfile
import zlib

import pytest

from gridloom.operators import layers as L
from gridloom.sources import requests as R
from gridloom.sources import sinks as K
from gridloom.streaming.tickets import latest_revisions


def request(**more):
    image = {"width": 2, "height": 1, "data": [0, 0, 0, 255, 255, 255, 255, 255]}
    palette = {"id": "p", "version": "1", "source": "own", "license": "CC0", "approximate": False, "colors": [{"id": "a", "brand": "b", "series": "s", "code": "1", "srgb8": [0, 0, 0]}]}
    return {"schemaVersion": 1, "revision": 0, "width": 2, "height": 1, "method": "area", "maxColors": 1, "image": image, "palette": palette} | more


def test_requests(spark, tmp_path):
    bad = request(method="magic", width=300, extra=1)
    bad["image"] = {"width": 2, "height": 1, "data": [0, 0, 0, 256]}
    for name, r in (("good", request()), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(r))
    rows = R.read_records(spark, str(tmp_path))
    found = {(r.file.rsplit("/", 1)[1], r.rule) for r in R.request_violations(rows).collect()}
    assert found == {("bad.json", x) for x in ("unknown keys", "grid size", "method", "image data")}
    px = R.request_pixels(rows.where("file LIKE '%good.json'")).orderBy("idx").collect()
    assert [(p.x, p.y, p.r, p.a) for p in px] == [(0, 0, 0, 255), (1, 0, 255, 255)]


def test_oversized_and_broken_requests_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(request()))
    with pytest.raises(Exception, match="at most 10 bytes"):
        R.read_records(spark, str(tmp_path), max_bytes=10).collect()
    (tmp_path / "a.json").write_text("{not json")
    with pytest.raises(Exception):
        R.read_records(spark, str(tmp_path)).collect()


def test_image_sizes(spark):
    png = K.png(3, 2, bytes(24))
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 480, 640) + bytes(8)
    vp8x = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")
    vp8l = b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(5) + struct.pack("<I", 99 | 49 << 14)
    assert [R.image_size(b) for b in (png, jpeg, vp8x, vp8l)] == [("png", 3, 2), ("jpeg", 640, 480), ("webp", 640, 480), ("webp", 100, 50)]
    assert R.image_size(b"") is None and R.image_size(jpeg[:9]) is None and R.image_size(png[:18]) is None
    rows = R.with_image_size(spark.createDataFrame([(png,), (None,)], "content binary")).collect()
    assert rows[0].width == 3 and rows[1].width is None


def test_old_projects(spark):
    layer = "array<struct<id:string,visible:boolean,locked:boolean,includeInUsage:boolean,opacity:double,cells:array<string>>>"
    rows = [(1, ["a", None], None), (2, None, [("x", None, True, None, 0.0, ["b"]), ("y", False, None, None, None, ["c"])])]
    out = R.normalised_layers(spark.createDataFrame(rows, f"project_id int, cells array<string>, layers {layer}")).orderBy("project_id", "z").collect()
    assert [(r.layer_id, r.visible, r.locked, r.in_usage, r.opacity) for r in out] == [("base", True, False, True, 1.0), ("x", True, True, True, 0.0), ("y", False, False, True, 1.0)]


def test_synthetic_images(spark):
    px = R.synthetic_images(spark, 4, 8, 6)
    assert px.count() == 4 * 48 and px.where("r NOT BETWEEN 0 AND 255 OR b NOT BETWEEN 0 AND 255").count() == 0
    assert px.where("a = 0").select("grid_id").distinct().count() == 1


def test_workbook():
    book = K.workbook({"a/b": [["code", "n"], ["<x>", 3], [None, 1.5]], "A b": [["k"]]})
    assert book == K.workbook({"a/b": [["code", "n"], ["<x>", 3], [None, 1.5]], "A b": [["k"]]})
    z = zipfile.ZipFile(io.BytesIO(book))
    assert z.testzip() is None
    assert re.findall(r'sheet name="([^"]+)"', z.read("xl/workbook.xml").decode()) == ["a b", "A b (2)"]
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "&lt;x&gt;" in sheet and '<c r="B2"><v>3</v></c>' in sheet
    assert [K.column_name(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_png_and_pdf():
    data = K.png(2, 2, bytes(range(16)))
    idat = data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]
    assert zlib.decompress(idat) == b"\0" + bytes(range(8)) + b"\0" + bytes(range(8, 16))
    pdf = K.image_pdf([(4, 5, b"JPEG1"), (4, 5, b"JPEG2")], 210, 297)
    assert pdf.startswith(b"%PDF-1.4") and b"/MediaBox [0 0 595.276 841.89]" in pdf and b"/Count 2" in pdf
    start = int(re.search(rb"startxref\n(\d+)", pdf)[1])
    assert pdf[start:].startswith(b"xref")
    for n, at in enumerate(re.findall(rb"(\d{10}) 00000 n", pdf), 1):
        assert pdf[int(at) :].startswith(b"%d 0 obj" % n)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([('a"b', 1), ("c,d", 2)], "code string, n int")
    K.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text == b'code,n\r\n"a""b",1\r\n"c,d",2\r\n'
    with pytest.raises(ValueError, match="not written"):
        K.write_checked(df, df.limit(1), str(tmp_path / "p"))
    K.write_checked(df, df.limit(0), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert zipfile.ZipFile(io.BytesIO(K.usage_workbook(df, "Usage"))).testzip() is None


def test_stream_keeps_newest_revision(spark, tmp_path):
    for k, rows in enumerate(([("t", 1), ("u", 5)], [("t", 3), ("u", 4)])):
        spark.createDataFrame(rows, "task string, revision int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task string, revision int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = latest_revisions(stream, "task", "revision").writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.task: r.revision for r in spark.table("newest").collect()} == {"t": 3, "u": 5}


def test_recolor_counts_only_visible_unlocked(spark):
    rows = [(0, 1, "a", True, False), (0, 2, "a", False, False), (0, 3, "a", True, True), (1, 1, None, True, False)]
    out = L.recolor(spark.createDataFrame(rows, "cell int, z int, color string, visible boolean, locked boolean"), "a", "b")
    assert sorted((r.z, r.color) for r in out.where("changed").collect()) == [(1, "b")]
