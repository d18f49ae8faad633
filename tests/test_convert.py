"""Whole conversions of small requests with known outcomes."""

import json

import pytest

from gridloom.plans import convert as V
from gridloom.sources import requests as R

B, W, CLEAR_W, CLEAR_B = [0, 0, 0, 255], [255, 255, 255, 255], [255, 255, 255, 0], [0, 0, 0, 0]
COLORS = {"B": (0, 0, 0), "W": (255, 255, 255), "G188": (188, 188, 188), "G128": (128, 128, 128), "R": (255, 0, 0), "G": (0, 255, 0), "L": (0, 0, 255)}


def request(pixels, iw, w, h, ids, method="nearest", colors=512, **more):
    data = [v for p in pixels for v in p]
    palette = {"id": "p", "version": "1", "source": "own", "license": "CC0", "approximate": False, "colors": [{"id": i, "brand": "x", "series": "s", "code": i, "srgb8": list(COLORS.get(i, (9, 9, 9)))} for i in ids]}
    return {"schemaVersion": 1, "revision": 0, "width": w, "height": h, "method": method, "maxColors": colors, "image": {"width": iw, "height": len(pixels) // iw, "data": data}, "palette": palette} | more


CASES = {
    "white": (request([W, CLEAR_W, B, CLEAR_B], 2, 2, 2, "BW"), ["W", None, "B", None]),
    "linear": (request([B, W, W, B], 2, 1, 1, ["B", "W", "G188", "G128"], "area"), ["G188"]),
    "alpha": (request([[255, 255, 255, 127], [255, 255, 255, 128]], 2, 2, 1, "BW"), [None, "W"]),
    "contain": (request([B, W], 2, 4, 4, "BW"), [None] * 4 + list("BBWW") * 2 + [None] * 4),
    "budget": (request([[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]], 3, 3, 1, "RGL", "nearest", 2), None),
    "allowed": (request([B, W], 2, 2, 1, "BW", allowedColors=["W"]), ["W", "W"]),
    "dominant": (request([B, B, B, W], 2, 1, 1, ["B", "W", "G188"], "dominant"), ["B"]),
    "empty": (request([CLEAR_B], 1, 1, 1, "BW", "area"), [None]),
    "optimized": (request([B, W, B, W], 2, 2, 2, "BW", "optimized", 1), None),
    "ties": (request([[9, 9, 9, 255]], 1, 1, 1, ["z", "a", "A"]), ["A"]),
}


@pytest.fixture(scope="module")
def converted(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    for name, (r, _) in CASES.items():
        (folder / f"{name}.json").write_text(json.dumps(r))
    V.convert(spark, str(folder), str(out))
    cells = {}
    for r in spark.read.json(f"{out}/pattern").collect():
        cells.setdefault(r.file.rsplit("/", 1)[1][:-5], {})[r.cx, r.cy] = r.color
    return cells, out


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c[1] is not None])
def test_cells(converted, name):
    r, want = CASES[name]
    got = converted[0].get(name, {})
    assert [got.get((i % r["width"], i // r["width"])) for i in range(r["width"] * r["height"])] == want


def test_budgets(converted):
    assert set(converted[0]["budget"].values()) == {"G", "L"}  # of equally frequent colours the smaller ids stay
    assert len(set(converted[0]["optimized"].values())) == 1


def test_bills_add_up(spark, converted):
    rows = spark.read.json(f"{converted[1]}/bom_json").collect()
    for name, cells in converted[0].items():
        mine = {r.id: r["count"] for r in rows if r.file.endswith(f"/{name}.json")}
        assert mine == {c: list(cells.values()).count(c) for c in set(cells.values())}
    assert not [r for r in rows if r.file.endswith("/empty.json")]


def test_broken_requests_write_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(request([B], 1, 1, 1, "B") | {"maxColors": 0}))
    with pytest.raises(ValueError, match="colour budget"):
        V.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_fractional_area(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(request([[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]], 3, 2, 1, "RGL", "area")))
    q = R.read_records(spark, str(tmp_path))
    rows = {r.cx: r for r in V.samples(R.request_pixels(q), V._geometry(q)).collect()}
    assert rows[0].lr == pytest.approx(2 / 3) and rows[0].lg == pytest.approx(1 / 3) and rows[1].lg == pytest.approx(1 / 3) and rows[1].lb == pytest.approx(2 / 3)
