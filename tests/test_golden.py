"""Hand-computed cases: colours, sampling, ties, components, composites, invariance under partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.functions import geometry as G
from gridloom.functions import text as X
from gridloom.operators import diagnostics as D
from gridloom.operators import layers as L
from gridloom.operators import match as M
from gridloom.operators import pages as P
from gridloom.operators import sampling as S
from gridloom.sources import tables as T

PX = "grid_id long, idx int, x int, y int, r int, g int, b int, a int"


def pixels(spark, rows, width):
    return spark.createDataFrame([(1, i, i % width, i // width, *p) for i, p in enumerate(rows)], PX)


BLACK, WHITE, CLEAR = (0, 0, 0, 255), (255, 255, 255, 255), (255, 255, 255, 0)


def test_average_is_linear(spark):
    row = S.sample_area(pixels(spark, [BLACK, WHITE, WHITE, BLACK], 2), 2, 2, 1, 1).first()
    assert row.lr == pytest.approx(0.5) and row.coverage == pytest.approx(1.0)
    grey = spark.range(1).select(C.linear_to_byte(F.lit(row.lr)).alias("v")).first().v
    assert grey == 188


def test_fractional_area(spark):
    px = pixels(spark, [(255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)], 3)
    rows = {r.cx: r for r in S.overlaps(px.withColumn("y", F.lit(0)), 3, 1, 2, 1).groupBy("cx", "r", "g", "b").agg(F.sum("area").alias("n")).collect()}
    assert set(rows) == {0, 1}
    shares = {(r.cx, r.r > 0, r.g > 0, r.b > 0): r.n for r in S.overlaps(px, 3, 1, 2, 1).groupBy("cx", "r", "g", "b").agg(F.sum("area").alias("n")).collect()}
    assert shares[0, True, False, False] == pytest.approx(1.0) and shares[0, False, True, False] == pytest.approx(0.5)


def test_alpha_edge(spark):
    for a, n in ((127, 0), (128, 1)):
        assert S.sample_nearest(pixels(spark, [(255, 255, 255, a)], 1), 1, 1, 1, 1).count() == n


def test_contain():
    assert S.fit(2, 1, 4, 4) == (2.0, 0.0, 1.0)


def test_tie_goes_to_smaller_id_or_first_place(spark):
    pal = spark.createDataFrame([(0, "z", "Z", 9, 9, 9), (1, "a", "a", 9, 9, 9), (2, "A", "A", 9, 9, 9)], T.PALETTE_SCHEMA)
    px = pixels(spark, [(9, 9, 9, 255)], 1)
    assert M.nearest_oklab(C.with_oklab(px), pal).first().color == "A"
    assert M.nearest_redmean(px, pal, F.col("r"), F.col("g"), F.col("b")).first().color == "z"
    top = M.top_k(C.with_oklab(px).select("idx", *C.OK), pal, 3).orderBy("rank").collect()
    assert [r.color for r in top] == ["A", "a", "z"]
    with pytest.raises(ValueError):
        M.top_k(px, pal, 0)


def test_palette_size_is_checked(spark):
    big = spark.range(600).select(F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("c").alias("code"), *[F.lit(1).alias(c) for c in "rgb"])
    with pytest.raises(Exception, match="at most 512"):
        M.nearest_redmean(pixels(spark, [BLACK], 1), big, F.col("r"), F.col("g"), F.col("b")).collect()


#: Published test pairs of the CIEDE2000 definition. Fixed values.
SHARMA = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.1848, -84.8006), (50, 0, -82.7485), 1.0), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)]


def test_ciede2000(spark):
    df = spark.createDataFrame([(*map(float, p), *map(float, q), d) for p, q, d in SHARMA], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    out = df.select(C.delta_e2000((F.col("l1"), F.col("a1"), F.col("b1")), (F.col("l2"), F.col("a2"), F.col("b2"))).alias("d"), "want").collect()
    assert all(abs(r.d - r.want) < 1e-4 for r in out)


def grid(spark, rows):
    w = len(rows[0])
    return spark.createDataFrame([(1, y * w + x, x, y, None if c == "." else c) for y, row in enumerate(rows) for x, c in enumerate(row)], "grid_id long, idx int, x int, y int, color string")


def test_white_is_not_empty(spark):
    g = grid(spark, ["W.", "B."])
    assert {r.region for r in D.regions(g).collect()} == {0}
    assert D.singletons(g).count() == 2 and g.where("color IS NOT NULL").count() == 2


def test_regions_against_search(spark):
    rng = np.random.default_rng(3)
    for same in (False, True):
        for eight in (False, True):
            rows = ["".join(rng.choice(list("ab.")) for _ in range(11)) for _ in range(9)]
            got = {r.idx: r.region for r in D.regions(grid(spark, rows), same, eight).collect()}
            want = {}
            for start in range(99):
                if rows[start // 11][start % 11] == "." or start in want:
                    continue
                stack = [start]
                want[start] = start
                while stack:
                    i = stack.pop()
                    for dx, dy in D.EIGHT if eight else D.FOUR:
                        x, y = i % 11 + dx, i // 11 + dy
                        if 0 <= x < 11 and 0 <= y < 9 and y * 11 + x not in want and rows[y][x] != "." and (not same or rows[y][x] == rows[i // 11][i % 11]):
                            want[y * 11 + x] = start
                            stack.append(y * 11 + x)
            assert got == want


def test_contacts(spark):
    r = D.contacts(grid(spark, ["a..", ".a.", "..."])).first()
    assert (r.diagonal, r.narrow) == (1, 0)
    assert D.contacts(grid(spark, ["aaa"])).first().narrow == 1


def test_composite(spark):
    rows = [(0, 1, "H7", True, 1), (0, 2, None, True, 1), (1, 1, "H7", True, 1), (1, 2, "H2", True, 1), (2, 3, "X", False, 1), (3, 4, "Z", True, 0)]
    layers = spark.createDataFrame(rows, "cell int, z int, color string, visible boolean, opacity int")
    assert {r.cell: r.color for r in L.composite(layers).collect()} == {0: "H7", 1: "H2"}
    assert {r.cell: r.color for r in L.top_visible(layers).collect()} == {0: "H7", 1: "H2", 3: "Z"}


def test_pages_cover_grids(spark):
    pages = P.page_plan(spark.createDataFrame([(1, 80, 90), (2, 1, 1), (3, 36, 46), (4, 37, 46)], "grid_id int, width int, height int")).collect()
    count = {g: sum(r.grid_id == g for r in pages) for g in (1, 2, 3, 4)}
    assert count == {1: 6, 2: 1, 3: 1, 4: 2}
    cells = {(r.x + i, r.y + j) for r in pages if r.grid_id == 1 for i in range(r.columns) for j in range(r.rows)}
    assert cells == {(x, y) for x in range(80) for y in range(90)}


def test_bilateral_keeps_flat_and_transparent(spark):
    px = pixels(spark, [(10, 20, 30, 255)] * 8 + [(1, 2, 3, 0)], 3)
    out = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in S.bilateral(px).collect()}
    assert out[2, 2] == (1, 2, 3, 0) and all(v == (10, 20, 30, 255) for k, v in out.items() if k != (2, 2))


def test_partitioning_does_not_matter(spark):
    g = grid(spark, ["aab.", "b.ab", "aabb", "..a."])
    for op in (D.isolated, D.singletons, D.contacts, D.regions, lambda d: D.speckle_pass(d, 1, 3)):
        results = [sorted(map(str, op(g.repartition(n)).collect())) for n in (1, 7, 32)]
        assert results[0] == results[1] == results[2]


def test_png_size(spark):
    head = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (48).to_bytes(4, "big")
    rows = T.png_size(spark.createDataFrame([(head,), (b"GIF89a",)], "content binary")).collect()
    assert (rows[0].width, rows[0].height) == (640, 48) and rows[1].width is None


def test_transform_and_area(spark):
    x, y = G.transform_point([2.0, 0, 1, 0, 2, 3, 0, 0, 1], F.lit(4.0), F.lit(5.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (9.0, 13.0)
    assert G.polygon_area([(0, 0), (4, 0), (4, 3), (0, 3)]) == 12


def test_text(spark):
    r = spark.createDataFrame([('a"b,c', "a/b:c", "", "A1, b2 a1,,B2")], "c string, f string, e string, l string").select(X.csv_field(F.col("c")).alias("c"), X.safe_file_name(F.col("f")).alias("f"), X.safe_file_name(F.col("e")).alias("e"), X.parse_codes(F.col("l")).alias("l")).first()
    assert tuple(r) == ('"a""b,c"', "a-b-c", "pattern", ["A1", "B2"])
