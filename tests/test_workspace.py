"""Workspace operators on small tables: ties, caps, locked layers, averages, white fallbacks."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import workspace as W

PAL = "pos int, id string, r int, g int, b int"


def test_despeckle_takes_the_colour_met_first(spark):
    rows = [(1, x, y, "z") for y in range(3) for x in range(3)]
    for (x, y), c in {(0, 0): "z", (1, 0): "a", (2, 0): "z", (0, 1): "a", (1, 1): "q", (2, 1): "z", (0, 2): "a", (1, 2): "z", (2, 2): "a"}.items():
        rows[y * 3 + x] = (1, x, y, c)
    cells = spark.createDataFrame(rows, "grid_id long, x int, y int, color string")
    got = {(r.x, r.y): r.color for r in W.despeckle(cells, 1, 0, 4).collect()}
    assert got[1, 1] == "z"  # four of each: z stands first, though a is the smaller name
    assert {r.color for r in W.despeckle(cells, 0, 0, 4).collect()} == {"a", "q", "z"}
    with pytest.raises(ValueError):
        W.despeckle(cells, 5, 0, 4)


def test_votes_fall_back_to_the_average(spark):
    palette = spark.createDataFrame([(0, "black", 0, 0, 0), (1, "grey", 128, 128, 128), (2, "white", 255, 255, 255)], PAL)
    rows = [(1, 0, 0, i, v, v, v) for i, v in enumerate((0, 0, 255, 255))] + [(1, 1, 0, i, v, v, v) for i, v in enumerate((255, 255, 255, 0))]
    samples = spark.createDataFrame(rows, "grid_id long, cx int, cy int, order int, r int, g int, b int")
    assert {r.cx: r.color for r in W.voted_colors(samples, palette, 0.6).collect()} == {0: "grey", 1: "white"}
    assert {r.cx: r.color for r in W.voted_colors(samples, palette, 0.5).collect()} == {0: "black", 1: "white"}


def test_caps_and_locked_layers(spark):
    messages = spark.createDataFrame([(1, i, f"m{i}") for i in range(5)] + [(2, i, f"m{i}") for i in range(3)], "k int, i int, message string")
    got = [(r.k, r.message) for r in W.capped_messages(messages, "k", "i", 3).orderBy("k", "place").collect()]
    assert got == [(1, "m0"), (1, "m1"), (1, "3 additional diagnostics omitted."), (2, "m0"), (2, "m1"), (2, "m2")]
    layers = spark.createDataFrame([(1, 0, "a", True, 1, False), (1, 1, "b", True, 1, True)], "cell int, z int, color string, visible boolean, opacity int, locked boolean")
    edits = spark.createDataFrame([(1, None)], "cell int, color string")
    assert [r.color for r in W.write_active(layers, edits, 1).collect()] == ["b"] and [r.color for r in W.write_active(layers, edits, 0).collect()] == ["b"]
    assert {(r.color, r.added) for r in W.snapshot(spark.createDataFrame([("a",)], "color string"), layers.withColumn("visible", F.lit(False))).collect()} == {("a", False), ("b", True)}


def test_edge_color_is_white_without_opaque_pixels(spark):
    rows = [(1, x, y, 10, 20, 30, 255) for x in range(4) for y in range(4)] + [(2, x, y, 10, 20, 30, 0) for x in range(4) for y in range(4)]
    pixels = spark.createDataFrame(rows, "grid_id long, x int, y int, r int, g int, b int, a int")
    assert {r.grid_id: (r.r, r.g, r.b) for r in W.edge_color(pixels, 4, 4).collect()} == {1: (10, 20, 30), 2: (255, 255, 255)}


def test_subtree_ends_on_cycles(spark):
    from gridloom.operators import evidence as E

    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 8), (7, 6), (8, 7)]
    tree = spark.createDataFrame(rows, "id int, parent int")
    assert {r.id for r in E.subtree(tree, F.col("id") == 2).collect()} == {2, 3, 4}
    assert {r.id for r in E.subtree(tree, F.col("id") == 7).collect()} == {6, 7, 8}
