"""Paths, skeletons, fills, assignments and shapes against exhaustive or independent computations."""

import itertools
import math
import random

import numpy as np
import pytest

from gridloom.functions import shapes as S
from gridloom.operators import graph as G


def test_cheapest_path_against_relaxation():
    rng = random.Random(1)
    for _ in range(40):
        weight = {(x, y): rng.random() for x in range(5) for y in range(4) if rng.random() < 0.75}
        start, end = (0, 0), (4, 3)
        best = {start: 0.0} if start in weight else {}
        for _ in range(20):
            for (x, y), d in list(best.items()):
                for dx, dy in G.RING:
                    q = x + dx, y + dy
                    if q in weight and d + 2 - weight[q] < best.get(q, math.inf) - 1e-12:
                        best[q] = d + 2 - weight[q]
        path = G.cheapest_path(weight, {start}, {end})
        if end not in best:
            assert path == []
        else:
            assert path[0] == start and path[-1] == end
            assert sum(2 - weight[c] for c in path[1:]) == pytest.approx(best[end])


def test_farthest_pair_on_a_tree():
    cells = {(x, 0) for x in range(7)} | {(3, y) for y in range(1, 6)}
    a, b, n = G.farthest_pair(cells, eight=False)
    assert n == 8 and {a, b} <= {(0, 0), (6, 0), (3, 5)}


def test_enclosed():
    ring = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0]], bool)
    assert G.enclosed(ring).sum() == 1 and G.enclosed(ring)[1, 1]
    ring[0, 1] = False
    assert not G.enclosed(ring).any()


def test_skeleton_keeps_parts_and_ends():
    bar = np.zeros((5, 12), bool)
    bar[1:4, 1:11] = True
    thin = G.thin(bar)
    assert thin.any() and thin.sum() < bar.sum() and (thin <= bar).all()
    assert len(G.critical_cells(bar)) == 2
    plus = np.zeros((9, 9), bool)
    plus[4, :] = plus[:, 4] = True
    assert (4, 4) in G.critical_cells(plus) and len(G.critical_cells(plus)) == 5


def test_merge_small_regions():
    rows = ["aab", "acb", "aab"]
    color = np.array([c for r in rows for c in r], object)
    assert "".join(G.merge_small_regions(color, 3, 1)) == "aabaabaab"


def test_replacement_chain():
    near = lambda a, b: abs(a - b) <= 2
    assert G.replacement_chain([10, 12, 14, 40], [9, 5, 3, 1], near) == {12: 10, 14: 10}


def test_spread_selection():
    points = np.array([[0.0, 0], [0.1, 0], [10, 0], [0, 10]])
    assert G.spread_selection(points, np.array([5.0, 4, 1, 1]), 3) == [0, 2, 3]


def test_harmonic_fill_is_harmonic():
    values = np.add.outer(np.arange(6.0), 2 * np.arange(7.0))
    hole = np.zeros((6, 7), bool)
    hole[1:5, 2:5] = True
    out = G.harmonic_fill(np.where(hole, 99, values), hole, 2000, 1e-10)
    assert np.allclose(out, values, atol=1e-6)


def test_assignment_against_all():
    rng = np.random.default_rng(2)
    for _ in range(40):
        iou = rng.uniform(0, 1, (rng.integers(1, 5), rng.integers(1, 5)))
        got = G.assign_regions(iou)
        total = sum(iou[i, j] for i, j in got)
        best = 0.0
        n, m = iou.shape
        for cols in itertools.product([None, *range(m)], repeat=n):
            used = [c for c in cols if c is not None]
            if len(used) == len(set(used)):
                ok = [iou[i, c] for i, c in enumerate(cols) if c is not None]
                if all(x >= 0.5 for x in ok):
                    best = max(best, sum(ok))
        assert total == pytest.approx(best) and len({j for _, j in got}) == len(got)


def test_circles_and_ellipses_lie_on_their_curves():
    for r in range(2, 14):
        cells = S.circle(0, 0, 2 * r, 2 * r)
        assert all(abs(math.hypot(x - r, y - r) - r) <= 0.75 for x, y in cells)
        assert {(2 * r - x, y) for x, y in cells} == cells == {(x, 2 * r - y) for x, y in cells}
    for a, b in ((3, 8), (10, 4), (7, 7)):
        cells = S.ellipse(0, 0, 2 * a, 2 * b)
        assert {(2 * a - x, y) for x, y in cells} == cells and {x for x, _ in cells} == set(range(2 * a + 1)) and {y for _, y in cells} == set(range(2 * b + 1))
        for x, y in cells:
            near = min(abs(((x + i - a) / a) ** 2 + ((y + j - b) / b) ** 2 - 1) for i in (-0.5, 0, 0.5) for j in (-0.5, 0, 0.5))
            assert near <= 0.35


def test_other_shapes():
    assert S.line(0, 0, 4, 2) == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)}
    assert S.square_end(5, 5, 1, 12) == (1, 9)
    assert S.triangle(0, 0, 8, 6) <= S.triangle(0, 0, 8, 6, True)
    arrow = S.arrow(0, 0, 20, 0)
    assert (20, 0) in arrow and (14, 6) in arrow and (14, -6) in arrow and (0, 6) not in arrow
    assert (6, 6) in S.arrow(0, 0, 20, 0, True)
    block = S.block_arrow(0, 0, 0, 20)
    assert (0, 20) in block and (2, 0) in block and (3, 0) not in block and (6, 14) in block
    assert S.block_arrow(0, 0, 10, 10) and S.arrow(0, 0, 9, 7)
    assert S.brush(3, 3, 0) == {(3, 3)} and (4, 3) in S.brush(3, 3, 1)


def test_shapes_in_a_table(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, 1, 1, 12, 9) for k in S.SHAPES], "kind string, x0 int, y0 int, x1 int, y1 int")
    out = rows.select("kind", S.shape_cells(*[F.col(c) for c in ("kind", "x0", "y0", "x1", "y1")]).alias("c")).collect()
    assert {r.kind: {(c.x, c.y) for c in r.c} for r in out} == {k: f(1, 1, 12, 9) for k, f in S.SHAPES.items()}


def test_polygon_overlap():
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert G.box_overlap(square, (5, 0, 15, 10)) == pytest.approx(1 / 3)
    assert G.box_overlap(square, (20, 20, 30, 30)) == 0 and G.box_overlap(square, (0, 0, 10, 10)) == pytest.approx(1)
    triangle = [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)]
    assert G.area(G.clip_to_box(triangle, (0, 0, 4, 4))) == pytest.approx(16)


def test_simple_polygons():
    assert G.is_simple([(0, 0), (4, 0), (4, 4), (0, 4)])
    assert not G.is_simple([(0, 0), (4, 4), (4, 0), (0, 4)]) and not G.is_simple([(0, 0), (1, 1), (2, 2)])
    assert G.crossing((0, 0), (4, 0), (2, 0), (2, 5)) and not G.crossing((0, 0), (1, 0), (2, 0), (3, 0))


def test_limits_and_chains_per_grid(spark):
    rows = [(1, i, c) for i, c in enumerate("aaaabbbccd")] + [(2, 0, "d"), (2, 1, None)]
    cells = spark.createDataFrame(rows, "grid_id long, idx int, color string")
    near = lambda p, q: abs(ord(p) - ord(q)) == 1
    merged = {(r.grid_id, r.idx): r.color for r in G.merge_similar(cells, near).collect()}
    assert {merged[1, i] for i in range(10)} == {"a"} and merged[2, 0] == "d" and merged[2, 1] is None
    palette = {"a": (0, 0, 0), "b": (1, 0, 0), "c": (90, 0, 0), "d": (99, 0, 0)}
    kept = G.limit_colors(cells, palette, 2, lambda p, q: abs(p[0] - q[0]))
    got = {(r.grid_id, r.idx): r.color for r in kept.collect()}
    assert {got[1, i] for i in range(7)} == {"a"} and {got[1, 7], got[1, 8], got[1, 9]} == {"c"} and got[2, 0] == "d"
