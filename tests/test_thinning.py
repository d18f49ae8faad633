"""Thinning against cell-by-cell removal and floods."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators.thinning import RING, removable, thinned
from tests.test_local import flood_counts

SCHEMA = "grid_id long, x int, y int, color string, s double"


def rows_of(grids, strengths, left=0, top=0):
    return [(g, int(x) + left, int(y) + top, "c" if a[y, x] else None, float(s[y, x])) for g, (a, s) in enumerate(zip(grids, strengths, strict=True)) for y, x in np.ndindex(a.shape)]


def test_table_equals_counting():
    """A cell can go exactly if pieces and holes of its 3 x 3 surroundings, set in empty space, stay."""
    for code in range(256):
        a = np.zeros((5, 5), bool)
        a[2, 2] = True
        for k, (dx, dy) in enumerate(RING):
            a[2 + dy, 2 + dx] = code >> k & 1
        b = a.copy()
        b[2, 2] = False
        assert removable(code) == (b.any() and flood_counts(a) == flood_counts(b))


def plain(a, s):
    """Rounds by plain loops."""
    on = {(x, y) for y, x in np.argwhere(a)}
    key = lambda c: (s[c[1], c[0]], c[1] % 2, c[0] % 2, c[1], c[0])
    around = lambda c: [(c[0] + dx, c[1] + dy) for dx, dy in RING]
    while able := {c for c in on if removable(sum((n in on) << k for k, n in enumerate(around(c))))}:
        on -= {c for c in able if all(key(c) < key(n) for n in around(c) if n in able)}
    return on


def test_thinned(spark):
    rng = np.random.default_rng(4)
    grids = [np.array([k >> i & 1 for i in range(9)], bool).reshape(3, 3) for k in range(512)]
    grids += [rng.random((9, 12)) < p for p in np.linspace(0.4, 0.98, 60)] + [np.ones((30, 40), bool)]
    ring = np.ones((20, 20), bool)
    ring[6:14, 6:13] = False
    grids.append(ring)
    strengths = [rng.integers(0, 3, a.shape) if i % 2 else rng.random(a.shape) for i, a in enumerate(grids)]
    strengths[-1] = np.zeros(ring.shape)
    df = spark.createDataFrame(rows_of(grids, strengths, -2, 3), SCHEMA)
    got = {}
    for r in thinned(df, F.col("s")).collect():
        got.setdefault(r.grid_id, set()).add((r.x + 2, r.y - 3))
    for g, (a, s) in enumerate(zip(grids, strengths, strict=True)):
        # Parities count from the table's own origin, an even step to the left and an odd one up.
        shifted, moved = np.vstack([np.zeros((1, a.shape[1]), bool), a]), np.vstack([np.zeros((1, a.shape[1])), s])
        kept = got.get(g, set())
        assert kept == {(x, y - 1) for x, y in plain(shifted, moved)}
        b = np.zeros(a.shape, bool)
        for x, y in kept:
            b[y, x] = True
        assert not (b & ~a).any()
        if a.any():
            assert flood_counts(b) == flood_counts(a)
    assert len(got[len(grids) - 2]) == 1 and len(got[len(grids) - 1]) < 60


def test_edge_cases(spark):
    assert thinned(spark.createDataFrame([], SCHEMA), F.col("s")).collect() == []
    odd = [(1, 0, 0, "a", None), (1, 1, 0, "b", 2.0), (1, 1, 0, "b", 3.0), (2, 5, 5, None, 1.0), (None, 7, 7, "a", 1.0)]
    got = {tuple(r) for r in thinned(spark.createDataFrame(odd, SCHEMA).withColumn("rank", F.lit("x")), F.col("s")).collect()}
    assert got == {(1, 1, 0), (None, 7, 7)}
