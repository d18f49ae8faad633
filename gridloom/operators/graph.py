"""Paths, skeletons, merges and fills on single grids, for use per group; each works on plain arrays."""

from __future__ import annotations

import heapq
import itertools
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diagnostics import label_regions, spread

RING = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def cheapest_path(weight: dict[tuple[int, int], float], starts: set, ends: set, eight: bool = True) -> list[tuple[int, int]]:
    """Path over supported cells from any start to any end; entering a cell costs 1 + (1 - its weight). Empty if there is none."""
    steps = RING if eight else RING[::2]
    tie = itertools.count()
    heap = [(0.0, next(tie), s, None) for s in sorted(starts) if s in weight]
    came: dict = {}
    while heap:
        d, _, at, before = heapq.heappop(heap)
        if at in came:
            continue
        came[at] = before
        if at in ends:
            path = [at]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            return path[::-1]
        for dx, dy in steps:
            q = at[0] + dx, at[1] + dy
            if q in weight and q not in came:
                heapq.heappush(heap, (d + 2 - weight[q], next(tie), q, at))
    return []


def distances(cells: set, start: tuple[int, int], eight: bool = True) -> dict:
    """Steps from a start to every cell that can be reached."""
    out, queue = {start: 0}, deque([start])
    while queue:
        x, y = queue.popleft()
        for dx, dy in RING if eight else RING[::2]:
            q = x + dx, y + dy
            if q in cells and q not in out:
                out[q] = out[x, y] + 1
                queue.append(q)
    return out


def farthest_pair(cells: set, eight: bool = True) -> tuple[tuple[int, int], tuple[int, int], int]:
    """Ends and length of a long shortest path by two searches (exact on trees); ties go to the smaller (y, x)."""
    order = lambda d: min(d, key=lambda c: (-d[c], c[1], c[0]))
    first = min(cells, key=lambda c: (c[1], c[0]))
    a = order(distances(cells, first, eight))
    far = distances(cells, a, eight)
    b = order(far)
    return a, b, far[b]


def enclosed(mask: np.ndarray) -> np.ndarray:
    """Empty cells that can't reach the outside by 4-steps."""
    padded = np.pad(~mask, 1, constant_values=True)
    y, x = np.indices(padded.shape)
    label = label_regions(np.where(padded.ravel(), "e", None), x.ravel(), y.ravel(), False, False).reshape(padded.shape)
    return (padded & (label != label[0, 0]))[1:-1, 1:-1]


def thin(mask: np.ndarray) -> np.ndarray:
    """One-cell-wide skeleton by alternating deletion of border cells that keep the ring around them connected."""
    m = np.pad(mask.astype(np.int8), 1)
    while True:
        changed = False
        for phase in (0, 1):
            p = [np.roll(m, (-dy, -dx), (0, 1)) for dx, dy in RING]
            count = sum(p)
            turns = sum((a == 0) & (b == 1) for a, b in zip(p, p[1:] + p[:1], strict=True))
            n, e, s, w = p[0], p[2], p[4], p[6]
            kept = (n * e * s == 0) & (e * s * w == 0) if phase == 0 else (n * e * w == 0) & (n * s * w == 0)
            gone = (m == 1) & (count >= 2) & (count <= 6) & (turns == 1) & kept
            if gone.any():
                m[gone] = 0
                changed = True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def critical_cells(mask: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) of a skeleton's ends, junctions and isolated cells; diagonal links beside straight ones don't count."""
    skeleton = np.pad(thin(mask), 1)
    out = []
    for y, x in zip(*np.nonzero(skeleton), strict=True):
        p = [bool(skeleton[y + dy, x + dx]) for dx, dy in RING]
        degree = sum(p[::2]) + sum(p[k] and not p[k - 1] and not p[(k + 1) % 8] for k in (1, 3, 5, 7))
        if degree <= 1 or degree >= 3:
            out.append((int(x) - 1, int(y) - 1))
    return out


def merge_small_regions(color: np.ndarray, width: int, limit: int, similar=lambda a, b: True) -> np.ndarray:
    """Regions of at most ``limit`` cells take the most frequent similar colour on their border, smallest index first; one pass."""
    out = color.copy()
    y, x = np.divmod(np.arange(len(out)), width)
    label = label_regions(out, x, y, True, False)
    for region in np.unique(label[label >= 0]):
        members = np.flatnonzero(label == region)
        if len(members) > limit:
            continue
        votes: dict = {}
        for i in members:
            for d in (-1, 1, -width, width):
                q = i + d
                if 0 <= q < len(out) and (abs(d) != 1 or q // width == i // width) and label[q] != region and out[q] is not None and out[q] != out[i] and similar(out[i], out[q]):
                    votes[out[q]] = votes.get(out[q], 0) + 1
        if votes:
            out[members] = min(votes, key=lambda c: (-votes[c], c))
    return out


def replacement_chain(colors: list, counts: list[int], similar) -> dict:
    """Rarer colours fall to the first more frequent similar colour, through earlier replacements; ties keep the given order."""
    order = sorted(range(len(colors)), key=lambda i: -counts[i])
    to: dict = {}
    for k, i in enumerate(order):
        target = next((colors[j] for j in order[:k] if similar(colors[i], colors[j])), None)
        if target is not None:
            to[colors[i]] = to.get(target, target)
    return to


def spread_selection(points: np.ndarray, weight: np.ndarray, k: int) -> list[int]:
    """k indices: the heaviest first, then always the point with the greatest root weight times distance to those chosen."""
    chosen = [int(np.argmax(weight))] if len(points) else []
    far = np.full(len(points), np.inf)
    while chosen and len(chosen) < min(k, len(points)):
        far = np.minimum(far, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1)))
        score = np.sqrt(weight) * far
        score[chosen] = -1
        chosen.append(int(np.argmax(score)))
    return chosen


def harmonic_fill(values: np.ndarray, hole: np.ndarray, sweeps: int = 192, tolerance: float = 1e-6) -> np.ndarray:
    """Values in a hole as means of their 4-neighbours, in place row by row, until no change exceeds the tolerance."""
    out = values.astype(float).copy()
    known = ~hole
    if not known.any():
        return out
    out[hole] = out[known].mean()
    h, w = out.shape
    cells = list(zip(*np.nonzero(hole), strict=True))
    for _ in range(sweeps):
        most = 0.0
        for y, x in cells:
            around = [out[j, i] for j, i in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= j < h and 0 <= i < w]
            new = sum(around) / len(around)
            most = max(most, abs(new - out[y, x]))
            out[y, x] = new
        if most < tolerance:
            break
    return out


def assign_regions(iou: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of greatest total overlap among pairs of at least ``least``; shortest augmenting paths."""
    n, m = iou.shape
    size = n + m  # each row may stay alone
    cost = np.zeros((size, size))
    cost[:n, :m] = np.where(iou >= least, -iou, 0.0)
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = slack < low[free]
            low[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(low[free])]
            d = low[j1]
            u[match[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] - 1 < n]
    return sorted((i, j) for i, j in pairs if iou[i, j] >= least)


def merge_regions(cells: DataFrame, width: int, limit: int) -> DataFrame:
    """(grid_id, idx, color) after ``merge_small_regions`` of every grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        color = pdf["color"].astype(object).where(pdf["color"].notna(), None).to_numpy(object)
        return pd.DataFrame({"grid_id": pdf["grid_id"], "idx": pdf["idx"], "color": merge_small_regions(color, width, limit)})

    return spread(cells.select("grid_id", "idx", "color")).groupBy("grid_id").applyInPandas(run, "grid_id long, idx int, color string")


def skeletons(cells: DataFrame) -> DataFrame:
    """(grid_id, x, y) of the critical cells of each grid's occupied cells."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), bool)
        full = pdf[pdf["color"].notna()]
        mask[full["y"], full["x"]] = True
        found = critical_cells(mask)
        return pd.DataFrame({"grid_id": pdf["grid_id"].iat[0], "x": [p[0] for p in found], "y": [p[1] for p in found]}).astype({"x": "int32", "y": "int32"})

    return spread(cells.select("grid_id", "x", "y", "color")).groupBy("grid_id").applyInPandas(run, "grid_id long, x int, y int")


def clip_to_box(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A polygon cut to a rectangle (left, top, right, bottom), side by side."""
    for axis, limit, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for a, b in zip(points, points[1:] + points[:1], strict=True):
            in_a, in_b = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if in_a:
                out.append(a)
            if in_a != in_b:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        points = out
        if not points:
            break
    return points


def area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2 if points else 0.0


def box_overlap(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> float:
    """Intersection over union of a polygon and a rectangle."""
    shared = area(clip_to_box(points, box))
    total = area(points) + (box[2] - box[0]) * (box[3] - box[1]) - shared
    return shared / total if total > 0 else 0.0


def crossing(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether the segments a b and c d share a point."""
    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def on(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    s = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    if s[0] != s[1] and s[2] != s[3]:
        return True
    return any(k == 0 and on(*seg, p) for k, seg, p in ((s[0], (a, b), c), (s[1], (a, b), d), (s[2], (c, d), a), (s[3], (c, d), b)))


def is_simple(points: list[tuple[float, float]]) -> bool:
    """At least three corners, some area, and no two sides that touch other than at a shared corner."""
    n = len(points)
    if n < 3 or area(points) == 0:
        return False
    sides = [(points[i], points[(i + 1) % n]) for i in range(n)]
    return not any(crossing(*sides[i], *sides[j]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i)


def merge_similar(cells: DataFrame, similar, key: str = "grid_id") -> DataFrame:
    """Cells with rarer colours replaced along the chain of similar more frequent ones; only the colour counts of a grid meet in a task."""
    counts = cells.where("color IS NOT NULL").groupBy(key, "color").agg(F.count(F.lit(1)).alias("n"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "color"], ascending=[False, True])
        to = replacement_chain(pdf["color"].tolist(), pdf["n"].tolist(), similar)
        return pd.DataFrame({key: pdf[key], "color": pdf["color"], "_to": [to.get(c, c) for c in pdf["color"]]})

    swaps = counts.groupBy(key).applyInPandas(chain, f"{key} long, color string, _to string")
    return cells.join(swaps, [key, "color"], "left").withColumn("color", F.coalesce("_to", "color")).drop("_to")


def limit_colors(cells: DataFrame, palette: dict[str, tuple[int, int, int]], k: int, distance, key: str = "grid_id") -> DataFrame:
    """At most k colours in each grid: frequent and far-apart ones stay, others go to the nearest of them (ties: smaller id)."""
    counts = cells.where("color IS NOT NULL").groupBy(key, "color").agg(F.count(F.lit(1)).alias("n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "color"], ascending=[False, True])
        ids = pdf["color"].tolist()
        kept = [ids[i] for i in spread_selection(np.array([palette[c] for c in ids], float), pdf["n"].to_numpy(float), k)]
        to = [c if c in kept else min(kept, key=lambda q: (distance(palette[c], palette[q]), q)) for c in ids]
        return pd.DataFrame({key: pdf[key], "color": ids, "_to": to})

    swaps = counts.groupBy(key).applyInPandas(choose, f"{key} long, color string, _to string")
    return cells.join(swaps, [key, "color"], "left").withColumn("color", F.coalesce("_to", "color")).drop("_to")
