"""Geometry expressions and point generators on integer grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .color import half_up

Point = tuple[Column, Column]


def contain_fit(source_w: Column, source_h: Column, w: Column, h: Column) -> tuple[Column, Column, Column]:
    """Scale and offsets that fit a source into a grid without cropping, centred."""
    scale = F.least(w / source_w, h / source_h)
    return scale, (w - source_w * scale) / 2, (h - source_h * scale) / 2


def transform_point(m: list[float], x: Column, y: Column) -> Point:
    """A row-major 3x3 homogeneous transform; points at infinity raise."""
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) < 1e-9, F.raise_error(F.lit("a point lies at infinity")).cast("double")).otherwise(w)
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def polygon_area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule."""
    crossings = []
    for (ax, ay), (bx, by) in zip(points, points[-1:] + points[:-1], strict=True):
        if ay == by:
            continue
        crossings.append((((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int"))
    return F.pmod(reduce(lambda a, b: a + b, crossings, F.lit(0)), F.lit(2)) == 1


def on_boundary(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    hits = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        hits.append((F.abs(cross) <= 1e-9) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    return reduce(lambda a, b: a | b, hits)


def line(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Adds the cells x, y of each row's line: max(|dx|, |dy|, 1) equal steps, each rounded half up."""
    steps = F.greatest(F.abs(F.col(x1) - F.col(x0)), F.abs(F.col(y1) - F.col(y0)), F.lit(1))
    s = df.withColumn("_n", steps).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = lambda a, b: half_up(F.col(a) + (F.col(b) - F.col(a)) * F.col("_s") / F.col("_n")).cast("int")
    return s.withColumns({"x": at(x0, x1), "y": at(y0, y1)}).drop("_n", "_s")


def line_cells(ends: DataFrame, key: str, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """(key, x, y): the distinct cells of the lines of each key, without a table of all cells: a key's lines are gathered, not their cells."""

    def cells(e: Column) -> Column:
        n = F.greatest(F.abs(e[x1] - e[x0]), F.abs(e[y1] - e[y0]), F.lit(1))
        at = lambda a, b, s: half_up(e[a] + (e[b] - e[a]) * s / n).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda s: F.struct(at(x0, x1, s).alias("x"), at(y0, y1, s).alias("y")))

    lines = ends.groupBy(key).agg(F.collect_list(F.struct(x0, y0, x1, y1)).alias("_l"))
    return lines.select(key, F.explode(F.array_distinct(F.flatten(F.transform("_l", cells)))).alias("_c")).select(key, "_c.x", "_c.y")


def box(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Adds all cells x, y of each row's rectangle, corners in any order."""
    span = lambda a, b: F.sequence(F.least(a, b), F.greatest(a, b))
    return df.withColumn("y", F.explode(span(y0, y1))).withColumn("x", F.explode(span(x0, x1)))


def edge_of_box(x0: str, y0: str, x1: str, y1: str) -> Column:
    return F.col("x").isin(F.least(x0, x1)) | F.col("x").isin(F.greatest(x0, x1)) | F.col("y").isin(F.least(y0, y1)) | F.col("y").isin(F.greatest(y0, y1))


def in_circle(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Cells of a filled circle in a square box: squared distance from the rounded centre within (radius + 0.2)^2."""
    c = [F.col(c) for c in (x0, y0, x1, y1)]
    size = F.least(F.abs(c[2] - c[0]), F.abs(c[3] - c[1]))
    cx, cy = half_up((c[0] + c[2]) / 2), half_up((c[1] + c[3]) / 2)
    radius = F.greatest(F.lit(1), half_up(size / 2))
    d = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)
    return d <= (radius + 0.2) * (radius + 0.2)


def in_ellipse(x0: str, y0: str, x1: str, y1: str) -> Column:
    c = [F.col(c) for c in (x0, y0, x1, y1)]
    w, h = F.abs(c[2] - c[0]), F.abs(c[3] - c[1])
    nx = (F.col("x") - (c[0] + c[2]) / 2) / F.greatest(F.lit(0.5), w / 2)
    ny = (F.col("y") - (c[1] + c[3]) / 2) / F.greatest(F.lit(0.5), h / 2)
    return (w <= 1) | (h <= 1) | (nx * nx + ny * ny <= 1.02)


def filled_circle(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Adds the cells of each square box's filled circle; around a rounded centre it may reach one cell beyond the box."""
    c = [F.col(c) for c in (x0, y0, x1, y1)]
    rows = df.withColumns({"_r": F.greatest(F.lit(1), half_up(F.least(F.abs(c[2] - c[0]), F.abs(c[3] - c[1])) / 2)).cast("int"), "_cx": half_up((c[0] + c[2]) / 2).cast("int"), "_cy": half_up((c[1] + c[3]) / 2).cast("int")})
    rows = rows.withColumn("y", F.explode(F.sequence(F.col("_cy") - F.col("_r"), F.col("_cy") + F.col("_r"))))
    rows = rows.withColumn("x", F.explode(F.sequence(F.col("_cx") - F.col("_r"), F.col("_cx") + F.col("_r"))))
    return rows.where(in_circle(x0, y0, x1, y1)).drop("_r", "_cx", "_cy")
