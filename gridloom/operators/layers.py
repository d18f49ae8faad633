"""Layered grids: composites, recolouring, moving, pasting, resizing, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEN = "visible AND opacity > 0"


def composite(layers: DataFrame) -> DataFrame:
    """(cell, color): the highest non-empty colour among layers that are visible and not fully transparent."""
    return layers.where(SEEN).where("color IS NOT NULL").groupBy("cell").agg(F.max_by("color", "z").alias("color"))


def top_visible(layers: DataFrame) -> DataFrame:
    """As ``composite``, but opacity doesn't matter: what an eyedropper picks."""
    return layers.where("visible AND color IS NOT NULL").groupBy("cell").agg(F.max_by("color", "z").alias("color"))


def usage(cells: DataFrame, known: DataFrame, per_pack: int) -> DataFrame:
    """(color, n, packs) of the colours that ``known`` (color) has; others are dropped."""
    counts = cells.where("color IS NOT NULL").groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known.select("color").distinct(), "color").withColumn("packs", F.ceil(F.col("n") / per_pack))


def recolor(layers: DataFrame, source: str, target: str, inside: Column | None = None) -> DataFrame:
    """Source colour becomes target in visible, unlocked layers (within ``inside``); ``changed`` marks the cells."""
    hit = F.col("visible") & ~F.col("locked") & (F.col("color") == source) & (F.lit(True) if inside is None else inside) & F.lit(source != target)
    hit = F.coalesce(hit, F.lit(False))
    return layers.withColumn("changed", hit).withColumn("color", F.when(F.col("changed"), F.lit(target)).otherwise(F.col("color")))


def mirror(cells: DataFrame, axis: str = "x") -> DataFrame:
    """Occupied cells mirrored within their own bounds along an axis."""
    full = cells.where("color IS NOT NULL")
    ends = full.groupBy("grid_id").agg((F.min(axis) + F.max(axis)).alias("ends"))
    return full.join(ends, "grid_id").withColumn(axis, F.col("ends") - F.col(axis)).drop("ends")


def shift(cells: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """Occupied cells moved; those that leave the grid are lost."""
    moved = cells.where("color IS NOT NULL").withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    return moved.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def clamped_shift(cells: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """(grid_id, dx, dy): the part of a move that keeps all occupied cells on the grid."""
    ends = cells.where("color IS NOT NULL").groupBy("grid_id").agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("b"))
    keep = lambda d, low, high, size: F.least(size - 1 - F.col(high), F.greatest(-F.col(low), F.lit(d)))
    return ends.select("grid_id", keep(dx, "l", "r", width).alias("dx"), keep(dy, "t", "b", height).alias("dy"))


def paste(cells: DataFrame, clip: DataFrame, dx: int, dy: int) -> DataFrame:
    """``cells`` with the non-empty cells of ``clip`` laid over at an offset; what falls outside the grid is clipped."""
    over = clip.where("color IS NOT NULL").select("grid_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("color").alias("_over"))
    return cells.join(over, ["grid_id", "x", "y"], "left").withColumn("color", F.coalesce("_over", "color")).drop("_over")


def resize(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Grids cut or padded with empty cells at the right and the bottom; the top left corner stays."""
    box = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("idx")
    frame = cells.select("grid_id").distinct().select("grid_id", box)
    frame = frame.select("grid_id", "idx", (F.col("idx") % width).alias("x"), F.floor(F.col("idx") / width).cast("int").alias("y"))
    return frame.join(cells.select("grid_id", "x", "y", "color"), ["grid_id", "x", "y"], "left")


def outside_locks(cells: DataFrame, inside: Column) -> DataFrame:
    """(grid_id, kind, color, idxs): every cell outside a selection as a lock, grouped by colour; empty cells lock as empty."""
    kind = F.when(F.col("color").isNull(), F.lit("lock-empty")).otherwise(F.lit("lock-color"))
    return cells.where(~inside).groupBy("grid_id", kind.alias("kind"), "color").agg(F.sort_array(F.collect_list("idx")).alias("idxs"))


def union_palettes(low: DataFrame, high: DataFrame, key: str) -> DataFrame:
    """Both palettes by key; where both have one, ``high`` wins."""
    both = low.withColumn("_p", F.lit(0)).unionByName(high.withColumn("_p", F.lit(1)))
    rest = [c for c in low.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_p").alias("v")).select(key, "v.*")
