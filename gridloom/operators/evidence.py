"""Evidence from images: votes of cells, components and their descriptors, masks on grids, whole conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from . import match as M
from . import sampling as S
from .diagnostics import regions
from .rounds import ascend


def cell_votes(matched: DataFrame, share: float) -> DataFrame:
    """(grid_id, cx, cy, color, share): a cell's most frequent sample colour if its share is enough, else null; ties: smaller id."""
    votes = matched.groupBy("grid_id", "cx", "cy", "color").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("grid_id", "cx", "cy").agg(F.min_by(F.struct("color", "n"), F.struct(-F.col("n"), "color")).alias("m"), F.sum("n").alias("total"))
    got = F.col("m.n") / F.col("total")
    return best.select("grid_id", "cx", "cy", F.when(got >= share, F.col("m.color")).alias("color"), got.alias("share"))


def component_descriptors(pixels: DataFrame, least: int = 3) -> DataFrame:
    """A row per 8-connected component of equal 4-bit colour among opaque pixels: area, box, density, whether it is compact.

    Components under ``least`` pixels are dropped. Labels are per image; the descriptors are one aggregate.
    """
    keyed = pixels.withColumn("color", F.when(F.col("a") >= 128, S.bin_key().cast("string")))
    found = regions(keyed, True, True).join(pixels.select("grid_id", "idx", "x", "y"), ["grid_id", "idx"])
    out = found.groupBy("grid_id", "region").agg(F.count(F.lit(1)).alias("area"), *[f(c).alias(n) for n, f, c in (("l", F.min, "x"), ("t", F.min, "y"), ("r", F.max, "x"), ("b", F.max, "y"))])
    w, h = F.col("r") - F.col("l") + 1, F.col("b") - F.col("t") + 1
    density = F.col("area") / (w * h)
    compact = (density >= 0.5) & (F.greatest(w, h) <= 2 * F.least(w, h))
    return out.where(F.col("area") >= least).select("grid_id", "region", "area", "l", "t", "r", "b", density.alias("density"), compact.alias("compact"))


def project_mask(runs: DataFrame, width: int, height: int, w: int, h: int, least: float = 0.04) -> DataFrame:
    """(grid_id, cx, cy, coverage): a run-length mask over source pixels as the cells it covers by at least ``least``."""
    idx = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("idx")
    px = runs.select("grid_id", idx).distinct().select("grid_id", (F.col("idx") % width).cast("int").alias("x"), F.floor(F.col("idx") / width).cast("int").alias("y"), F.lit(255).alias("a"))
    scale = S.fit(width, height, w, h)[0]
    rows = S.overlaps(px, width, height, w, h).groupBy("grid_id", "cx", "cy").agg((F.sum("area") * scale * scale).alias("coverage"))
    return rows.where(F.col("coverage") + 1e-12 >= least)


def generate(pixels: DataFrame, palette: DataFrame, width: int, height: int, w: int, h: int, max_colors: int) -> DataFrame:
    """(grid_id, cx, cy, color): area samples matched to the palette, again within each grid's most frequent colours."""
    area = S.sample_area(pixels, width, height, w, h)
    lab = C.oklab((F.col("lr"), F.col("lg"), F.col("lb")))
    cells = area.select("grid_id", "cx", "cy", *[c.alias(n) for c, n in zip(lab, C.OK, strict=True)])
    first = M.nearest_oklab(cells, palette)
    kept = S.budget_by_frequency(first, max_colors).groupBy("grid_id").agg(F.collect_set("color").alias("kept"))
    pal = F.broadcast(C.with_oklab(palette).select("id", *C.OK).agg(F.sort_array(F.collect_list(F.struct("id", *C.OK))).alias("pal")))
    rows = first.drop("color").join(kept, "grid_id").crossJoin(pal)
    allowed = F.filter("pal", lambda p: F.array_contains("kept", p["id"]))
    near = F.array_min(F.transform(allowed, lambda p: F.struct(C.squared(tuple(F.col(c) for c in C.OK), tuple(p[c] for c in C.OK)).alias("d"), p["id"].alias("id"))))
    return rows.select("grid_id", "cx", "cy", near["id"].alias("color"))


def scene_feature(pixels: DataFrame, inside: Column, palette: DataFrame) -> DataFrame:
    """(grid_id, key, n, color): the fullest colour bin of a box (ties: smaller key) and the palette colour nearest to its mean."""
    bins = pixels.where(inside & (F.col("a") >= 128)).withColumn("key", S.bin_key()).groupBy("grid_id", "key").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    rank = F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("n"), "key"))
    top = bins.withColumn("_k", rank).where("_k = 1").drop("_k").select("grid_id", "key", "n", *[C.half_up(F.col(c)).cast("int").alias(c) for c in "rgb"])
    return M.nearest_oklab(C.with_oklab(top), palette).select("grid_id", "key", "n", "color")


def over_white(pixels: DataFrame) -> DataFrame:
    """Adds cr, cg, cb: each pixel over white; null where it is fully clear."""
    mixed = {f"c{c}": F.when(F.col("a") > 0, C.half_up((F.col(c) * F.col("a") + 255 * (255 - F.col("a"))) / 255).cast("int")) for c in "rgb"}
    return pixels.withColumns(mixed)


def subtree(tree: DataFrame, root: Column, key: str = "id", parent: str = "parent") -> DataFrame:
    """(key) of the rows that ``root`` selects and all below them, in logarithmically many joins; cycles end."""
    return ascend(tree, root, key=key, parent=parent).where("marked").select(key)
