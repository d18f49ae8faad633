"""Resampling of images to grids, histograms and modes of cells, smoothing, borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C

ALPHA = 0.5


def fit(width: int, height: int, w: int, h: int, phase: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float, float]:
    scale = min(w / width, h / height)
    return scale, (w - width * scale) / 2 + phase[0], (h - height * scale) / 2 + phase[1]


def sample_nearest(pixels: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """(grid_id, cx, cy, r, g, b) of the source pixel under each cell's centre; cells on transparent or no source are left out."""
    scale, dx, dy = fit(width, height, w, h)
    spots = [(x, y, int((x + 0.5 - dx) / scale // 1), int((y + 0.5 - dy) / scale // 1)) for y in range(h) for x in range(w)]
    inside = [s for s in spots if 0 <= s[2] < width and 0 <= s[3] < height]
    grid = pixels.sparkSession.createDataFrame(inside, "cx int, cy int, x int, y int")
    return pixels.where(F.col("a") / 255 >= ALPHA).join(F.broadcast(grid), ["x", "y"]).select("grid_id", "cx", "cy", "r", "g", "b")


def overlaps(pixels: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """A row per pixel and cell that overlap: cell place, overlap area, weight = area times opacity.

    The cells of a pixel follow from its place, so a pixel is expanded to them; there is no range join.
    """
    scale, dx, dy = fit(width, height, w, h)

    def reach(c: str, d: float, size: int):
        low = F.greatest(F.lit(0), F.floor(F.col(c) * scale + d).cast("int"))
        high = F.least(F.lit(size - 1), (F.ceil((F.col(c) + 1) * scale + d) - 1).cast("int"))
        return F.when(low <= high, F.sequence(low, high))

    def shared(cell: str, c: str, d: float):
        return F.least((F.col(cell) + 1 - d) / scale, F.col(c) + 1) - F.greatest((F.col(cell) - d) / scale, F.col(c).cast("double"))

    rows = pixels.withColumn("cx", F.explode(reach("x", dx, w))).withColumn("cy", F.explode(reach("y", dy, h)))
    rows = rows.withColumn("area", F.greatest(F.lit(0.0), shared("cx", "x", dx)) * F.greatest(F.lit(0.0), shared("cy", "y", dy)))
    return rows.withColumn("weight", F.col("area") * F.col("a") / 255)


def sample_area(pixels: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """(grid_id, cx, cy, coverage, lr, lg, lb): opacity-weighted mean in linear light of each cell covered at least half."""
    scale = fit(width, height, w, h)[0]
    rows = overlaps(pixels, width, height, w, h)
    mean = {f"l{c}": F.sum(F.col("weight") * C.byte_to_linear(F.col(c))) for c in "rgb"}
    out = rows.groupBy("grid_id", "cx", "cy").agg(F.sum("weight").alias("covered"), *[v.alias(k) for k, v in mean.items()])
    out = out.where((F.col("covered") > 0) & (F.col("covered") * scale * scale + 1e-12 >= ALPHA))
    share = F.least(F.lit(1.0), F.col("covered") * scale * scale)
    return out.select("grid_id", "cx", "cy", share.alias("coverage"), *[(F.col(f"l{c}") / F.col("covered")).alias(f"l{c}") for c in "rgb"])


def bin_key() -> Column:
    return F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)


def color_bins(pixels: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """(grid_id, cx, cy, key, weight, lr, lg, lb): each cell's histogram over bins of 4 bits a channel."""
    rows = overlaps(pixels, width, height, w, h).where("weight > 0").withColumn("key", bin_key())
    return rows.groupBy("grid_id", "cx", "cy", "key").agg(F.sum("weight").alias("weight"), *[(F.sum(F.col("weight") * C.byte_to_linear(F.col(c))) / F.sum("weight")).alias(f"l{c}") for c in "rgb"])


def top_modes(bins: DataFrame, n: int = 3) -> DataFrame:
    """The n heaviest bins of each cell (ties: smaller key) as ranks 1.., all others merged into rank 0; weights are shares."""
    cell = Window.partitionBy("grid_id", "cx", "cy")
    ranked = bins.withColumns({"total": F.sum("weight").over(cell), "at": F.row_number().over(cell.orderBy(F.round("weight", 9).desc(), "key"))})
    rank = F.when(F.col("at") <= n, F.col("at")).otherwise(0).alias("rank")
    return ranked.groupBy("grid_id", "cx", "cy", rank).agg((F.sum("weight") / F.max("total")).alias("share"), F.min("key").alias("key"))


def pair_contrast(cells: DataFrame, width: int) -> DataFrame:
    """Adds right and down: OKLab distance (at most 1) to the next cell of the row and of the column, null at the edge."""
    at = Window.partitionBy("grid_id", "y").orderBy("x"), Window.partitionBy("grid_id", "x").orderBy("y")
    lab = tuple(F.col(c) for c in C.OK)

    def to(window):
        return F.least(F.lit(1.0), F.sqrt(C.squared(lab, tuple(F.lead(c).over(window) for c in C.OK))))

    return cells.withColumns({"right": to(at[0]), "down": to(at[1])})


def bilateral(pixels: DataFrame) -> DataFrame:
    """(grid_id, x, y, r, g, b, a): 3 x 3 smoothing in linear light that keeps edges; transparent pixels neither change nor count.

    A pixel sends itself to its nine neighbours and each place is summed once: one shuffle, no self-join explosion.
    """
    lin = pixels.select("grid_id", "x", "y", "r", "g", "b", "a", *[C.byte_to_linear(F.col(c)).alias(f"l{c}") for c in "rgb"])
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    sent = lin.where("a > 0").select("grid_id", F.explode(offsets).alias("o"), "x", "y", "a", "lr", "lg", "lb")
    sent = sent.select("grid_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("o.dx") ** 2 + F.col("o.dy") ** 2).alias("far"), F.col("a").alias("na"), *[F.col(f"l{c}").alias(f"n{c}") for c in "rgb"])
    rows = lin.join(sent, ["grid_id", "x", "y"], "left")
    d = C.squared(tuple(F.col(f"l{c}") for c in "rgb"), tuple(F.col(f"n{c}") for c in "rgb"))
    rows = rows.withColumn("w", F.col("na") / 255 * F.exp(-0.5 * F.col("far") - d / 0.02))
    keep = ["grid_id", "x", "y", "r", "g", "b", "a"]
    out = rows.groupBy(*keep).agg(*[(F.sum(F.col("w") * F.col(f"n{c}")) / F.sum("w")).alias(f"m{c}") for c in "rgb"])
    return out.select("grid_id", "x", "y", *[F.when(F.col("a") == 0, F.col(c)).otherwise(C.linear_to_byte(F.col(f"m{c}"))).alias(c) for c in "rgb"], "a")


def bounds(cells: DataFrame, occupied) -> DataFrame:
    """(grid_id, l, t, r, b, n): half-open bounds of the occupied cells of each grid."""
    return cells.where(occupied).groupBy("grid_id").agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"), F.count(F.lit(1)).alias("n"))


def modal_background(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(grid_id, r, g, b): mean of the fullest 16-level bin on the border; needs half of it opaque and a quarter of that in the bin.

    Of equally full bins the one met first on the border counts: top row, bottom row, then the sides.
    """
    edge = (F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x") == 0) | (F.col("x") == width - 1)
    border = 2 * (width + height) - 4
    rows = pixels.where(edge & (F.col("a") >= 128)).withColumn("key", bin_key())
    rows = rows.groupBy("grid_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), *[F.sum(c).alias(c) for c in "rgb"])
    best = rows.groupBy("grid_id").agg(F.sum("n").alias("opaque"), F.max_by(F.struct("n", "r", "g", "b"), F.struct("n", -F.col("first"))).alias("m"))
    best = best.where((F.col("opaque") * 2 >= border) & (F.col("m.n") * 4 >= F.col("opaque")))
    return best.select("grid_id", *[C.half_up(F.col(f"m.{c}") / F.col("m.n")).cast("int").alias(c) for c in "rgb"])


def budget_by_frequency(cells: DataFrame, n: int) -> DataFrame:
    """The n most frequent colours of each grid (ties: smaller id), for matching again within the budget."""
    counts = cells.where("color IS NOT NULL").groupBy("grid_id", "color").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("n"), "color"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def minority_modes(bins: DataFrame, top: int = 3, least: float = 0.02, contrast: float = 0.18) -> DataFrame:
    """(grid_id, cx, cy, key, share, contrast): beside the ``top`` heaviest bins of a cell, the one that stands out most from the heaviest.

    Candidates hold at least ``least`` of the cell and differ by more than ``contrast`` in OKLab; contrast times root share decides.
    """
    cell = Window.partitionBy("grid_id", "cx", "cy")
    lab = C.oklab((F.col("lr"), F.col("lg"), F.col("lb")))
    rows = bins.withColumns({"share": F.col("weight") / F.sum("weight").over(cell), "place": F.row_number().over(cell.orderBy(F.round("weight", 9).desc(), "key"))})
    rows = rows.withColumns(dict(zip(C.OK, lab, strict=True)))
    main = tuple(F.first(F.when(F.col("place") == 1, F.col(c)), ignorenulls=True).over(cell) for c in C.OK)
    rows = rows.withColumn("contrast", F.sqrt(C.squared(tuple(F.col(c) for c in C.OK), main)))
    rows = rows.where((F.col("place") > top) & (F.col("share") >= least) & (F.col("contrast") > contrast))
    best = F.row_number().over(cell.orderBy(F.round(F.col("contrast") * F.sqrt("share"), 9).desc(), "key"))
    return rows.withColumn("_best", best).where("_best = 1").select("grid_id", "cx", "cy", "key", "share", "contrast")


def sample_points(pixels: DataFrame, width: int, height: int, w: int, h: int, n: int) -> DataFrame:
    """(grid_id, cx, cy, sx, sy, r, g, b, a): n x n evenly spread sample points in each cell, read from the nearest pixel."""
    spots = []
    for c in range(w * h):
        cy, cx = divmod(c, w)
        for s in range(n * n):
            sy, sx = divmod(s, n)
            spots.append((cx, cy, sx, sy, min(width - 1, int((cx + (sx + 0.5) / n) * width / w)), min(height - 1, int((cy + (sy + 0.5) / n) * height / h))))
    grid = pixels.sparkSession.createDataFrame(spots, "cx int, cy int, sx int, sy int, x int, y int")
    return pixels.join(F.broadcast(grid), ["x", "y"]).select("grid_id", "cx", "cy", "sx", "sy", "r", "g", "b", "a")
