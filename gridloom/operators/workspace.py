"""A workspace's bookkeeping: palette snapshots, capped lists, versions, active layers, constraints on selections, feature colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.color import half_up
from . import layers as L
from . import match as M
from .diagnostics import EIGHT


def snapshot(saved: DataFrame, layers: DataFrame) -> DataFrame:
    """(color, added): the saved colours, and those that any layer uses, hidden ones too, and the snapshot lacks."""
    used = layers.where("color IS NOT NULL").select("color").distinct().join(saved, "color", "left_anti")
    return saved.select("color").distinct().withColumn("added", F.lit(False)).unionByName(used.withColumn("added", F.lit(True)))


def capped_messages(messages: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """(key, place, message): all messages of a key if they are at most ``most``; else most - 1 and a line that counts the rest."""
    w = Window.partitionBy(key)
    rows = messages.select(key, "message", F.row_number().over(w.orderBy(order)).alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    rest = F.concat((F.col("n") - most + 1).cast("string"), F.lit(" additional diagnostics omitted."))
    text = F.when((F.col("place") == most) & (F.col("n") > most), rest).otherwise(F.col("message"))
    return rows.where(F.col("place") <= most).select(key, "place", text.alias("message"))


def latest_versions(versions: DataFrame, key: str, order: list[Column], most: int = 40) -> DataFrame:
    """The ``most`` newest versions of each key: what can be undone."""
    return versions.withColumn("_age", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_age") <= most).drop("_age")


def solo_view(layers: DataFrame, active: int) -> DataFrame:
    """Layers with ``shown``: only the active one is drawn; what is saved as visible stays."""
    return layers.withColumn("shown", (F.col("z") == active) & F.col("visible"))


def write_active(layers: DataFrame, edits: DataFrame, active: int) -> DataFrame:
    """(cell, color): the composite after ``edits`` (cell, color) went into the active layer; a locked layer takes none."""
    new = edits.select("cell", F.col("color").alias("_new"), F.lit(True).alias("_edit"))
    hit = F.coalesce(F.col("_edit"), F.lit(False)) & (F.col("z") == active) & ~F.col("locked")
    return L.composite(layers.join(new, "cell", "left").withColumn("color", F.when(hit, F.col("_new")).otherwise(F.col("color"))))


def constrain(constraints: DataFrame, cells: DataFrame, inside: Column, kind: str) -> DataFrame:
    """(grid_id, idx, kind, color) after a selection got a constraint: what it had goes; 'lock-color' locks each cell to what it holds
    (an empty one as empty), 'clear' adds nothing."""
    chosen = cells.where(inside).select("grid_id", "idx", "color")
    kept = constraints.select("grid_id", "idx", "kind", "color").join(chosen.select("grid_id", "idx"), ["grid_id", "idx"], "left_anti")
    if kind == "clear":
        return kept
    name, color = F.lit(kind), F.lit(None).cast("string")
    if kind == "lock-color":
        name, color = F.when(F.col("color").isNull(), F.lit("lock-empty")).otherwise(name), F.col("color")
    return kept.unionByName(chosen.select("grid_id", "idx", name.alias("kind"), color.alias("color")))


def color_positions(cells: DataFrame) -> DataFrame:
    """(grid_id, color, n, idxs): the places of each colour in order."""
    rows = cells.where("color IS NOT NULL").groupBy("grid_id", "color")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("idx")).alias("idxs"))


def workspace_ids(palette: DataFrame, brand: str) -> DataFrame:
    """(id, workspace_id): colours of ``brand`` go by brand and lower-case code, others keep their id."""
    known = F.concat(F.lit(brand.lower() + "-"), F.lower("code"))
    return palette.select("id", F.when(F.col("brand") == brand, known).otherwise(F.col("id")).alias("workspace_id"))


def similar_colors(samples: DataFrame, palette: DataFrame, k: int = 6) -> DataFrame:
    """A row per rank with the ``k`` palette colours nearest to each row's r, g, b in OKLab, by (distance, id)."""
    return M.top_k(C.with_oklab(samples), palette, k)


def option_violations(options: DataFrame, ranges: dict[str, tuple[int, int]], kinds: dict[str, list[str]], weights: dict[str, tuple[int, int]] | None = None, flags: list[str] | None = None) -> DataFrame:
    """(request, field, rule) of every option given (name, value as text) that isn't known or breaks its rule.

    ``ranges`` are whole numbers within bounds, ``weights`` any numbers within bounds, ``kinds`` one of some words, ``flags`` true or false.
    """
    name, value, number = F.col("name"), F.col("value"), F.expr("try_cast(value AS DECIMAL(38, 6))")

    def outside(bounds: dict[str, tuple[int, int]]) -> Column:
        low, high = (F.coalesce(*[F.when(name == n, F.lit(b[i]).cast("long")) for n, b in bounds.items()], F.lit(None).cast("long")) for i in (0, 1))
        return number.isNull() | (number < low) | (number > high)

    kind_ok = F.lit(False)
    for n, values in kinds.items():
        kind_ok = kind_ok | ((name == n) & value.isin(values))
    rule = F.when(name.isin(list(ranges)), F.when(outside(ranges) | (number != F.floor(number)), "not a whole number in range"))
    rule = rule.when(name.isin(list(weights or {})), F.when(outside(weights or {}), "not a number in range"))
    rule = rule.when(name.isin(list(flags or [])), F.when(~value.isin("true", "false"), "not true or false"))
    rule = rule.when(name.isin(list(kinds)), F.when(~kind_ok, "unknown strategy")).otherwise("unknown option")
    return options.where("value IS NOT NULL").withColumn("rule", rule).where("rule IS NOT NULL").select("request", name.alias("field"), "rule")


def despeckle(cells: DataFrame, passes: int, same_limit: int, majority: int) -> DataFrame:
    """``passes`` (0 to 4) synchronous majority passes. Of equally frequent neighbour colours the one met first, row by row, counts."""
    if not 0 <= passes <= 4:
        raise ValueError("there are 0 to 4 passes")
    for _ in range(passes):
        to = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in EIGHT])).alias("o")
        sent = cells.where("color IS NOT NULL").select("grid_id", "x", "y", F.col("color").alias("n_color"), to)
        sent = sent.selectExpr("grid_id", "x + o.dx AS x", "y + o.dy AS y", "n_color", "-3 * o.dy - o.dx AS place")
        near = cells.where("color IS NOT NULL").select("grid_id", "x", "y", "color").join(sent, ["grid_id", "x", "y"])
        votes = near.groupBy("grid_id", "x", "y", "color", "n_color").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        best = votes.groupBy("grid_id", "x", "y").agg(
            F.min_by(F.struct("n_color", "n"), F.struct(-F.col("n"), F.col("first"))).alias("m"), F.sum(F.when(F.col("n_color") == F.col("color"), F.col("n")).otherwise(0)).alias("same")
        )
        hit = F.coalesce((F.col("same") <= same_limit) & (F.col("m.n") >= majority), F.lit(False))
        cells = cells.join(best, ["grid_id", "x", "y"], "left").withColumn("color", F.when(hit, F.col("m.n_color")).otherwise(F.col("color"))).drop("m", "same")
    return cells


def voted_colors(samples: DataFrame, palette: DataFrame, share: float) -> DataFrame:
    """(grid_id, cx, cy, color): the colour that most of a cell's samples (order, r, g, b) match; where its share is below ``share``, the colour
    nearest to the samples' average. Of equally frequent colours the one met first counts."""
    matched = M.nearest_redmean(samples, palette, *(F.col(c) for c in "rgb"))
    votes = matched.groupBy("grid_id", "cx", "cy", "color").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("first"), *[F.sum(c).alias(c) for c in "rgb"])
    cell = votes.groupBy("grid_id", "cx", "cy").agg(F.min_by(F.struct("color", "n"), F.struct(-F.col("n"), "first")).alias("m"), F.sum("n").alias("total"), *[F.sum(c).alias(c) for c in "rgb"])
    mean = M.nearest_redmean(cell, palette, *(half_up(F.col(c) / F.col("total")) for c in "rgb"), out="mean_color")
    return mean.select("grid_id", "cx", "cy", F.when(F.col("m.n") / F.col("total") >= share, F.col("m.color")).otherwise(F.col("mean_color")).alias("color"))


def feature_colors(counts: DataFrame) -> DataFrame:
    """Colours (grid_id, r, g, b, n) with ``feature``: vivid or dark ones whose share of the most frequent colour is enough, and
    ``feature_palette``: vivid or dark ones by themselves."""
    p = tuple(F.col(c) for c in "rgb")
    share = F.col("n") / F.greatest(F.lit(1), F.max("n").over(Window.partitionBy("grid_id")))
    chroma, light = C.chroma(p), C.luma(p)
    feature = ((chroma > 70) & (share > 0.002)) | ((chroma > 52) & (share > 0.006)) | ((light < 36) & (share > 0.003))
    return counts.withColumns({"feature": feature, "feature_palette": (chroma > 48) | (light < 45)})


def edge_color(pixels: DataFrame, width: int, height: int, samples: int = 80) -> DataFrame:
    """(grid_id, r, g, b): the mean of the most frequent colour, in steps of 16, of at most ``samples`` opaque pixels along each edge; white without any.

    Corners count once for each edge. Of equally frequent colours the one met first counts: top and bottom column by column, then
    left and right row by row.
    """
    sx, sy = max(1, width // samples), max(1, height // samples)
    x, y = F.col("x"), F.col("y")
    sides = [((y == 0) & (x % sx == 0), 2 * x), ((y == height - 1) & (x % sx == 0), 2 * x + 1), ((x == 0) & (y % sy == 0), 2 * width + 2 * y), ((x == width - 1) & (y % sy == 0), 2 * width + 2 * y + 1)]
    places = F.array_compact(F.array(*[F.when(ok, at) for ok, at in sides]))
    seen = pixels.where("a >= 24").select("grid_id", *"rgb", F.explode(places).alias("at"))
    step = [half_up(F.col(c) / 16).cast("int").alias(f"k{c}") for c in "rgb"]
    bins = seen.groupBy("grid_id", *step).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), *[F.sum(c).alias(c) for c in "rgb"])
    best = bins.groupBy("grid_id").agg(F.min_by(F.struct("n", *"rgb"), F.struct(-F.col("n"), "first")).alias("m"))
    mean = best.select("grid_id", *[half_up(F.col(f"m.{c}") / F.col("m.n")).cast("int").alias(c) for c in "rgb"])
    return pixels.select("grid_id").distinct().join(mean, "grid_id", "left").select("grid_id", *[F.coalesce(c, F.lit(255)).alias(c) for c in "rgb"])
