"""From request records to patterns and bills of materials: many requests at once, each with its own image, size and palette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import optimize as O
from ..operators.sampling import ALPHA, bin_key
from ..sources import requests as R
from ..sources import sinks

KEYS = ["file", "cx", "cy"]


def _geometry(requests: DataFrame) -> DataFrame:
    """(file, method, iw, ih, w, h, scale, dx, dy): contain-fit of each request, shifted by its phase."""
    scale = F.least(F.col("width") / F.col("image.width"), F.col("height") / F.col("image.height"))
    rows = requests.select("file", "method", F.col("image.width").alias("iw"), F.col("image.height").alias("ih"), F.col("width").alias("w"), F.col("height").alias("h"), scale.alias("scale"), "phase")
    move = lambda size, image, k: (F.col(size) - F.col(image) * F.col("scale")) / 2 + F.coalesce(F.get("phase", F.lit(k)), F.lit(0.0))
    return rows.withColumns({"dx": move("w", "iw", 0), "dy": move("h", "ih", 1)}).drop("phase")


def _palettes(requests: DataFrame) -> DataFrame:
    """(file, id, brand, series, code, r, g, b, ok_l, ok_a, ok_b) of each request's allowed colours."""
    rows = requests.select("file", F.explode("palette.colors").alias("c"), "allowedColors")
    rows = rows.where(F.col("allowedColors").isNull() | F.array_contains("allowedColors", F.col("c.id")))
    return C.with_oklab(rows.select("file", "c.id", "c.brand", "c.series", "c.code", *[F.get("c.srgb8", F.lit(k)).alias(n) for k, n in enumerate("rgb")]))


def _nearest_samples(pixels: DataFrame, geometry: DataFrame) -> DataFrame:
    """The opaque pixel under each cell's centre, as linear light."""
    cells = geometry.where("method = 'nearest'").withColumn("cx", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    at = lambda c, d: F.floor((F.col(c) + 0.5 - F.col(d)) / F.col("scale")).cast("int")
    cells = cells.select(*KEYS, at("cx", "dx").alias("x"), at("cy", "dy").alias("y"))
    return pixels.where(F.col("a") / 255 >= ALPHA).join(cells, ["file", "x", "y"]).select(*KEYS, *[C.byte_to_linear(F.col(c)).alias("l" + c) for c in "rgb"])


def _weights(pixels: DataFrame, geometry: DataFrame) -> DataFrame:
    """A row per pixel and cell that overlap, with the overlap times the opacity."""
    rows = pixels.join(geometry.where("method <> 'nearest'"), "file")

    def reach(c: str, d: str, size: str) -> Column:
        low = F.greatest(F.lit(0), F.floor(F.col(c) * F.col("scale") + F.col(d)).cast("int"))
        high = F.least(F.col(size) - 1, (F.ceil((F.col(c) + 1) * F.col("scale") + F.col(d)) - 1).cast("int"))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    def shared(cell: str, c: str, d: str) -> Column:
        return F.greatest(F.lit(0.0), F.least((F.col(cell) + 1 - F.col(d)) / F.col("scale"), F.col(c) + 1) - F.greatest((F.col(cell) - F.col(d)) / F.col("scale"), F.col(c).cast("double")))

    rows = rows.withColumn("cx", reach("x", "dx", "w")).withColumn("cy", reach("y", "dy", "h"))
    return rows.withColumn("weight", shared("cx", "x", "dx") * shared("cy", "y", "dy") * F.col("a") / 255).where("weight > 0")


def _mean(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "method", "scale").agg(F.sum("weight").alias("covered"), *[(F.sum(F.col("weight") * C.byte_to_linear(F.col(c))) / F.sum("weight")).alias("l" + c) for c in "rgb"])


def samples(pixels: DataFrame, geometry: DataFrame) -> DataFrame:
    """(file, cx, cy, lr, lg, lb) of the cells that are covered at least half, by each request's method."""
    rows = _weights(pixels, geometry)
    enough = F.col("covered") * F.col("scale") * F.col("scale") + 1e-12 >= ALPHA
    area = _mean(rows.where("method <> 'dominant'"), KEYS).where(enough).select(*KEYS, "lr", "lg", "lb")
    bins = _mean(rows.where("method = 'dominant'").withColumn("key", bin_key()), [*KEYS, "key"])
    cell = Window.partitionBy(*KEYS)
    place = F.row_number().over(cell.orderBy(F.round("covered", 9).desc(), "key"))
    bins = bins.withColumns({"place": place, "covered": F.sum("covered").over(cell)})
    dominant = bins.where((F.col("place") == 1) & enough).select(*KEYS, "lr", "lg", "lb")
    return _nearest_samples(pixels, geometry).unionByName(area).unionByName(dominant)


def _match(cells: DataFrame, palettes: DataFrame) -> DataFrame:
    """The nearest of each file's palette colours; a file's palette is one bounded array, joined by file."""
    packed = palettes.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("id", *C.OK))).alias("_p"))
    lab = tuple(F.col(c) for c in C.OK)
    near = F.array_min(F.transform("_p", lambda p: F.struct(C.squared(lab, tuple(p[c] for c in C.OK)).alias("d"), p["id"].alias("id"))))
    return cells.join(packed, "file").withColumn("color", near["id"]).drop("_p")


def _optimised(cells: DataFrame, palettes: DataFrame, requests: DataFrame) -> DataFrame:
    """Cells of requests with method ``optimized``, assigned by local search within the budget."""
    sizes = requests.where("method = 'optimized'").select("file", F.col("width").alias("w"), F.col("height").alias("h"), "maxColors")

    def solve(samples_: pd.DataFrame, palette: pd.DataFrame) -> pd.DataFrame:
        if not len(samples_):
            return pd.DataFrame({"file": pd.Series([], dtype=object), "cx": pd.Series([], dtype="int32"), "cy": pd.Series([], dtype="int32"), "color": pd.Series([], dtype=object)})
        palette = palette.sort_values("id")
        w, h, k = (int(samples_[c].iat[0]) for c in ("w", "h", "maxColors"))
        lab = np.full((w * h, 3), np.nan)
        lab[samples_["cy"] * w + samples_["cx"]] = samples_[list(C.OK)]
        best, _ = O.solve(O.Problem(lab, w, palette[list(C.OK)].to_numpy(float), O.Spec(max_colors=k)))
        at = np.flatnonzero(best >= 0)
        return pd.DataFrame({"file": samples_["file"].iat[0], "cx": at % w, "cy": at // w, "color": palette["id"].to_numpy()[best[at]]})

    rows = cells.join(sizes, "file")
    return rows.groupBy("file").cogroup(palettes.select(F.col("file").alias("owner"), "id", *C.OK).groupBy("owner")).applyInPandas(solve, "file string, cx int, cy int, color string")


def patterns(requests: DataFrame) -> DataFrame:
    """(file, cx, cy, color): each request's occupied cells, with at most its maxColors colours."""
    palettes = _palettes(requests)
    linear = samples(R.request_pixels(requests), _geometry(requests))
    cells = linear.select(*KEYS, *[c.alias(n) for c, n in zip(C.oklab((F.col("lr"), F.col("lg"), F.col("lb"))), C.OK, strict=True)])
    plain = cells.join(requests.where("method <> 'optimized'").select("file", "maxColors"), "file")
    first = _match(plain, palettes)
    counts = first.groupBy("file", "maxColors", "color").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "color"))
    kept = counts.withColumn("_k", rank).where("_k <= maxColors").select("file", F.col("color").alias("id"))
    again = _match(plain, palettes.join(kept, ["file", "id"], "left_semi"))
    return again.select(*KEYS, "color").unionByName(_optimised(cells, palettes, requests))


def bills(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, id, brand, series, code, r, g, b, count) of the colours used."""
    counts = cells.groupBy("file", F.col("color").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    return _palettes(requests).drop(*C.OK).join(counts, ["file", "id"])


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Reads the requests of a folder, and writes patterns, bills as CSV and JSON only if no request breaks a rule."""
    requests = R.read_records(spark, source)
    broken = R.request_violations(requests).take(5)
    if broken:
        raise ValueError(f"not converted: {[r.asDict() for r in broken]}")
    cells = patterns(requests)
    cells.write.mode("overwrite").json(f"{target}/pattern")
    bill = bills(spark.read.schema(cells.schema).json(f"{target}/pattern"), requests)
    sinks.write_csv(bill.drop("file") if requests.limit(2).count() == 1 else bill, f"{target}/bom_csv")
    sinks.write_json(bill, f"{target}/bom_json")
