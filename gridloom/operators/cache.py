"""Evidence of regions kept in a table by the content of its image, and computed again only where an image changed."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from . import sampling as S
from .diagnostics import spread
from .local import region_evidence
from .rounds import settled

#: To be raised whenever ``region_evidence`` gives other numbers.
VERSION = 1
SHARES = ("edge", "contrast", "reliability", "dominance")
VALUES = (*C.OK, *SHARES)
SCHEMA = f"key string, cx int, cy int, {', '.join(f'{c} double' for c in VALUES)}, cells long, check string, settings string, part string"


def settings_hash(width: int, height: int, w: int, h: int) -> Column:
    """The SHA-256 of all that evidence depends on beside the pixels, as JSON with sorted keys."""
    text = json.dumps({"version": VERSION, "width": width, "height": height, "w": w, "h": h}, sort_keys=True, separators=(",", ":"))
    return F.sha2(F.lit(text), 256)


def image_keys(pixels: DataFrame) -> DataFrame:
    """(grid_id, key): the SHA-256 of an image's rows' SHA-256s, so that no task holds more than one row of pixels and one column of hashes."""
    channels = [F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgba"]
    places = F.sort_array(F.collect_list(F.struct("x", F.concat(*[F.coalesce(c, F.lit("--")) for c in channels]).alias("p"))))
    rows = spread(pixels.select("grid_id", "x", "y", *"rgba")).groupBy("grid_id", "y").agg(F.sha2(F.array_join(F.transform(places, lambda p: F.concat_ws(":", p["x"], p["p"])), ","), 256).alias("h"))
    lines = F.sort_array(F.collect_list(F.struct("y", "h")))
    return rows.groupBy("grid_id").agg(F.sha2(F.array_join(F.transform(lines, lambda r: F.concat_ws(":", r["y"], r["h"])), ","), 256).alias("key"))


def _check() -> Column:
    return F.sha2(F.concat_ws("|", "settings", "key", "cells", "cx", "cy", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in VALUES]), 256)


def sound(w: int, h: int) -> Column:
    """Whether a stored row is as it was written and its values can be evidence."""
    ranges = [F.col(C.OK[0]).between(-0.001, 1.001), *[F.col(c).between(-0.5, 0.5) for c in C.OK[1:]], *[F.col(c).between(0, 1 + 1e-9) for c in SHARES]]
    out = (F.col("check") == _check()) & F.col("cx").between(0, w - 1) & F.col("cy").between(0, h - 1)
    for r in ranges:
        out = out & r
    return F.coalesce(out, F.lit(False))


def stored(asked: DataFrame, folder: str, settings: Column, w: int, h: int) -> DataFrame:
    """Rows of asked images (part, key) that the table holds whole: sound, one for each cell, as many as were written. All others count as absent.

    The names of the folders asked for, 16 to the power of their digits at most, go through the driver, so that the scan opens no others.
    """
    spark = asked.sparkSession
    parts = [r.part for r in asked.select("part").distinct().collect()]
    try:
        table = spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], SCHEMA)
    rows = table.where((F.col("settings") == settings) & F.col("part").isin(parts)).join(asked, ["part", "key"], "left_semi")
    rows = rows.where(sound(w, h)).dropDuplicates(["part", "key", "cx", "cy"])
    image = Window.partitionBy("part", "key")
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(image), "_least": F.min("cells").over(image), "_most": F.max("cells").over(image)})
    return rows.where("_n = _least AND _n = _most").drop("_n", "_least", "_most")


def cached_evidence(pixels: DataFrame, folder: str, width: int, height: int, w: int, h: int, digits: int = 1) -> DataFrame:
    """``region_evidence`` of the images, of which the table in ``folder`` keeps those it has met: (grid_id, cx, cy, VALUES).

    The table's key is the content of an image, so equal images are computed and kept once, whatever their ids; its folders are named by the
    settings and by the first ``digits`` of the key (more for larger tables, always the same for one), so a run reads only folders that its own
    keys name. A run computes images that
    the table lacks and adds them. An image of which a row is missing or was changed in the table is computed again; the row
    that was changed fails its hash for ever, the new one is read. Images without an opaque pixel have no cells, hence no rows: they are
    computed each time. Two runs at once can both add an image: its cells are read once. Columns other than the pixels' are ignored.
    """
    settings = settings_hash(width, height, w, h)
    keys = settled(image_keys(pixels).withColumn("part", F.substring("key", 1, digits)))
    asked = settled(keys.select("part", "key").distinct())
    held = stored(asked, folder, settings, w, h).select("part", "key").distinct()
    missing = settled(keys.join(held, ["part", "key"], "left_anti").groupBy("part", "key").agg(F.min("grid_id").alias("grid_id")))
    if not missing.isEmpty():
        fresh = region_evidence(_of(pixels, missing.select("grid_id")), width, height, w, h)
        add_evidence(fresh, missing, folder, settings)
    return keys.join(stored(asked, folder, settings, w, h), ["part", "key"]).select("grid_id", "cx", "cy", *VALUES)


def _of(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """The pixels of images (grid_id, each once, more columns may follow), dealt by image before the join.

    Spark leaves out a repartition that follows a join by the same key, and would then merge the tasks by their few bytes or, where the
    pixels are broadcast, work on all images in the few tasks that hold ``images``.
    """
    return spread(pixels.select("grid_id", "x", "y", *"rgba")).hint("merge").join(images, "grid_id")


def add_evidence(evidence: DataFrame, keys: DataFrame, folder: str, settings: Column) -> None:
    """Appends the evidence of images (grid_id, key, part) to the table in ``folder``."""
    rows = evidence.join(keys.select("grid_id", "key", "part"), "grid_id").withColumns({"cx": F.col("cx").cast("int"), "cy": F.col("cy").cast("int")})
    rows = rows.withColumn("cells", F.count(F.lit(1)).over(Window.partitionBy("grid_id"))).withColumn("settings", settings)
    rows = rows.withColumn("check", _check()).select("key", "cx", "cy", *VALUES, "cells", "check", "settings", "part")
    rows.repartition("part").write.partitionBy("settings", "part").mode("append").parquet(folder)


def changed_boxes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(grid_id, l, t, r, b): of each image that differs the smallest box [l, r) x [t, b) around all pixels that do."""
    pixel = lambda df, name: df.select("grid_id", "x", "y", F.struct("r", "g", "b", "a").alias(name))
    both = pixel(before, "p").join(pixel(after, "q"), ["grid_id", "x", "y"], "full").where("NOT p <=> q")
    return both.groupBy("grid_id").agg(F.min("x").alias("l"), F.min("y").alias("t"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("b"))


def evidence_again(evidence: DataFrame, pixels: DataFrame, boxes: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """``evidence`` (grid_id, cx, cy, VALUES) with the cells that the changed boxes (grid_id, l, t, r, b; one an image) touch computed again from ``pixels``.

    A pixel counts in the cells it lies in and in the edges of its neighbours, so a box is grown by one pixel. Only the pixels of the
    cells it then touches, and one more on each side, are worked on. All other cells, and images without a box, stay as they are.
    """
    scale, dx, dy = S.fit(width, height, w, h)
    low = lambda c, d, n: F.greatest(F.lit(0), F.floor((F.col(c) - 1) * scale + d)).cast("int")
    high = lambda c, d, n: F.least(F.lit(n), F.ceil((F.col(c) + 1) * scale + d)).cast("int")
    cells = boxes.select("grid_id", low("l", dx, w).alias("c0"), high("r", dx, w).alias("c1"), low("t", dy, h).alias("d0"), high("b", dy, h).alias("d1"))
    first = lambda c, d: F.floor((F.col(c) - d) / scale) - 1
    last = lambda c, d: F.ceil((F.col(c) - d) / scale)
    area = cells.select("grid_id", "c0", "c1", "d0", "d1", first("c0", dx).alias("x0"), last("c1", dx).alias("x1"), first("d0", dy).alias("y0"), last("d1", dy).alias("y1"))
    part = _of(pixels, area.select("grid_id", "x0", "x1", "y0", "y1"))
    part = part.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").drop("x0", "x1", "y0", "y1")
    names = ["grid_id", "cx", "cy", *VALUES]
    own = area.select("grid_id", "c0", "c1", "d0", "d1")
    touched = "cx >= c0 AND cx < c1 AND cy >= d0 AND cy < d1"
    fresh = region_evidence(part, width, height, w, h).join(own, "grid_id").where(touched).select(*names)
    kept = evidence.join(own, "grid_id", "left").where(f"NOT coalesce({touched}, false)").select(*names)
    return kept.unionByName(fresh)
