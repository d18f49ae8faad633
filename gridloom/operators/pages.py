"""Page plans and text output of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_field, fixed4, xml_escape

PAPER = {"a4": (210.0, 297.0), "letter": (215.9, 279.4)}


def page_grid(paper: str, pitch: float) -> tuple[int, int]:
    """Columns and rows of cells on a page, inside its margins."""
    w, h = PAPER[paper]
    return int((w - 30) / pitch), int((h - 65) / pitch)


def _tiles(size: Column, per_page: int, overlap: int) -> Column:
    """Starts of overlapping tiles; the first that reaches the end is the last."""
    step = per_page - overlap
    last = F.greatest(F.lit(0), F.ceil((size - per_page) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def page_plan(grids: DataFrame, paper: str = "a4", pitch: float = 5.0, overlap: int = 1) -> DataFrame:
    """A row per page of each grid (grid_id, width, height): x, y, columns, rows, page (numbered row by row from 0)."""
    columns, rows = page_grid(paper, pitch)
    if not 0 <= overlap <= 5 or overlap >= min(columns, rows):
        raise ValueError("pages overlap by 0 to 5 cells")
    out = grids.withColumn("y", F.explode(_tiles(F.col("height"), rows, overlap))).withColumn("x", F.explode(_tiles(F.col("width"), columns, overlap)))
    out = out.withColumns({"columns": F.least(F.lit(columns), F.col("width") - F.col("x")), "rows": F.least(F.lit(rows), F.col("height") - F.col("y"))})
    return out.withColumn("page", F.row_number().over(Window.partitionBy("grid_id").orderBy("y", "x")) - 1)


def export_grid(cells: DataFrame, mirrored: bool) -> DataFrame:
    """Cells cut to the occupied bounds and renumbered, read from the right if mirrored; empty grids are left out."""
    ends = cells.where("color IS NOT NULL").groupBy("grid_id").agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("b"))
    rows = cells.join(ends, "grid_id").where("x BETWEEN l AND r AND y BETWEEN t AND b")
    x = F.col("r") - F.col("x") if mirrored else F.col("x") - F.col("l")
    return rows.select("grid_id", x.alias("x"), (F.col("y") - F.col("t")).alias("y"), (F.col("r") - F.col("l") + 1).alias("width"), (F.col("b") - F.col("t") + 1).alias("height"), "color")


def svg_cells(cells: DataFrame, palette: DataFrame, pitch: float) -> DataFrame:
    """(grid_id, x, y, svg): a rectangle element per occupied cell, in millimetres."""
    hexes = palette.select(F.col("id").alias("color"), F.concat(F.lit("#"), *[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgb"]).alias("hex"), "code")
    at = lambda c: fixed4(F.col(c) * pitch)
    size = fixed4(F.lit(pitch))
    svg = F.concat(F.lit('<rect x="'), at("x"), F.lit('" y="'), at("y"), F.lit('" width="'), size, F.lit('" height="'), size, F.lit('" fill="'), F.col("hex"), F.lit('"><title>'), xml_escape(F.col("code")), F.lit("</title></rect>"))
    return cells.where("color IS NOT NULL").join(F.broadcast(hexes), "color").select("grid_id", "x", "y", svg.alias("svg"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a CSV line; to be written with CRLF between lines."""
    return rows.select(F.concat_ws(",", *[F.coalesce(csv_field(F.col(c).cast("string")), F.lit("")) for c in columns]).alias("line"))


def runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, start, length): runs of consecutive whole numbers."""
    w = Window.partitionBy(key).orderBy(value)
    return df.select(key, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(w)).groupBy(key, "_g").agg(F.min(value).alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def expand_runs(df: DataFrame, value: str = "idx") -> DataFrame:
    return df.withColumn(value, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))).drop("start", "length")


def svg_documents(elements: DataFrame, width_mm: float, height_mm: float) -> DataFrame:
    """(grid_id, svg): one document a grid from its ``svg_cells`` elements, in row order; a grid's cells are bounded."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "svg"))), lambda e: e["svg"]), "")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width_mm:g}mm" height="{height_mm:g}mm" viewBox="0 0 {width_mm:g} {height_mm:g}">'
    return elements.groupBy("grid_id").agg(F.concat(F.lit(head), body, F.lit("</svg>")).alias("svg"))
