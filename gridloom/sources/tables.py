"""Pixels, cells and layers from tables; palettes; conversions between packed and exploded grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import palette_group, parse_hex

#: A neutral palette of our own: (position, id, code, r, g, b).
PALETTE = (
    (0, "c00", "K1", 16, 16, 20), (1, "c01", "W1", 250, 250, 248), (2, "c02", "N1", 128, 128, 132), (3, "c03", "R1", 200, 40, 48),
    (4, "c04", "O1", 240, 130, 40), (5, "c05", "Y1", 248, 216, 60), (6, "c06", "G1", 150, 200, 60), (7, "c07", "G2", 40, 140, 70),
    (8, "c08", "T1", 30, 140, 150), (9, "c09", "B1", 110, 190, 235), (10, "c10", "B2", 40, 70, 170), (11, "c11", "P1", 120, 60, 160),
    (12, "c12", "P2", 240, 150, 190), (13, "c13", "D1", 120, 76, 44), (14, "c14", "D2", 214, 178, 134), (15, "c15", "W2", 255, 240, 210),
)
PALETTE_SCHEMA = "pos int, id string, code string, r int, g int, b int"
MAX_PALETTE = 512


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PALETTE), PALETTE_SCHEMA)


def part_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour (id, r, g, b) of each part, from its key and size."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(F.concat(F.lit("p"), key.cast("string")).alias("id"), (key * 37 % 256).cast("int").alias("r"), (size * 5 % 256).cast("int").alias("g"), ((key * size + 31) % 256).cast("int").alias("b"))


def parse_palette(lines: DataFrame) -> DataFrame:
    """Rows of ``value`` = 'code,#RRGGBB' as code, group, r, g, b; blank lines are skipped."""
    parts = F.split(F.trim("value"), r"\s*,\s*")
    rows = lines.where(F.trim("value") != "").select(parts[0].alias("code"), parts[1].alias("hex"))
    r, g, b = parse_hex(F.col("hex"))
    return rows.select("code", palette_group(F.col("code")).alias("grp"), r.alias("r"), g.alias("g"), b.alias("b"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (grid_id, idx, x, y, v, r, g, b, a): each embedding of 64 values as a tile of 8 x 8."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("grid_id"), F.posexplode("embedding").alias("idx", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.5) * 255 + 0.5))).cast("int")
    rows = rows.select("grid_id", "idx", (F.col("idx") % 8).alias("x"), F.floor(F.col("idx") / 8).cast("int").alias("y"), v.alias("v"))
    return rows.select("*", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), (F.col("v") * 3 % 256).alias("b"), F.when(F.col("v") < 96, 0).otherwise(255).alias("a"))


def tile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (grid_id, idx, x, y, color) of the tiles; a null colour is an empty cell."""
    color = F.when(F.col("v") >= 96, F.concat(F.lit("k"), F.floor((F.col("v") - 96) / 24).cast("string")))
    return tiles(spark, sf_dir).select("grid_id", "idx", "x", "y", color.alias("color"))


def layer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer cells (cell, z, color) from order lines, one per (cell, z), with each layer's flags."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    color = F.when(F.col("l_discount") != 0, F.concat("l_returnflag", "l_linestatus"))
    rows = rows.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").cast("int").alias("z")).agg(F.max(color).alias("color"))
    return rows.select("cell", "z", "color", (F.col("z") % 4 != 0).alias("visible"), (F.col("z") % 5 != 0).cast("int").alias("opacity"), (F.col("z") % 3 == 0).alias("locked"), (F.col("z") != 2).alias("in_usage"))


def pack(cells: DataFrame) -> DataFrame:
    """(grid_id, colors): cells as one array in index order."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", "color")))
    return cells.groupBy("grid_id").agg(F.transform(ordered, lambda c: c["color"]).alias("colors"))


def unpack(grids: DataFrame, width: int) -> DataFrame:
    rows = grids.select("grid_id", F.posexplode("colors").alias("idx", "color"))
    return rows.select("grid_id", "idx", (F.col("idx") % width).alias("x"), F.floor(F.col("idx") / width).cast("int").alias("y"), "color")


def png_size(df: DataFrame, content: str = "content") -> DataFrame:
    """Width and height from the header of PNG bytes, without decoding; null where the bytes are no PNG."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return df.withColumns({"width": F.when(ok, number(17)), "height": F.when(ok, number(21))})
