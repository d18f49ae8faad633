"""Strict reading of JSON records, image headers, projects, and synthetic images."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_REQUEST_BYTES = 64 * 1024 * 1024

REQUEST = (
    "schemaVersion int, revision long, width int, height int, method string, maxColors int, "
    "image struct<width:int,height:int,data:array<int>>, palette struct<id:string,version:string,source:string,license:string,approximate:boolean,"
    "colors:array<struct<id:string,brand:string,series:string,code:string,name:string,srgb8:array<int>>>>, "
    "allowedColors array<string>, requiredColors array<string>, style string, phase array<double>"
)
METHODS = ("nearest", "area", "dominant", "optimized")


def read_records(spark: SparkSession, path: str, schema: str = REQUEST, max_bytes: int = MAX_REQUEST_BYTES) -> DataFrame:
    """One JSON document per file as rows (file, record columns, unknown): files over ``max_bytes`` fail, ``unknown`` lists keys outside the schema.

    Spark drops unknown keys silently; here they stay visible, so that closed records can be enforced.
    """
    raw = spark.read.format("binaryFile").load(path)
    text = F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit(f"a record has at most {max_bytes} bytes")).cast("string"))
    rows = raw.select(F.col("path").alias("file"), text.alias("_text"))
    parsed = rows.select("file", "_text", F.from_json("_text", schema, {"mode": "FAILFAST"}).alias("r"))
    known = F.array(*[F.lit(name) for name in parsed.schema["r"].dataType.names])
    return parsed.select("file", "r.*", F.array_except(F.json_object_keys("_text"), known).alias("unknown"))


def request_violations(requests: DataFrame) -> DataFrame:
    """(file, rule): every rule a request breaks."""
    size = F.size("image.data")
    rules: dict[str, Column] = {
        "unknown keys": F.size("unknown") > 0,
        "schema version": ~F.coalesce(F.col("schemaVersion") == 1, F.lit(False)),
        "revision": ~F.coalesce(F.col("revision") >= 0, F.lit(False)),
        "grid size": ~F.coalesce(F.col("width").between(1, 256) & F.col("height").between(1, 256), F.lit(False)),
        "method": ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)),
        "colour budget": ~F.coalesce(F.col("maxColors").between(1, 512), F.lit(False)),
        "image size": ~F.coalesce((F.col("image.width") <= 4096) & (F.col("image.height") <= 4096) & (F.col("image.width") * F.col("image.height") <= 4_194_304) & (F.col("image.width") >= 1) & (F.col("image.height") >= 1), F.lit(False)),
        "image data": ~F.coalesce((size == 4 * F.col("image.width") * F.col("image.height")) & F.forall("image.data", lambda v: v.between(0, 255)), F.lit(False)),
        "palette size": ~F.coalesce(F.size("palette.colors").between(1, 512), F.lit(False)),
        "repeated colour id": F.coalesce(F.size(F.array_distinct(F.transform("palette.colors", lambda c: c["id"]))) < F.size("palette.colors"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return requests.select("file", F.explode(broken).alias("rule"))


def request_pixels(requests: DataFrame) -> DataFrame:
    """Pixels (file, idx, x, y, r, g, b, a) of each request's image."""
    w = F.col("image.width")
    at = F.explode(F.sequence(F.lit(0), w * F.col("image.height") - 1)).alias("idx")
    rows = requests.select("file", w.alias("_w"), F.col("image.data").alias("_d"), at)
    return rows.select("file", "idx", (F.col("idx") % F.col("_w")).alias("x"), F.floor(F.col("idx") / F.col("_w")).cast("int").alias("y"), *[F.get("_d", F.col("idx") * 4 + k).alias(c) for k, c in enumerate("rgba")])


def image_size(content: bytes | None) -> tuple[str, int, int] | None:
    """(kind, width, height) from the header of PNG, JPEG or WebP bytes; None if they are none of these or cut short."""
    b = content or b""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", b[16:24])
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8X":
                return "webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
            if b[12:16] == b"VP8L":
                v = struct.unpack("<I", b[21:25])[0]
                return "webp", 1 + (v & 0x3FFF), 1 + (v >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", b[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b):
                if b[at] != 0xFF:
                    return None
                marker = b[at + 1]
                if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 1:
                    at += 1 if marker == 0xFF else 2
                    continue
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    except struct.error:
        return None
    return None


def with_image_size(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds kind, width, height of image files without decoding them."""

    @F.udf("kind string, width int, height int")
    def size(b):
        return image_size(bytes(b)) if b is not None else None

    return files.withColumn("_s", size(content)).select(*files.columns, "_s.*")


def normalised_layers(projects: DataFrame) -> DataFrame:
    """Layers (project_id, z, layer_id, visible, locked, in_usage, opacity, cells) with defaults for what old projects leave out.

    A project without layers becomes one layer of its cells; a missing opacity is 1, missing flags are visible, unlocked, counted.
    """
    layer = F.struct(F.lit("base").alias("id"), F.lit(True).alias("visible"), F.lit(False).alias("locked"), F.lit(True).alias("includeInUsage"), F.lit(1.0).alias("opacity"), F.col("cells").alias("cells"))
    layers = F.when(F.coalesce(F.size("layers"), F.lit(0)) > 0, F.col("layers")).otherwise(F.array(layer))
    rows = projects.select("project_id", F.posexplode(layers).alias("z", "l"))
    return rows.select("project_id", "z", F.col("l.id").alias("layer_id"), F.coalesce("l.visible", F.lit(True)).alias("visible"), F.coalesce("l.locked", F.lit(False)).alias("locked"), F.coalesce("l.includeInUsage", F.lit(True)).alias("in_usage"), F.coalesce("l.opacity", F.lit(1.0)).alias("opacity"), F.col("l.cells").alias("cells"))


def synthetic_images(spark: SparkSession, n: int, width: int, height: int) -> DataFrame:
    """Pixels of n images from closed forms of (x, y): gradients, checkers, rings and stripes, with a clear frame on every fourth."""
    rows = spark.range(n * width * height).select(F.floor(F.col("id") / (width * height)).alias("grid_id"), (F.col("id") % (width * height)).cast("int").alias("idx"))
    rows = rows.select("grid_id", "idx", (F.col("idx") % width).alias("x"), F.floor(F.col("idx") / width).cast("int").alias("y"))
    kind = F.col("grid_id") % 4
    far = (F.col("x") * 2 - width + 1) * (F.col("x") * 2 - width + 1) + (F.col("y") * 2 - height + 1) * (F.col("y") * 2 - height + 1)
    v = F.when(kind == 0, F.floor(F.col("x") * 255 / max(1, width - 1))).when(kind == 1, (F.floor(F.col("x") / 4) + F.floor(F.col("y") / 4)) % 2 * 255).when(kind == 2, far % 256).otherwise(F.when(F.col("y") % 6 < 2, 20).otherwise(235)).cast("int")
    clear = (kind == 3) & ((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1))
    return rows.select("grid_id", "idx", "x", "y", v.alias("r"), (255 - v).alias("g"), ((v * 5 + F.col("grid_id") * 40) % 256).cast("int").alias("b"), F.when(clear, 0).otherwise(255).alias("a"))
