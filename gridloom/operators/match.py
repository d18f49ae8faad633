"""Nearest and k nearest palette colours of many samples, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..sources.tables import MAX_PALETTE


def _packed(palette: DataFrame, *columns: str) -> DataFrame:
    """The palette as one row of structs, so that a broadcast of that row replaces a join; its size is bounded and checked."""
    rows = F.sort_array(F.collect_list(F.struct(*columns)))
    packed = palette.agg(rows.alias("_palette"))
    too_many = F.raise_error(F.lit(f"a palette has at most {MAX_PALETTE} colours")).cast(packed.schema[0].dataType)
    return packed.select(F.when(F.size("_palette") > MAX_PALETTE, too_many).otherwise(F.col("_palette")).alias("_palette"))


#: Palettes up to this size become one compiled expression; larger ones are an array that is walked for each row.
UNROLLED = 64


def _best(df: DataFrame, palette: DataFrame, distance: Callable[[dict[str, Column]], Column], tie: str, columns: tuple[str, ...], out: str) -> DataFrame:
    """The palette colour of least (distance, tie). A palette is bounded, so its rows come to the driver and go out as constants."""
    rows = sorted(tuple(r) for r in palette.select(*columns).limit(MAX_PALETTE + 1).collect())
    if not 0 < len(rows) <= MAX_PALETTE:
        raise ValueError(f"a palette has at least one and at most {MAX_PALETTE} colours")
    if len(rows) > UNROLLED:
        pal = _packed(palette, *columns)
        scored = F.transform("_palette", lambda p: F.struct(distance({c: p[c] for c in columns}).alias("d"), p[tie].alias("tie"), p["id"].alias("id")))
        return df.crossJoin(F.broadcast(pal)).withColumn(out, F.array_min(scored)["id"]).drop("_palette")
    known = [{c: F.lit(v) for c, v in zip(columns, r, strict=True)} for r in rows]
    scored = [F.struct(distance(p).alias("d"), p[tie].alias("tie"), p["id"].alias("id")) for p in known]
    return df.withColumn(out, (F.least(*scored) if len(scored) > 1 else scored[0])["id"])


def nearest_oklab(df: DataFrame, palette: DataFrame, out: str = "color") -> DataFrame:
    """The palette colour of least squared OKLab distance for each row's ok_l, ok_a, ok_b; ties go to the smaller id."""
    pal = C.with_oklab(palette)
    lab = tuple(F.col(c) for c in C.OK)
    return _best(df, pal, lambda p: C.squared(lab, tuple(p[c] for c in C.OK)), "id", ("id", *C.OK), out)


def nearest_redmean(df: DataFrame, palette: DataFrame, r: Column, g: Column, b: Column, out: str = "color") -> DataFrame:
    """The palette colour of least redmean distance; ties go to the first in palette order."""
    return _best(df, palette, lambda p: C.redmean((r, g, b), (p["r"], p["g"], p["b"])), "pos", ("pos", "id", "r", "g", "b"), out)


def top_k(df: DataFrame, palette: DataFrame, k: int) -> DataFrame:
    """A row per rank 1..k with the k nearest palette colours of each row's ok_l, ok_a, ok_b by (distance, id)."""
    if not 1 <= k <= MAX_PALETTE:
        raise ValueError(f"k must be from 1 to {MAX_PALETTE}")
    pal = _packed(C.with_oklab(palette), "id", *C.OK)
    lab = tuple(F.col(c) for c in C.OK)
    scored = F.transform("_palette", lambda p: F.struct(F.sqrt(C.squared(lab, tuple(p[c] for c in C.OK))).alias("distance"), p["id"].alias("id")))
    near = F.slice(F.array_sort(scored), 1, k)
    rows = df.crossJoin(F.broadcast(pal)).select(*df.columns, F.posexplode(near).alias("_rank", "_c"))
    return rows.select(*df.columns, (F.col("_rank") + 1).alias("rank"), F.col("_c.id").alias("color"), F.col("_c.distance").alias("distance"))


def match_distinct(df: DataFrame, keys: list[str], match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Matches each distinct sample once and joins the answers back: worthwhile where samples repeat much."""
    return df.join(match(df.select(*keys).distinct()), keys)
