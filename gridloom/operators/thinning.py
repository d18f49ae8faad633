"""Thinning of coloured cells to lines and loops of one cell's width, with pieces and holes kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import settled

#: The cells around a cell, counter-clockwise from the right, as steps (x, y).
RING = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))
#: Rounds between two looks at which grids still change.
ROUNDS = 8


def removable(code: int) -> bool:
    """Whether a cell can go without changing pieces (joined over edges and corners) or holes (joined over edges), by the bits of the cells around it.

    That is so if the empty cells around it that share an edge with it hang together in one piece, over edges of the ring.
    """
    empty = [not code >> k & 1 for k in range(8)]
    return sum(empty[k] and not (empty[k + 1] and empty[(k + 2) % 8]) for k in (0, 2, 4, 6)) == 1


def _dense(cells: DataFrame, strength: Column) -> DataFrame:
    """(grid_id, l, t, stride, ranks): each grid as one array with an empty border: the place of each cell in the order of removal, -1 where none is."""
    places = cells.where("color IS NOT NULL").groupBy("grid_id", "x", "y").agg(F.min(strength).cast("double").alias("s"))
    bounds = [F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("b")]
    field = F.pmod("y", F.lit(2)) * 2 + F.pmod("x", F.lit(2))
    grids = places.groupBy("grid_id").agg(*bounds, F.sort_array(F.collect_list(F.struct("s", field.alias("f"), "y", "x"))).alias("c"))
    grids = grids.withColumns({"stride": F.expr("r - l + 3"), "size": F.expr("(r - l + 3) * (b - t + 3)")})
    at = F.sort_array(F.transform("c", lambda c, i: F.struct(((c["y"] - F.col("t") + 1) * F.col("stride") + c["x"] - F.col("l") + 1).cast("int").alias("at"), i.alias("rank"))))
    grids = grids.withColumn("c", at)
    none = lambda n: F.array_repeat(F.lit(-1), n.cast("int"))
    before = lambda i: F.coalesce(F.get(F.col("c"), i - 1)["at"], F.lit(-1))
    filled = F.flatten(F.transform("c", lambda c, i: F.concat(none(c["at"] - before(i) - 1), F.array(c["rank"]))))
    return grids.select("grid_id", "l", "t", "stride", F.concat(filled, none(F.col("size") - F.size(filled))).alias("ranks"))


def _rounds() -> Column:
    """``ranks`` after ROUNDS rounds. A round has two steps: find what could go, then drop those of it that are weaker than all of it around them."""
    table = F.array(*[F.lit(removable(code)) for code in range(256)])
    near = [F.lit(dx) + F.lit(dy) * F.col("stride") for dx, dy in RING]

    def find(ranks: Column) -> Column:
        code = lambda p: sum((F.when(F.get(ranks, p + d) >= 0, 1 << k).otherwise(0) for k, d in enumerate(near)), F.lit(0))
        return F.transform(ranks, lambda v, p: F.when((v >= 0) & F.get(table, F.when(v >= 0, code(p)).otherwise(0)), v).otherwise(-1))

    def drop(ranks: Column, able: Column) -> Column:
        weaker = lambda v, p: F.least(*[F.when(F.get(able, p + d) >= 0, F.get(able, p + d)) for d in near])
        return F.transform(ranks, lambda v, p: F.when((v >= 0) & (F.get(able, p) >= 0) & (v < F.coalesce(F.when(v >= 0, weaker(v, p)), v + 1)), -1).otherwise(v))

    start = F.struct(F.col("ranks").alias("ranks"), F.col("ranks").alias("able"))
    step = lambda s, i: F.when(i % 2 == 1, F.struct(s["ranks"].alias("ranks"), find(s["ranks"]).alias("able"))).otherwise(F.struct(drop(s["ranks"], s["able"]).alias("ranks"), s["able"].alias("able")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start, step, lambda s: s["ranks"])


def thinned(cells: DataFrame, strength: Column) -> DataFrame:
    """(grid_id, x, y) of the occupied cells that stay when each grid is thinned, the weakest first.

    In a round every cell that can go without changing the grid's pieces and holes, and that is weaker than all such cells around it, goes;
    rounds follow until none can. Cells of equal strength go by the parity of their row and column, so cells beside each other never go at
    once: each removal is safe by itself, hence all of a round are. A loop becomes a closed line around its hole, a piece without a hole one
    cell.

    A grid is one row, an array that whole rounds rewrite in place: no round shuffles. Grids that no longer change are
    set aside. The cells of a place that occurs twice count once, with the smaller strength; a null strength is the weakest; grids
    without a cell, and empty tables, give no rows.
    """
    grids = settled(_dense(cells, strength))
    done = []
    while True:
        moved = settled(grids.withColumn("before", F.col("ranks")).withColumn("ranks", _rounds()))
        done.append(moved.where("ranks = before").drop("before"))
        grids = moved.where("ranks <> before").drop("before")
        if grids.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    rows = out.select("grid_id", "l", "t", "stride", F.posexplode("ranks").alias("at", "rank")).where("rank >= 0")
    return rows.select("grid_id", F.expr("CAST(at % stride + l - 1 AS INT)").alias("x"), F.expr("CAST(at div stride + t - 1 AS INT)").alias("y"))
