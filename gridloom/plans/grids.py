"""Queries on grids: layers, edits, shapes, structure, regions."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import diagnostics as D
from ..operators import layers as L
from ..operators import sampling as S
from ..sources.tables import layer_cells, pack, tile_cells, unpack
from .base import CELLS, LAYERS, query

# layers


@query(f"WITH {LAYERS} SELECT cell, arg_max(color, z) AS color FROM layers WHERE visible AND opacity > 0 AND color IS NOT NULL GROUP BY 1")
def layer_composite(spark, sf):
    return L.composite(layer_cells(spark, sf))


@query(f"WITH {LAYERS} SELECT cell, arg_max(color, z) AS color FROM layers WHERE visible AND color IS NOT NULL GROUP BY 1")
def top_visible(spark, sf):
    return L.top_visible(layer_cells(spark, sf))


@query(f"""WITH {LAYERS}, top AS (SELECT cell, arg_max(color, z) AS color FROM layers WHERE visible AND opacity > 0 AND color IS NOT NULL GROUP BY 1)
SELECT color, count(*)::BIGINT AS n, ceil(count(*) / 1000.0)::BIGINT AS packs FROM top WHERE color IN ('AF', 'RF', 'NO') GROUP BY 1""")
def usage_packs(spark, sf):
    known = spark.createDataFrame([("AF",), ("RF",), ("NO",), ("XX",)], "color string")
    return L.usage(L.composite(layer_cells(spark, sf)), known, 1000)


@query(f"WITH {LAYERS} SELECT z, color, count(*)::BIGINT AS n FROM layers WHERE color IS NOT NULL AND in_usage GROUP BY 1, 2")
def layer_color_stats(spark, sf):
    return layer_cells(spark, sf).where("color IS NOT NULL AND in_usage").groupBy("z", "color").agg(F.count(F.lit(1)).alias("n"))


HIT = "coalesce(visible AND NOT locked AND color = 'NO' AND cell % 64 BETWEEN 8 AND 40 AND cell // 64 BETWEEN 3 AND 90, false)"


@query(f"WITH {LAYERS} SELECT cell, z, CASE WHEN {HIT} THEN 'RF' ELSE color END AS color, {HIT} AS changed FROM layers")
def recolor_rectangle(spark, sf):
    inside = (F.col("cell") % 64).between(8, 40) & F.floor(F.col("cell") / 64).between(3, 90)
    return L.recolor(layer_cells(spark, sf), "NO", "RF", inside).select("cell", "z", "color", "changed")


@query(f"WITH {LAYERS} SELECT z, count(*)::BIGINT AS changed FROM layers WHERE visible AND NOT locked AND color = 'AF' GROUP BY 1")
def recolor_count(spark, sf):
    return L.recolor(layer_cells(spark, sf), "AF", "NO").where("changed").groupBy("z").agg(F.count(F.lit(1)).alias("changed"))


# edits


@query(f"WITH {CELLS}, o AS (SELECT * FROM cells WHERE color IS NOT NULL), e AS (SELECT grid_id, min(x) + max(x) AS e FROM o GROUP BY 1) SELECT grid_id, e - x AS x, y, color FROM o JOIN e USING (grid_id)")
def mirror_horizontal(spark, sf):
    return L.mirror(tile_cells(spark, sf), "x").select("grid_id", "x", "y", "color")


@query(f"WITH {CELLS}, o AS (SELECT * FROM cells WHERE color IS NOT NULL), e AS (SELECT grid_id, min(y) + max(y) AS e FROM o GROUP BY 1) SELECT grid_id, x, e - y AS y, color FROM o JOIN e USING (grid_id)")
def mirror_vertical(spark, sf):
    return L.mirror(tile_cells(spark, sf), "y").select("grid_id", "x", "y", "color")


@query(f"WITH {CELLS} SELECT grid_id, x + 2 AS x, y - 1 AS y, color FROM cells WHERE color IS NOT NULL AND x + 2 <= 7 AND y >= 1")
def shift_cells(spark, sf):
    return L.shift(tile_cells(spark, sf), 2, -1, 8, 8).select("grid_id", "x", "y", "color")


@query(f"WITH {CELLS} SELECT grid_id, least(7 - max(x), greatest(-min(x), 3)) AS dx, least(7 - max(y), greatest(-min(y), -2)) AS dy FROM cells WHERE color > 'k3' GROUP BY 1")
def clamped_shift(spark, sf):
    cells = tile_cells(spark, sf).withColumn("color", F.when(F.col("color") > "k3", F.col("color")))
    return L.clamped_shift(cells, 3, -2, 8, 8)


@query(f"""WITH {CELLS}, clip AS (SELECT grid_id, x + 3 AS x, y + 2 AS y, color AS over FROM cells WHERE x < 4 AND y < 4 AND color IS NOT NULL)
SELECT grid_id, x, y, coalesce(over, color) AS color FROM cells LEFT JOIN clip USING (grid_id, x, y)""")
def paste_cells(spark, sf):
    cells = tile_cells(spark, sf)
    return L.paste(cells, cells.where("x < 4 AND y < 4"), 3, 2).select("grid_id", "x", "y", "color")


@query(f"""WITH {CELLS}, f AS (SELECT grid_id, (i % 10)::INT AS x, (i // 10)::INT AS y FROM (SELECT DISTINCT grid_id FROM cells), unnest(range(0, 60)) t(i))
SELECT grid_id, x, y, color FROM f LEFT JOIN cells USING (grid_id, x, y)""")
def resize_cells(spark, sf):
    return L.resize(tile_cells(spark, sf), 10, 6).select("grid_id", "x", "y", "color")


@query(f"""WITH {CELLS} SELECT grid_id, CASE WHEN color IS NULL THEN 'lock-empty' ELSE 'lock-color' END AS kind, color, string_agg(idx, ',' ORDER BY idx) AS idxs FROM cells WHERE NOT (x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6) GROUP BY 1, 2, 3""")
def outside_locks(spark, sf):
    rows = L.outside_locks(tile_cells(spark, sf), F.col("x").between(2, 5) & F.col("y").between(1, 6))
    return rows.withColumn("idxs", F.array_join(F.transform("idxs", lambda i: i.cast("string")), ","))


@query(f"WITH {CELLS} SELECT grid_id, idx, x, y, color FROM cells")
def pack_unpack(spark, sf):
    return unpack(pack(tile_cells(spark, sf)), 8)


# shapes

BOX_SQL = "s AS (SELECT p_partkey AS id, (p_partkey % 23)::INT AS x0, (p_size % 17)::INT AS y0, (p_partkey * 7 % 29)::INT AS x1, ((p_size * 3 + p_partkey) % 19)::INT AS y1 FROM part)"
IN_BOX = f"{BOX_SQL}, bx AS (SELECT s.*, tx.x::INT AS x, ty.y::INT AS y FROM s, LATERAL (SELECT unnest(range(least(x0, x1), greatest(x0, x1) + 1)) AS x) tx, LATERAL (SELECT unnest(range(least(y0, y1), greatest(y0, y1) + 1)) AS y) ty)"
CORNERS = ("x0", "y0", "x1", "y1")


def boxes(spark, sf):
    """Two corners of a box for each part, in any order."""
    key, size = F.col("p_partkey"), F.col("p_size")
    corners = {"x0": key % 23, "y0": size % 17, "x1": key * 7 % 29, "y1": (size * 3 + key) % 19}
    return spark.read.parquet(f"{sf}/part.parquet").select(key.alias("id"), *[c.cast("int").alias(n) for n, c in corners.items()])


@query(f"""WITH {BOX_SQL}, n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0), 1) AS n FROM s), p AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n)
SELECT DISTINCT id, floor(x0 + (x1 - x0) * k / n::DOUBLE + 0.5)::INT AS x, floor(y0 + (y1 - y0) * k / n::DOUBLE + 0.5)::INT AS y FROM p""")
def shape_line(spark, sf):
    return G.line_cells(D.spread(boxes(spark, sf), "id"), "id", *CORNERS)


@query(f"WITH {IN_BOX} SELECT id, x, y FROM bx WHERE x IN (x0, x1) OR y IN (y0, y1)")
def shape_rectangle(spark, sf):
    return G.box(boxes(spark, sf), *CORNERS).where(G.edge_of_box(*CORNERS)).select("id", "x", "y")


@query(f"WITH {IN_BOX} SELECT id, x, y FROM bx")
def shape_filled_rectangle(spark, sf):
    return G.box(boxes(spark, sf), *CORNERS).select("id", "x", "y")


@query(f"""WITH {IN_BOX} SELECT id, x, y FROM bx WHERE abs(x1 - x0) <= 1 OR abs(y1 - y0) <= 1
  OR ((x - (x0 + x1) / 2.0::DOUBLE) / (abs(x1 - x0) / 2.0::DOUBLE)) ** 2 + ((y - (y0 + y1) / 2.0::DOUBLE) / (abs(y1 - y0) / 2.0::DOUBLE)) ** 2 <= 1.02""")
def shape_filled_ellipse(spark, sf):
    return G.box(boxes(spark, sf), *CORNERS).where(G.in_ellipse(*CORNERS)).select("id", "x", "y")


@query("""WITH """ + BOX_SQL + """, c AS (SELECT id, floor((x0 + x1) / 2.0 + 0.5)::INT AS cx, floor((y0 + y0 + x1 - x0) / 2.0 + 0.5)::INT AS cy, greatest(1, floor(abs(x1 - x0) / 2.0 + 0.5))::INT AS r FROM s),
p AS (SELECT *, cx + tx.d AS x, cy + ty.d AS y FROM c, LATERAL (SELECT unnest(range(-r, r + 1))::INT AS d) tx, LATERAL (SELECT unnest(range(-r, r + 1))::INT AS d) ty)
SELECT id, x, y FROM p WHERE (x - cx) ** 2 + (y - cy) ** 2 <= (r + 0.2::DOUBLE) ** 2""")
def shape_filled_circle(spark, sf):
    return G.filled_circle(boxes(spark, sf).withColumn("y1", F.col("y0") + F.col("x1") - F.col("x0")), *CORNERS).select("id", "x", "y")


TRIANGLE = [(8.0, 0.0), (0.0, 12.0), (16.0, 12.0)]


def polygon_sql(points, x="x", y="y"):
    parts = []
    for (ax, ay), (bx, by) in zip(points, points[-1:] + points[:-1], strict=True):
        if ay != by:
            parts.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < {bx - ax}::DOUBLE * ({y} - {ay}) / {by - ay}::DOUBLE + {ax} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(f"SELECT l_orderkey, l_linenumber, x, y FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 17)::INT AS x, (l_suppkey % 13)::INT AS y FROM lineitem) WHERE {polygon_sql(TRIANGLE)}")
def shape_filled_polygon(spark, sf):
    grid = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 17).cast("int").alias("x"), (F.col("l_suppkey") % 13).cast("int").alias("y"))
    return grid.where(G.in_polygon(F.col("x"), F.col("y"), TRIANGLE))


STAR = [(0.5, 0.5), (7.0, 1.5), (4.0, 3.5), (6.5, 7.0), (3.0, 5.0), (0.5, 6.5)]


@query(f"WITH {CELLS} SELECT grid_id, color, count(*)::BIGINT AS n FROM cells WHERE {polygon_sql(STAR)} GROUP BY 1, 2")
def cells_in_polygon(spark, sf):
    rows = tile_cells(spark, sf).where(G.in_polygon(F.col("x"), F.col("y"), STAR))
    return rows.groupBy("grid_id", "color").agg(F.count(F.lit(1)).alias("n"))


# structure

NEAR = f"""{CELLS}, n AS (SELECT *, lag(color) OVER rw AS l, lead(color) OVER rw AS r, lag(color) OVER cl AS u, lead(color) OVER cl AS d FROM cells
  WINDOW rw AS (PARTITION BY grid_id, y ORDER BY x), cl AS (PARTITION BY grid_id, x ORDER BY y))"""


@query(f"WITH {NEAR} SELECT grid_id, idx, color FROM n WHERE color IS NOT NULL AND l IS NULL AND r IS NULL AND u IS NULL AND d IS NULL")
def isolated_cells(spark, sf):
    return D.isolated(tile_cells(spark, sf)).select("grid_id", "idx", "color")


@query(f"WITH {NEAR} SELECT grid_id, idx, color FROM n WHERE color IS NOT NULL AND NOT coalesce(l = color, false) AND NOT coalesce(r = color, false) AND NOT coalesce(u = color, false) AND NOT coalesce(d = color, false)")
def singletons(spark, sf):
    return D.singletons(tile_cells(spark, sf)).select("grid_id", "idx", "color")


@query(f"""WITH {NEAR}, m AS (SELECT *, lead(d) OVER (PARTITION BY grid_id, y ORDER BY x) AS dr, lag(d) OVER (PARTITION BY grid_id, y ORDER BY x) AS dl FROM n)
SELECT grid_id, sum(CASE WHEN color IS NULL THEN 0 ELSE (dr IS NOT NULL AND r IS NULL AND d IS NULL)::INT + (dl IS NOT NULL AND l IS NULL AND d IS NULL)::INT END)::BIGINT AS diagonal,
  sum((color IS NOT NULL AND ((l IS NOT NULL AND r IS NOT NULL AND u IS NULL AND d IS NULL) OR (u IS NOT NULL AND d IS NOT NULL AND l IS NULL AND r IS NULL)))::INT)::BIGINT AS narrow FROM m GROUP BY 1""")
def contacts(spark, sf):
    return D.contacts(tile_cells(spark, sf))


def regions_sql(step: str, condition: str, cells: str = "cells") -> str:
    return f"""r AS (SELECT grid_id, idx, idx AS region FROM {cells} WHERE color IS NOT NULL
  UNION SELECT b.grid_id, b.idx, r.region FROM r JOIN {cells} a USING (grid_id, idx) JOIN {cells} b ON b.grid_id = a.grid_id AND {step} AND {condition} AND b.color IS NOT NULL),
reg AS (SELECT grid_id, idx, min(region) AS region FROM r GROUP BY 1, 2)"""


STEP4 = "abs(a.x - b.x) + abs(a.y - b.y) = 1"
STEP8 = "greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1"


@query(f"WITH RECURSIVE {CELLS}, {regions_sql(STEP4, 'true')} SELECT grid_id, idx, region FROM reg")
def components(spark, sf):
    return D.regions(tile_cells(spark, sf))


@query(f"WITH RECURSIVE {CELLS}, {regions_sql(STEP4, 'a.color = b.color')} SELECT grid_id, region, count(*)::BIGINT AS size FROM reg GROUP BY 1, 2")
def color_components(spark, sf):
    return D.regions(tile_cells(spark, sf), True).groupBy("grid_id", "region").agg(F.count(F.lit(1)).alias("size"))


@query(f"WITH RECURSIVE {CELLS}, {regions_sql(STEP8, 'a.color = b.color')} SELECT grid_id, region, count(*)::BIGINT AS size FROM reg GROUP BY 1, 2")
def diagonal_components(spark, sf):
    return D.regions(tile_cells(spark, sf), True, True).groupBy("grid_id", "region").agg(F.count(F.lit(1)).alias("size"))


@query(f"""WITH RECURSIVE {CELLS}, s AS (SELECT grid_id, idx, x, y, coalesce(color, '') AS color FROM cells),
f AS (SELECT * FROM s WHERE idx = 27 UNION SELECT b.* FROM f a JOIN s b ON a.grid_id = b.grid_id AND {STEP4} AND a.color = b.color) SELECT grid_id, idx FROM f""")
def flood_region(spark, sf):
    return D.flood(tile_cells(spark, sf), 27)


@query(f"""WITH {CELLS}, v AS (SELECT c.grid_id, c.x, c.y, c.color, n.color AS nc, count(*) AS n FROM cells c JOIN cells n ON c.grid_id = n.grid_id AND greatest(abs(c.x - n.x), abs(c.y - n.y)) = 1
  WHERE c.color IS NOT NULL AND n.color IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT grid_id, x, y, arg_min(nc, (-n, nc)) AS nc, max(n) AS n, sum(CASE WHEN nc = color THEN n ELSE 0 END) AS same FROM v GROUP BY 1, 2, 3)
SELECT grid_id, c.x, c.y, CASE WHEN same <= 1 AND n >= 4 THEN nc ELSE color END AS color FROM cells c LEFT JOIN m USING (grid_id, x, y)""")
def speckle_pass(spark, sf):
    return D.speckle_pass(tile_cells(spark, sf), 1, 4).select("grid_id", "x", "y", "color")


@query(f"WITH {CELLS}, c AS (SELECT grid_id, color, count(*)::BIGINT AS n FROM cells WHERE color IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, color)::INT AS rank FROM c) SELECT grid_id, color, n, rank FROM r WHERE rank <= 3")
def budget_frequency(spark, sf):
    return S.budget_by_frequency(tile_cells(spark, sf), 3)


@query(f"WITH {CELLS} SELECT grid_id, count(color)::BIGINT AS beads, count(DISTINCT color)::BIGINT AS colors FROM cells GROUP BY 1")
def grid_totals(spark, sf):
    return tile_cells(spark, sf).groupBy("grid_id").agg(F.count("color").alias("beads"), F.countDistinct("color").alias("colors"))


@query(f"WITH {CELLS} SELECT a.grid_id, count(*)::BIGINT AS pairs, sum((a.color IS NOT DISTINCT FROM b.color)::INT)::BIGINT AS equal FROM cells a JOIN cells b ON a.grid_id = b.grid_id AND a.y = b.y AND b.x = 7 - a.x WHERE a.x < 4 GROUP BY 1")
def symmetry(spark, sf):
    cells = tile_cells(spark, sf)
    other = cells.select("grid_id", "y", (7 - F.col("x")).alias("x"), F.col("color").alias("twin"))
    rows = cells.where("x < 4").join(other, ["grid_id", "x", "y"])
    return rows.groupBy("grid_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("color").eqNullSafe(F.col("twin")).cast("int")).alias("equal"))
