"""Queries on evidence, conversions and optimisation."""

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import shapes as H
from ..operators import diagnostics as D
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import match as M
from ..operators import optimize as O
from ..operators import pages as P
from ..operators import sampling as S
from ..operators import validate as V
from ..sources.tables import palette, tile_cells, tiles
from .base import CELLS, PAL, PX, lab, lab_of_linear, linear, query, redmean
from .colors import NEAREST, rgb
from .grids import CORNERS, STEP4, STEP8, boxes, regions_sql
from .images import AREA, OVERLAP, SCALE


@query(f"""WITH {PX}, {PAL}, n AS (SELECT grid_id, x // 2 AS cx, y // 2 AS cy, idx, arg_min(q.id, ({redmean('p', 'q')}, q.pos)) AS color FROM px p, pal q GROUP BY 1, 2, 3, 4),
v AS (SELECT grid_id, cx, cy, color, count(*) AS n FROM n GROUP BY 1, 2, 3, 4), m AS (SELECT grid_id, cx, cy, arg_min(color, (-n, color)) AS color, max(n) / sum(n)::DOUBLE AS share FROM v GROUP BY 1, 2, 3)
SELECT grid_id, cx, cy, CASE WHEN share >= 0.6 THEN color END AS color, round(share, 6) AS share FROM m""")
def cell_votes(spark, sf):
    rows = M.nearest_redmean(tiles(spark, sf), palette(spark), *rgb())
    rows = rows.select("grid_id", F.floor(F.col("x") / 2).cast("int").alias("cx"), F.floor(F.col("y") / 2).cast("int").alias("cy"), "color")
    return E.cell_votes(rows, 0.6).withColumn("share", F.round("share", 6))


@query(f"""WITH RECURSIVE {PX}, kc AS (SELECT grid_id, idx, x, y, CASE WHEN a >= 128 THEN (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) END AS color FROM px), {regions_sql(STEP8, 'a.color = b.color', 'kc')},
d AS (SELECT reg.grid_id, region, count(*)::BIGINT AS area, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM reg JOIN kc USING (grid_id, idx) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT grid_id, region, area, l, t, r, b, round(area / ((r - l + 1) * (b - t + 1))::DOUBLE, 6) AS density,
  area / ((r - l + 1) * (b - t + 1))::DOUBLE >= 0.5 AND greatest(r - l, b - t) + 1 <= 2 * (least(r - l, b - t) + 1) AS compact FROM d""")
def component_descriptors(spark, sf):
    return E.component_descriptors(tiles(spark, sf)).withColumn("density", F.round("density", 6))


@query(f"""WITH m AS (SELECT vec_id AS grid_id, (i % 8)::INT AS x, (i // 8)::INT AS y FROM embeddings, unnest(range(0, 64)) t(i) WHERE i BETWEEN vec_id % 20 AND vec_id % 20 + 6 OR i BETWEEN 40 AND 40 + vec_id % 9),
o AS (SELECT grid_id, cx.c AS cx, cy.c AS cy, greatest(0, least((cx.c + 1) / {SCALE}::DOUBLE, x + 1) - greatest(cx.c / {SCALE}::DOUBLE, x)) * greatest(0, least((cy.c + 1) / {SCALE}::DOUBLE, y + 1) - greatest(cy.c / {SCALE}::DOUBLE, y)) AS w
  FROM m, (SELECT unnest(range(0, 3))::INT AS c) cx, (SELECT unnest(range(0, 3))::INT AS c) cy)
SELECT grid_id, cx, cy, round(sum(w) * {SCALE * SCALE}, 6) AS coverage FROM o GROUP BY 1, 2, 3 HAVING sum(w) * {SCALE * SCALE} + 1e-12 >= 0.04""")
def mask_projection(spark, sf):
    ids = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("grid_id"))
    runs = F.explode(F.array(F.struct((F.col("grid_id") % 20).alias("start"), F.lit(7).cast("long").alias("length")), F.struct(F.lit(40).cast("long").alias("start"), (F.col("grid_id") % 9 + 1).alias("length")))).alias("r")
    return E.project_mask(ids.select("grid_id", runs).select("grid_id", "r.*"), 8, 8, 3, 3).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {AREA}, {PAL}, {lab_of_linear('ar', 'grid_id, cx, cy', 'o')}, {lab('pal', 'id', 'q')},
d AS (SELECT grid_id, cx, cy, q.id, (o.ok_l - q.ok_l) ** 2 + (o.ok_a - q.ok_a) ** 2 + (o.ok_b - q.ok_b) ** 2 AS d FROM o, q), n AS (SELECT grid_id, cx, cy, arg_min(id, (d, id)) AS id FROM d GROUP BY 1, 2, 3),
k AS (SELECT grid_id, id, row_number() OVER (PARTITION BY grid_id ORDER BY count(*) DESC, id) AS place FROM n GROUP BY 1, 2)
SELECT grid_id, cx, cy, arg_min(id, (d, id)) AS color FROM d JOIN k USING (grid_id, id) WHERE place <= 2 GROUP BY 1, 2, 3""")
def generate_pattern(spark, sf):
    return E.generate(tiles(spark, sf), palette(spark), 8, 8, 3, 3, 2)


PHASES = ((0.0, 0.0), (0.5, 0.0), (-0.5, 0.0), (0.0, 0.5), (0.0, -0.5))


@query("WITH " + PX + ", ph(k, dx, dy) AS (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(PHASES)) + f"""),
s AS (SELECT k, cx, cy, floor((cx + 0.5 - dx) / {SCALE}::DOUBLE)::INT AS x, floor((cy + 0.5 - dy) / {SCALE}::DOUBLE)::INT AS y FROM ph, (SELECT unnest(range(0, 3))::INT AS cx), (SELECT unnest(range(0, 3))::INT AS cy))
SELECT k AS phase, grid_id, count(*)::BIGINT AS cells, sum(v)::BIGINT AS total FROM px JOIN s USING (x, y) WHERE a / 255.0 >= 0.5 GROUP BY 1, 2""")
def phase_comparison(spark, sf):
    spots = [(k, cx, cy, int((cx + 0.5 - dx) / SCALE // 1), int((cy + 0.5 - dy) / SCALE // 1)) for k, (dx, dy) in enumerate(PHASES) for cx in range(3) for cy in range(3)]
    grid = spark.createDataFrame(spots, "phase int, cx int, cy int, x int, y int")
    rows = tiles(spark, sf).where(F.col("a") / 255 >= S.ALPHA).join(F.broadcast(grid), ["x", "y"])
    return rows.groupBy("phase", "grid_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total"))


@query(f"""WITH {PX}, {PAL}, b AS (SELECT grid_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS key, count(*)::BIGINT AS n, floor(avg(r) + 0.5)::INT AS r, floor(avg(g) + 0.5)::INT AS g, floor(avg(b) + 0.5)::INT AS b FROM px
  WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 5 AND a >= 128 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, key) AS place FROM b),
top AS (SELECT * FROM k WHERE place = 1), {lab('top', 'grid_id, key, n', 'o')}, {lab('pal', 'id', 'q')}
SELECT grid_id, key, n, arg_min(q.id, ((o.ok_l - q.ok_l) ** 2 + (o.ok_a - q.ok_a) ** 2 + (o.ok_b - q.ok_b) ** 2, q.id)) AS color FROM o, q GROUP BY 1, 2, 3""")
def scene_feature(spark, sf):
    return E.scene_feature(tiles(spark, sf), F.col("x").between(2, 6) & F.col("y").between(1, 5), palette(spark))


@query(f"""WITH {PX}, w AS (SELECT grid_id, idx, r, g, b, (v * 7) % 256 AS a FROM px) SELECT grid_id, idx, {', '.join(f"CASE WHEN a > 0 THEN floor(({c} * a + 255 * (255 - a)) / 255.0::DOUBLE + 0.5)::INT END AS c{c}" for c in 'rgb')} FROM w""")
def over_white(spark, sf):
    return E.over_white(tiles(spark, sf).withColumn("a", F.col("v") * 7 % 256)).select("grid_id", "idx", "cr", "cg", "cb")


@query("""WITH RECURSIVE t AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey > 2 AND o_orderpriority = '1-URGENT' UNION ALL SELECT c.o_orderkey FROM orders c JOIN t ON c.o_orderkey // 3 = t.id AND c.o_orderkey > 2) SELECT DISTINCT id FROM t""")
def region_subtree(spark, sf):
    tree = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey > 2").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 3).alias("parent"), "o_orderpriority")
    return E.subtree(tree, F.col("o_orderpriority") == "1-URGENT")


NEAR_CELLS = f"{NEAREST}, asg AS (SELECT n.grid_id, n.idx, px.x, px.y, n.color FROM near n JOIN px USING (grid_id, idx))"


@query(f"""WITH RECURSIVE {NEAR_CELLS}, c AS (SELECT s.*, o.ok_l, o.ok_a, o.ok_b, q.ok_l AS pl, q.ok_a AS pa, q.ok_b AS pb FROM asg s JOIN o USING (grid_id, idx) JOIN q ON q.id = s.color),
e AS (SELECT a.grid_id, a.color <> b.color AS differs, least(1, sqrt((a.ok_l - b.ok_l) ** 2 + (a.ok_a - b.ok_a) ** 2 + (a.ok_b - b.ok_b) ** 2)) AS contrast, least(1, sqrt((a.pl - b.pl) ** 2 + (a.pa - b.pa) ** 2 + (a.pb - b.pb) ** 2)) AS got
  FROM c a JOIN c b ON a.grid_id = b.grid_id AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1)),
own AS (SELECT grid_id, avg((ok_l - pl) ** 2 + (ok_a - pa) ** 2 + (ok_b - pb) ** 2) AS color, 0.0001 * count(DISTINCT color) / 8 AS palette FROM c GROUP BY 1),
pair AS (SELECT grid_id, 0.02 * avg(CASE WHEN differs THEN exp(-8 * contrast) ELSE 0 END) AS smooth, 0.18 * avg((got - contrast) ** 2) AS edge FROM e GROUP BY 1), {regions_sql(STEP4, 'a.color = b.color', 'asg')},
sz AS (SELECT grid_id, region, count(*) AS n FROM reg GROUP BY 1, 2), isl AS (SELECT grid_id, 0.01 * sum(CASE WHEN n <= 4 THEN (5 - n) / 4.0::DOUBLE ELSE 0 END) / sum(n) AS island FROM sz GROUP BY 1)
SELECT grid_id, round(color, 8) AS color, round(smooth, 8) AS smooth, round(edge, 8) AS edge, round(island, 8) AS island, round(palette::DOUBLE, 8) AS palette FROM own JOIN pair USING (grid_id) JOIN isl USING (grid_id)""")
def energy_terms(spark, sf):
    cells = M.nearest_oklab(C.with_oklab(tiles(spark, sf)), palette(spark)).select("grid_id", "idx", "x", "y", *C.OK, "color")
    out = O.energy_table(cells, palette(spark), D.regions(cells, True), O.Spec())
    return out.select("grid_id", *[F.round(c, 8).alias(c) for c in ("color", "smooth", "edge", "island", "palette")])


@query()
def optimize_tiles(spark, sf):
    cells = C.with_oklab(tiles(spark, sf))
    cells = cells.select("grid_id", "idx", *[F.when(F.col("a") > 0, F.col(c)).alias(c) for c in C.OK])
    return O.optimize_grids(cells, palette(spark), O.Spec(max_colors=4), 8)


@query()
def merge_small_regions(spark, sf):
    return G.merge_regions(tile_cells(spark, sf), 8, 2)


@query()
def skeleton_points(spark, sf):
    return G.skeletons(tile_cells(spark, sf))


@query()
def shape_outlines(spark, sf):
    kinds = F.array(*map(F.lit, H.SHAPES))
    rows = D.spread(boxes(spark, sf), "id").withColumn("kind", F.element_at(kinds, (F.col("id") % len(H.SHAPES) + 1).cast("int")))
    return rows.select("*", F.explode(H.shape_cells(*[F.col(c) for c in ("kind", *CORNERS)])).alias("c")).select("id", "kind", *CORNERS, "c.x", "c.y")


@query(f"""WITH {PX}, {OVERLAP}, bn AS (SELECT grid_id, cx, cy, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS key, sum(w) AS weight, sum(w * {linear('r')}) / sum(w) AS lr, sum(w * {linear('g')}) / sum(w) AS lg, sum(w * {linear('b')}) / sum(w) AS lb FROM ov WHERE w > 0 GROUP BY 1, 2, 3, 4),
sh AS (SELECT *, weight / sum(weight) OVER c AS share, row_number() OVER (PARTITION BY grid_id, cx, cy ORDER BY round(weight, 9) DESC, key) AS place FROM bn WINDOW c AS (PARTITION BY grid_id, cx, cy)),
{lab_of_linear('sh', 'grid_id, cx, cy, key, share, place', 'o')}, d AS (SELECT o.*, sqrt((o.ok_l - m.ok_l) ** 2 + (o.ok_a - m.ok_a) ** 2 + (o.ok_b - m.ok_b) ** 2) AS contrast FROM o JOIN o m ON m.place = 1 AND m.grid_id = o.grid_id AND m.cx = o.cx AND m.cy = o.cy),
k AS (SELECT *, row_number() OVER (PARTITION BY grid_id, cx, cy ORDER BY round(contrast * sqrt(share), 9) DESC, key) AS best FROM d WHERE place > 3 AND share >= 0.02 AND contrast > 0.02)
SELECT grid_id, cx, cy, key, round(share, 6) AS share, round(contrast, 6) AS contrast FROM k WHERE best = 1""")
def minority_modes(spark, sf):
    rows = S.minority_modes(S.color_bins(tiles(spark, sf), 8, 8, 3, 3), contrast=0.02)
    return rows.select("grid_id", "cx", "cy", "key", F.round("share", 6).alias("share"), F.round("contrast", 6).alias("contrast"))


@query(f"""WITH {PX}, s AS (SELECT (c % 4)::INT AS cx, (c // 4)::INT AS cy, least(7, floor(((c % 4) + ((k % 3) + 0.5) / 3::DOUBLE) * 2))::INT AS x, least(7, floor(((c // 4) + ((k // 3) + 0.5) / 3::DOUBLE) * 2))::INT AS y
  FROM (SELECT unnest(range(0, 16)) AS c), (SELECT unnest(range(0, 9)) AS k))
SELECT grid_id, cx, cy, count(*)::BIGINT AS n, round(avg(CASE WHEN a < 24 THEN 1 ELSE 0 END), 6) AS background, floor(avg(r) FILTER (a >= 24) + 0.5)::INT AS r FROM px JOIN s USING (x, y) GROUP BY 1, 2, 3""")
def sample_grid(spark, sf):
    rows = S.sample_points(tiles(spark, sf), 8, 8, 4, 4, 3)
    clear = F.col("a") < 24
    out = rows.groupBy("grid_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(clear.cast("int")), 6).alias("background"), C.half_up(F.avg(F.when(~clear, F.col("r")))).cast("int").alias("r"))
    return out.select("grid_id", "cx", "cy", "n", "background", "r")


MM = "regexp_replace(regexp_replace(printf('%.4f', {} * 2.6::DOUBLE), '0+$', ''), '[.]$', '')"


@query(f"""WITH {CELLS}, {PAL} SELECT grid_id, '<svg xmlns="http://www.w3.org/2000/svg" width="20.8mm" height="20.8mm" viewBox="0 0 20.8 20.8">' || string_agg('<rect x="' || {MM.format('x')} || '" y="' || {MM.format('y')} || '" width="2.6" height="2.6" fill="'
  || printf('#%02X%02X%02X', r, g, b) || '"><title>' || code || '</title></rect>', '' ORDER BY y, x) || '</svg>' AS svg FROM cells JOIN pal ON pal.id = 'c' || lpad(substr(color, 2), 2, '0') GROUP BY 1""")
def svg_documents(spark, sf):
    named = F.when(F.col("color").isNotNull(), F.concat(F.lit("c"), F.lpad(F.substring("color", 2, 9), 2, "0")))
    return P.svg_documents(P.svg_cells(tile_cells(spark, sf).withColumn("color", named), palette(spark), 2.6), 20.8, 20.8)


@query(f"""WITH {CELLS}, c AS (SELECT grid_id, color, count(*)::BIGINT AS counted FROM cells WHERE color IS NOT NULL GROUP BY 1, 2),
b AS (SELECT grid_id, color, CASE WHEN grid_id % 50 = 0 THEN counted + 1 ELSE counted END AS stated FROM c WHERE grid_id % 70 <> 3 UNION ALL SELECT 5, 'k99', 2)
SELECT grid_id, color, counted, stated FROM c FULL JOIN b USING (grid_id, color) WHERE counted IS DISTINCT FROM stated""")
def bill_differences(spark, sf):
    cells = tile_cells(spark, sf)
    counted = cells.where("color IS NOT NULL").groupBy("grid_id", "color").agg(F.count(F.lit(1)).alias("n")).where("grid_id % 70 <> 3")
    bill = counted.withColumn("n", F.when(F.col("grid_id") % 50 == 0, F.col("n") + 1).otherwise(F.col("n"))).unionByName(spark.createDataFrame([(5, "k99", 2)], "grid_id long, color string, n long"))
    return V.bill_differences(cells, bill)


@query()
def merge_similar_colors(spark, sf):
    return G.merge_similar(tile_cells(spark, sf), lambda a, b: abs(int(a[1:]) - int(b[1:])) == 1).select("grid_id", "idx", "color")


@query()
def limit_grid_colors(spark, sf):
    colors = {f"k{i}": (i * 24 + 96, 159 - i * 24, i * 30) for i in range(12)}
    return G.limit_colors(tile_cells(spark, sf), colors, 3, lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))).select("grid_id", "idx", "color")
