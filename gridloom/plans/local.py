"""Queries on local evidence: regions of images, pairs of cells, holes, thinning, repeated strokes, trees."""

from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import cache
from ..operators import local as L
from ..operators import workspace as W
from ..operators.rounds import ascend, shared_folder
from ..operators.thinning import thinned
from ..sources.tables import tile_cells, tiles
from .base import CELLS, PX, lab_of_linear, linear, query
from .grids import STEP8, regions_sql
from .images import N, OVERLAP
from .workspace import _pass

_BOUND = "cx / 0.375::DOUBLE AS x0, least(8, (cx + 1) / 0.375::DOUBLE) AS x1, cy / 0.375::DOUBLE AS y0, least(8, (cy + 1) / 0.375::DOUBLE) AS y1"
_LIN = f"pl AS (SELECT *, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM px)"
EVIDENCE = f"""{PX}, {OVERLAP}, {_LIN},
pe AS (SELECT p.grid_id, p.idx, max(CASE WHEN q.a > 0 THEN sqrt((p.lr - q.lr) ** 2 + (p.lg - q.lg) ** 2 + (p.lb - q.lb) ** 2) / sqrt(3.0::DOUBLE) * least(p.a, q.a) / 255 ELSE 0 END) AS edge
  FROM pl p JOIN pl q ON p.grid_id = q.grid_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 GROUP BY 1, 2),
part AS (SELECT o.grid_id * {N * N} + cy * {N} + cx AS box, o.grid_id AS image, cx, cy, o.idx, o.x, o.y, o.a, w, (o.r >> 4) * 256 + (o.g >> 4) * 16 + (o.b >> 4) AS key, lr, lg, lb, edge
  FROM ov o JOIN pl USING (grid_id, idx) JOIN pe USING (grid_id, idx) WHERE w > 0),
mean AS (SELECT box, image, cx, cy, max(edge) AS edge, sum(w * lr) / sum(w) AS lr, sum(w * lg) / sum(w) AS lg, sum(w * lb) / sum(w) AS lb FROM part GROUP BY 1, 2, 3, 4), {lab_of_linear('mean', 'box, image, cx, cy, edge', 'ml')},
oc AS (SELECT box AS grid_id, idx, x, y, CASE WHEN a >= 127.5 THEN key END AS color, w, key FROM part), {regions_sql(STEP8, 'a.color = b.color', 'oc')},
bounds AS (SELECT DISTINCT box, {_BOUND} FROM part),
piece AS (SELECT grid_id AS box, region, key, sum(w) AS w, count(*) AS n, min(x) AS l, max(x) + 1 AS r, min(y) AS t, max(y) + 1 AS b FROM reg JOIN oc USING (grid_id, idx) GROUP BY 1, 2, 3),
spans AS (SELECT box, key, round(w, 9) AS w, n, round(least(1, greatest((least(x1, r) - greatest(x0, l)) / (x1 - x0), (least(y1, b) - greatest(y0, t)) / (y1 - y0))), 9) AS span FROM piece JOIN bounds USING (box)),
big AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY box, key ORDER BY w DESC, span DESC, n DESC) = 1),
bin0 AS (SELECT box, key, sum(w) AS w, sum(w * lr) / sum(w) AS lr, sum(w * lg) / sum(w) AS lg, sum(w * lb) / sum(w) AS lb FROM part GROUP BY 1, 2), {lab_of_linear('bin0', 'box, key, w', 'bl')},
placed AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY round(w, 9) DESC, key) AS place, sum(w) OVER (PARTITION BY box) AS total FROM bl),
heavy AS (SELECT box, ok_l AS ml, ok_a AS ma, ok_b AS mb, w / total AS dominance FROM placed WHERE place = 1),
mode AS (SELECT p.box, least(1, sqrt((ok_l - ml) ** 2 + (ok_a - ma) ** 2 + (ok_b - mb) ** 2)) AS contrast, CASE WHEN g.n >= 3 THEN least(1, g.w / p.w * span ** 2) ELSE 0 END AS support
  FROM placed p JOIN heavy USING (box) LEFT JOIN big g ON g.box = p.box AND g.key = p.key),
seen AS (SELECT box, max(contrast) AS contrast, max(contrast * support) AS held FROM mode GROUP BY 1),
ev AS (SELECT image AS grid_id, cx, cy, ok_l, ok_a, ok_b, least(1, edge) AS edge, contrast, CASE WHEN contrast > 1e-8 THEN least(1, held / contrast) ELSE 1 END AS reliability, dominance FROM ml JOIN seen USING (box) JOIN heavy USING (box))"""
_EVIDENCE = ("ok_l", "ok_a", "ok_b", "edge", "contrast", "reliability", "dominance")


@query(f"WITH RECURSIVE {EVIDENCE} SELECT grid_id, cx, cy, {', '.join(f'round({c}, 6) AS {c}' for c in _EVIDENCE)} FROM ev")
def region_evidence(spark, sf):
    rows = L.region_evidence(tiles(spark, sf), 8, 8, N, N)
    return rows.select("grid_id", "cx", "cy", *[F.round(c, 6).alias(c) for c in _EVIDENCE])


@query(f"""WITH RECURSIVE {EVIDENCE}, pair AS (SELECT a.grid_id, a.cx, a.cy, b.cx - a.cx AS i, b.cy - a.cy AS j, least(1, sqrt((a.ok_l - b.ok_l) ** 2 + (a.ok_a - b.ok_a) ** 2 + (a.ok_b - b.ok_b) ** 2)) AS c, least(a.reliability, b.reliability) * a.dominance ** 2 * b.dominance ** 2 AS t
  FROM ev a JOIN ev b ON a.grid_id = b.grid_id AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1)
SELECT grid_id, cx, cy, round(max(c) FILTER (i = 1), 6) AS right_contrast, round(max(t) FILTER (i = 1), 6) AS right_reliability, round(max(c) FILTER (j = 1), 6) AS down_contrast, round(max(t) FILTER (j = 1), 6) AS down_reliability,
  round(greatest(any_value(edge * reliability), coalesce(max(c), 0)), 6) AS edge_guide FROM ev LEFT JOIN pair USING (grid_id, cx, cy) GROUP BY 1, 2, 3""")
def pair_reliability(spark, sf):
    rows = L.pair_reliability(L.region_evidence(tiles(spark, sf), 8, 8, N, N))
    names = {"right": "right_contrast", "right_reliability": "right_reliability", "down": "down_contrast", "down_reliability": "down_reliability", "edge_guide": "edge_guide"}
    return rows.select("grid_id", "cx", "cy", *[F.round(c, 6).alias(n) for c, n in names.items()])


_SWAPPED = "x - grid_id % 6 IN (0, 1) AND y - grid_id // 6 % 6 IN (0, 1, 2)"
SWAPPED = PX.replace("px AS (", "px0 AS (", 1) + f""", px AS (SELECT grid_id, idx, x, y, v, CASE WHEN {_SWAPPED} THEN g ELSE r END AS r, CASE WHEN {_SWAPPED} THEN r ELSE g END AS g, b,
  CASE WHEN {_SWAPPED} THEN 255 ELSE a END AS a FROM px0)"""


@query(f"WITH RECURSIVE {EVIDENCE.replace(PX, SWAPPED, 1)} SELECT grid_id, cx, cy, {', '.join(f'round({c}, 6) AS {c}' for c in _EVIDENCE)} FROM ev")
def evidence_again(spark, sf):
    """Evidence of the tiles from the table that keeps it, computed again where a box of 2 x 3 pixels of each tile is changed."""
    px = tiles(spark, sf)
    inside = (F.col("x") - F.col("grid_id") % 6).isin(0, 1) & (F.col("y") - F.floor(F.col("grid_id") / 6) % 6).isin(0, 1, 2)
    now = px.withColumns({"r": F.when(inside, F.col("g")).otherwise(F.col("r")), "g": F.when(inside, F.col("r")).otherwise(F.col("g")), "a": F.when(inside, 255).otherwise(F.col("a"))})
    held = cache.cached_evidence(px, shared_folder(spark) + "/evidence", 8, 8, N, N)
    rows = cache.evidence_again(held, now, cache.changed_boxes(px, now), 8, 8, N, N)
    return rows.select("grid_id", "cx", "cy", *[F.round(c, 6).alias(c) for c in _EVIDENCE])


@query(f"""WITH {PX} SELECT c.grid_id, c.idx, count(*)::BIGINT AS n, sum(p.r)::BIGINT AS red, sum(p.r + p.g + p.b)::BIGINT AS light FROM px c JOIN px p ON p.grid_id = c.grid_id AND abs(p.x - c.x) <= 2 AND abs(p.y - c.y) <= 2 GROUP BY 1, 2""")
def local_sums(spark, sf):
    """Sums over the 5 x 5 pixels around each pixel."""
    px = tiles(spark, sf)
    values = {"n": F.lit(1), "red": F.col("r"), "light": F.col("r") + F.col("g") + F.col("b")}
    low, high = (lambda c: F.greatest(F.lit(0.0), F.col(c) - 2.0)), (lambda c: F.least(F.lit(8.0), F.col(c) + 3.0))
    boxes = px.select("grid_id", F.col("idx").alias("box"), low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    sums = L.box_sums(L.summed_areas(px, values), boxes, [*values])
    return sums.select("grid_id", F.col("box").alias("idx"), *[F.round(c).cast("long").alias(c) for c in values])


def _structure(cells: str, name: str) -> str:
    """Pieces and holes by flooding: 8-connected occupied cells; 4-connected empty places of the grid with a border around it."""
    return f"""{name}_s AS (SELECT grid_id, idx, x, y, color IS NOT NULL AS full_ FROM {cells}),
{name}_p AS (SELECT g.grid_id, (y + 1) * 10 + x + 1 AS idx, x, y, coalesce(s.full_, false) AS full_ FROM (SELECT DISTINCT grid_id FROM {name}_s) g CROSS JOIN (SELECT unnest(range(-1, 9)) AS x) CROSS JOIN (SELECT unnest(range(-1, 9)) AS y) LEFT JOIN {name}_s s USING (grid_id, x, y)),
{name}_r AS (SELECT grid_id, idx, idx AS region, full_ FROM {name}_p UNION SELECT b.grid_id, b.idx, r.region, b.full_ FROM {name}_r r JOIN {name}_p a USING (grid_id, idx)
  JOIN {name}_p b ON b.grid_id = a.grid_id AND b.full_ = a.full_ AND (abs(a.x - b.x) + abs(a.y - b.y) = 1 OR a.full_ AND {STEP8})),
{name}_m AS (SELECT grid_id, idx, full_, min(region) AS region FROM {name}_r GROUP BY 1, 2, 3),
{name} AS (SELECT grid_id, count(DISTINCT region) FILTER (full_) AS pieces, count(DISTINCT region) FILTER (NOT full_) - 1 AS holes FROM {name}_m GROUP BY 1)"""


@query(f"WITH RECURSIVE {CELLS}, {_structure('cells', 'h')} SELECT grid_id, pieces::BIGINT AS pieces, holes::BIGINT AS holes FROM h WHERE pieces > 0")
def grid_holes(spark, sf):
    return L.holes(tile_cells(spark, sf))


@query(f"""WITH RECURSIVE {CELLS}, {_pass('cells', 'p1')}, even AS (SELECT grid_id, y * 8 + x AS idx, x, y, CASE WHEN color <> 'k1' THEN color END AS color FROM p1), {_structure('cells', 'h')}, {_structure('even', 'g')}
SELECT h.grid_id, abs(h.pieces - g.pieces)::BIGINT AS component_error, abs(h.holes - g.holes)::BIGINT AS hole_error FROM h JOIN g USING (grid_id)""")
def structure_errors(spark, sf):
    """Tiles against what is left of them without speckles and without one colour."""
    cells = tile_cells(spark, sf)
    even = W.despeckle(cells, 1, 1, 3).select("grid_id", (F.col("y") * 8 + F.col("x")).alias("idx"), "x", "y", F.when(F.col("color") != "k1", F.col("color")).alias("color"))
    return L.structure_errors(cells, even)


_RING = (1, -9, -10, -11, -1, 9, 10, 11)
_EMPTY = [f"(c[p + 1 + {d}] < 0)::INT" for d in _RING]
_TURNS = " + ".join(f"{_EMPTY[k]} * (1 - {_EMPTY[k + 1]} * {_EMPTY[(k + 2) % 8]})" for k in (0, 2, 4, 6))
_WEAKER = " OR ".join(f"able[p + 1 + {d}] BETWEEN 0 AND c[p + 1] - 1" for d in _RING)


#: Rounds over lists of 10 x 10 places, of which the outer are empty.
_THINNED = f"""WITH RECURSIVE {PX}, s0 AS (SELECT grid_id, x, y, row_number() OVER (PARTITION BY grid_id ORDER BY v, y % 2, x % 2, idx) - 1 AS k FROM px WHERE v >= 96),
g AS (SELECT DISTINCT grid_id FROM s0), start_ AS (SELECT g.grid_id, list(coalesce(k, -1) ORDER BY p) AS c FROM g CROSS JOIN (SELECT unnest(range(100)) AS p) LEFT JOIN s0 ON s0.grid_id = g.grid_id AND (s0.y + 1) * 10 + s0.x + 1 = p GROUP BY 1),
r AS (SELECT grid_id, 0 AS round, c FROM start_ UNION ALL SELECT grid_id, round + 1, list_transform(range(100), lambda p: CASE WHEN able[p + 1] >= 0 AND NOT coalesce({_WEAKER}, false) THEN -1 ELSE c[p + 1] END)
  FROM (SELECT grid_id, round, c, list_transform(range(100), lambda p: CASE WHEN c[p + 1] >= 0 AND {_TURNS} = 1 THEN c[p + 1] ELSE -1 END) AS able FROM r) WHERE list_max(able) >= 0),
last_ AS (SELECT grid_id, unnest(arg_max(c, round)) AS k, unnest(range(100)) AS p FROM r GROUP BY 1)
SELECT grid_id, (p % 10 - 1)::INT AS x, (p // 10 - 1)::INT AS y FROM last_ WHERE k >= 0"""


@query(_THINNED)
def thinned_loops(spark, sf):
    """The occupied cells of tiles, thinned to closed lines and single cells, the darkest first."""
    return thinned(tiles(spark, sf).withColumn("color", F.when(F.col("v") >= 96, "k")), F.col("v"))


_STROKES = """st AS (SELECT l_suppkey AS image, (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey * 60 + l_quantity::BIGINT AS stroke, l_quantity::DOUBLE / 50 AS ok_l, (l_discount::DOUBLE - 0.05) * 3.7::DOUBLE AS ok_a, (l_tax::DOUBLE - 0.04) * 3.7::DOUBLE AS ok_b,
  1 + l_partkey % 97 AS area, 1 + l_orderkey % 13 AS span, 0.9::DOUBLE AS support FROM lineitem)"""


@query(f"""WITH {_STROKES}, b AS (SELECT *, [floor(ok_l * 25), floor(ok_a * 25), floor(ok_b * 25), floor(log2(area)), floor(log2(span))] AS bin FROM st),
w AS (SELECT *, row_number() OVER (PARTITION BY image, bin ORDER BY stroke) AS place, count(*) OVER (PARTITION BY image, bin) AS own FROM b),
m AS (SELECT s.image, s.stroke, count(*) AS met FROM w s JOIN w o ON o.image = s.image AND o.place <= 3 AND o.bin <> s.bin AND sqrt((s.ok_l - o.ok_l) ** 2 + (s.ok_a - o.ok_a) ** 2 + (s.ok_b - o.ok_b) ** 2) < 0.08
  AND greatest(s.area / o.area::DOUBLE, o.area / s.area::DOUBLE) <= 4 AND greatest(s.span / o.span::DOUBLE, o.span / s.span::DOUBLE) <= 2 GROUP BY 1, 2)
SELECT image, stroke, least(3, own + coalesce(met, 0))::INT AS repetitions, round(support * exp(-greatest(0, least(3, own + coalesce(met, 0)) - 2)), 9) AS support FROM w LEFT JOIN m USING (image, stroke)""")
def repeated_strokes(spark, sf):
    key = F.col("l_orderkey")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("image"), ((key * 8 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey") * 60 + F.col("l_quantity").cast("long")).alias("stroke"), (F.col("l_quantity").cast("double") / 50).alias(C.OK[0]), ((F.col("l_discount").cast("double") - 0.05) * 3.7).alias(C.OK[1]),
        ((F.col("l_tax").cast("double") - 0.04) * 3.7).alias(C.OK[2]), (1 + F.col("l_partkey") % 97).alias("area"), (1 + key % 13).alias("span"), F.lit(0.9).alias("support"),
    )
    return L.repeated_strokes(rows).withColumn("support", F.round("support", 9))


_PARENT = "(p_partkey * 37 + p_size * 11) % 2003"


@query(f"""WITH RECURSIVE t AS (SELECT left(p_brand, 7) AS record, p_partkey AS id, {_PARENT} AS parent FROM part), e AS (SELECT t.record, t.id, u.id AS parent FROM t LEFT JOIN t u ON u.record = t.record AND u.id = t.parent),
c AS (SELECT record, id, parent AS here, 1 AS steps FROM e WHERE parent IS NOT NULL UNION SELECT c.record, c.id, e.parent, steps + 1 FROM c JOIN e ON e.record = c.record AND e.id = c.here WHERE e.parent IS NOT NULL AND steps < 60),
ring AS (SELECT DISTINCT record, id FROM c WHERE id = here), low AS (SELECT DISTINCT c.record, c.id FROM c JOIN ring r ON r.record = c.record AND r.id = c.here),
top AS (SELECT record, id, arg_max(here, steps) AS top, max(steps) AS depth FROM c GROUP BY 1, 2)
SELECT e.record, e.id, CASE WHEN low.id IS NULL THEN coalesce(top, e.id) END AS top, CASE WHEN low.id IS NULL THEN coalesce(depth, 0) END::BIGINT AS depth,
  CASE WHEN ring.id IS NOT NULL THEN 'cycle' WHEN low.id IS NOT NULL THEN 'below a cycle' ELSE 'tree' END AS state
FROM e LEFT JOIN top USING (record, id) LEFT JOIN low USING (record, id) LEFT JOIN ring USING (record, id)""")
def text_region_trees(spark, sf):
    """Regions of text records with the region each lies in: roots, depths, and the cycles that make a record invalid."""
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.substring("p_brand", 1, 7).alias("record"), F.col("p_partkey").alias("id"), F.expr(_PARENT).alias("parent"))
    return ascend(rows, record="record").select("record", "id", "top", "depth", "state")
