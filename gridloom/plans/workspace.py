"""Queries on a workspace: snapshots, capped lists, versions, active layers, constraints, feature colours."""

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import workspace as W
from ..sources.tables import layer_cells, palette, tile_cells, tiles
from .base import CELLS, LAYERS, PAL, PX, lab, query, redmean


@query(f"WITH {LAYERS} SELECT color, false AS added FROM (VALUES ('AF'), ('XX')) t(color) UNION ALL SELECT DISTINCT color, true FROM layers WHERE color IS NOT NULL AND color NOT IN ('AF', 'XX')")
def palette_snapshot(spark, sf):
    return W.snapshot(spark.createDataFrame([("AF",), ("XX",)], "color string"), layer_cells(spark, sf))


@query(f"""WITH {CELLS}, w AS (SELECT grid_id, 'cell ' || idx || ' is empty' AS message, row_number() OVER (PARTITION BY grid_id ORDER BY idx)::INT AS place, count(*) OVER (PARTITION BY grid_id) AS n FROM cells WHERE color IS NULL)
SELECT grid_id, place, CASE WHEN place = 32 AND n > 32 THEN (n - 31) || ' additional diagnostics omitted.' ELSE message END AS message FROM w WHERE place <= 32""")
def capped_warnings(spark, sf):
    rows = tile_cells(spark, sf).where("color IS NULL").select("grid_id", "idx", F.concat(F.lit("cell "), F.col("idx").cast("string"), F.lit(" is empty")).alias("message"))
    return W.capped_messages(rows, "grid_id", "idx", 32)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 7 ORDER BY o_orderdate DESC, o_orderkey DESC) <= 40")
def undo_versions(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").withColumn("board", F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 7).cast("string")))
    return W.latest_versions(rows, "board", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


_BACK, _ON = "op = 'undo' AND len(past) > 0", "op = 'redo' AND len(future) > 0"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS board, event_id AS version, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
s AS (SELECT DISTINCT board, 0::BIGINT AS seq, NULL::BIGINT AS version, NULL::BIGINT AS shown, []::BIGINT[] AS past, []::BIGINT[] AS future FROM e
  UNION ALL SELECT e.board, e.seq, e.version, CASE WHEN op = 'edit' THEN e.version WHEN {_BACK} THEN past[len(past)] WHEN {_ON} THEN future[len(future)] ELSE shown END,
    CASE WHEN op = 'edit' THEN list_append(past, shown)[greatest(1, len(past) - 38):] WHEN {_BACK} THEN past[1:len(past) - 1] WHEN {_ON} THEN list_append(past, shown) ELSE past END,
    CASE WHEN op = 'edit' THEN [] WHEN {_BACK} THEN list_append(future, shown) WHEN {_ON} THEN future[1:len(future) - 1] ELSE future END
  FROM s JOIN e ON e.board = s.board AND e.seq = s.seq + 1)
SELECT board, version, shown, len(past)::INT AS undoable, len(future)::INT AS redoable FROM s WHERE seq > 0""")
def undo_redo(spark, sf):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("board"), F.col("event_id").alias("version"), op.alias("op"), "ts", "event_id")
    return H.replay(rows, ["ts", "event_id"])


@query(f"WITH {LAYERS} SELECT cell, z, visible, z = 3 AND visible AS shown FROM layers")
def active_layer_view(spark, sf):
    return W.solo_view(layer_cells(spark, sf), 3).select("cell", "z", "visible", "shown")


@query(f"""WITH {LAYERS}, e AS (SELECT cell, z, CASE WHEN z = 1 AND cell % 3 = 0 AND NOT locked THEN CASE WHEN cell % 2 = 0 THEN 'QQ' END ELSE color END AS color, visible, opacity FROM layers)
SELECT cell, arg_max(color, z) AS color FROM e WHERE visible AND opacity > 0 AND color IS NOT NULL GROUP BY 1""")
def write_active_layer(spark, sf):
    layers = layer_cells(spark, sf)
    edits = layers.where("cell % 3 = 0").select("cell").distinct().withColumn("color", F.when(F.col("cell") % 2 == 0, F.lit("QQ")))
    return W.write_active(layers, edits, 1)


@query(f"""WITH {CELLS} SELECT grid_id, idx, 'lock-color' AS kind, color FROM cells WHERE y < 2 AND color IS NOT NULL AND NOT x BETWEEN 2 AND 5
UNION ALL SELECT grid_id, idx, CASE WHEN color IS NULL THEN 'lock-empty' ELSE 'lock-color' END, color FROM cells WHERE x BETWEEN 2 AND 5""")
def constrain_selection(spark, sf):
    cells = tile_cells(spark, sf)
    old = cells.where("y < 2 AND color IS NOT NULL").select("grid_id", "idx", F.lit("lock-color").alias("kind"), "color")
    return W.constrain(old, cells, F.col("x").between(2, 5), "lock-color")


@query(f"WITH {CELLS} SELECT grid_id, idx, 'lock-color' AS kind, color FROM cells WHERE y < 2 AND color IS NOT NULL AND NOT x BETWEEN 2 AND 5")
def clear_selection(spark, sf):
    cells = tile_cells(spark, sf)
    old = cells.where("y < 2 AND color IS NOT NULL").select("grid_id", "idx", F.lit("lock-color").alias("kind"), "color")
    return W.constrain(old, cells, F.col("x").between(2, 5), "clear")


@query(f"WITH {CELLS} SELECT grid_id, color, count(*)::BIGINT AS n, string_agg(idx, ',' ORDER BY idx) AS idxs FROM cells WHERE color IS NOT NULL GROUP BY 1, 2")
def color_positions(spark, sf):
    return W.color_positions(tile_cells(spark, sf)).withColumn("idxs", F.array_join(F.transform("idxs", lambda i: i.cast("string")), ","))


@query("SELECT p_brand || '/' || p_partkey AS id, CASE WHEN p_brand = 'Brand#13' THEN 'brand#13-' || lower(p_type) ELSE p_brand || '/' || p_partkey END AS workspace_id FROM part")
def workspace_color_ids(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("code"))
    return W.workspace_ids(rows, "Brand#13")


@query(f"""WITH {PX}, {PAL}, {lab('px', 'grid_id, idx', 's')}, {lab('pal', 'id', 'q')}, d AS (SELECT grid_id, idx, q.id AS color, sqrt((s.ok_l - q.ok_l) ** 2 + (s.ok_a - q.ok_a) ** 2 + (s.ok_b - q.ok_b) ** 2) AS distance FROM s, q),
r AS (SELECT *, row_number() OVER (PARTITION BY grid_id, idx ORDER BY distance, color)::INT AS rank FROM d) SELECT grid_id, idx, rank, color FROM r WHERE rank <= 6""")
def similar_source_colors(spark, sf):
    picked = tiles(spark, sf).select("grid_id", "idx", "r", "g", "b")
    return W.similar_colors(picked, palette(spark)).select("grid_id", "idx", "rank", "color")


#: Whole-number options with their bounds, weights from 0 to 10, options of named kinds.
RANGES = {"iterations": (0, 30), "maxEvaluations": (1, 2_000_000), "restarts": (1, 8), "seed": (0, 4_294_967_295), "islandMaxSize": (1, 16)}
WEIGHTS = {f"weights.{n}": (0, 10) for n in ("color", "smooth", "edge", "island", "palette", "feature", "symmetry")}
KINDS = {"strategy": ["dominant", "mean", "weighted-area", "modes"], "unary": ["representative", "modes"]}
FLAGS = ["symmetry", "sourceComponents", "sourceShapes", "sourceColors", "sourceEdges", "crossBinStrokes"]
_NAMES = [*RANGES, *KINDS, "other", *FLAGS, *WEIGHTS]
_VALUE = "CASE WHEN o_orderkey % 11 = 5 THEN 'modes' WHEN o_orderkey % 11 = 6 THEN '1.5' WHEN o_orderkey % 11 = 7 THEN 'true' WHEN o_orderkey % 11 = 8 THEN (o_orderkey * 20000)::VARCHAR ELSE (o_orderkey % 45 - 3)::VARCHAR END"


@query(f"""WITH o AS (SELECT o_orderkey AS request, [{', '.join(f"'{n}'" for n in _NAMES)}][(o_orderkey % {len(_NAMES)} + 1)::INT] AS name, {_VALUE} AS value FROM orders),
c AS (SELECT *, CASE {' '.join(f"WHEN name = '{n}' THEN CASE WHEN try_cast(value AS DOUBLE) IS NULL OR value::DOUBLE <> floor(value::DOUBLE) OR value::DOUBLE < {a} OR value::DOUBLE > {b} THEN 'not a whole number in range' END" for n, (a, b) in RANGES.items())}
  {' '.join(f"WHEN name = '{n}' THEN CASE WHEN try_cast(value AS DOUBLE) IS NULL OR value::DOUBLE < {a} OR value::DOUBLE > {b} THEN 'not a number in range' END" for n, (a, b) in WEIGHTS.items())}
  WHEN name IN ({', '.join(f"'{n}'" for n in FLAGS)}) THEN CASE WHEN value NOT IN ('true', 'false') THEN 'not true or false' END
  {' '.join(f"WHEN name = '{n}' THEN CASE WHEN value NOT IN ({', '.join(repr(v) for v in vs)}) THEN 'unknown strategy' END" for n, vs in KINDS.items())} ELSE 'unknown option' END AS rule FROM o)
SELECT request, name AS field, rule FROM c WHERE rule IS NOT NULL""")
def option_violations(spark, sf):
    key = F.col("o_orderkey")
    value = F.when(key % 11 == 5, F.lit("modes")).when(key % 11 == 6, F.lit("1.5")).when(key % 11 == 7, F.lit("true")).when(key % 11 == 8, (key * 20000).cast("string")).otherwise((key % 45 - 3).cast("string"))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(key.alias("request"), F.element_at(F.array(*map(F.lit, _NAMES)), (key % len(_NAMES) + 1).cast("int")).alias("name"), value.alias("value"))
    return W.option_violations(rows, RANGES, KINDS, WEIGHTS, FLAGS)


def _pass(source: str, name: str) -> str:
    return f"""{name}_v AS (SELECT c.grid_id, c.x, c.y, c.color, n.color AS nc, count(*) AS n, min((n.y - c.y) * 3 + n.x - c.x) AS first FROM {source} c JOIN {source} n ON c.grid_id = n.grid_id AND greatest(abs(c.x - n.x), abs(c.y - n.y)) = 1
  WHERE c.color IS NOT NULL AND n.color IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
{name}_m AS (SELECT grid_id, x, y, arg_min(nc, (-n, first)) AS nc, max(n) AS n, sum(CASE WHEN nc = color THEN n ELSE 0 END) AS same FROM {name}_v GROUP BY 1, 2, 3),
{name} AS (SELECT grid_id, c.x, c.y, CASE WHEN same <= 1 AND n >= 3 THEN nc ELSE color END AS color FROM {source} c LEFT JOIN {name}_m USING (grid_id, x, y))"""


@query(f"WITH {CELLS}, {_pass('cells', 'p1')}, {_pass('p1', 'p2')} SELECT grid_id, x, y, color FROM p2")
def despeckled(spark, sf):
    return W.despeckle(tile_cells(spark, sf), 2, 1, 3).select("grid_id", "x", "y", "color")


@query(f"""WITH {PX}, {PAL}, n AS (SELECT grid_id, x // 2 AS cx, y // 2 AS cy, idx, any_value(p.r) AS r, any_value(p.g) AS g, any_value(p.b) AS b, arg_min(q.id, ({redmean('p', 'q')}, q.pos)) AS color FROM px p, pal q GROUP BY 1, 2, 3, 4),
v AS (SELECT grid_id, cx, cy, color, count(*) AS n, min(idx) AS first, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM n GROUP BY 1, 2, 3, 4),
m AS (SELECT grid_id, cx, cy, arg_min(color, (-n, first)) AS color, max(n) / sum(n)::DOUBLE AS share, floor(sum(r) / sum(n)::DOUBLE + 0.5) AS r, floor(sum(g) / sum(n)::DOUBLE + 0.5) AS g, floor(sum(b) / sum(n)::DOUBLE + 0.5) AS b FROM v GROUP BY 1, 2, 3),
a AS (SELECT grid_id, cx, cy, arg_min(q.id, ({redmean('m', 'q')}, q.pos)) AS mean_color FROM m, pal q GROUP BY 1, 2, 3)
SELECT grid_id, cx, cy, CASE WHEN share >= 0.6 THEN color ELSE mean_color END AS color FROM m JOIN a USING (grid_id, cx, cy)""")
def voted_colors(spark, sf):
    rows = tiles(spark, sf).select("grid_id", F.floor(F.col("x") / 2).cast("int").alias("cx"), F.floor(F.col("y") / 2).cast("int").alias("cy"), F.col("idx").alias("order"), "r", "g", "b")
    return W.voted_colors(rows, palette(spark), 0.6)


@query(f"""WITH {PX}, c AS (SELECT grid_id, r, g, b, count(*)::BIGINT AS n FROM px GROUP BY ALL), s AS (SELECT *, n / greatest(1, max(n) OVER (PARTITION BY grid_id))::DOUBLE AS share, greatest(r, g, b) - least(r, g, b) AS ch, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS li FROM c)
SELECT grid_id, r, g, b, n, (ch > 70 AND share > 0.002) OR (ch > 52 AND share > 0.006) OR (li < 36 AND share > 0.003) AS feature, ch > 48 OR li < 45 AS feature_palette FROM s""")
def feature_colors(spark, sf):
    return W.feature_colors(tiles(spark, sf).groupBy("grid_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {PX}, s AS (SELECT grid_id, r, g, b, 2 * x AS place_at FROM px WHERE y = 0 AND a >= 24 UNION ALL SELECT grid_id, r, g, b, 2 * x + 1 FROM px WHERE y = 7 AND a >= 24
  UNION ALL SELECT grid_id, r, g, b, 16 + 2 * y FROM px WHERE x = 0 AND a >= 24 UNION ALL SELECT grid_id, r, g, b, 17 + 2 * y FROM px WHERE x = 7 AND a >= 24),
k AS (SELECT grid_id, floor(r / 16.0 + 0.5) AS kr, floor(g / 16.0 + 0.5) AS kg, floor(b / 16.0 + 0.5) AS kb, count(*) AS n, min(place_at) AS first, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM s GROUP BY 1, 2, 3, 4),
m AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, first) AS place FROM k)
SELECT p.grid_id, coalesce(floor(m.r / n::DOUBLE + 0.5), 255)::INT AS r, coalesce(floor(m.g / n::DOUBLE + 0.5), 255)::INT AS g, coalesce(floor(m.b / n::DOUBLE + 0.5), 255)::INT AS b
FROM (SELECT DISTINCT grid_id FROM px) p LEFT JOIN m ON m.grid_id = p.grid_id AND place = 1""")
def edge_background_color(spark, sf):
    return W.edge_color(tiles(spark, sf), 8, 8)
