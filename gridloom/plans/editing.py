"""Queries on edits, precedence, masks, selections and reviews."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import diagnostics as D
from ..operators import layers as L
from ..operators import match as M
from ..operators import pages as P
from ..sources.tables import layer_cells, palette, part_colors, tile_cells, tiles
from .base import BOTH, CELLS, LAYERS, PAL, PC, PX, lab, query, redmean
from .colors import pairs, rgb

HSL = """{n}_h AS (SELECT id, r, g, b, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM {src}),
{n} AS (SELECT id, r, g, b, 60 * CASE WHEN hi = lo THEN 0 WHEN hi = rr THEN fmod(fmod((gg - bb) / (hi - lo), 6) + 6, 6) WHEN hi = gg THEN (bb - rr) / (hi - lo) + 2 ELSE (rr - gg) / (hi - lo) + 4 END AS hue,
  CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END AS sat, (hi + lo) / 2 AS light FROM {n}_h)"""
#: The same with six added to negative turns only, as ``rgb_to_hsl`` does: adding it to all costs digits that decide where a channel lies half-way.
HSL_ONCE = HSL.replace("fmod(fmod((gg - bb) / (hi - lo), 6) + 6, 6)", "(gg - bb) / (hi - lo) + CASE WHEN gg < bb THEN 6 ELSE 0 END")
BYTE = "greatest(0, least(255, floor({} + 0.5)))::INT"
FACTOR = 259 * (20 * 2.55 + 255) / (255 * (259 - 20 * 2.55))


def _channel(n: int) -> str:
    k = f"fmod({n} + hue / 30, 12)"
    return BYTE.format(f"255 * (light - sat * least(light, 1 - light) * greatest(-1, least({k} - 3, 9 - {k}, 1)))")


@query(f"""WITH {PAL}, {PC}, w AS (SELECT id, {BYTE.format('r + 1.35 * 12::DOUBLE')} AS r, {BYTE.format('g + 0.28 * 12::DOUBLE')} AS g, {BYTE.format('b - 1.35 * 12::DOUBLE')} AS b FROM pc),
c AS (SELECT id, {', '.join(BYTE.format(f'{FACTOR}::DOUBLE * ({x} - 128) + 128 + 10 * 2.55::DOUBLE') + ' AS ' + x for x in 'rgb')} FROM w), {HSL_ONCE.format(n='h', src='c')},
t AS (SELECT id, fmod(hue + 40, 360) AS hue, least(1, sat * 1.25) AS sat, light FROM h), o AS (SELECT id, {_channel(0)} AS r, {_channel(8)} AS g, {_channel(4)} AS b FROM t)
SELECT p.id, p.r, p.g, p.b, arg_min(q.id, ({redmean('p', 'q')}, q.pos)) AS color FROM o p, pal q GROUP BY 1, 2, 3, 4""")
def adjust_colors(spark, sf):
    rows = C.adjust(part_colors(spark, sf).select("id", "r", "g", "b"), 12, 20, 10, 40, 25)
    return M.nearest_redmean(rows, palette(spark), *rgb()).select("id", "r", "g", "b", "color")


def _close_sql(level: int) -> str:
    pick = lambda *v: v[level - 1]
    y = lambda t: f"(0.299::DOUBLE * {t}.r + 0.587::DOUBLE * {t}.g + 0.114::DOUBLE * {t}.b)"
    ch = lambda t: f"(greatest({t}.r, {t}.g, {t}.b) - least({t}.r, {t}.g, {t}.b))"
    return f"""z AS (SELECT p.id AS p_id, q.id AS q_id, {redmean('p', 'q')} AS d, {ch('p')} AS cp, {ch('q')} AS cq, abs({y('p')} - {y('q')}) AS gap, least(abs(p.hue - q.hue), 360 - abs(p.hue - q.hue)) AS turn FROM h p, h q WHERE p.id LIKE 'p%' AND q.id LIKE 'c%'),
v AS (SELECT *, cp > 72 OR cq > 72 AS vivid, CASE WHEN cp > 72 OR cq > 72 THEN {pick(34, 50, 66, 82)} ELSE {pick(44, 64, 84, 104)} END AS lim FROM z)
SELECT p_id, q_id FROM v WHERE CASE WHEN cp < 34 AND cq < 34 THEN d <= {pick(48, 68, 88, 108)} AND gap <= {pick(30, 44, 60, 76)}
  ELSE (NOT vivid OR turn <= {pick(12, 18, 28, 38)}) AND abs(cp - cq) <= {pick(30, 44, 60, 76)} AND gap <= {pick(34, 50, 68, 84)} AND (d <= lim OR turn <= {pick(14, 24, 36, 48)} AND d <= lim * 1.18::DOUBLE) END"""


@query(f"WITH {BOTH}, {HSL.format(n='h', src='pp')}, {_close_sql(4)}")
def merge_candidates(spark, sf):
    p, q = (df.select(*[F.col(c).alias(k + c) for c in ("id", "r", "g", "b")]) for k, df in (("p_", D.spread(part_colors(spark, sf), "id")), ("q_", palette(spark))))
    p, q = C.with_traits(p, "p_"), C.with_traits(q, "q_")
    traits = [tuple(F.col(k + c) for c in ("hue", "chroma", "luma")) for k in ("p_", "q_")]
    return p.crossJoin(F.broadcast(q)).where(C.close_for_merge(rgb("p_"), rgb("q_"), 4, *traits)).select("p_id", "q_id")


@query(f"WITH {PX} SELECT grid_id, x - 2 AS x, y - 1 AS y, (y - 1) * 5 + x - 2 AS idx, v FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 5")
def crop_renumber(spark, sf):
    rows = tiles(spark, sf).where("x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 5").select("grid_id", (F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), "v")
    return rows.select("grid_id", "x", "y", (F.col("y") * 5 + F.col("x")).alias("idx"), "v")


@query(f"WITH {PX}, {PAL}, ok AS (SELECT * FROM pal WHERE id IN ('c00', 'c01', 'c07', 'c12')), {lab('px', 'grid_id, idx', 'o')}, {lab('ok', 'id', 'q')} SELECT grid_id, idx, arg_min(q.id, ((o.ok_l - q.ok_l) ** 2 + (o.ok_a - q.ok_a) ** 2 + (o.ok_b - q.ok_b) ** 2, q.id)) AS color FROM o, q GROUP BY 1, 2")
def allowed_colors(spark, sf):
    allowed = spark.createDataFrame([("c00",), ("c01",), ("c07",), ("c12",), ("zz",)], "id string")
    return M.nearest_oklab(C.with_oklab(tiles(spark, sf)), palette(spark).join(allowed, "id", "left_semi")).select("grid_id", "idx", "color")


@query(f"""WITH {PAL}, u AS (SELECT p_brand AS code, count(*)::BIGINT AS n FROM part GROUP BY 1), s AS (SELECT 'BRAND#1' || (pos % 5 + 1) AS code, r, g, b FROM pal WHERE pos < 5), i AS (SELECT 'Brand#' || (pos % 3 + 1) || (pos % 5 + 1) AS code, r, g, b FROM pal WHERE pos < 15)
SELECT u.code, n, coalesce(s.r, i.r) AS r, coalesce(s.g, i.g) AS g, coalesce(s.b, i.b) AS b FROM u LEFT JOIN s ON lower(u.code) = lower(s.code) LEFT JOIN i ON lower(u.code) = lower(i.code)""")
def color_precedence(spark, sf):
    usage = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    pal = palette(spark)
    saved = pal.where("pos < 5").select(F.concat(F.lit("brand#1"), (F.col("pos") % 5 + 1).cast("string")).alias("k"), *[F.col(c).alias("s" + c) for c in "rgb"])
    known = pal.where("pos < 15").select(F.concat(F.lit("brand#"), (F.col("pos") % 3 + 1).cast("string"), (F.col("pos") % 5 + 1).cast("string")).alias("k"), *[F.col(c).alias("i" + c) for c in "rgb"])
    rows = usage.withColumn("k", F.lower("code")).join(F.broadcast(saved), "k", "left").join(F.broadcast(known), "k", "left")
    return rows.select("code", "n", *[F.coalesce("s" + c, "i" + c).alias(c) for c in "rgb"])


@query(f"WITH {CELLS} SELECT color, count(*)::BIGINT AS n FROM cells WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 5 AND color IS NOT NULL GROUP BY 1")
def selection_histogram(spark, sf):
    return tile_cells(spark, sf).where("x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 5 AND color IS NOT NULL").groupBy("color").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, sha256('42:' || c_custkey) AS order_key FROM customer")
def seeded_order(spark, sf):
    """The key of a seeded permutation; sorting by it is left to the reader, so that no task has to hold all rows."""
    key = F.sha2(F.concat(F.lit("42:"), F.col("c_custkey").cast("string")).cast("binary"), 256)
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", key.alias("order_key"))


@query("SELECT l_orderkey AS cell, l_suppkey % 5 AS id, max(l_quantity * (1 - l_discount)) AS strength, arg_max(l_partkey, (l_quantity * (1 - l_discount), l_partkey)) AS source FROM lineitem GROUP BY 1, 2")
def strongest_evidence(spark, sf):
    s = F.col("l_quantity") * (1 - F.col("l_discount"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_suppkey") % 5).alias("id")).agg(F.max(s).alias("strength"), F.max_by("l_partkey", F.struct(s.alias("s"), "l_partkey")).alias("source"))


@query(f"WITH {CELLS} SELECT grid_id, idx FROM cells WHERE color IS NOT NULL INTERSECT SELECT grid_id, idx FROM px WHERE v >= 120 EXCEPT SELECT grid_id, idx FROM cells WHERE (x + y) % 3 = 0")
def writable_cells(spark, sf):
    cells = tile_cells(spark, sf)
    return cells.where("color IS NOT NULL").select("grid_id", "idx").intersect(tiles(spark, sf).where("v >= 120").select("grid_id", "idx")).exceptAll(cells.where("(x + y) % 3 = 0").select("grid_id", "idx"))


@query(f"WITH {PX}, d AS (SELECT DISTINCT grid_id, idx, idx - row_number() OVER (PARTITION BY grid_id ORDER BY idx) AS k FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3) SELECT grid_id, min(idx) AS start, count(*)::BIGINT AS length FROM d GROUP BY grid_id, k")
def rectangle_runs(spark, sf):
    return P.runs(tiles(spark, sf).where("x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3"), "grid_id", "idx")


# A brush of radius 1.6 drawn from (1, 1) to (6, 4): distance from a point to the segment.
SEGMENT = "greatest(0, least(1, ((x - 1) * 5 + (y - 1) * 3) / 34.0::DOUBLE))"


@query(f"WITH {PX} SELECT grid_id, idx FROM px WHERE sqrt((x - 1 - 5 * {SEGMENT}) ** 2 + (y - 1 - 3 * {SEGMENT}) ** 2) <= 1.6")
def mask_brush(spark, sf):
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - 1) * 5 + (F.col("y") - 1) * 3) / 34))
    far = F.hypot(F.col("x") - 1 - 5 * t, F.col("y") - 1 - 3 * t)
    return tiles(spark, sf).where(far <= 1.6).select("grid_id", "idx")


@query(f"""WITH {LAYERS} SELECT cell, z, color, false AS visible FROM layers UNION ALL SELECT cell, 100, arg_max(color, z), true FROM layers WHERE color IS NOT NULL GROUP BY cell""")
def accept_candidate(spark, sf):
    old = layer_cells(spark, sf)
    new = old.where("color IS NOT NULL").groupBy("cell").agg(F.max_by("color", "z").alias("color"))
    return old.select("cell", "z", "color", F.lit(False).alias("visible")).unionByName(new.select("cell", F.lit(100).alias("z"), "color", F.lit(True).alias("visible")))


@query(f"WITH {LAYERS} SELECT cell, arg_max(color, CASE z WHEN 3 THEN 6 WHEN 6 THEN 3 ELSE z END) AS color FROM layers WHERE visible AND opacity > 0 AND color IS NOT NULL GROUP BY 1")
def layer_reorder(spark, sf):
    moved = layer_cells(spark, sf).withColumn("z", F.when(F.col("z") == 3, 6).when(F.col("z") == 6, 3).otherwise(F.col("z")))
    return L.composite(moved)


@query(f"""WITH {PAL}, {PC}, c AS (SELECT p.id AS p_id, q.id AS q_id, {redmean('p', 'q')} AS d FROM pc p, pal q), b AS (SELECT p_id, min(d) AS nearest FROM c GROUP BY 1),
w AS (SELECT p.id AS q_id, {redmean('p', 'q')} AS d FROM pal p, pal q WHERE q.id = 'c01')
SELECT c.p_id, c.q_id, round(c.d, 6) AS d FROM c JOIN b ON b.p_id = c.p_id JOIN w ON w.q_id = c.q_id WHERE c.d <= greatest(60, nearest + 20) AND c.d < 0.75 * w.d""")
def acceptable_colors(spark, sf):
    """Palette colours close enough to a part's, and clearly closer to it than to the background."""
    d = pairs(spark, sf).select("p_id", "q_id", C.redmean(rgb("p_"), rgb("q_")).alias("d"))
    near = d.withColumn("nearest", F.min("d").over(Window.partitionBy("p_id")))
    white = palette(spark).where("id = 'c01'").select(*[F.col(c).alias("w_" + c) for c in "rgb"])
    back = palette(spark).crossJoin(F.broadcast(white)).select(F.col("id").alias("q_id"), C.redmean(rgb(), rgb("w_")).alias("back"))
    ok = near.join(F.broadcast(back), "q_id").where((F.col("d") <= F.greatest(F.lit(60.0), F.col("nearest") + 20)) & (F.col("d") < 0.75 * F.col("back")))
    return ok.select("p_id", "q_id", F.round("d", 6).alias("d"))


@query("""WITH k AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'left' ELSE 'right' END AS first_side FROM documents),
r AS (SELECT doc_id, CASE quality + 2 * toxic WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'tie' ELSE 'neither' END AS choice FROM labels),
b AS (SELECT source, CASE WHEN choice IN ('tie', 'neither') THEN choice WHEN choice = first_side THEN 'first' ELSE 'second' END AS bucket FROM r JOIN k USING (doc_id))
SELECT source, count(*) FILTER (bucket = 'first')::BIGINT AS first, count(*) FILTER (bucket = 'second')::BIGINT AS second, count(*) FILTER (bucket = 'tie')::BIGINT AS tie, count(*) FILTER (bucket = 'neither')::BIGINT AS neither FROM b GROUP BY 1""")
def review_pivot(spark, sf):
    key = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.lit("left")).otherwise(F.lit("right")).alias("first_side"))
    code = F.col("quality") + 2 * F.col("toxic")
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.when(code == 0, "left").when(code == 1, "right").when(code == 2, "tie").otherwise("neither").alias("choice"))
    bucket = F.when(F.col("choice").isin("tie", "neither"), F.col("choice")).when(F.col("choice") == F.col("first_side"), "first").otherwise("second")
    out = rows.join(key, "doc_id").withColumn("bucket", bucket).groupBy("source").pivot("bucket", ["first", "second", "tie", "neither"]).count()
    return out.na.fill(0)
