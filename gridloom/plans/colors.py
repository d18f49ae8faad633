"""Queries on colours: conversions, matching, effects, bills of materials."""

from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import layers as L
from ..operators import match as M
from ..sources.tables import palette, part_colors, tiles
from .base import BOTH, PAL, PC, PX, lab, linear, query, redmean

OK_SQL = "round(ok_l, 6) AS ok_l, round(ok_a, 6) AS ok_a, round(ok_b, 6) AS ok_b"


def rgb(prefix=""):
    return tuple(F.col(prefix + c) for c in "rgb")


def rounded(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


def pairs(spark, sf):
    """Each part's colour with each colour of the palette, whose size is bounded."""
    p, q = (df.select(*[F.col(c).alias(k + c) for c in ("id", "r", "g", "b")]) for k, df in (("p_", part_colors(spark, sf)), ("q_", palette(spark))))
    return p.crossJoin(F.broadcast(q))


@query(f"WITH {PX} SELECT grid_id, idx, x, y, r, g, b, a FROM px")
def tile_pixels(spark, sf):
    return tiles(spark, sf).select("grid_id", "idx", "x", "y", "r", "g", "b", "a")


@query(f"WITH {PX}, {lab('px', 'grid_id, idx', 'o')} SELECT grid_id, idx, {OK_SQL} FROM o")
def srgb_oklab(spark, sf):
    return C.with_oklab(tiles(spark, sf)).select("grid_id", "idx", *rounded(*C.OK))


@query(f"WITH {PX} SELECT grid_id, idx, r, g, b FROM px")
def oklab_round_trip(spark, sf):
    back = C.oklab_to_linear(tuple(F.col(c) for c in C.OK))
    rows = C.with_oklab(tiles(spark, sf)).select("grid_id", "idx", *[c.alias(f"l{n}") for c, n in zip(back, "rgb", strict=True)])
    return rows.select("grid_id", "idx", *[C.linear_to_byte(F.col(f"l{c}")).alias(c) for c in "rgb"])


CIE = """f AS (SELECT id, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x, 0.2126729 * lr + 0.7151522 * lg + 0.072175 * lb AS y,
  (0.0193339 * lr + 0.119192 * lg + 0.9503041 * lb) / 1.08883 AS z FROM lin),
h AS (SELECT id, CASE WHEN x > 216.0 / 24389 THEN cbrt(x) ELSE (24389.0::DOUBLE / 27 * x + 16) / 116 END AS x, CASE WHEN y > 216.0 / 24389 THEN cbrt(y) ELSE (24389.0::DOUBLE / 27 * y + 16) / 116 END AS y,
  CASE WHEN z > 216.0 / 24389 THEN cbrt(z) ELSE (24389.0::DOUBLE / 27 * z + 16) / 116 END AS z FROM f),
cie AS (SELECT id, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM h)"""
CIE_BOTH = f"{BOTH}, lin AS (SELECT id, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM pp), {CIE}"


def cie_colors(colors):
    lin = colors.select("id", *[C.byte_to_linear(F.col(c)).alias(f"l{c}") for c in "rgb"])
    l, a, b = C.cie_lab((F.col("lr"), F.col("lg"), F.col("lb")))
    return lin.select("id", l.alias("l"), a.alias("a"), b.alias("b"))


@query(f"WITH {CIE_BOTH} SELECT id, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM cie")
def cie_lab(spark, sf):
    return cie_colors(part_colors(spark, sf).unionByName(palette(spark).select("id", "r", "g", "b"))).select("id", *rounded("l", "a", "b"))


@query(f"""WITH {CIE_BOTH},
u AS (SELECT p.id AS p_id, q.id AS q_id, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2, pow((sqrt(p.a * p.a + p.b * p.b) + sqrt(q.a * q.a + q.b * q.b)) / 2, 7) AS m7 FROM cie p, cie q WHERE p.id LIKE 'p%' AND q.id LIKE 'c%'),
v AS (SELECT *, 1 + 0.5 * (1 - sqrt(m7 / (m7 + pow(25.0::DOUBLE, 7)))) AS s FROM u),
w AS (SELECT *, sqrt(s * a1 * s * a1 + b1 * b1) AS c1, sqrt(s * a2 * s * a2 + b2 * b2) AS c2 FROM v),
hh AS (SELECT *, CASE WHEN c1 = 0 THEN 0 ELSE fmod(degrees(atan2(b1, s * a1)) + 360, 360) END AS h1, CASE WHEN c2 = 0 THEN 0 ELSE fmod(degrees(atan2(b2, s * a2)) + 360, 360) END AS h2 FROM w),
k AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS turn,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm,
  (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm FROM hh),
t AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) AS t FROM k),
z AS (SELECT *, (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / sqrt(20 + (lm - 50) ** 2)) AS dl, (c2 - c1) / (1 + 0.045 * cm) AS dc,
  2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015 * cm * t) AS dh,
  -2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::DOUBLE, 7))) * sin(radians(60 * exp(-(((hm - 275) / 25) ** 2)))) AS rt FROM t)
SELECT p_id, q_id, round(sqrt(greatest(0, dl * dl + dc * dc + dh * dh + rt * dc * dh)), 5) AS de FROM z""")
def delta_e2000(spark, sf):
    p, q = (cie_colors(df).select(*[F.col(c).alias(k + c) for c in ("id", *"lab")]) for k, df in (("p_", part_colors(spark, sf)), ("q_", palette(spark))))
    de = C.delta_e2000(*[tuple(F.col(k + c) for c in "lab") for k in ("p_", "q_")])
    return p.crossJoin(F.broadcast(q)).select("p_id", "q_id", F.round(de, 5).alias("de"))


@query(f"WITH {PAL}, {PC} SELECT p.id AS p_id, q.id AS q_id, round({redmean('p', 'q')}, 6) AS d FROM pc p, pal q")
def redmean_distance(spark, sf):
    return pairs(spark, sf).select("p_id", "q_id", F.round(C.redmean(rgb("p_"), rgb("q_")), 6).alias("d"))


NEAREST = f"""{PX}, {PAL}, {lab('px', 'grid_id, idx, a', 'o')}, {lab('pal', 'id', 'q')},
near AS (SELECT grid_id, idx, a, arg_min(q.id, ((o.ok_l - q.ok_l) ** 2 + (o.ok_a - q.ok_a) ** 2 + (o.ok_b - q.ok_b) ** 2, q.id)) AS color FROM o, q GROUP BY 1, 2, 3)"""


def nearest(spark, sf):
    return M.nearest_oklab(C.with_oklab(tiles(spark, sf)), palette(spark)).select("grid_id", "idx", "a", "color")


@query(f"WITH {NEAREST} SELECT grid_id, idx, color FROM near")
def nearest_color(spark, sf):
    return nearest(spark, sf).select("grid_id", "idx", "color")


@query(f"""WITH {PX}, {PAL}, d AS (SELECT DISTINCT r, g, b FROM px), {lab('d', 'r, g, b', 'o')}, {lab('pal', 'id', 'q')},
s AS (SELECT r, g, b, q.id, sqrt((o.ok_l - q.ok_l) ** 2 + (o.ok_a - q.ok_a) ** 2 + (o.ok_b - q.ok_b) ** 2) AS d FROM o, q),
k AS (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d, id) AS rank FROM s)
SELECT r, g, b, rank::INT AS rank, id AS color, round(d, 6) AS distance FROM k WHERE rank <= 5""")
def topk_colors(spark, sf):
    distinct = C.with_oklab(tiles(spark, sf).select("r", "g", "b").distinct())
    return M.top_k(distinct, palette(spark), 5).select("r", "g", "b", "rank", "color", F.round("distance", 6).alias("distance"))


@query(f"""WITH {PX}, {PAL} SELECT grid_id, idx, arg_min(q.id, ({redmean('p', 'q')}, q.pos)) AS color FROM px p, pal q GROUP BY 1, 2""")
def nearest_redmean(spark, sf):
    return M.nearest_redmean(tiles(spark, sf), palette(spark), *rgb()).select("grid_id", "idx", "color")


@query(f"""WITH {NEAREST} SELECT n.color, p.code, count(*)::BIGINT AS n, ceil(count(*) / 500.0)::BIGINT AS packs FROM near n JOIN pal p ON n.color = p.id WHERE n.a > 0 GROUP BY 1, 2""")
def bom(spark, sf):
    cells = nearest(spark, sf).where("a > 0")
    return L.usage(cells, palette(spark).select(F.col("id").alias("color")), 500).join(F.broadcast(palette(spark).select(F.col("id").alias("color"), "code")), "color").select("color", "code", "n", "packs")


def effects():
    """The colour each effect makes of r, g, b."""
    y = C.luma(rgb())
    grey = C.clamp_byte(y)
    bw = F.when(y >= 150, 255).otherwise(0)
    return {"invert": tuple(255 - c for c in rgb()), "grayscale": (grey,) * 3, "black-white": (bw,) * 3}


EFFECTS_SQL = """e AS (SELECT id, 'invert' AS effect, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM pc
  UNION ALL SELECT id, 'grayscale', y, y, y FROM (SELECT id, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5)::INT AS y FROM pc)
  UNION ALL SELECT id, 'black-white', y, y, y FROM (SELECT id, CASE WHEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b >= 150 THEN 255 ELSE 0 END AS y FROM pc))"""


@query(f"WITH {PAL}, {PC}, {EFFECTS_SQL} SELECT p.effect, p.id, arg_min(q.id, ({redmean('p', 'q')}, q.pos)) AS color FROM e p, pal q GROUP BY 1, 2")
def effect_colors(spark, sf):
    rows = None
    for name, out in effects().items():
        part = part_colors(spark, sf).select("id", F.lit(name).alias("effect"), *[c.alias(n) for c, n in zip(out, "rgb", strict=True)])
        rows = part if rows is None else rows.unionByName(part)
    return M.nearest_redmean(rows, palette(spark), *rgb()).select("effect", "id", "color")


HSL_SQL = """c AS (SELECT DISTINCT r, g, b, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM px),
h AS (SELECT r, g, b, 60 * CASE WHEN hi = lo THEN 0 WHEN hi = rr THEN fmod(fmod((gg - bb) / (hi - lo), 6) + 6, 6) WHEN hi = gg THEN (bb - rr) / (hi - lo) + 2 ELSE (rr - gg) / (hi - lo) + 4 END AS hue,
  CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END AS sat, (hi + lo) / 2 AS light FROM c)"""


@query(f"WITH {PX}, {HSL_SQL} SELECT r, g, b, round(hue, 5) AS hue, round(sat, 5) AS sat, round(light, 5) AS light FROM h")
def rgb_hsl(spark, sf):
    hue, sat, light = C.rgb_to_hsl(rgb())
    return tiles(spark, sf).select("r", "g", "b").distinct().select("r", "g", "b", F.round(hue, 5).alias("hue"), F.round(sat, 5).alias("sat"), F.round(light, 5).alias("light"))


@query(f"""WITH {PX}, d AS (SELECT DISTINCT r, g, b, greatest(r, g, b) - least(r, g, b) <= 14 AS grey FROM px)
SELECT r, g, b, greatest(0, least(255, floor((CASE WHEN grey THEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b ELSE r END) / 9 + 0.5) * 9))::INT AS sr,
  greatest(0, least(255, floor((CASE WHEN grey THEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b ELSE g END) / 9 + 0.5) * 9))::INT AS sg,
  greatest(0, least(255, floor((CASE WHEN grey THEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b ELSE b END) / 9 + 0.5) * 9))::INT AS sb FROM d""")
def simplify_rgb(spark, sf):
    out = C.simplify(rgb(), 2)
    return tiles(spark, sf).select("r", "g", "b").distinct().select("r", "g", "b", *[c.alias("s" + n) for c, n in zip(out, "rgb", strict=True)])


CLASSES = ("dark", "light", "neutral", "brown", "pink", *C.HUES)


def _class_sql(name: str) -> str:
    if name == "dark":
        return "hi < 0.48"
    if name == "light":
        return "lo > 0.64 AND hi - lo < 0.22"
    if name == "neutral":
        return "hi - lo < 0.13 AND hi BETWEEN 0.25 AND 0.85"
    vivid = "hi - lo >= 0.12 AND hi >= 0.18"
    if name == "brown":
        return f"{vivid} AND hue >= 5 AND hue < 65 AND hi < 0.7"
    if name == "pink":
        return f"{vivid} AND (hue >= 310 OR hue < 15) AND lo > 0.25"
    a, z = C.HUES[name]
    return f"{vivid} AND (hue >= {a} {'OR' if a > z else 'AND'} hue < {z})"


@query(f"""WITH {PX}, c AS (SELECT DISTINCT r, g, b, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM px),
h AS (SELECT *, fmod(CASE WHEN hi = lo THEN 0 WHEN hi = rr THEN (gg - bb) / (hi - lo) WHEN hi = gg THEN (bb - rr) / (hi - lo) + 2 ELSE (rr - gg) / (hi - lo) + 4 END * 60 + 360, 360) AS hue FROM c)
SELECT r, g, b, array_to_string(list_filter([{', '.join(f"CASE WHEN {_class_sql(n)} THEN '{n}' END" for n in CLASSES)}], lambda x: x IS NOT NULL), ',') AS classes FROM h""")
def color_classes(spark, sf):
    names = F.concat_ws(",", *[F.when(C.in_class(rgb(), n), F.lit(n)) for n in CLASSES])
    return tiles(spark, sf).select("r", "g", "b").distinct().select("r", "g", "b", names.alias("classes"))


@query(f"""WITH {PX} SELECT grid_id, count(*)::BIGINT AS n FROM px WHERE a < 24 OR sqrt((r - 120) ** 2 + (g - 130) ** 2 + (b - 90) ** 2) <= 60 GROUP BY 1""")
def background_samples(spark, sf):
    near = F.sqrt((F.col("r") - 120) ** 2 + (F.col("g") - 130) ** 2 + (F.col("b") - 90) ** 2) <= 60
    return tiles(spark, sf).where((F.col("a") < 24) | near).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PC} SELECT id, CASE WHEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b < 130 THEN '#ffffff' ELSE '#111111' END AS ink, printf('#%02X%02X%02X', r, g, b) AS hex FROM pc")
def readable_text(spark, sf):
    return part_colors(spark, sf).select("id", F.when(C.luma(rgb()) < 130, F.lit("#ffffff")).otherwise(F.lit("#111111")).alias("ink"), C.hex_color(rgb()).alias("hex"))


def _similar_sql() -> str:
    y = lambda t: f"(0.299::DOUBLE * {t}.r + 0.587::DOUBLE * {t}.g + 0.114::DOUBLE * {t}.b)"
    ch = lambda t: f"(greatest({t}.r, {t}.g, {t}.b) - least({t}.r, {t}.g, {t}.b))"
    return f"""SELECT p_id, q_id FROM (SELECT p.id AS p_id, q.id AS q_id, {redmean('p', 'q')} AS d, {ch('p')} AS cp, {ch('q')} AS cq, {y('p')} AS lp, {y('q')} AS lq FROM pc p, pal q)
WHERE d <= 84 * (CASE WHEN (lp < 84 AND lq < 84) OR (lp > 188 AND lq > 188 AND cp < 46 AND cq < 46) OR (lp > 96 AND lq > 96 AND cp < 82 AND cq < 82) THEN 1.15::DOUBLE ELSE 1 END)
  * (CASE WHEN cp > 78 OR cq > 78 THEN 0.7::DOUBLE ELSE 1 END) * (CASE WHEN abs(cp - cq) > 56 THEN 0.58::DOUBLE ELSE 1 END) * (CASE WHEN abs(lp - lq) > 86 AND NOT (lp < 84 AND lq < 84) THEN 0.55::DOUBLE ELSE 1 END)"""


@query(f"WITH {PAL}, {PC} {_similar_sql()}")
def similar_pairs(spark, sf):
    return pairs(spark, sf).where(C.similar(rgb("p_"), rgb("q_"), 4)).select("p_id", "q_id")


@query(f"""WITH {PX}, {PAL}, n AS (SELECT grid_id, idx, arg_min(q.id, ({redmean('p', 'q')}, q.pos)) AS id FROM px p, pal q WHERE a > 0 GROUP BY 1, 2),
c AS (SELECT id, count(*) AS n, sum(count(*)) OVER () AS total FROM n GROUP BY 1),
s AS (SELECT id, c.n, c.n / total::DOUBLE AS share, greatest(r, g, b) - least(r, g, b) AS ch, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM c JOIN pal USING (id))
SELECT id, n::BIGINT AS n, round(n * (CASE WHEN ch > 48 THEN 2.25::DOUBLE WHEN ch > 28 THEN 1.4::DOUBLE ELSE 1 END) * (CASE WHEN ch > 58 AND share < 0.018 THEN 2.45::DOUBLE ELSE 1 END)
  * (CASE WHEN y < 48 THEN 1.55::DOUBLE ELSE 1 END) * (CASE WHEN y > 210 AND ch < 22 THEN 0.82::DOUBLE ELSE 1 END), 6) AS score FROM s""")
def palette_ranking(spark, sf):
    counts = M.nearest_redmean(tiles(spark, sf).where("a > 0"), palette(spark), *rgb(), out="id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total)).join(F.broadcast(palette(spark)), "id")
    share, ch, y = F.col("n") / F.col("total"), C.chroma(rgb()), C.luma(rgb())
    one = F.lit(1.0)
    score = F.col("n") * F.when(ch > 48, 2.25).when(ch > 28, 1.4).otherwise(one) * F.when((ch > 58) & (share < 0.018), 2.45).otherwise(one)
    score = score * F.when(y < 48, 1.55).otherwise(one) * F.when((y > 210) & (ch < 22), 0.82).otherwise(one)
    return rows.select("id", "n", F.round(score, 6).alias("score"))
