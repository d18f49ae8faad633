"""Queries on images: fitting, sampling, histograms, smoothing, borders."""

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.geometry import contain_fit
from ..operators import diagnostics as D
from ..operators import sampling as S
from ..sources.tables import tiles
from .base import PX, lab, linear, query

SCALE, N = 3 / 8, 3
OVERLAP = f"""ov AS (SELECT p.*, cx.c AS cx, cy.c AS cy,
  greatest(0, least((cx.c + 1) / {SCALE}::DOUBLE, x + 1) - greatest(cx.c / {SCALE}::DOUBLE, x)) * greatest(0, least((cy.c + 1) / {SCALE}::DOUBLE, y + 1) - greatest(cy.c / {SCALE}::DOUBLE, y)) * a / 255 AS w
  FROM px p, (SELECT unnest(range(0, {N}))::INT AS c) cx, (SELECT unnest(range(0, {N}))::INT AS c) cy)"""


@query("""WITH t AS (SELECT p_partkey, (p_size + 1)::INT AS w, (p_partkey % 40 + 1)::INT AS h, (p_partkey % 17 + 1)::INT AS tw, (p_size % 23 + 1)::INT AS th FROM part)
SELECT p_partkey, w, h, tw, th, round(least(tw / w::DOUBLE, th / h::DOUBLE), 9) AS scale, round((tw - w * least(tw / w::DOUBLE, th / h::DOUBLE)) / 2, 9) + 0 AS dx, round((th - h * least(tw / w::DOUBLE, th / h::DOUBLE)) / 2, 9) + 0 AS dy FROM t""")
def contain_geometry(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    sizes = {"w": size + 1, "h": key % 40 + 1, "tw": key % 17 + 1, "th": size % 23 + 1}
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", *[c.cast("int").alias(n) for n, c in sizes.items()])
    scale, dx, dy = contain_fit(F.col("w"), F.col("h"), F.col("tw"), F.col("th"))
    return rows.select("p_partkey", "w", "h", "tw", "th", F.round(scale, 9).alias("scale"), (F.round(dx, 9) + 0).alias("dx"), (F.round(dy, 9) + 0).alias("dy"))


@query(f"""WITH {PX}, s AS (SELECT cx, cy, floor((cx + 0.5) / {SCALE}::DOUBLE)::INT AS x, floor((cy + 0.5) / {SCALE}::DOUBLE)::INT AS y FROM (SELECT unnest(range(0, {N}))::INT AS cx), (SELECT unnest(range(0, {N}))::INT AS cy))
SELECT grid_id, cx, cy, r, g, b FROM px JOIN s USING (x, y) WHERE a / 255.0 >= 0.5""")
def sample_nearest(spark, sf):
    return S.sample_nearest(tiles(spark, sf), 8, 8, N, N)


AREA = f"""{PX}, {OVERLAP}, ar AS (SELECT grid_id, cx, cy, sum(w) AS cov, sum(w * {linear('r')}) / sum(w) AS lr, sum(w * {linear('g')}) / sum(w) AS lg, sum(w * {linear('b')}) / sum(w) AS lb
  FROM ov GROUP BY 1, 2, 3 HAVING sum(w) > 0 AND sum(w) * {SCALE * SCALE} + 1e-12 >= 0.5)"""


@query(f"WITH {AREA} SELECT grid_id, cx, cy, round(least(1, cov * {SCALE * SCALE}), 6) AS coverage, round(lr, 6) AS lr, round(lg, 6) AS lg, round(lb, 6) AS lb FROM ar")
def sample_area(spark, sf):
    rows = S.sample_area(tiles(spark, sf), 8, 8, N, N)
    return rows.select("grid_id", "cx", "cy", *[F.round(c, 6).alias(c) for c in ("coverage", "lr", "lg", "lb")])


BINS = f"""{PX}, {OVERLAP}, bins AS (SELECT grid_id, cx, cy, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS key, sum(w) AS weight FROM ov WHERE w > 0 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {BINS} SELECT grid_id, cx, cy, key, round(weight, 6) AS weight FROM bins")
def color_bins(spark, sf):
    return S.color_bins(tiles(spark, sf), 8, 8, N, N).select("grid_id", "cx", "cy", "key", F.round("weight", 6).alias("weight"))


@query(f"""WITH {BINS}, r AS (SELECT *, sum(weight) OVER (PARTITION BY grid_id, cx, cy) AS total, row_number() OVER (PARTITION BY grid_id, cx, cy ORDER BY round(weight, 9) DESC, key) AS place FROM bins)
SELECT grid_id, cx, cy, (CASE WHEN place <= 3 THEN place ELSE 0 END)::INT AS rank, round(sum(weight) / max(total), 6) AS share, min(key) AS key FROM r GROUP BY 1, 2, 3, 4""")
def top_modes(spark, sf):
    modes = S.top_modes(S.color_bins(tiles(spark, sf), 8, 8, N, N))
    return modes.select("grid_id", "cx", "cy", "rank", F.round("share", 6).alias("share"), "key")


@query(f"""WITH {PX}, {lab('px', 'grid_id, idx, x, y', 'o')},
d AS (SELECT grid_id, idx, sqrt((ok_l - lead(ok_l) OVER rw) ** 2 + (ok_a - lead(ok_a) OVER rw) ** 2 + (ok_b - lead(ok_b) OVER rw) ** 2) AS rgt,
  sqrt((ok_l - lead(ok_l) OVER cl) ** 2 + (ok_a - lead(ok_a) OVER cl) ** 2 + (ok_b - lead(ok_b) OVER cl) ** 2) AS dwn FROM o
  WINDOW rw AS (PARTITION BY grid_id, y ORDER BY x), cl AS (PARTITION BY grid_id, x ORDER BY y))
SELECT grid_id, idx, round(CASE WHEN rgt > 1 THEN 1 ELSE rgt END, 6) AS right_contrast, round(CASE WHEN dwn > 1 THEN 1 ELSE dwn END, 6) AS down_contrast FROM d""")
def pair_contrast(spark, sf):
    rows = S.pair_contrast(C.with_oklab(tiles(spark, sf)), 8)
    clean = lambda c, has: F.when(has, F.round(c, 6))
    return rows.select("grid_id", "idx", clean("right", F.col("x") < 7).alias("right_contrast"), clean("down", F.col("y") < 7).alias("down_contrast"))


@query(f"""WITH {PX}, l AS (SELECT *, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM px),
w AS (SELECT c.grid_id, c.x, c.y, n.lr, n.lg, n.lb, n.a / 255.0::DOUBLE * exp(-0.5 * ((n.x - c.x) ** 2 + (n.y - c.y) ** 2) - ((c.lr - n.lr) ** 2 + (c.lg - n.lg) ** 2 + (c.lb - n.lb) ** 2) / 0.02) AS w
  FROM l c JOIN l n ON c.grid_id = n.grid_id AND abs(c.x - n.x) <= 1 AND abs(c.y - n.y) <= 1 WHERE c.a > 0 AND n.a > 0),
m AS (SELECT grid_id, x, y, sum(w * lr) / sum(w) AS lr, sum(w * lg) / sum(w) AS lg, sum(w * lb) / sum(w) AS lb FROM w GROUP BY 1, 2, 3),
s AS (SELECT grid_id, x, y, {', '.join(f"floor(least(1, greatest(0, CASE WHEN l{c} <= 0.0031308 THEN l{c} * 12.92 ELSE 1.055 * pow(l{c}, 1 / 2.4::DOUBLE) - 0.055 END)) * 255 + 0.5)::INT AS {c}" for c in 'rgb')} FROM m)
SELECT p.grid_id, p.x, p.y, coalesce(s.r, p.r) AS r, coalesce(s.g, p.g) AS g, coalesce(s.b, p.b) AS b, p.a FROM px p LEFT JOIN s USING (grid_id, x, y)""")
def bilateral(spark, sf):
    return S.bilateral(tiles(spark, sf))


@query(f"WITH {PX} SELECT grid_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, count(*)::BIGINT AS n FROM px WHERE v >= 150 GROUP BY 1")
def crop_bounds(spark, sf):
    return S.bounds(tiles(spark, sf), F.col("v") >= 150)


@query(f"""WITH {PX}, q AS (SELECT grid_id, x, y, v < 130 AND a = 0 OR v >= 190 AS margin FROM px)
SELECT grid_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, (64 - (max(x) + 1 - min(x)) * (max(y) + 1 - min(y)))::BIGINT AS trimmed FROM q WHERE NOT margin GROUP BY 1""")
def white_border(spark, sf):
    margin = ((F.col("v") < 130) & (F.col("a") == 0)) | (F.col("v") >= 190)
    rows = S.bounds(tiles(spark, sf), ~margin)
    return rows.select("grid_id", "l", "t", "r", "b", (64 - (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).cast("long").alias("trimmed"))


@query(f"""WITH {PX}, e AS (SELECT grid_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS key, count(*) AS n, min(idx) AS fst, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM px WHERE a >= 128 AND (x IN (0, 7) OR y IN (0, 7)) GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY grid_id) AS opaque, row_number() OVER (PARTITION BY grid_id ORDER BY n DESC, fst) AS place FROM e)
SELECT grid_id, floor(r / n::DOUBLE + 0.5)::INT AS r, floor(g / n::DOUBLE + 0.5)::INT AS g, floor(b / n::DOUBLE + 0.5)::INT AS b FROM k WHERE place = 1 AND opaque * 2 >= 28 AND n * 4 >= opaque""")
def modal_background(spark, sf):
    return S.modal_background(tiles(spark, sf), 8, 8)


@query(f"""WITH RECURSIVE {PX}, c AS (SELECT grid_id, idx, x, y FROM px WHERE a = 0 OR v BETWEEN 96 AND 110),
f AS (SELECT * FROM c WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT n.* FROM f JOIN c n ON n.grid_id = f.grid_id AND abs(n.x - f.x) + abs(n.y - f.y) = 1)
SELECT grid_id, idx FROM f""")
def background_flood(spark, sf):
    px = tiles(spark, sf)
    return D.edge_background(px, (F.col("a") == 0) | F.col("v").between(96, 110), 8, 8)
