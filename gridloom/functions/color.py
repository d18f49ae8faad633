"""Colour expressions as Columns: transfer curves, OKLab, CIE Lab, CIEDE2000, redmean, HSL. Doubles throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]

#: Published constants of the OKLab definition. Fixed values.
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
LMS_INVERSE = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
RGB_INVERSE = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
#: Names of the OKLab columns.
OK = ("ok_l", "ok_a", "ok_b")
#: Limits by level 0 to 4. Fixed values.
QUANTISE_STEP = (1, 5, 9, 14, 20)
QUANTISE_GREY = (0, 8, 14, 20, 28)
SIMILAR_DISTANCE = (0, 26, 42, 62, 84)
#: Limits of merges in an editor by level 1 to 4: of greys, then of vivid and other colours. Fixed values.
GREY_DISTANCE = (48, 68, 88, 108)
GREY_LUMA = (30, 44, 60, 76)
VIVID_HUE = (12, 18, 28, 38)
CHROMA_GAP = (30, 44, 60, 76)
LUMA_GAP = (34, 50, 68, 84)
VIVID_DISTANCE = (34, 50, 66, 82)
OTHER_DISTANCE = (44, 64, 84, 104)
NEAR_HUE = (14, 24, 36, 48)
#: sRGB to XYZ rows divided by the D65 white. Fixed values.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def half_up(c: Column) -> Column:
    """Rounding of .5 towards positive infinity."""
    return F.floor(c + 0.5)


def clamp_byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), half_up(c))).cast("int")


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def _linear(v: int) -> float:
    x = v / 255
    return x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4


#: The 256 values as one SQL constant, so that building a plan takes one call for each use.
_LINEAR_ARRAY = f"array({', '.join(f'{_linear(v)!r}D' for v in range(256))})"


def byte_to_linear(c: Column) -> Column:
    """A lookup in 256 constants instead of a power per pixel."""
    return F.element_at(F.expr(_LINEAR_ARRAY), c + 1)


def linear_to_byte(c: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear_to_srgb(c))) * 255).cast("int")


def _dot(row: tuple[float, ...], cols: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(k) * c for k, c in zip(row, cols, strict=True)])


def oklab(linear: Rgb) -> Rgb:
    lms = tuple(F.cbrt(_dot(row, linear)) for row in LMS)
    return tuple(_dot(row, lms) for row in LAB)


def oklab_to_linear(lab: Rgb) -> Rgb:
    lms = tuple(F.pow(_dot(row, lab), F.lit(3.0)) for row in LMS_INVERSE)
    return tuple(_dot(row, lms) for row in RGB_INVERSE)


def cie_lab(linear: Rgb) -> Rgb:
    def f(v: Column) -> Column:
        return F.when(v > 216 / 24389, F.cbrt(v)).otherwise((24389 / 27 * v + 16) / 116)

    x, y, z = (f(_dot(row, linear) / w) for row, w in zip(XYZ, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def with_oklab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Adds ok_l, ok_a, ok_b of byte columns; each step is a projection of its own, so that no cube root is taken twice."""
    lin = df.withColumns({"_lr": byte_to_linear(F.col(r)), "_lg": byte_to_linear(F.col(g)), "_lb": byte_to_linear(F.col(b))})
    return lin.withColumns(dict(zip(OK, oklab((F.col("_lr"), F.col("_lg"), F.col("_lb"))), strict=True))).drop("_lr", "_lg", "_lb")


def squared(p: Rgb, q: Rgb) -> Column:
    return reduce(lambda a, b: a + b, [(x - y) * (x - y) for x, y in zip(p, q, strict=True)])


def redmean(p: Rgb, q: Rgb) -> Column:
    mean = (p[0] + q[0]) / 2
    dr, dg, db = (a - b for a, b in zip(p, q, strict=True))
    return F.sqrt((2 + mean / 256) * dr * dr + 4 * dg * dg + (2 + (255 - mean) / 256) * db * db)


def luma(p: Rgb) -> Column:
    return 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]


def chroma(p: Rgb) -> Column:
    return F.greatest(*p) - F.least(*p)


def hex_color(p: Rgb) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in p])


def delta_e2000(p: Rgb, q: Rgb) -> Column:
    """CIEDE2000 of two CIE Lab colours with unit weights, after the published definition."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    mean7 = F.pow((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2, F.lit(7.0))
    stretch = 1 + 0.5 * (1 - F.sqrt(mean7 / (mean7 + 25.0**7)))
    c1, c2 = F.hypot(stretch * a1, b1), F.hypot(stretch * a2, b2)
    grey = c1 * c2 == 0

    def hue(a: Column, b: Column, c: Column) -> Column:
        return F.when(c == 0, F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, stretch * a)) + 360, F.lit(360.0)))

    h1, h2 = hue(a1, b1, c1), hue(a2, b2, c2)
    apart = h2 - h1
    turn = F.when(grey, F.lit(0.0)).when(apart > 180, apart - 360).when(apart < -180, apart + 360).otherwise(apart)
    dl, dc, dh = l2 - l1, c2 - c1, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(turn / 2))
    lm, cm, total = (l1 + l2) / 2, (c1 + c2) / 2, h1 + h2
    hm = F.when(grey, total).when(F.abs(h1 - h2) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)

    def cos(degrees: Column) -> Column:
        return F.cos(F.radians(degrees))

    t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.2 * cos(4 * hm - 63)
    off = (lm - 50) * (lm - 50)
    sl, sc, sh = 1 + 0.015 * off / F.sqrt(20 + off), 1 + 0.045 * cm, 1 + 0.015 * cm * t
    cm7 = F.pow(cm, F.lit(7.0))
    bend = (hm - 275) / 25
    rt = -2 * F.sqrt(cm7 / (cm7 + 25.0**7)) * F.sin(F.radians(60 * F.exp(-bend * bend)))
    x, y, z = dl / sl, dc / sc, dh / sh
    return F.sqrt(F.greatest(F.lit(0.0), x * x + y * y + z * z + rt * y * z))


def rgb_to_hsl(p: Rgb) -> Rgb:
    """Hue in degrees, saturation and lightness in 0..1, of channels in 0..255."""
    r, g, b = (c / 255.0 for c in p)
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    sat = F.when(d == 0, F.lit(0.0)).otherwise(d / (1 - F.abs(2 * light - 1)))
    # Divisions stay behind their conditions: the session may raise on zero.
    hue = F.when(d == 0, F.lit(0.0)).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return hue, sat, light


def simplify(p: Rgb, level: int) -> Rgb:
    """Near-greys become grey, other channels are quantised; both by level 0..4."""
    step, limit = QUANTISE_STEP[level], QUANTISE_GREY[level]
    if level == 0:
        return p

    def quantise(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(255), half_up(c / step) * step)).cast("int")

    grey = chroma(p) <= limit
    return tuple(F.when(grey, quantise(luma(p))).otherwise(quantise(c)) for c in p)


#: Hue ranges in degrees, low end included; a range that ends before it begins passes through zero. Fixed values.
HUES = {"red": (345, 20), "orange": (20, 45), "yellow": (45, 75), "green": (75, 165), "cyan": (165, 200), "blue": (200, 265), "purple": (265, 345)}


def in_class(p: Rgb, name: str) -> Column:
    """Whether a colour belongs to a broad class; classes overlap."""
    r, g, b = (c / 255.0 for c in p)
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    if name == "dark":
        return hi < 0.48
    if name == "light":
        return (lo > 0.64) & (d < 0.22)
    if name == "neutral":
        return (d < 0.13) & (hi >= 0.25) & (hi <= 0.85)
    h = F.pmod(F.when(d == 0, F.lit(0.0)).when(hi == r, (g - b) / d).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60 + 360, F.lit(360.0))
    vivid = ~((d < 0.12) | (hi < 0.18))
    if name == "brown":
        return vivid & (h >= 5) & (h < 65) & (hi < 0.7)
    if name == "pink":
        return vivid & ((h >= 310) | (h < 15)) & (lo > 0.25)
    a, z = HUES[name]
    return vivid & (((h >= a) | (h < z)) if a > z else ((h >= a) & (h < z)))


def similar(p: Rgb, q: Rgb, level: int, rare: bool = False) -> Column:
    """Whether two colours count as alike at a level 0..4; ``rare`` colours are merged more readily."""
    base = SIMILAR_DISTANCE[level]
    cp, cq, lp, lq = chroma(p), chroma(q), luma(p), luma(q)
    dark = (lp < 84) & (lq < 84)
    light = (lp > 188) & (lq > 188) & (cp < 46) & (cq < 46)
    muted = (lp > 96) & (lq > 96) & (cp < 82) & (cq < 82)
    limit = F.lit(base * (1.45 if rare else 1.0))
    for test, factor in ((dark | light | muted, 1.15), ((cp > 78) | (cq > 78), 0.7), (F.abs(cp - cq) > 56, 0.58), ((F.abs(lp - lq) > 86) & ~dark, 0.55)):
        limit = limit * F.when(test, F.lit(factor)).otherwise(F.lit(1.0))
    return F.lit(base > 0) & (redmean(p, q) <= limit)


def hsl_to_rgb(hue: Column, sat: Column, light: Column) -> Rgb:
    """Channels in 0..255 of hue in degrees, saturation and lightness in 0..1."""
    span = sat * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(n + hue / 30, F.lit(12.0))
        return clamp_byte(255 * (light - span * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))))

    return channel(0), channel(8), channel(4)


def adjust(df: DataFrame, temperature: float = 0, contrast: float = 0, brightness: float = 0, hue: float = 0, saturation: float = 0) -> DataFrame:
    """Replaces r, g, b: warmed, then contrast and brightness, then hue and saturation, rounded to bytes after each step."""
    level = contrast * 2.55
    factor = 259 * (level + 255) / (255 * (259 - level))
    warm = {c: clamp_byte(F.col(c) + k * temperature) for c, k in (("r", 1.35), ("g", 0.28), ("b", -1.35))}
    steep = {c: clamp_byte(factor * (F.col(c) - 128) + 128 + brightness * 2.55) for c in "rgb"}
    rows = df.withColumns(warm).withColumns(steep)
    rows = rows.withColumns(dict(zip(("_h", "_s", "_l"), rgb_to_hsl((F.col("r"), F.col("g"), F.col("b"))), strict=True)))
    turned = hsl_to_rgb(F.pmod(F.col("_h") + hue, F.lit(360.0)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_s") * (1 + saturation / 100))), F.col("_l"))
    return rows.withColumns(dict(zip("rgb", turned, strict=True))).drop("_h", "_s", "_l")


def with_traits(df: DataFrame, prefix: str = "") -> DataFrame:
    """Adds hue, chroma and luma of r, g, b: once a row, where pairs would need them once a pair."""
    p = tuple(F.col(prefix + c) for c in "rgb")
    return df.withColumns({f"{prefix}hue": rgb_to_hsl(p)[0], f"{prefix}chroma": chroma(p), f"{prefix}luma": luma(p)})


def close_for_merge(p: Rgb, q: Rgb, level: int, p_traits: Rgb | None = None, q_traits: Rgb | None = None) -> Column:
    """Whether an editor may merge two colours at a level 1..4; greys, vivid and other colours have limits of their own.

    ``p_traits`` and ``q_traits``: hue, chroma and luma, where the rows have them already.
    """
    pick = lambda v: float(v[level - 1])
    (hp, cp, yp), (hq, cq, yq) = (t or (rgb_to_hsl(c)[0], chroma(c), luma(c)) for c, t in ((p, p_traits), (q, q_traits)))
    grey, vivid = (cp < 34) & (cq < 34), (cp > 72) | (cq > 72)
    gap = F.abs(yp - yq)
    turn = F.abs(hp - hq)
    turn = F.least(turn, 360 - turn)
    d = redmean(p, q)
    limit = F.when(vivid, pick(VIVID_DISTANCE)).otherwise(pick(OTHER_DISTANCE))
    greys = (d <= pick(GREY_DISTANCE)) & (gap <= pick(GREY_LUMA))
    near = (~vivid | (turn <= pick(VIVID_HUE))) & (F.abs(cp - cq) <= pick(CHROMA_GAP)) & (gap <= pick(LUMA_GAP))
    return F.when(grey, greys).otherwise(near & ((d <= limit) | ((turn <= pick(NEAR_HUE)) & (d <= limit * 1.18))))
