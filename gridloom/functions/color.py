"""Colour arithmetic as Column expressions: hex forms, OKLab, distances, blends, ink."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(text: Column) -> Column:
    """STRUCT<r,g,b> of six hex digits after any number of #, else NULL."""
    bare = F.regexp_replace(text, "^#+", "")
    part = lambda k: F.conv(F.substring(bare, k, 2), 16, 10).cast("int")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column, digits: int | None = None) -> Column:
    """OKLab as STRUCT<l,a,b DOUBLE>; the matrices are the published ones."""
    r, g, b = linear(r), linear(g), linear(b)
    l_ = F.cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b)
    m_ = F.cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b)
    s_ = F.cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)
    out = (
        0.2104542553 * l_ + 0.7936177850 * m_ - 0.0040720468 * s_,
        1.9779984951 * l_ - 2.4285922050 * m_ + 0.4505937099 * s_,
        0.0259040371 * l_ + 0.7827717662 * m_ - 0.8086757660 * s_,
    )
    if digits is not None:
        out = tuple(F.round(x, digits) for x in out)
    return F.struct(out[0].alias("l"), out[1].alias("a"), out[2].alias("b"))


def dist2(p: Column, q: Column) -> Column:
    d = [p[c] - q[c] for c in ("l", "a", "b")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def dist(p: Column, q: Column) -> Column:
    return F.sqrt(dist2(p, q))


def segment_deviation(p: Column, a: Column, b: Column) -> Column:
    """Distance of p to the segment a-b in OKLab."""
    length = dist2(a, b)
    along = sum((p[c] - a[c]) * (b[c] - a[c]) for c in ("l", "a", "b"))
    t = F.when(length <= 0, 0.0).otherwise(F.least(F.greatest(along / length, F.lit(0.0)), F.lit(1.0)))
    off = [p[c] - (a[c] + t * (b[c] - a[c])) for c in ("l", "a", "b")]
    return F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])


def blend_between(p: Column, a: Column, b: Column, margin: float, deviation: float) -> Column:
    """Farther than margin from both ends and nearer than deviation to what lies between."""
    return (dist(p, a) > margin) & (dist(p, b) > margin) & (segment_deviation(p, a, b) < deviation)


def is_ink(r: Column, g: Column, b: Column) -> Column:
    """Near black and grey."""
    return (F.greatest(r, g, b) <= 30) & (F.greatest(r, g, b) - F.least(r, g, b) <= 8)


def is_key_fill(r: Column, g: Column, b: Column) -> Column:
    return (g >= 200) & (r <= 100) & (b <= 100)


def over_white(channel: Column, alpha: Column) -> Column:
    """A channel composited over white."""
    return (channel * alpha + 255 * (255 - alpha)) / 255.0


def hashed_color(key: Column) -> Column:
    """A stable hue for an integer key (32-bit avalanche) as STRUCT<r,g,b> of full value and saturation 0.65."""
    mask = F.lit(0xFFFFFFFF)
    x = key.cast("long").bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    x = F.pmod(x * F.lit(0x7FEB352D), F.lit(1 << 32))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 15))
    x = F.pmod(F.pmod(x * F.lit(0x846C), F.lit(1 << 32)) * F.lit(65536) + x * F.lit(0xA68B), F.lit(1 << 32))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    hue = F.pmod(x, F.lit(360)) / 60.0
    v, s = 0.95, 0.65
    f = hue - F.floor(hue)
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * f), v * (1 - s * (1 - f))
    sextant = F.floor(hue).cast("int")
    pick = lambda *cs: F.round(255 * F.element_at(F.array(*[F.lit(c) if isinstance(c, float) else c for c in cs]), sextant + 1)).cast("int")
    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def recolored(r: Column, g: Column, b: Column, name: Column) -> Column:
    """The fill of a path as drawn: near black turns white on fill layers. STRUCT<r,g,b>."""
    near_black = F.greatest(r, g, b) <= 5
    white = F.contains(name, F.lit("Fill")) & near_black
    return F.struct(*(F.when(white, F.lit(255)).otherwise(c).cast("int").alias(k) for k, c in (("r", r), ("g", g), ("b", b))))


def ramp_color(share: Column) -> Column:
    """A heat colour from blue (0) to red (1), STRUCT<r,g,b>."""
    t = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    lerp = lambda a, z: F.round(a + (z - a) * t).cast("int")
    return F.struct(lerp(64, 224).alias("r"), lerp(96, 64).alias("g"), lerp(224, 48).alias("b"))
