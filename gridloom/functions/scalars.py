"""Settings arithmetic, names and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detail_area(detail: Column, scale: Column, size: Column) -> Column:
    side = detail * scale * 512 / F.greatest(size, F.lit(1))
    return side * side


def least_speck(detail: Column, scale: Column, size: Column) -> Column:
    return F.greatest(F.lit(4), F.floor(0.5 * detail_area(detail, scale, size)).cast("int"))


def corner_threshold(alphamax: Column) -> Column:
    return F.radians(alphamax * 90)


def smooth_radius(smoothing: Column, scale: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), smoothing) * scale)


def scaled_pin(x: Column, y: Column, ox: Column, oy: Column, scale: Column, w: Column, h: Column) -> Column:
    """A document pixel as the centre of its scaled pixel in a crop, NULL outside of the crop."""
    dx, dy = x - ox, y - oy
    at = lambda d: (d * scale + F.expr("0") + F.floor(scale / 2)).cast("long")
    return F.when((dx >= 0) & (dy >= 0) & (dx < w) & (dy < h), F.struct(at(dx).alias("x"), at(dy).alias("y")))


def stroke_of(width: Column, color: Column) -> Column:
    return F.when(width > 0, F.struct(width.alias("width"), color.alias("color")))


def glob_regex(key: Column) -> Column:
    """An anchored, case-sensitive pattern in which only * is special."""
    quoted = F.regexp_replace(key, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\*", ".*"), F.lit("$"))


def key_matches(key: Column, name: Column) -> Column:
    """Does a wildcard key match a whole name? The empty key matches nothing."""
    return (F.length(key) > 0) & F.call_function("rlike", name, glob_regex(key))


def specificity(key: Column) -> Column:
    """Orders keys: more literal characters, then a leading *, then length."""
    return F.struct(F.length(F.replace(key, F.lit("*"), F.lit(""))).alias("literals"), F.startswith(key, F.lit("*")).cast("int").alias("suffix"), F.length(key).alias("size"))


def ago(seconds: Column) -> Column:
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    return (
        F.when(minutes < 1, "just now")
        .when(hours < 1, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(days < 1, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 2, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.concat(F.floor(days / 7).cast("string"), F.lit("w ago")))
    )


def file_label(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.length(last) > 0, last).otherwise(path)


def first_word_glob(name: Column) -> Column:
    return F.concat(F.element_at(F.split(F.trim(name), r"\s+"), 1), F.lit(" *"))


def without_suffix(name: Column, suffix: str) -> Column:
    """The name without the suffix, if it is longer than that."""
    n = len(suffix)
    return F.when(F.endswith(name, F.lit(suffix)) & (F.length(name) > n), F.substring(name, F.lit(1), F.length(name) - n)).otherwise(name)


def without_first(name: Column, part: str) -> Column:
    at = F.instr(name, part)
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + len(part), F.length(name)))).otherwise(name)


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def base36(index: Column) -> Column:
    return F.lower(F.conv(index.cast("string"), 10, 36))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def ramp(value: Column, most: Column) -> Column:
    """A heat share from 0 to 1."""
    return F.when(most > 0, F.least(F.greatest(value / most, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def fit_view(w: Column, h: Column, vw: Column, vh: Column) -> Column:
    """Zoom and offsets that centre a w x h image in a view."""
    zoom = F.least(vw / w, vh / h)
    return F.struct(zoom.alias("zoom"), ((vw - w * zoom) / 2).alias("dx"), ((vh - h * zoom) / 2).alias("dy"))


def tidy_number(v: Column) -> Column:
    return F.round(v * 1000) / 1000


def to_screen(x: Column, y: Column, view: Column) -> Column:
    """An image point in a view (STRUCT<zoom, dx, dy>)."""
    return F.struct((x * view["zoom"] + view["dx"]).alias("x"), (y * view["zoom"] + view["dy"]).alias("y"))


def to_image(x: Column, y: Column, view: Column) -> Column:
    return F.struct(((x - view["dx"]) / view["zoom"]).alias("x"), ((y - view["dy"]) / view["zoom"]).alias("y"))


def with_setting(settings: Column, field: str, value: Column | None) -> Column:
    """A settings struct with one field set, or cleared (None)."""
    return settings.withField(field, F.lit(None) if value is None else value)


def is_set(settings: Column, field: str) -> Column:
    return settings[field].isNotNull()
