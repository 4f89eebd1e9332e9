"""Column expressions used across the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """Null, NaN and infinite values as 0.0; everything else as double."""
    d = x.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)).otherwise(d)


def cell_id(tile_x: Column, tile_y: Column, label: Column) -> Column:
    return F.concat_ws("_", tile_x.cast("string"), tile_y.cast("string"), label.cast("string"))


def to_global(tile: Column, local: Column) -> Column:
    return tile.cast("double") + local.cast("double")


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def nearest_pixel(x: Column, size: int) -> Column:
    """Half-even rounding, then clipping to the image."""
    return clip(F.rint(x).cast("long"), 0, size - 1)


def sample_of(path: Column) -> Column:
    """The component after the first ``outputs``; without one, the name of the file's grandparent folder."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "outputs")
    return F.coalesce(F.when(at > 0, F.get(parts, at.cast("int"))), F.get(parts, F.size(parts) - 3))


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def tile_of_name(name: Column, axis: int) -> Column:
    """``x`` (axis 1) or ``y`` (axis 2) from a name that ends in ``_<x>_<y>.<ext>``; null if it doesn't."""
    return F.expr("null").cast("long") if axis not in (1, 2) else F.when(
        F.regexp_like(name, F.lit(r"_(\d+)_(\d+)\.\w+$")), F.regexp_extract(name, r"_(\d+)_(\d+)\.\w+$", axis)
    ).cast("long")


def unit_scale(x: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; zero where the range is under 1e-6."""
    return F.when(high - low < 1e-6, F.lit(0.0)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def to_uint8(x: Column, low: Column, high: Column) -> Column:
    """To 0..255, truncated; zero where the range is empty."""
    return F.when(high <= low, F.lit(0)).otherwise(F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * 255).cast("int"))


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def confidence(nearest: Column, second: Column) -> Column:
    """1 - d1/d2, clipped: near 1 for a clear assignment."""
    return F.lit(1.0) - clip(nearest / (second + 1e-6), 0.0, 1.0)


def prefixed_name(sample: Column, index: Column, name: Column) -> Column:
    """``<sample>_<two-digit index>_<name>.png``."""
    return F.format_string("%s_%02d_%s.png", sample, index.cast("int"), name)


def clamped(start: Column, size: Column, length: int) -> Column:
    """The first place of a window of ``length`` that stays within ``size``."""
    return F.greatest(F.lit(0), F.least(start, size - F.lit(length)))


def centred(size: Column, length: int) -> Column:
    """Where a window of ``length`` in the middle of ``size`` begins."""
    return F.greatest(F.lit(0), F.floor((size - F.lit(length)) / 2))


def lot(key: Column, seed: int) -> Column:
    """A number from 0 to 2^32 - 1 by the MD5 of seed and key: the same in any engine, however rows are dealt."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
