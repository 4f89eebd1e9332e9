"""Tile grids, samples and windows; all over metadata, before any pixel is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import lot


def grid(images: DataFrame, tile: int) -> DataFrame:
    """Rectangles of images (``image_id, height, width``), rows outer; edge tiles keep their true size."""
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1, F.lit(tile).cast("long"))))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1, F.lit(tile).cast("long"))))
    size = F.lit(tile).cast("long")
    return cells.select("image_id", "y", "x", F.least(size, F.col("height") - F.col("y")).alias("h"), F.least(size, F.col("width") - F.col("x")).alias("w"))


def effective_size(height, width, tile: int):
    """The tile size, or half the shorter side (64 at least) where a side has fewer than two tiles."""
    shorter = F.least(height, width)
    return F.when(F.ceil(shorter / tile) < 2, F.greatest(F.floor(shorter / 2), F.lit(64))).otherwise(F.lit(tile))


def window(tiles: DataFrame, y0: int, x0: int, h: int, w: int) -> DataFrame:
    """Tiles that meet a window."""
    return tiles.where((F.col("y") < y0 + h) & (F.col("y") + F.col("h") > y0) & (F.col("x") < x0 + w) & (F.col("x") + F.col("w") > x0))


def every_nth(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Of each group every ceil(n / most)-th row in order, all if there are no more than ``most``."""
    w = W.partitionBy(*by)
    n = F.count("*").over(w)
    step = F.greatest(F.lit(1), F.ceil(n / most))
    return df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__step": step}).where("__i % __step = 0").drop("__i", "__step")


def sample_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each group, by a hash of key and seed: the same rows however the data are dealt."""
    w = W.partitionBy(*by).orderBy(lot(F.col(key), seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def centre_crop(planes: DataFrame) -> DataFrame:
    """Offsets that crop every plane (``image_id, channel, height, width``) to the smallest of its image."""
    w = W.partitionBy("image_id")
    low_h, low_w = F.min("height").over(w), F.min("width").over(w)
    return planes.withColumns(
        {"crop_h": low_h, "crop_w": low_w, "y0": F.floor((F.col("height") - low_h) / 2), "x0": F.floor((F.col("width") - low_w) / 2)}
    )


def cut_window(pixels: DataFrame, y0: int, x0: int, h: int, w: int) -> DataFrame:
    """Pixels (``y, x``) of a window, counted from its corner."""
    inside = pixels.where((F.col("y") >= y0) & (F.col("y") < y0 + h) & (F.col("x") >= x0) & (F.col("x") < x0 + w))
    return inside.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def level_for(levels: DataFrame, downsample: float = 4.0) -> DataFrame:
    """Of each image (``image_id, level, downsample``) the level nearest to a downsampling; of two as near the finer one."""
    off = F.struct(F.abs(F.col("downsample") - F.lit(downsample)), "level")
    return levels.groupBy("image_id").agg(F.min_by("level", off).alias("level"), F.min_by("downsample", off).alias("downsample"))


def quality_sample(tiles: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` tiles of each image for a look (a sampling operator): the same ones on every run."""
    return sample_per_group(tiles.withColumn("__key", F.concat_ws("_", "tile_y", "tile_x")), ["image_id"], "__key", n, seed).drop("__key")
