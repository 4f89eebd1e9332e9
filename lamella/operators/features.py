"""Per-cell, per-channel intensity features over pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import to_uint8, unit_scale
from ..functions.ranks import quantiles
from ..functions.shared import small

TILE = ["tile_x", "tile_y"]
CELL = [*TILE, "label"]
LONG = [
    *CELL, "local_x", "local_y", "channel_index", "channel_name", "mean", "median", "sum", "std", "mean_bg_corr", "median_bg_corr", "n_pixels",
]


def medians(pixels: DataFrame, by: list[str], name: str) -> DataFrame:
    """Exact median of the values of each group, without a task that holds a group's values."""
    return quantiles(pixels, "value", [0.5], by).select(*by, F.col("q")[0].alias(name))


def beside(rows: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of their group's row in ``levels``, null where there is none; null keys are equal."""
    right = levels.withColumnsRenamed({c: f"__{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(right, on, "left").drop(*[f"__{c}" for c in by])


def background(pixels: DataFrame) -> DataFrame:
    """Exact median of the pixels outside cells for each tile and channel."""
    return medians(pixels.where(F.col("label") == 0), [*TILE, "channel"], "background")


def long(pixels: DataFrame) -> DataFrame:
    """Statistics of every cell and channel; without background pixels the background is 0.0. Never clipped."""
    cells, by = pixels.where(F.col("label") > 0), [*CELL, "channel"]
    stats = cells.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.sum("value").alias("sum"),
        F.stddev_pop("value").alias("std"),
        F.count("*").alias("n_pixels"),
    )
    stats = beside(stats, medians(cells, by, "median"), by).select(*by, "mean", "median", "sum", "std", "n_pixels")
    level = F.coalesce("background", F.lit(0.0))
    return (
        stats.join(background(pixels), [*TILE, "channel"], "left")
        .withColumns({"mean_bg_corr": F.col("mean") - level, "median_bg_corr": F.col("median") - level})
        .drop("background")
    )


def placed(stats: DataFrame, places: DataFrame, channels: DataFrame) -> DataFrame:
    """The long table's columns: ``stats`` with positions (``centroids``) and each channel's ``index, name``."""
    names = channels.select(F.col("name").alias("channel"), F.col("index").alias("channel_index"))
    return (
        stats.join(places.select(*CELL, "local_x", "local_y"), CELL)
        .join(small(names), "channel")  # a panel, of any size
        .withColumnRenamed("channel", "channel_name").select(*LONG)
    )


def measure(tiles: DataFrame, channels: dict[int, str]) -> DataFrame:
    """The long table (``image_id`` and ``LONG``) of tiles with labels and all channels in one row, without moving a pixel.

    ``image_id, tile_y, tile_x, h, w, channels, planes, labels``: what ``long``
    and ``centroids`` give over the tiles' pixels, computed where the tile is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                label = np.asarray(t.labels)
                order = np.argsort(label, kind="stable")
                ids, begin, n = np.unique(label[order], return_index=True, return_counts=True)
                y, x = np.divmod(order, t.w)
                cells = ids > 0
                mean = lambda v: np.add.reduceat(v.astype(np.float64), begin) / n  # noqa: B023, E731
                local_y, local_x = mean(y), mean(x)
                for c, plane in zip(t.channels, t.planes):
                    if int(c) not in channels:
                        continue
                    v = np.asarray(plane, np.float64)
                    by = np.lexsort((v, label))
                    w, m = v[by], mean(v[order])
                    middle = (w[begin + (n - 1) // 2] + w[begin + n // 2]) / 2
                    std = np.sqrt(np.add.reduceat((v[order] - np.repeat(m, n)) ** 2, begin) / n)
                    ground = middle[ids == 0][0] if (ids == 0).any() else 0.0
                    yield pd.DataFrame({
                        "image_id": t.image_id, "tile_x": t.tile_x, "tile_y": t.tile_y, "label": ids.astype(np.int64), "local_x": local_x, "local_y": local_y,
                        "channel_index": int(c), "channel_name": channels[int(c)], "mean": m, "median": middle, "sum": np.add.reduceat(v[order], begin), "std": std,
                        "mean_bg_corr": m - ground, "median_bg_corr": middle - ground, "n_pixels": n,
                    })[cells]

    schema = (
        "image_id string, tile_x long, tile_y long, label long, local_x double, local_y double, channel_index int, channel_name string, "
        "mean double, median double, sum double, std double, mean_bg_corr double, median_bg_corr double, n_pixels long"
    )
    return tiles.select("image_id", "tile_y", "tile_x", "h", "w", "channels", "planes", "labels").mapInPandas(run, schema)


def background_of_rows(pixels: DataFrame) -> DataFrame:
    """The background beside every pixel row; a row for each tile and channel meets them, no window gathers them."""
    return beside(pixels, background(pixels), [*TILE, "channel"]).withColumn("background", F.coalesce("background", F.lit(0.0)))


def scaled(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Append ``unit`` (0 to 1) and ``byte`` (0 to 255) of every pixel between the extremes of its group."""
    ends = pixels.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    v, lo, hi = F.col("value"), F.col("__lo"), F.col("__hi")
    return pixels.join(ends, by).withColumns({"unit": unit_scale(v, lo, hi), "byte": to_uint8(v, lo, hi)}).drop("__lo", "__hi")


def cropped(pixels: DataFrame, crops: DataFrame) -> DataFrame:
    """Pixels within each plane's centre crop (``tiles.centre_crop``), counted from its corner."""
    both = pixels.join(crops.select("image_id", "channel", "crop_h", "crop_w", "y0", "x0"), ["image_id", "channel"])
    moved = both.withColumns({"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0")})
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("crop_h")) & (F.col("x") < F.col("crop_w"))
    return moved.where(inside).drop("crop_h", "crop_w", "y0", "x0")


def centroids(pixels: DataFrame) -> DataFrame:
    """Mean position and area of every cell, once and not for each channel."""
    where = pixels.where(F.col("label") > 0).select(*CELL, "y", "x").distinct()
    return where.groupBy(*CELL).agg(F.avg("x").alias("local_x"), F.avg("y").alias("local_y"), F.count("*").alias("area"))


def cell_count(pixels: DataFrame) -> DataFrame:
    """``n_cells``: different cells of all tiles."""
    return pixels.where(F.col("label") > 0).agg(F.count_distinct(F.struct(*CELL)).alias("n_cells"))


def matrix(features: DataFrame, channels: list[str], metric: str = "mean_bg_corr", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each cell, one column for each channel, 0.0 where a cell lacks one; sorted by the cell's name.

    ``features`` is the long table; positions are kept where it has them. A
    channel that a cell has twice counts with its last (greatest) position and
    value.
    """
    name = "channel_name" if "channel_name" in features.columns else "channel"
    places = [c for c in ("local_x", "local_y") if c in features.columns]
    last = F.max_by(metric, F.struct(*places, metric))
    wide = features.groupBy(*by, *CELL).pivot(name, channels).agg(last).na.fill(0.0, channels)
    if places:
        seen = F.when((F.col("local_x") != 0) | (F.col("local_y") != 0), F.struct(*places))
        at = features.groupBy(*by, *CELL).agg(F.min(seen).alias("__at"))
        wide = wide.join(at, [*by, *CELL]).withColumns({c: F.coalesce(F.col(f"__at.{c}"), F.lit(0.0)) for c in places})
    out = wide.withColumn("cell_id", F.concat_ws("_", *CELL)).select(*by, "cell_id", *CELL, *places, *channels)
    return out.orderBy(*by, "cell_id")


def shape(pixels: DataFrame) -> DataFrame:
    """Bounding box, area, equivalent diameter, ellipse axes and orientation-free moments of every label."""
    m = pixels.where(F.col("label") > 0).groupBy(*CELL).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.count("*").alias("area"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"),
    )
    half, spread = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("vxy", 2))
    return m.select(
        *CELL, "x0", "y0", "x1", "y1", "area",
        F.sqrt(4 * F.col("area") / F.lit(3.141592653589793)).alias("equivalent_diameter"),
        (4 * F.sqrt(half + spread)).alias("major_axis"),
        (4 * F.sqrt(F.greatest(half - spread, F.lit(0.0)))).alias("minor_axis"),
    )


def perimeter(pixels: DataFrame) -> DataFrame:
    """Sides between a cell's pixels and others (or the border) for every cell: neighbours of its own are taken off."""
    own = pixels.where(F.col("label") > 0).select(*CELL, "y", "x").distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0))]))
    beside = own.withColumn("s", steps).select(*CELL, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    shared = beside.join(own, [*CELL, "y", "x"]).groupBy(*CELL).agg(F.count("*").alias("__shared"))
    area = own.groupBy(*CELL).agg(F.count("*").alias("__area"))
    return area.join(shared, CELL, "left").select(*CELL, (4 * F.col("__area") - 2 * F.coalesce("__shared", F.lit(0))).alias("perimeter"))


def with_normalised(matrix: DataFrame, channels: list[str]) -> DataFrame:
    """The matrix with a ``z_`` column beside each channel's raw one (population deviation, 0 counts as 1)."""
    spread = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    one = matrix.agg(*[f.alias(f"__{k}{i}") for i, c in enumerate(channels) for k, f in (("m", F.avg(c)), ("s", spread(c)))])
    z = {f"z_{c}": (F.col(c) - F.col(f"__m{i}")) / F.col(f"__s{i}") for i, c in enumerate(channels)}
    return matrix.join(F.broadcast(one)).withColumns(z).drop(*one.columns)  # one row


def with_autofluorescence(features: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``af_raw, af_bg_corr, af_norm`` (0 to 1 over all cells) of every cell, from the long table's rows of channel ``name``."""
    channel = "channel_name" if "channel_name" in features.columns else "channel"
    own = features.where(F.col(channel) == name).select(*by, *CELL, F.col("mean").alias("af_raw"), F.col("mean_bg_corr").alias("af_bg_corr"))
    ends = own.agg(F.min("af_bg_corr").alias("__lo"), F.max("af_bg_corr").alias("__hi"))
    return own.join(F.broadcast(ends)).withColumn("af_norm", unit_scale(F.col("af_bg_corr"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row
