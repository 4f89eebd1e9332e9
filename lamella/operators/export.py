"""Exports: points, classes and sparse rasters."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip, nearest_pixel
from ..functions.shared import small
from ..sources import sinks
from ..sources.codecs import encode_png, lay_out_tiff

# Colours of classes, in order of their rank.
PALETTE = ("#E41A1C", "#377EB8", "#4DAF4A", "#984EA3", "#FF7F00", "#FFFF33", "#A65628", "#F781BF", "#999999")
# Fixed value: what follows the number of clusters in a point's note.
NOTE = "聚类点"
#: Values that an 8-bit raster has beside the background.
MOST_CLASSES = 255


def encode(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Distinct clusters with their dense ``value`` from 1 and ``color``; ranked on the short distinct list."""
    rank = F.row_number().over(W.orderBy(cluster))
    colors = F.array(*[F.lit(c) for c in PALETTE])
    return (
        cells.select(cluster).distinct().withColumn("value", rank)
        .withColumn("color", F.element_at(colors, (F.col("value") - 1) % len(PALETTE) + 1))
    )


def checked(classes: DataFrame) -> DataFrame:
    """``classes``, if an 8-bit raster can hold them."""
    n = classes.count()
    if n > MOST_CLASSES:
        raise ValueError(f"{n} classes do not fit into {MOST_CLASSES} raster values")
    return classes


def points(cells: DataFrame, cluster: str = "cluster", keep: tuple[str, ...] = ()) -> DataFrame:
    """Point features of cells (``x, y``, cluster), with the columns ``keep``; cells without a cluster have no class.

    There may be any number of classes; they ride along where they are few.
    """
    meta = encode(cells.where(F.col(cluster).isNotNull()), cluster).drop("value")
    k = meta.agg(F.count("*").alias("k"))
    named = cells.join(small(meta), cluster, "left").join(F.broadcast(k))  # one row
    return named.select(
        *keep,
        F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("coordinates")).alias("geometry"),
        F.struct(
            F.col(cluster).alias("class_value"), F.col(cluster).cast("string").alias("class_name"), F.col("color").alias("class_color"),
            F.concat(F.lit("k="), F.col("k"), F.lit(NOTE)).alias("note"),
        ).alias("properties"),
    )


def write_points(cells: DataFrame, path: str, cluster: str = "cluster") -> None:
    """One JSON object a line."""
    points(cells, cluster).select(F.to_json(F.struct("geometry", "properties")).alias("value")).write.text(path)


def classes(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``value, name, color`` of every cluster, in order."""
    meta = encode(cells.where(F.col(cluster).isNotNull()), cluster)
    return meta.select(F.col(cluster).alias("value"), F.col(cluster).cast("string").alias("name"), "color").orderBy("value")


def write_classes(cells: DataFrame, path: str, cluster: str = "cluster") -> None:
    """The classes as one JSON array, indented by two (a line each would not be one value)."""
    rows = [r.asDict() for r in classes(cells, cluster).collect()]  # a row a class: the text that is written
    text = json.dumps(rows, ensure_ascii=False, indent=2)
    cells.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def point_rows(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``pixel_value, x, y`` of every cell."""
    return cells.select(F.col(cluster).cast("int").alias("pixel_value"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def write_csv(df: DataFrame, path: str, empty: bool = True) -> bool:
    """A table with a header, in place of one that is there; with ``empty=False`` nothing is written for no rows. Says whether it was written."""
    if not empty and df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def cluster_path(path: str) -> str:
    """Where the clustered form of a matrix goes: ``_cluster`` before its suffix."""
    return re.sub(r"\.csv$", "", path) + "_cluster.csv"


def combined_path(root: str, output: str | None = None, name: str = "combined_features_cluster.csv") -> str:
    """``output``; ``name`` in it if it is a folder, and in ``root`` if there is no output."""
    if not output:
        return os.path.join(root, name)
    return os.path.join(output, name) if os.path.isdir(output) else output


def by_tile(cells: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """Cells for a drawing of each sample's tile: ``sample, tile_x, tile_y, points`` (``local_x, local_y, cluster``).

    ``most`` cells a tile at most, by hash (a sampling operator); without it
    a tile's cells are all of them.
    """
    own = ["sample", "tile_x", "tile_y"]
    if most:
        order = F.xxhash64("local_x", "local_y", F.lit(seed))
        cells = cells.withColumn("__r", F.row_number().over(W.partitionBy(*own).orderBy(order, "local_x", "local_y"))).where(F.col("__r") <= most)
    return cells.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("local_x", "local_y", "cluster"))).alias("points"))


def n_clusters(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The greatest cluster and one, or how many there are where they are no whole numbers."""
    whole = F.max(F.col(cluster).cast("string").try_cast("int")) + 1
    return cells.agg(F.coalesce(whole, F.count_distinct(cluster)).cast("long").alias("n_clusters"))


def level_statistics(pixels: DataFrame, level: str = "level", value: str = "value") -> DataFrame:
    """``height, width, n_nonzero`` of every pyramid level, from pixels (``py, px``)."""
    return pixels.groupBy(level).agg((F.max("py") + 1).alias("height"), (F.max("px") + 1).alias("width"), F.count_if(F.col(value) != 0).alias("n_nonzero"))


def write_pngs(tiles: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a PNG for each tile (``image_id, tile_x, tile_y, h, w`` and the raster ``name``) below ``folder``, a shared one; gives the paths.

    ``name`` is ``labels`` (16 bits), ``mask`` (labels above 0 as 255),
    ``colored`` (labels by colour) or ``raw`` (``pixels``, scaled to 8 bits).
    All tiles are there when it returns, or none of this run (``sources.sinks``).
    """
    prefix = {"raw": "raw", "mask": "mask", "labels": "roi_label", "colored": "roi_label_colored"}[name]
    file = F.concat(F.col("image_id"), F.lit(f"/{prefix}_"), F.col("tile_x"), F.lit("_"), F.col("tile_y"), F.lit(".png"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = []
            for t in pdf.itertuples():
                x = np.asarray(t.pixels if name == "raw" else t.labels).reshape(t.h, t.w)
                if name == "raw":
                    span = x.max() - x.min()
                    x = (np.zeros_like(x) if span <= 0 else (x - x.min()) / span * 255).astype(np.uint8)
                else:
                    x = {"labels": lambda v: v.astype(np.uint16), "mask": lambda v: ((v > 0) * 255).astype(np.uint8), "colored": colored}[name](x)
                images.append(encode_png(x))
            yield pd.DataFrame({"name": pdf["name"], "data": images, "note": [None] * len(images)})

    raster = "pixels" if name == "raw" else "labels"
    sinks.register(tiles.sparkSession)
    rows = tiles.select(file.alias("name"), "h", "w", raster).mapInPandas(run, sinks.SCHEMA)
    rows.write.format("files").mode("append").save(folder)
    return tiles.select("image_id", "tile_x", "tile_y", F.concat(F.lit(f"{folder}/"), file).alias("path"))


def colored(labels: np.ndarray) -> np.ndarray:
    """Labels in colours from blue over green to yellow by their share of the greatest; 0 is black."""
    share = labels / max(labels.max(), 1)
    stops = np.array([[53, 42, 135], [15, 92, 221], [18, 125, 216], [7, 156, 207], [21, 177, 180], [89, 189, 140], [165, 190, 107], [225, 185, 82], [252, 206, 46], [249, 251, 14]], float)
    at = np.linspace(0, 1, len(stops))
    rgb = np.stack([np.interp(share, at, stops[:, i]) for i in range(3)], axis=-1)
    return np.where(labels[..., None] > 0, rgb, 0).astype(np.uint8)


def write_map(cells: DataFrame, path: str, height: int, width: int, order: str, value: str = "value", cell: int = 512, least: int = 512) -> None:
    """The cluster map as a pyramidal TIFF of 8-bit tiles at ``path``, in a folder that all machines share.

    Tasks deflate the tiles with a pixel and write them as parts; the driver gets
    their sizes alone, lays out the file and writes its directories, and tasks
    copy the parts to their places. The file gets its name when it is whole.
    """
    if not cells.where(F.col(value) > MOST_CLASSES).isEmpty():
        raise ValueError(f"values above {MOST_CLASSES} do not fit into a raster of 8 bits")
    spark = cells.sparkSession
    shapes = [(height, width)] + [(h, w) for _, h, w in level_sizes(height, width, least=least)]
    base = raster(cells, height, width, order, value).select(F.lit(0).alias("level"), "py", "px", value)
    pixels = base.unionByName(pyramid(cells, height, width, order, value, least=least).select("level", "py", "px", value)) if len(shapes) > 1 else base
    tiles = pixels.groupBy("level", F.floor(F.col("py") / cell).alias("r"), F.floor(F.col("px") / cell).alias("c")).agg(
        F.collect_list((F.col("py") % cell * cell + F.col("px") % cell).cast("int")).alias("at"), F.collect_list(F.col(value).cast("int")).alias("v")
    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data, index = [], []
            for t in pdf.itertuples():
                out = np.zeros(cell * cell, np.uint8)
                out[np.asarray(t.at, np.int64)] = t.v
                data.append(zlib.compress(out.tobytes()))
                index.append((int(t.level), int(t.r), int(t.c), len(data[-1])))
            if index:  # a batch of tiles is a part
                yield pd.DataFrame({"name": [f"{uuid.uuid4().hex}.part"], "data": [b"".join(data)], "note": [json.dumps(index)]})

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                with open(t.part, "rb") as f, open(t.file, "r+b") as out:
                    out.seek(t.start)
                    shutil.copyfileobj(f, out)
            yield pd.DataFrame({"n": [len(pdf)]})

    parts = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(parts)
    try:
        sinks.register(spark)
        tiles.mapInPandas(packed, sinks.SCHEMA).write.format("files").mode("append").save(parts)
        notes = os.path.join(parts, sinks.NOTES)
        index = {n: json.loads(x) for n, x in json.loads(open(notes, encoding="utf-8").read()).items()} if os.path.exists(notes) else {}
        file = os.path.join(parts, "whole")
        starts = lay_out_tiff(file, shapes, index, cell)
        rows = [(os.path.join(parts, n), file, start) for n, start in starts.items()]
        if rows:
            todo = spark.createDataFrame(rows, "part string, file string, start long").repartition(min(len(rows), spark.sparkContext.defaultParallelism))
            todo.mapInPandas(copied, "n long").agg(F.sum("n")).first()
        os.replace(file, path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def thumbnail_rectangle(x0: Column, y0: Column, w: Column, h: Column, width: Column, height: Column, thumb_w: Column, thumb_h: Column) -> Column:
    """A window's rectangle on a thumbnail: corners in whole pixels of it."""
    sx, sy = thumb_w / width, thumb_h / height
    return F.struct(
        F.floor(x0 * sx).alias("x0"), F.floor(y0 * sy).alias("y0"), F.floor((x0 + w) * sx).alias("x1"), F.floor((y0 + h) * sy).alias("y1")
    )


def raster(cells: DataFrame, height: int, width: int, order: str, value: str = "value") -> DataFrame:
    """Sparse raster of cells (``x, y``): 3 x 3 stamps, clipped; the last offset, and in it the last row, wins."""
    steps = F.array(*[F.struct(F.lit(3 * (dy + 1) + dx + 1).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    stamped = cells.select(nearest_pixel(F.col("y"), height).alias("gy"), nearest_pixel(F.col("x"), width).alias("gx"), value, order, F.explode(steps).alias("s"))
    at = stamped.select(
        clip(F.col("gy") + F.col("s.dy"), 0, height - 1).alias("py"), clip(F.col("gx") + F.col("s.dx"), 0, width - 1).alias("px"), value, F.struct("s.k", order).alias("__at")
    )
    return at.groupBy("py", "px").agg(F.max_by(value, "__at").alias(value))


def level_sizes(height: int, width: int, levels: int = 4, least: int = 512) -> list[tuple[int, int, int]]:
    """(scale, height, width) of the levels after the first, while both sides reach ``least``."""
    out = []
    for i in range(1, levels):
        h, w = height >> i, width >> i
        if h < least or w < least:
            break
        out.append((1 << i, h, w))
    return out


def pyramid(cells: DataFrame, height: int, width: int, order: str, value: str = "value", levels: int = 4, least: int = 512) -> DataFrame:
    """Sparse rasters of the levels after the first: one pixel a cell, the last row wins."""
    sizes = level_sizes(height, width, levels, least)
    if not sizes:
        return cells.sparkSession.createDataFrame([], "level int, py long, px long, value int")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(s).alias("s"), F.lit(h).alias("h"), F.lit(w).alias("w")) for i, (s, h, w) in enumerate(sizes, 1)]))
    spread = cells.select(nearest_pixel(F.col("y"), height).alias("gy"), nearest_pixel(F.col("x"), width).alias("gx"), value, order, each.alias("l"))

    def down(g: str, side: str) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.floor(F.col(g) / F.col("l.s")), F.col(f"l.{side}") - 1))

    at = spread.select(F.col("l.level").alias("level"), down("gy", "h").alias("py"), down("gx", "w").alias("px"), value, order)
    return at.groupBy("level", "py", "px").agg(F.max_by(value, order).alias(value))
