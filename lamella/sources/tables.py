"""Readers of feature tables, sidecars and image listings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean, tile_of_name
from .codecs import decode_png

IMAGES = (".qptiff", ".qptif", ".tif", ".tiff")
#: Columns of a matrix that are no numbers, in any case of letters.
TEXT = ("cell_id", "image_id", "source_csv", "__source_csv", "sample")
CLUSTER_COLUMNS = ("tile_x", "tile_y", "local_x", "local_y", "cluster")
CLUSTER_SCHEMA = "cell_id string, tile_x double, tile_y double, label long, local_x double, local_y double, cluster int"


class MissingColumns(ValueError):
    """A table lacks columns that it needs."""


def require(df: DataFrame, columns: tuple[str, ...], any_case: bool = False) -> DataFrame:
    """``df``, if it has all of ``columns``; in any case, renamed to them."""
    have = {(c.lower() if any_case else c): c for c in df.columns}
    missing = [c for c in columns if c not in have]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df.select([F.col(f"`{have[c]}`").alias(c) for c in columns]) if any_case else df


def images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """Image files below ``root`` by path, listed without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | F.lower("path").endswith(s)
    return files.where(fits).orderBy("path")


def label_tiles(spark: SparkSession, root: str) -> DataFrame:
    """Label rasters below ``root`` (``roi_label_<x>_<y>.png``, not the coloured ones), by tile row and column."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("name", name)
    return (
        files.where(F.col("name").startswith("roi_label_") & F.lower("name").endswith(".png") & ~F.col("name").contains("colored"))
        .withColumns({"tile_x": tile_of_name(F.col("name"), 1), "tile_y": tile_of_name(F.col("name"), 2)})
        .orderBy("tile_y", "tile_x")
    )


def matrix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A feature matrix; give the schema where it is known, else it is inferred in a pass of its own."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def clustered_cells(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A clustered table's coordinates and clusters; a malformed value raises, or drops its row if not ``strict``."""
    raw = require(spark.read.option("header", True).csv(path), CLUSTER_COLUMNS, any_case=True)
    cast = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: F.col(c).try_cast(t))
    out = raw.select(*[cast(c, "double").alias(c) for c in CLUSTER_COLUMNS[:4]], cast("cluster", "int").alias("cluster"))
    return out if strict else out.dropna()


def cohort(spark: SparkSession, root: str, name: str = "features_matrix_mean.csv") -> DataFrame:
    """All matrices named ``name`` below ``root`` by column name; what a file lacks is 0.0. ``source_csv`` says whence.

    Headers are read in one pass; files of one header are one scan, so there
    are as many plans as headers. Empty files and those that can't be read are
    left out (``unread``); numbers that are none count as missing.
    """
    heads = headers(spark, root, name).where("header <> ''").groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    parts = []
    for header, paths in heads.orderBy("header").collect():  # a header with its paths
        columns = [c.strip().strip('"') for c in header.split(",")]
        schema = ", ".join(f"`{c}` string" for c in columns)
        rows = spark.read.option("header", True).option("ignoreCorruptFiles", True).schema(schema).csv(paths)
        typed = [F.col(f"`{c}`") if c.lower() in TEXT else F.col(f"`{c}`").try_cast("double").alias(c) for c in columns]
        parts.append(rows.select(*typed, F.col("_metadata.file_path").alias("source_csv")))
    if not parts:
        raise FileNotFoundError(f"no {name} below {root}")
    return united(parts)


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; numbers that a part lacks, or that are none, are 0.0."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.withColumns({c: clean(F.col(f"`{c}`")) for c, t in out.dtypes if t == "double"})


def headers(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``path, header`` of the text files named ``name`` below ``root``: their first line."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("ignoreCorruptFiles", True).text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        .where("block = 0").withColumn("n", F.monotonically_increasing_id())
    )
    return lines.groupBy("path").agg(F.min_by("value", "n").alias("header"))


def unread(spark: SparkSession, root: str, name: str = "features_matrix_mean.csv") -> DataFrame:
    """Paths of the files named ``name`` below ``root`` that give ``cohort`` no header (Spark itself lists no files of length zero)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    good = headers(spark, root, name).where("header <> ''").select(plain("path").alias("__path"))
    return files.withColumn("__own", plain("path")).join(good, F.col("__own") == F.col("__path"), "left_anti").drop("__own")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` files (``#`` comments): ``path, meta`` (a map, later lines win) and ``band_names`` without empty names.

    A line without ``=`` is a key with an empty value.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"), F.monotonically_increasing_id().alias("n"))
    parts = F.split("line", "=", 2)
    pairs = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).select(
        "path", "n", F.trim(parts[0]).alias("key"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("value")
    )
    last = pairs.groupBy("path", "key").agg(F.max_by("value", "n").alias("value"))
    names = F.split(F.try_element_at(F.col("meta"), F.lit("BandNames")), ",")
    return (
        last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))
        .withColumn("band_names", F.when(F.map_contains_key("meta", "BandNames"), F.filter(F.transform(names, lambda b: F.trim(b)), lambda b: b != "")))
    )


def bands_by_position(images: DataFrame, names: str, planes: str) -> DataFrame:
    """``pos, band`` of the planes of images that have as many names as planes; the others have no rows."""
    return images.where(F.size(names) == F.col(planes)).select("*", F.posexplode(names).alias("pos", "band")).drop(names, planes)


def labels(tiles: DataFrame) -> DataFrame:
    """Label PNGs (``content``) as ``h, w, labels``; what is no grey PNG has an ``error`` and no labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    image = decode_png(bytes(content))
                    if image.ndim != 2:
                        raise ValueError("labels have one sample a pixel")
                    rows.append((*image.shape, image.astype(np.int32).ravel(), None))
                except Exception as e:  # one bad file must not end the job
                    rows.append((0, 0, None, f"{type(e).__name__}: {e}"[:200]))
            yield pdf.drop(columns="content").assign(**{c: [r[i] for r in rows] for i, c in enumerate(("h", "w", "labels", "error"))})

    kept = [f"`{c}` {t}" for c, t in tiles.dtypes if c != "content"]
    return tiles.mapInPandas(run, ", ".join([*kept, "h int, w int, labels array<int>, error string"]))


def pictures(tiles: DataFrame) -> DataFrame:
    """PNGs (``content``) as ``h, w, pixels`` of three samples; grey ones are repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [decode_png(bytes(c)) for c in pdf["content"]]
            images = [np.repeat(i[..., None], 3, axis=2) if i.ndim == 2 else i[..., :3] for i in images]
            yield pdf.drop(columns="content").assign(h=[i.shape[0] for i in images], w=[i.shape[1] for i in images], pixels=[i.astype(np.int32).ravel() for i in images])

    kept = [f"`{c}` {t}" for c, t in tiles.dtypes if c != "content"]
    return tiles.mapInPandas(run, ", ".join([*kept, "h int, w int, pixels array<int>"]))


def first_image(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """The first image below ``root`` by path (a row, or none)."""
    return images(spark, root, suffixes).limit(1)


def folders(images: DataFrame, rois: DataFrame, name: str = "image_id") -> DataFrame:
    """Images with their ROI folder by name: ``n_tiles`` and ``status``, ``failed`` for images without one."""
    n = rois.groupBy(name).agg(F.count("*").alias("__n"))
    status = F.when(F.col("__n") > 0, "found").otherwise("failed")
    return images.join(n, name, "left").withColumns({"n_tiles": F.coalesce("__n", F.lit(0)).cast("long"), "status": status}).drop("__n")


def todo(images: DataFrame, outputs: DataFrame, needs: tuple[str, ...], name: str = "image_id") -> DataFrame:
    """Images that lack one of the outputs ``needs`` (kinds in ``outputs``: ``name, kind``): those that a resumed run still does."""
    have = outputs.where(F.col("kind").isin(*needs)).groupBy(name).agg(F.count_distinct("kind").alias("__n")).where(F.col("__n") == len(needs))
    return images.join(have, name, "left_anti")


def present(groups: DataFrame, files: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups that have a file, and those that don't."""
    keys = files.select(*by)
    return groups.join(keys, by, "left_semi"), groups.join(keys, by, "left_anti")
