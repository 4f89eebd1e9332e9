"""Whole runs: quality control of slides, and the path from tables of many slides to clusters, maps and points."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ranks import quantiles
from ..operators import cluster, export, features, qc, segment
from ..sources import panels, slides, tables
from .. import plugins
from . import pipeline


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    slides.register(spark)
    return spark.read.format("slides").options(path=path, **{**plugins.codec_options(), **options}).load()


def quality_control(
    spark: SparkSession,
    path: str,
    panel: list[tuple] | None = None,
    tile: int = 512,
    reference: str | None = None,
    max_tiles: int = 0,
    radius: int = 10,
    level: str = "full",
) -> dict[str, DataFrame]:
    """Tables of a quality control of all slides below ``path``, each image apart.

    ``drift`` (vectors), ``drift_summary``, ``correlation``, ``crosstalk``,
    ``quality``, ``failed``, and with ``level="full"`` and an autofluorescence
    channel ``af`` and ``af_histogram`` (raw and corrected); ``report`` has one
    row an image. ``reference`` names the channel that drifts are against,
    else it is the nuclear one. ``level="off"`` gives nothing.
    """
    if level == "off":
        return {}
    spec = panel or panels.PANELS[panels.DEFAULT]
    names = F.create_map(*[F.lit(x) for c in spec for x in (c[0], c[1])])
    ref = next((c[0] for c in spec if c[1] == reference), None) or next((c[0] for c in spec if c[4]), 1)
    af = next((c[0] for c in spec if c[5]), None)
    options = {"tile": str(tile), "effective": "true", "channels": ",".join(str(c[0]) for c in spec)}
    shapes = read(spark, path, metadata="true")
    whole = qc.measured(read(spark, path, layout="stack", **options), ref).persist()
    sampled = qc.measured(read(spark, path, layout="stack", max_tiles=str(max_tiles), **options), ref) if max_tiles else whole
    named = lambda df, *at: df.withColumns({c: F.coalesce(F.try_element_at(names, F.col(c)), F.col(c).cast("string")) for c in at})
    out = {"drift": named(qc.drift_field(sampled.where("error is null")), "channel")}
    out["drift_summary"] = qc.drift_summary(out["drift"], ["image_id", "channel"])
    out["correlation"] = named(qc.channel_correlation(whole.where("error is null")), "a", "b")
    out["crosstalk"] = qc.crosstalk(out["correlation"], ("image_id",))
    out["quality"] = qc.quality(whole.where("error is null"))
    out["failed"] = whole.where("error is not null").select("image_id", "tile_y", "tile_x", "error")
    if af and level == "full":
        one = {"tile": str(tile), "channels": str(af)}
        raw = qc.levels(read(spark, path, **one), af)
        ends = qc.level_stats(raw, ["image_id"])
        bent = qc.levels(read(spark, path, halo=str(2 * radius), **one), af, 2 * radius, tile, radius, ends.select("image_id", "lo", "hi"))
        both = raw.withColumn("kind", F.lit("raw")).unionByName(bent.withColumn("kind", F.lit("corrected")))
        stats = qc.level_stats(both, ["image_id", "kind"])
        out["af_histogram"] = qc.level_histogram(both, stats, ["image_id", "kind"])
        share = C.unit_scale(F.col("median"), F.col("lo"), F.col("hi"))
        wide = stats.groupBy("image_id").agg(*[F.max(F.when(F.col("kind") == k, share)).alias(f"median_{k}") for k in ("raw", "corrected")])
        out["af"] = wide.withColumn("median_drop_ratio", qc.drop_ratio(F.col("median_raw"), F.col("median_corrected")))
    out["report"] = qc.report(out["drift_summary"], out["crosstalk"], out["quality"], shapes.where("error is null"), out.get("af"))
    return out


def write_report(tables_: dict[str, DataFrame], folder: str) -> None:
    """``qc_report`` (a JSON object a line and image) and the tables behind it, below ``folder``."""
    for name, df in tables_.items():
        if name == "report":
            df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(os.path.join(folder, "qc_report.json"))
        else:
            df.write.mode("overwrite").parquet(os.path.join(folder, name))


def sampled_features(
    spark: SparkSession,
    path: str,
    folder: str,
    channels: dict[int, str],
    nucleus_channel: int = 1,
    n: int = 5,
    tile: int = 512,
    segmenter: Callable[[np.ndarray], np.ndarray] = segment.threshold_segmenter,
    seed: int = 42,
) -> DataFrame:
    """Matrices of ``n`` tiles of each slide, chosen by hash, below ``<folder>/outputs/sample=<image>/tile=<x>_<y>``.

    Only the chosen tiles are read. Gives ``image_id, tile_x, tile_y, n_cells``
    of the tiles with cells.
    """
    some = read(spark, path, layout="stack", tile=str(tile), sample=str(n), seed=str(seed))
    labelled = segment.segment(some, segmenter, nucleus_channel).where("error is null")
    cells = features.matrix(features.measure(labelled, channels), list(channels.values()), by=("image_id",))
    own = cells.withColumns({"sample": F.col("image_id"), "tile": F.concat_ws("_", "tile_x", "tile_y")})
    own.write.partitionBy("sample", "tile").option("header", True).csv(os.path.join(folder, "outputs"))
    return tables.cohort(spark, os.path.join(folder, "outputs"), "*.csv").groupBy(
        "image_id", F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y")
    ).agg(F.count("*").alias("n_cells"))


def cluster_cohort(
    spark: SparkSession, root: str, output: str | None = None, k: int | None = None, seed: int = 42, name: str = "features_matrix_mean.csv"
) -> DataFrame:
    """All matrices ``name`` below ``root`` clustered together, each row with its ``source_csv`` and ``sample``; written if there is an ``output``."""
    sample = F.regexp_replace(C.sample_of(F.col("source_csv")), "^sample=", "")
    cells = tables.cohort(spark, root, name).withColumn("sample", sample)
    columns = cluster.feature_columns(cells)
    told = cells.withColumn("id", F.concat_ws("/", "source_csv", "cell_id"))
    out = pipeline.clustered(told, columns, told.count(), k, seed).drop("id")
    if output:
        n = len(out.select("pca").head()[0])
        wide = out.select("*", *[F.col("pca")[i].alias(f"pca_{i + 1}") for i in range(n)]).drop("pca")
        export.write_csv(wide, export.combined_path(root, output))
    return out


def cluster_table(spark: SparkSession, path: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """One matrix at ``path`` with clusters, written beside it as ``*_cluster.csv``."""
    cells = tables.matrix(spark, path)
    told = cells.withColumn("id", F.col("cell_id"))
    out = pipeline.clustered(told, cluster.feature_columns(cells), told.count(), k, seed).drop("id", "pca")
    export.write_csv(out, export.cluster_path(path))
    return out


def artifacts(cells: DataFrame, columns: list[str], most: float = 0.03) -> DataFrame:
    """Cells with ``artifact``: a value outside 1.5 interquartile ranges in most of the channels."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])).alias("e")
    told = quantiles(cells.select(each).select("e.at", "e.x"), "x", [0.25, 0.75], ["at"])
    reach = 1.5 * (F.col("q")[1] - F.col("q")[0])
    one = F.map_from_entries(F.collect_list(F.struct("at", F.struct((F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high")))))
    out, votes = cells.join(F.broadcast(told.agg(one.alias("__ends")))), F.lit(0)  # one row, with an entry a channel
    for i, c in enumerate(columns):
        ends = F.try_element_at(F.col("__ends"), F.lit(i))
        beyond = (F.col(f"`{c}`") < ends["low"]) | (F.col(f"`{c}`") > ends["high"])
        votes = votes + F.coalesce(beyond.cast("int"), F.lit(0))
    return out.withColumn("artifact", votes > len(columns) / 2).drop("__ends")


def final_table(result: pipeline.Result, channels: list[str], af: str | None = None) -> DataFrame:
    """Every cell of a run: names, global position, raw and ``z_`` channels, cluster, confidence, ``artifact`` and, with a channel ``af``, its fields.

    Without a clustering, cluster and confidence are null.
    """
    cells = result.clustered.drop("id", "pca") if result.clustered is not None else result.matrix
    for name, kind in (("cluster", "int"), ("confidence", "double")):
        cells = cells if name in cells.columns else cells.withColumn(name, F.lit(None).cast(kind))
    place = {f"global_{a}": C.to_global(F.col(f"tile_{a}"), F.col(f"local_{a}")) for a in "xy"}
    out = artifacts(features.with_normalised(cells, channels), channels).withColumns(place)
    if af:
        out = out.join(features.with_autofluorescence(result.features, af, ("image_id",)), ["image_id", *features.CELL], "left")
    return out


def autofluorescence_gain(cells: DataFrame, channels: list[str], af: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """Whether clusters of ``cells`` (with ``id``) are better with the autofluorescence channel among the features, by Calinski-Harabasz."""
    n = cells.count()
    told = [pipeline.clustered(cells, c, n, k, seed).select("id", F.col("pca").alias("v"), "cluster") for c in ([*channels, af], channels)]
    return cluster.gain(*told)
