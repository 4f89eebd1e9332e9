"""The path from tiles to clustered cells as lazy frames, and what it writes."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, export, features, segment

Step = Callable[[DataFrame], DataFrame]
TILE = ["image_id", "tile_y", "tile_x"]


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    """Apply steps in order."""
    for step in steps:
        df = df.transform(step)
    return df


@dataclass
class Result:
    """Frames of a run; nothing but k-means' passes has been computed yet. ``close`` frees what is kept of them."""

    tiles: DataFrame
    failed: DataFrame
    nuclei: DataFrame
    features: DataFrame
    matrix: DataFrame
    clustered: DataFrame | None = None
    kept: tuple[DataFrame, ...] = ()

    def counts(self) -> DataFrame:
        """Cells, tiles, failures and whether no tile was good, by image; one that can't be opened has a failure and no tile."""
        t = self.tiles.groupBy("image_id").agg(F.count("tile_y").alias("n_tiles"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.count_if(F.col("error").isNull()).alias("__good"))
        c = self.matrix.groupBy("image_id").agg(F.count("*").alias("n_cells"))
        return t.withColumn("failed", F.col("__good") == 0).drop("__good").join(c, "image_id", "left").na.fill(0, ["n_cells"])

    def totals(self) -> DataFrame:
        """One row: images, those processed and failed (not to be opened, or every tile failed), tiles and cells."""
        return self.counts().agg(
            F.count("*").alias("images"), F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("failed"),
            F.coalesce(F.sum("n_tiles"), F.lit(0)).alias("tiles"), F.coalesce(F.sum("n_cells"), F.lit(0)).alias("cells"),
        )

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()

    def write(self, folder: str) -> dict[str, str]:
        """CSV tables below ``folder``: features, matrix, nuclei and clusters; without a nucleus or cluster there is no such table."""
        place = lambda name: os.path.join(folder, name)
        matrix = place("features_matrix_mean.csv")
        tables = {
            place("features_long.csv"): self.features.select("image_id", *features.LONG),
            matrix: self.matrix,
            place("nuclei_centroids.csv"): self.nuclei.select("image_id", "global_x", "global_y", "tile_x", "tile_y", "local_x", "local_y"),
        }
        if self.clustered is not None:
            parts = F.col("pca")
            n = len(self.clustered.select("pca").head()[0])
            tables[export.cluster_path(matrix)] = self.clustered.select("*", *[parts[i].alias(f"pca_{i + 1}") for i in range(n)]).drop("id", "pca")
        return {os.path.basename(p): p for p, df in tables.items() if export.write_csv(df, p, empty="nuclei" not in p)}


def stacked(slides: DataFrame) -> DataFrame:
    """Tiles with all their channels in one row: what ``layout=stack`` reads, or rows of single channels brought together."""
    if "planes" in slides.columns:
        return slides
    one = F.array_sort(F.collect_list(F.struct("channel", "pixels")))
    error = F.max("error") if "error" in slides.columns else F.lit(None).cast("string")
    return (
        slides.groupBy(*TILE, "h", "w").agg(one.alias("s"), error.alias("error"))
        .select(*TILE, "h", "w", F.col("s.channel").alias("channels"), F.col("s.pixels").alias("planes"), "error")
    )


def run(
    slides: DataFrame,
    nucleus_channel: int,
    channels: dict[int, str],
    segmenter: Callable[[np.ndarray], np.ndarray] = segment.threshold_segmenter,
    done: DataFrame | None = None,
    k: int | None = None,
    seed: int = 42,
) -> Result:
    """Segment, measure and cluster tiles of ``slides`` rows, leaving out the images in ``done``.

    Labels are put beside the channels of their tile and cells are measured
    there; what leaves a tile is a row for each cell and channel. A slide that
    can't be opened, and a tile that can't be read or segmented, is in
    ``failed`` and ends nothing else.
    """
    todo = slides.join(done, "image_id", "left_anti") if done is not None else slides
    labelled = segment.segment(stacked(todo), segmenter, nucleus_channel)
    good = labelled.where(F.col("error").isNull())
    long = features.measure(good, channels).persist()
    tiles = labelled.select(*TILE, "error")
    matrix = features.matrix(long, list(channels.values()), by=("image_id",))
    out = Result(
        tiles=tiles,
        failed=tiles.where(F.col("error").isNotNull()),
        nuclei=segment.cells_of_tiles(good),
        features=long,
        matrix=matrix,
        kept=(long,),
    )
    n = matrix.count()
    if n >= 2:
        out.clustered = clustered(matrix.withColumn("id", F.concat_ws("/", "image_id", "cell_id")), list(channels.values()), n, k, seed)
    return out


def clustered(cells: DataFrame, columns: list[str], n: int, k: int | None = None, seed: int = 42) -> DataFrame:
    """``cells`` (with a unique ``id``) with ``cluster, confidence`` and ``pca``: z-scores, components, k-means."""
    points = cluster.zscore(cluster.vectors(cells, "id", columns))
    scores, _ = cluster.pca(points, min(20, n, len(columns)))
    labels = cluster.kmeans(scores, cluster.auto_k(n, k), seed)[0].select("id", "cluster", "confidence", F.col("v").alias("pca"))
    return cells.join(labels, "id")
