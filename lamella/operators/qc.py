"""Quality control of slides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import quantiles


def correlation(wide: DataFrame, channels: list[str]) -> DataFrame:
    """Pearson correlation of every two channel columns over all pixels, in one pass; null where one is constant."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]

    def corr(a: str, b: str):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        s = F.stddev_pop(x) * F.stddev_pop(y)
        return F.covar_pop(x, y) / F.nullif(s, F.lit(0.0))

    one = wide.agg(*[corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for p, q in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"__{i}").alias("r")))
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.a", "s.b", "s.r")


def crosstalk(corr: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Least and greatest correlation, and the mean absolute one off the diagonal over all C^2 cells and over those off it."""
    off = F.sum(F.when(F.col("a") != F.col("b"), F.abs("r")).otherwise(0.0))
    return corr.groupBy(*by).agg(
        F.min("r").alias("min"), F.max("r").alias("max"), (off / F.count("*")).alias("mean_abs_offdiag"),
        (off / F.nullif(F.count_if(F.col("a") != F.col("b")), F.lit(0))).alias("mean_abs_offdiag_strict"),
    )


def drift_summary(fields: DataFrame, by: list[str]) -> DataFrame:
    """Greatest and mean length of drift vectors (``dx, dy``); 0.0 without any."""
    d = F.hypot("dx", "dy")
    return fields.groupBy(*by).agg(F.coalesce(F.max(d), F.lit(0.0)).alias("max_px"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_px"))


def drop_ratio(raw, corrected):
    """Relative drop of a median after correction."""
    return (raw - corrected) / (raw + 1e-8)


def histogram(df: DataFrame, column: str, bins: int = 64, by: list[str] | None = None) -> DataFrame:
    """Counts of equal bins between each group's extremes, the last one closed."""
    by = by or []
    x = F.col(column)
    ends = df.groupBy(*by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    both = df.join(ends, by) if by else df.join(F.broadcast(ends))  # one row
    at = F.when(F.col("__hi") <= F.col("__lo"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((x - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * bins))
    )
    return both.withColumn("bin", at.cast("int")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def low_quality(tiles: DataFrame, column: str, share: float = 0.2) -> DataFrame:
    """The threshold below which that share of the tiles lies (interpolated), and the share strictly below it."""
    cut = quantiles(tiles, column, [share]).select(F.col("q")[0].alias("threshold"))
    return (
        tiles.join(F.broadcast(cut))  # one row
        .groupBy("threshold")
        .agg(F.avg((F.col(column) < F.col("threshold")).cast("double")).alias("low_quality_ratio"))
    )


# ---- Kernels on one tile


def unit(image: np.ndarray) -> np.ndarray:
    """To [0, 1]; zeros where the range is under 1e-6."""
    low, high = float(image.min()), float(image.max())
    return np.zeros_like(image) if high - low < 1e-6 else (image - low) / (high - low)


def eight_bit(image: np.ndarray) -> np.ndarray:
    return (unit(image) * 255).astype(np.uint8)


def folded(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a short kernel along an axis; the border is mirrored without its own row."""
    r = len(kernel) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r, r)
    p = np.pad(image, pad, mode="reflect" if image.shape[axis] > r else "edge")
    n = image.shape[axis]
    return sum(k * np.take(p, range(i, i + n), axis=axis) for i, k in enumerate(kernel))


def blur(image: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    return folded(folded(image.astype(float), k, 0), k, 1)


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Canny edges (0 or 255) of the normalised, blurred 8-bit image: ridges of the gradient above ``low`` that reach one above ``high``."""
    smooth = np.rint(blur(eight_bit(image), 1.2, 4))
    slope, mean = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    gx, gy = folded(folded(smooth, slope, 1), mean, 0), folded(folded(smooth, slope, 0), mean, 1)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    sector = [(angle < 22.5) | (angle >= 157.5), (angle >= 22.5) & (angle < 67.5), (angle >= 67.5) & (angle < 112.5)]
    before = np.select(sector, [at(0, -1), at(-1, -1), at(-1, 0)], at(-1, 1))
    after = np.select(sector, [at(0, 1), at(1, 1), at(1, 0)], at(1, -1))
    ridge = (size > before) & (size >= after) & (size > low)
    found = ridge & (size > high)
    while True:
        q = np.pad(found, 1)
        grown = ridge & np.logical_or.reduce([q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == found).all():
            return found.astype(np.float32) * 255
        found = grown


def sharpness(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of the normalised 8-bit image."""
    x, k = eight_bit(image).astype(float), np.array([1.0, -2.0, 1.0])
    return float((folded(x, k, 0) + folded(x, k, 1)).var())


def phase_drift(ref: np.ndarray, moved: np.ndarray, upsample: int = 10) -> tuple[float, float]:
    """Shift (dy, dx) that takes ``moved`` onto ``ref``, to 1 / ``upsample`` of a pixel.

    The peak of the cross power spectrum gives whole pixels; the spectrum is
    then summed at the finer steps within 0.75 pixels of it only.
    """
    product = np.fft.fft2(ref) * np.conj(np.fft.fft2(moved))
    product /= np.maximum(np.abs(product), 100 * np.finfo(float).eps)
    peak = np.array(np.unravel_index(np.abs(np.fft.ifft2(product)).argmax(), ref.shape), float)
    size = np.array(ref.shape)
    peak[peak > size // 2] -= size[peak > size // 2]
    if upsample > 1:
        reach = int(np.ceil(0.75 * upsample))
        near = np.arange(-reach, reach + 1) / upsample
        wave = [np.exp(2j * np.pi * np.outer(peak[a] + near, np.fft.fftfreq(size[a]))) for a in (0, 1)]
        fine = np.abs(wave[0] @ product @ wave[1].T)
        best = np.unravel_index(fine.argmax(), fine.shape)
        peak = np.round((peak + near[list(best)]) * upsample) / upsample
    peak[size == 1] = 0.0
    return float(peak[0]) + 0.0, float(peak[1]) + 0.0


def top_hat(image: np.ndarray, radius: int = 10) -> np.ndarray:
    """The image less its opening by a disk; pixels beyond the border count for nothing."""
    r = np.arange(-radius, radius + 1)
    reach = [(int(dy), int(np.sqrt(radius * radius - dy * dy))) for dy in r]

    def sweep(a: np.ndarray, fold, edge: float) -> np.ndarray:
        h, w = a.shape
        p, out = np.pad(a, radius, constant_values=edge), np.full(a.shape, edge)
        for dy, dx in reach:  # a disk is a row of each width; a window's extreme comes from windows half as wide
            row, n, need = p[radius + dy : radius + dy + h], 1, 2 * dx + 1
            while 2 * n <= need:
                row, n = fold(row[:, :-n], row[:, n:]), 2 * n
            if n < need:
                row = fold(row[:, : row.shape[1] - (need - n)], row[:, need - n :])
            out = fold(out, row[:, radius - dx : radius - dx + w])
        return out

    return image - sweep(sweep(image, np.minimum, np.inf), np.maximum, -np.inf)


def overlay(ref: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Edges of two channels as red and blue, their mean as green."""
    r, c = unit(edges(ref)), unit(edges(other))
    return np.clip(np.stack([c, 0.5 * (r + c), r], axis=-1), 0.0, 1.0)


# ---- Operators on tiles with all their channels (``image_id, tile_y, tile_x, h, w, channels, planes``)


def images_of(row) -> dict[int, np.ndarray]:
    return {int(c): np.asarray(p, np.float64).reshape(int(row.h), int(row.w)) for c, p in zip(row.channels, row.planes)}


def top_hats(tiles: DataFrame, channel: int, radius: int = 10) -> DataFrame:
    """``image_id, tile_y, tile_x, total, most``: sum and greatest value of the top-hat of a channel in every tile.

    Tiles without the channel, and those with an error, have nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                image = images_of(t).get(channel) if t.planes is not None and not t.error else None
                rest = top_hat(image, radius) if image is not None else None
                rows.append((t.image_id, t.tile_y, t.tile_x, *((float(rest.sum()), float(rest.max())) if rest is not None else (None, None))))
            yield pd.DataFrame(rows, columns=["image_id", "tile_y", "tile_x", "total", "most"])

    return tiles.select("image_id", "tile_y", "tile_x", "h", "w", "channels", "planes", "error").mapInPandas(run, "image_id string, tile_y long, tile_x long, total double, most double")


def measured(tiles: DataFrame, reference: int) -> DataFrame:
    """One pass over the pixels: ``drift``, ``products`` (of channels) and the reference's ``sharpness`` of every tile.

    Nothing but these numbers leaves a tile. A tile that fails, or lacks the
    reference channel, has an ``error``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                try:
                    images = images_of(t)
                    ref = images[reference]
                    drift = [(c, y + 0.0, x + 0.0) for c, m in images.items() for y, x in [phase_drift(ref, m)]]
                    x = np.stack([m.ravel() for m in images.values()])
                    mean, names = x.mean(axis=1), list(images)
                    c = (x - mean[:, None]) @ (x - mean[:, None]).T
                    pairs = [(a, b, x.shape[1], mean[i], mean[j], c[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)]
                    rows.append((t.image_id, t.tile_y, t.tile_x, t.h, t.w, drift, pairs, sharpness(ref), t.error))
                except Exception as e:  # one bad tile must not end the job
                    rows.append((t.image_id, t.tile_y, t.tile_x, t.h, t.w, [], [], None, t.error or f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["image_id", "tile_y", "tile_x", "h", "w", "drift", "products", "sharpness", "error"])

    return tiles.select("image_id", "tile_y", "tile_x", "h", "w", "channels", "planes", "error").mapInPandas(
        run,
        "image_id string, tile_y long, tile_x long, h int, w int, drift array<struct<channel:int,dy:double,dx:double>>, "
        "products array<struct<a:int,b:int,n:long,mean_a:double,mean_b:double,c:double>>, sharpness double, error string",
    )


def drift_field(measures: DataFrame) -> DataFrame:
    """Drift vectors at tile centres: ``image_id, channel, cy, cx, dy, dx``."""
    rows = measures.select("image_id", (F.col("tile_y") + F.col("h") / 2).alias("cy"), (F.col("tile_x") + F.col("w") / 2).alias("cx"), F.explode("drift").alias("d"))
    return rows.select("image_id", "d.channel", "cy", "cx", "d.dy", "d.dx")


def correlation_of_products(products: DataFrame, by: list[str]) -> DataFrame:
    """Pearson correlation of every two channels from sums (``a, b, n, mean_a, mean_b, c``) of parts; null where one is constant."""
    n, x, y = F.sum("n"), F.sum(F.col("n") * F.col("mean_a")), F.sum(F.col("n") * F.col("mean_b"))
    whole = products.groupBy(*by, "a", "b").agg((F.sum("c") + F.sum(F.col("n") * F.col("mean_a") * F.col("mean_b")) - x * y / n).alias("c"))
    own = whole.where("a = b").select(*by, F.col("a").alias("__k"), F.col("c").alias("__v"))
    left = own.withColumnsRenamed({"__k": "a", "__v": "__va"})
    right = own.withColumnsRenamed({"__k": "b", "__v": "__vb"})
    both = whole.join(left, [*by, "a"]).join(right, [*by, "b"])
    spread = F.sqrt(F.greatest(F.col("__va"), F.lit(0.0)) * F.greatest(F.col("__vb"), F.lit(0.0)))
    return both.select(*by, "a", "b", (F.col("c") / F.nullif(spread, F.lit(0.0))).alias("r"))


def channel_correlation(measures: DataFrame) -> DataFrame:
    return correlation_of_products(measures.select("image_id", F.explode("products").alias("p")).select("image_id", "p.*"), ["image_id"])


def levels(tiles: DataFrame, channel: int, halo: int = 0, tile: int = 0, radius: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """``image_id, value, n``: how often each pixel value occurs in a channel's tiles (one row a channel, ``pixels``).

    With a ``radius`` the values are those of the normalised image's top-hat
    (``ends``: each image's ``lo, hi``); tiles then carry a ``halo`` of 2 radii
    and only their inner part counts, so it is the top-hat of the whole image.
    Scanners give 2^16 values at most, which is what an image's rows come to.
    """
    own = tiles.where(F.col("channel") == channel).where(F.col("error").isNull())
    own = own.join(ends, "image_id") if ends is not None else own.withColumns({"lo": F.lit(0.0), "hi": F.lit(0.0)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                x = np.asarray(t.pixels, np.float64).reshape(t.h, t.w)
                if radius is not None:
                    x = top_hat(np.zeros_like(x) if t.hi - t.lo < 1e-6 else (x - t.lo) / (t.hi - t.lo), radius)
                top, left = min(halo, t.tile_y), min(halo, t.tile_x)
                inner = x[top : top + tile, left : left + tile] if tile else x
                values, counts = np.unique(np.round(inner, 9), return_counts=True)
                yield pd.DataFrame({"image_id": t.image_id, "value": values, "n": counts})

    got = own.select("image_id", "tile_y", "tile_x", "h", "w", "pixels", "lo", "hi").mapInPandas(run, "image_id string, value double, n long")
    return got.groupBy("image_id", "value").agg(F.sum("n").alias("n"))


def level_stats(counts: DataFrame, by: list[str]) -> DataFrame:
    """``lo, hi, median`` of each group's values, from their counts: numpy's median, the mean of the two middle ones."""
    w = W.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    told = counts.withColumns({"__upto": upto, "__all": F.sum("n").over(w)})
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col("value")))
    half = F.col("__all") / 2
    return told.groupBy(*by).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), ((at(F.ceil(half) - 1) + at(F.floor(half))) / 2).alias("median")
    )


def level_histogram(counts: DataFrame, stats: DataFrame, by: list[str], bins: int = 64) -> DataFrame:
    """Counts of equal bins between each group's extremes, the last one closed, from counts of values."""
    both = counts.join(stats.select(*by, "lo", "hi"), by)
    at = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins))
    )
    return both.groupBy(*by, at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def quality(measures: DataFrame, share: float = 0.2) -> DataFrame:
    """``image_id, threshold, low_quality_ratio`` from each tile's sharpness."""
    cut = measures.groupBy("image_id").agg(F.percentile("sharpness", F.lit(share)).alias("threshold"))
    low = (F.col("sharpness") < F.col("threshold")).cast("double")
    return measures.join(cut, "image_id").groupBy("image_id", "threshold").agg(F.avg(low).alias("low_quality_ratio"))


def overlays(tiles: DataFrame, reference: int) -> DataFrame:
    """Edge overlays of every channel on the reference: ``image_id, tile_y, tile_x, channel, h, w, rgb`` (0 to 1, three a pixel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                images = images_of(t)
                rows = [(t.image_id, t.tile_y, t.tile_x, c, t.h, t.w, overlay(images[reference], m).astype(np.float32).ravel()) for c, m in images.items() if reference in images]
                yield pd.DataFrame(rows, columns=["image_id", "tile_y", "tile_x", "channel", "h", "w", "rgb"])

    whole = tiles.where(F.col("error").isNull()).select("image_id", "tile_y", "tile_x", "h", "w", "channels", "planes")
    return whole.mapInPandas(run, "image_id string, tile_y long, tile_x long, channel int, h int, w int, rgb array<float>")


def tile_quality(tiles: DataFrame) -> DataFrame:
    """Append each tile's ``sharpness`` (``h, w, pixels``), one tile at a time."""

    def run(batches):
        for pdf in batches:
            got = [sharpness(np.asarray(p, np.float64).reshape(h, w)) for h, w, p in zip(pdf["h"], pdf["w"], pdf["pixels"])]
            yield pdf.drop(columns="pixels").assign(sharpness=got)

    schema = ", ".join(f"`{c}` {t}" for c, t in tiles.dtypes if c != "pixels")
    return tiles.mapInPandas(run, f"{schema}, sharpness double")


def report(drift: DataFrame, cross: DataFrame, quality: DataFrame, shapes: DataFrame, af: DataFrame | None = None) -> DataFrame:
    """One row an image: ``file, shape, drift`` (by channel), ``crosstalk, af, quality``.

    ``drift`` has ``image_id, channel, max_px, mean_px``, ``cross`` the summary
    of ``crosstalk``, ``af`` ``median_raw, median_corrected, median_drop_ratio``.
    """
    by = drift.groupBy("image_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", F.struct("max_px", "mean_px"))))).alias("drift"))
    summary = F.struct(F.struct("min", "max", "mean_abs_offdiag").alias("matrix_summary")).alias("crosstalk")
    out = shapes.select(F.col("image_id"), F.col("image_id").alias("file"), F.array("n_channels", "height", "width").alias("shape"))
    out = out.join(by, "image_id", "left").join(cross.select("image_id", summary), "image_id", "left")
    if af is not None:
        out = out.join(af.select("image_id", F.struct("median_raw", "median_corrected", "median_drop_ratio").alias("af")), "image_id", "left")
    return out.join(quality.select("image_id", F.struct("threshold", "low_quality_ratio").alias("quality")), "image_id", "left").drop("image_id")
