"""Nuclei and cell regions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.graph import components
from ..functions.shared import cut
from .qc import blur

#: A cell reaches this many nucleus radii, and this share of the distance to the nearest nucleus at most.
SCALE, NEAREST = 1.8, 0.6
#: Halvings of the reach down to the finest grid on which nearest neighbours are looked for.
BITS = 26
#: Side of the blocks of pixels that are given to nuclei at once.
SIDE = 256


def areas(mask: np.ndarray) -> np.ndarray:
    """Labels of the 4-connected areas, numbered by their first pixel in row order: runs of rows, joined where they touch."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    (row, begin), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
    # Runs of the next row that overlap: those that end behind a run's begin and begin before its end.
    low = np.searchsorted(row * (w + 2) + end, (row + 1) * (w + 2) + begin, "right")
    high = np.searchsorted(row * (w + 2) + begin, (row + 1) * (w + 2) + end, "left")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(row)), n)
    j = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    root = np.arange(len(row))
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    while (root[root] != root).any():
        root = root[root]
    out = np.zeros((h, w), np.int32)
    out[mask.astype(bool)] = np.repeat(np.unique(root, return_inverse=True)[1] + 1, end - begin)
    return out


def threshold_segmenter(image: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Labels of the 4-connected areas brighter than ``least`` and the mean plus one standard deviation, in row order."""
    return areas(image > max(image.mean() + image.std(), least))


def parting(image: np.ndarray, bins: int = 256) -> float:
    """The level that parts an image's values into two classes with the greatest variance between them; the value of a flat image."""
    low, high = float(image.min()), float(image.max())
    if high <= low:
        return high
    counts, edges = np.histogram(image, bins, (low, high))
    middle = (edges[:-1] + edges[1:]) / 2
    below, sums = np.cumsum(counts), np.cumsum(counts * middle)
    above, rest = below[-1] - below, sums[-1] - sums
    between = np.where((below > 0) & (above > 0), below * above * (sums / np.maximum(below, 1) - rest / np.maximum(above, 1)) ** 2, 0)
    return float(edges[int(between.argmax()) + 1])


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Exact squared distance of each pixel of the mask to the nearest one outside it, in the image; without any, to its border."""
    h, w = mask.shape
    far = h + w
    if mask.all():
        y, x = np.ogrid[:h, :w]
        return np.minimum(np.minimum(y + 1, h - y), np.minimum(x + 1, w - x)).astype(np.int64) ** 2
    column = np.where(mask, far, 0).astype(np.int64)
    for y in range(1, h):
        np.minimum(column[y], column[y - 1] + 1, out=column[y])
    for y in range(h - 2, -1, -1):
        np.minimum(column[y], column[y + 1] + 1, out=column[y])
    column *= column
    out, k = column.copy(), 1
    while k < w and k * k < out.max():  # no column further away can be nearer
        np.minimum(out[:, k:], column[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], column[:, k:] + k * k, out=out[:, :-k])
        k += 1
    return out


def peaks(height: np.ndarray, rise: float) -> np.ndarray:
    """Labels of the tops that stand ``rise`` above every way to a higher one."""
    level = height - rise
    while True:
        grown = np.pad(level, 1, mode="edge")
        grown = np.maximum.reduce([grown[y : y + level.shape[0], x : x + level.shape[1]] for y in range(3) for x in range(3)])
        grown = np.minimum(grown, height)
        if (grown == level).all():
            break
        level = grown
    return areas(height - level >= rise - 1e-9)


def flooded(markers: np.ndarray, height: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Markers grown over the mask from the highest pixels to the lowest (whole numbers), first come, first served."""
    h, w = mask.shape
    wide = np.zeros((h + 2, w + 2), np.int32)
    wide[1:-1, 1:-1] = markers
    free = np.zeros((h + 2, w + 2), bool)
    free[1:-1, 1:-1] = mask & (markers == 0)
    levels = np.zeros((h + 2, w + 2), np.int64)
    levels[1:-1, 1:-1] = height
    label, open_, level = wide.ravel().tolist(), free.ravel().tolist(), levels.ravel().tolist()
    waiting: dict[int, list[int]] = {}
    for at in np.flatnonzero(wide).tolist():
        waiting.setdefault(level[at], []).append(at)
    order = sorted({*waiting, *np.unique(levels[free]).tolist()}, reverse=True)
    for now in order:
        queue = waiting.pop(now, [])
        for at in queue:  # grows as it is read
            for to in (at - w - 2, at - 1, at + 1, at + w + 2):
                if open_[to]:
                    open_[to], label[to] = False, label[at]
                    if level[to] >= now:
                        queue.append(to)
                    else:
                        waiting.setdefault(level[to], []).append(to)
    return np.array(label, np.int32).reshape(h + 2, w + 2)[1:-1, 1:-1]


def watershed_segmenter(image: np.ndarray, least: float = 0.0, rise: float = 1.0, smallest: int = 1) -> np.ndarray:
    """Labels of nuclei in row order, touching ones apart: areas above ``parting`` and ``least``, divided where they are narrow.

    Nuclei are the tops of the distance to the background that stand ``rise``
    pixels above the neck to a higher one; areas of fewer than ``smallest``
    pixels are dropped. An empty or flat tile has none.
    """
    image = np.asarray(image, np.float64)
    mask = image > max(parting(blur(image, 1.0, 3)), least) if image.size else np.zeros(image.shape, bool)
    if not mask.any():
        return np.zeros(image.shape, np.int32)
    square = squared_distance(mask)
    markers, whole = peaks(np.sqrt(square), rise) * mask, areas(mask)
    # An area without a top of that height is one nucleus.
    bare = np.setdiff1d(np.arange(1, whole.max() + 1), whole[markers > 0])
    lone = np.isin(whole, bare)
    markers = np.where(lone, markers.max() + whole, markers)
    out = flooded(markers, square, mask)
    ids, inverse, n = np.unique(out, return_inverse=True, return_counts=True)
    out = np.where(n[inverse].reshape(out.shape) >= smallest, out, 0)
    _, first, inverse = np.unique(out, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(first)] = np.arange(len(first))
    named = rank[inverse].reshape(out.shape)
    zero = named[out == 0][0] if (out == 0).any() else -1
    named = np.where(named < zero, named + 1, named) if zero >= 0 else named + 1  # in order of first pixels, 0 for none
    return np.where(out > 0, named, 0).astype(np.int32)


def prepared(image: np.ndarray, sigma: float = 1.0, background: int = 15, clip: float = 3.0) -> np.ndarray:
    """A nuclear image before segmentation: blurred, less its local background, and its histogram evened out (bounded contrast)."""
    smooth = blur(np.asarray(image, np.float64), sigma, max(1, round(3 * sigma)))
    x = np.clip(smooth - blur(smooth, background, 2 * background), 0, None)
    low, high = x.min(), x.max()
    if high - low < 1e-6:
        return np.zeros_like(x)
    byte = ((x - low) / (high - low) * 255).astype(np.uint8)
    counts = np.bincount(byte.ravel(), minlength=256).astype(float)
    most = clip * counts.mean()
    counts = np.minimum(counts, most) + np.maximum(counts - most, 0).sum() / 256
    return (np.cumsum(counts) / counts.sum())[byte]


def segment(tiles: DataFrame, segmenter: Callable[[np.ndarray], np.ndarray] = threshold_segmenter, channel: int | None = None) -> DataFrame:
    """Append ``labels`` and ``error`` to tiles; a tile that fails has an error and no labels.

    Tiles are rows of one channel (``h, w, pixels``), or of all (``h, w,
    channels, planes``) of which ``channel`` is segmented; the labels then
    stand beside the pixels that they label.
    """
    stacked = channel is not None

    def run(batches):
        for pdf in batches:
            labels, errors = [], []
            before = pdf["error"] if "error" in pdf else [None] * len(pdf)
            for i, (h, w, old) in enumerate(zip(pdf["h"], pdf["w"], before)):
                try:
                    if old:
                        raise OSError(old)
                    p = pdf["planes"].iloc[i][list(pdf["channels"].iloc[i]).index(channel)] if stacked else pdf["pixels"].iloc[i]
                    labels.append(segmenter(np.asarray(p, np.float64).reshape(int(h), int(w))).astype(np.int32).ravel())
                    errors.append(None)
                except Exception as e:  # one bad tile must not end the job
                    labels.append(None)
                    errors.append(old or f"{type(e).__name__}: {e}"[:200])
            yield pdf.assign(labels=labels, error=errors)

    base = tiles.drop("labels")
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes if c != "error")
    return base.mapInPandas(run, f"{schema}, labels array<int>, error string")


def cells_of_tiles(tiles: DataFrame) -> DataFrame:
    """Nuclei of labelled tiles: ``image_id, tile_x, tile_y, label, local_x, local_y, area, global_x, global_y`` from the labels alone."""

    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples():
                label = np.asarray(t.labels)
                n = np.bincount(label)
                y, x = np.divmod(np.arange(len(label)), t.w)
                ids = np.flatnonzero(n[1:]) + 1 if len(n) else np.zeros(0, int)
                cy, cx = (np.bincount(label, weights=v)[ids] / n[ids] if len(ids) else np.zeros(0) for v in (y, x))
                yield pd.DataFrame({
                    "image_id": t.image_id, "tile_x": t.tile_x, "tile_y": t.tile_y, "label": ids, "local_x": cx, "local_y": cy, "area": n[ids],
                    "global_x": cx + t.tile_x, "global_y": cy + t.tile_y,
                })

    schema = "image_id string, tile_x long, tile_y long, label long, local_x double, local_y double, area long, global_x double, global_y double"
    return tiles.select("image_id", "tile_x", "tile_y", "w", "labels").mapInPandas(run, schema)


def unique_labels(cells: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Append ``global_label``, unique and gapless over all tiles of an image, in order of tile and label.

    Labels are counted by tile; only these counts are summed up within an image.
    """
    n = cells.groupBy(*by, "tile_y", "tile_x").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*by).orderBy("tile_y", "tile_x").rowsBetween(W.unboundedPreceding, -1)
    before = n.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    own = F.row_number().over(W.partitionBy(*by, "tile_y", "tile_x").orderBy("label"))
    return cells.withColumn("__own", own).join(before, [*by, "tile_y", "tile_x"]).withColumn("global_label", F.col("__before") + F.col("__own")).drop("__own", "__before")


def merged_cells(tiles: DataFrame, tile: int, halo: int, share: float = 0.5) -> DataFrame:
    """``image_id, cell, area, global_x, global_y, sums`` of labelled tiles that carry a halo: cells across borders are one.

    ``tiles`` has ``image_id, tile_y, tile_x, h, w, planes, labels``, read with
    ``layout=stack`` and those ``tile`` and ``halo``. Two labels of neighbouring
    tiles are one cell if they share ``share`` of the smaller one's pixels in the
    overlap of the tiles; chains of them, too. Areas, centres and ``sums`` (of
    each plane) count every pixel once, in the tile that it belongs to. ``cell``
    is the first of a cell's ``tile_y/tile_x/label``. Only labels near borders
    leave a tile as pixels. Labels that have no pixel in any tile's own part
    don't count; an empty table gives no rows.
    """

    def placed(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label = np.asarray(t.labels).reshape(int(t.h), int(t.w))
        y, x = np.mgrid[: label.shape[0], : label.shape[1]]
        return label, y + int(t.tile_y) - min(halo, int(t.tile_y)), x + int(t.tile_x) - min(halo, int(t.tile_x))

    def nodes(t, labels: np.ndarray) -> pa.Array:
        return pa.array([f"{t.tile_y:012}/{t.tile_x:012}/{i:08}" for i in labels.tolist()], pa.string())

    def own(batches):
        for batch in batches:
            for t in batch.to_pandas().itertuples():
                label, y, x = placed(t)
                core = (y >= t.tile_y) & (y < t.tile_y + tile) & (x >= t.tile_x) & (x < t.tile_x + tile) & (label > 0)
                ids, at, n = np.unique(label[core], return_inverse=True, return_counts=True)
                add = lambda v: np.bincount(at, v[core].astype(np.float64), len(ids))  # noqa: B023, E731
                sums = np.stack([add(np.asarray(p).reshape(label.shape)) for p in t.planes], axis=1)
                columns = (pa.array([t.image_id] * len(ids), pa.string()), nodes(t, ids), pa.array(n, pa.int64()), pa.array(add(y), pa.float64()), pa.array(add(x), pa.float64()), pa.array(sums.tolist(), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(list(columns), names=["image_id", "node", "area", "y", "x", "sums"])

    def strips(batches):
        for batch in batches:
            for t in batch.to_pandas().itertuples():
                label, y, x = placed(t)
                inner = (y >= t.tile_y + halo) & (y < t.tile_y + tile - halo) & (x >= t.tile_x + halo) & (x < t.tile_x + tile - halo)
                at = (label > 0) & ~inner
                columns = (pa.array([t.image_id] * int(at.sum()), pa.string()), pa.array(y[at], pa.int64()), pa.array(x[at], pa.int64()), nodes(t, label[at]))
                yield pa.RecordBatch.from_arrays(list(columns), names=["image_id", "y", "x", "node"])

    base = tiles.select("image_id", "tile_y", "tile_x", "h", "w", "planes", "labels").where(F.col("labels").isNotNull())
    stats = base.mapInArrow(own, "image_id string, node string, area long, y double, x double, sums array<double>")
    pixels = cut(base.drop("planes").mapInArrow(strips, "image_id string, y long, x long, node string"))
    b = pixels.withColumnRenamed("node", "other")
    met = pixels.join(b, ["image_id", "y", "x"]).where(F.col("node") < F.col("other")).groupBy("image_id", "node", "other").agg(F.count("*").alias("n"))
    # A label's pixels where the two tiles overlap: those that lie in the other tile, halo and all.
    spot = lambda c, i: F.split(c, "/")[i].cast("long")
    inside = (
        (F.col("y") >= spot("tile", 0) - halo) & (F.col("y") < spot("tile", 0) + tile + halo) & (F.col("x") >= spot("tile", 1) - halo) & (F.col("x") < spot("tile", 1) + tile + halo)
    )
    asked = met.select("image_id", "node", F.regexp_extract("other", "^[^/]*/[^/]*", 0).alias("tile")).union(met.select("image_id", "other", F.regexp_extract("node", "^[^/]*/[^/]*", 0))).distinct()
    size = pixels.join(asked, ["image_id", "node"]).where(inside).groupBy("image_id", "node", "tile").agg(F.count("*").alias("size"))
    of = lambda node, other, name: size.select("image_id", F.col("node").alias(node), F.col("tile").alias(f"tile_{other}"), F.col("size").alias(name))
    met = met.withColumns({f"tile_{c}": F.regexp_extract(c, "^[^/]*/[^/]*", 0) for c in ("node", "other")})
    met = met.join(of("node", "other", "size_node"), ["image_id", "node", "tile_other"]).join(of("other", "node", "size_other"), ["image_id", "other", "tile_node"])
    key = lambda c: F.concat_ws("\n", "image_id", c)
    part = components(met.where(F.col("n") >= share * F.least("size_node", "size_other")).select(key("node").alias("a"), key("other").alias("b")))
    named = stats.withColumn("key", key("node")).join(part.withColumnRenamed("node", "key"), "key", "left")
    each = named.withColumn("cell", F.element_at(F.split(F.coalesce("component", "key"), "\n"), -1))
    total = F.sum("area")
    plane = each.select("image_id", "cell", F.posexplode("sums").alias("plane", "x")).groupBy("image_id", "cell", "plane").agg(F.sum("x").alias("x"))
    sums = plane.groupBy("image_id", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("plane", "x"))), lambda s: s["x"]).alias("sums"))
    cells = each.groupBy("image_id", "cell").agg(total.alias("area"), (F.sum("x") / total).alias("global_x"), (F.sum("y") / total).alias("global_y"))
    return cells.join(sums, ["image_id", "cell"])


def regions(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Centroid, area and equivalent radius (4.0 for an empty one) of every label above 0."""
    return (
        pixels.where(F.col("label") > 0)
        .groupBy(*by, "label")
        .agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("area"))
        .withColumn("radius", F.when(F.col("area") > 0, F.sqrt(F.col("area") / F.lit(3.141592653589793))).otherwise(4.0))
    )


def z_order(x: Column, y: Column) -> Column:
    """The bits of two numbers of ``BITS`` bits by turns."""
    bit = lambda c, i: F.call_function("shiftleft", F.call_function("shiftright", c, i).bitwiseAND(F.lit(1).cast("long")), i)
    add = lambda z, i: z.bitwiseOR(F.call_function("shiftleft", bit(x, i), i)).bitwiseOR(F.call_function("shiftleft", bit(y, i), i + 1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), add)


def nearest_neighbour(points: DataFrame, by: list[str], key: str, reach: float | Column) -> DataFrame:
    """Distance of every point (``cx, cy``) to the nearest other of its group, null beyond ``reach``.

    ``reach`` may be a column that is the same for a whole group. A cell's reach never needs more than 3 radii, as R is the smaller of
    1.8 r and 0.6 d. Points of one key are no neighbours; null and non-finite places have none and are none.

    A point's neighbours in the Z-order of its group bound its distance. It
    looks around itself on the grid whose cells are just wider than that: in
    the order's quarter of such a cell it is alone, so that a cell is looked at
    by few points, however dense a group or a part of it is. Points of one
    place are one.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    rows = points.select(*by, F.col(key).alias("__key"), "cx", "cy", (reach if isinstance(reach, Column) else F.lit(float(reach))).alias("__reach_of"))
    rows = rows.where(finite("cx") & finite("cy") & F.col("__key").isNotNull() & (F.col("__reach_of") > 0))
    fine = lambda c: F.floor(F.col(c) / F.col("__reach_of") * float(2**BITS)).bitwiseAND(F.lit(2**BITS - 1).cast("long"))
    places = (
        rows.groupBy(*by, "__reach_of", "cx", "cy")
        .agg(F.min("__key").alias("__key"), (F.min("__key") != F.max("__key")).alias("__many"))
        .withColumns({"__gx": F.floor(F.col("cx") / F.col("__reach_of")), "__gy": F.floor(F.col("cy") / F.col("__reach_of")), "__z": z_order(fine("cx"), fine("cy"))})
    )
    order = [*by, "__gx", "__gy", "__z"]
    dealt = places.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    w = W.partitionBy("__range").orderBy(*order)
    d = lambda x, y: F.sqrt(F.pow(F.col("cx") - x, 2) + F.pow(F.col("cy") - y, 2))

    def bound(move) -> Column:
        o = move(F.struct(*by, "cx", "cy", "__key", "__many")).over(w)
        other = o["__many"] | (o["__key"] != F.col("__key"))
        for c in by:
            other = other & (o[c] == F.col(c))
        return F.when(other, d(o["cx"], o["cy"]))

    side = F.col("__reach_of")
    # What rounding may take away is added.
    far = F.least(side, bound(F.lag), bound(F.lead)) * (1 + 1e-12) + (F.abs("cx") + F.abs("cy")) * 1e-15
    level = F.least(F.lit(BITS), F.greatest(F.lit(0), 2 * F.floor(F.log2(side / F.col("__far")) / 2))).cast("int")
    bounded = dealt.withColumn("__far", F.greatest(F.least(far, 2 * side), side * 2.0**-BITS)).withColumn("__level", level)
    bounded = cut(bounded.select(*by, "__reach_of", "cx", "cy", "__key", "__many", "__far", "__level"))
    asking = bounded.where(~F.col("__many"))
    levels = [r[0] for r in asking.select("__level").distinct().collect()]  # ``BITS`` / 2 + 1 at most
    cell = lambda x: F.floor(x / side * F.pow(F.lit(2.0), F.col("__level")))
    around = lambda c: F.explode(F.sequence(cell(F.col(c) - F.col("__far")), cell(F.col(c) + F.col("__far"))))
    asked = asking.withColumn("__gx", around("cx")).withColumn("__gy", around("cy")).drop("__many", "__far")
    there = bounded.withColumn("__level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>"))).select(
        *by, "__level", F.col("__key").alias("__other"), "__many", F.col("cx").alias("__x"), F.col("cy").alias("__y"), cell(F.col("cx")).alias("__gx"), cell(F.col("cy")).alias("__gy")
    )
    between = d(F.col("__x"), F.col("__y"))
    pairs = asked.join(there, [*by, "__level", "__gx", "__gy"]).where((F.col("__many") | (F.col("__key") != F.col("__other"))) & (between <= side))
    shared = rows.join(bounded.where("__many").select(*by, "cx", "cy"), [*by, "cx", "cy"])
    found = pairs.select(*by, "__key", between.alias("d")).union(shared.select(*by, "__key", F.lit(0.0)))
    near = found.groupBy(*by, F.col("__key").alias(key)).agg(F.min("d").alias("nearest"))
    return points.join(near, [*by, key], "left")


def reach_of(nuclei: DataFrame) -> DataFrame:
    """The radius ``R`` of every cell from ``radius`` and ``nearest`` (null: no neighbour that matters)."""
    return nuclei.withColumn(
        "R", F.coalesce(F.least(SCALE * F.col("radius"), NEAREST * F.col("nearest")), SCALE * F.col("radius"))
    )


def assign_pixels(nuclei: DataFrame, by: list[str], h: int, w: int) -> DataFrame:
    """Pixels within ``R`` of a nucleus (``cx, cy, label, ord``), each to the nearest, ties to the earlier.

    Nuclei travel, not pixels: they go through the blocks of a tile that their
    boxes touch, and a task holds one block of pixels, whatever the number of
    nuclei or the size of a tile.
    """
    low = lambda c, top: F.greatest(F.lit(0), F.ceil(F.col(c) - F.col("R"))).cast("long")
    high = lambda c, top: F.least(F.lit(top - 1), F.floor(F.col(c) + F.col("R"))).cast("long")
    block = lambda x: F.floor(x / SIDE).cast("long")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    inside = nuclei.where(known("cy") & known("cx") & known("R")).where((low("cy", h) <= high("cy", h)) & (low("cx", w) <= high("cx", w)))
    boxed = inside.withColumn("__by", F.explode(F.sequence(block(low("cy", h)), block(high("cy", h))))).withColumn(
        "__bx", F.explode(F.sequence(block(low("cx", w)), block(high("cx", w))))
    )
    key = [*by, "__by", "__bx"]
    dealt = boxed.repartition(*key).sortWithinPartitions(*key, "ord")
    own = dealt.select(*key, "label", *[F.col(c).cast("double").alias(c) for c in ("cy", "cx", "R")])
    schema = StructType([*nuclei.select(*by).schema, StructField("y", LongType()), StructField("x", LongType()), nuclei.schema["label"]])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, label = None, np.empty((SIDE, SIDE)), np.empty((SIDE, SIDE), object)

        def told() -> pa.RecordBatch:
            y, x = np.nonzero(best < np.inf)
            columns = [*[[k] * len(y) for k in now[:-2]], y + now[-2] * SIDE, x + now[-1] * SIDE, label[y, x].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

        for batch in batches:
            for *place, name, cy, cx, r in zip(*(c.to_pylist() for c in batch.columns)):
                if place != now:
                    if now is not None:
                        yield told()
                    now = place
                    best.fill(np.inf)
                y0, x0 = now[-2] * SIDE, now[-1] * SIDE
                top, left = math.ceil(max(cy - r, y0)), math.ceil(max(cx - r, x0))
                end, right = math.floor(min(cy + r, h - 1, y0 + SIDE - 1)), math.floor(min(cx + r, w - 1, x0 + SIDE - 1))
                d2 = (np.arange(top, end + 1) - cy)[:, None] ** 2 + (np.arange(left, right + 1) - cx) ** 2
                part = slice(top - y0, end + 1 - y0), slice(left - x0, right + 1 - x0)
                nearer = (d2 <= r * r) & (d2 < best[part])
                best[part][nearer] = d2[nearer]
                label[part][nearer] = name
        if now is not None:
            yield told()

    return own.mapInArrow(run, schema)


def build_cells(nuclei: DataFrame, by: list[str], h: int, w: int) -> DataFrame:
    """Cell regions of nuclei (``label, cx, cy, radius``): nearest neighbour, reach, disk-limited Voronoi.

    Each tile's grid cells are as wide as its own largest nucleus asks for.
    """
    top = nuclei.groupBy(*by).agg(F.greatest(F.max("radius") * (SCALE / NEAREST), F.lit(1.0)).alias("__reach"))
    near = nearest_neighbour(nuclei.join(top, by), by, "label", F.col("__reach")).drop("__reach")
    return assign_pixels(reach_of(near).withColumn("ord", F.col("label")), by, h, w)


def overlaps(nuclei: DataFrame, by: list[str], key: str = "label") -> DataFrame:
    """Append ``overlap``: the greatest share of a cell's disk (``R``) that one other's covers, by the lens of two circles.

    Meets neighbours on grid cells of the tile's largest diameter, as ``nearest_neighbour`` does.
    """
    side = nuclei.groupBy(*by).agg(F.greatest(2 * F.max("R"), F.lit(1.0)).alias("__side"))
    home = nuclei.join(side, by).withColumns({"__gx": F.floor(F.col("cx") / F.col("__side")), "__gy": F.floor(F.col("cy") / F.col("__side"))})
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    out = home.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).select(
        *by, F.col(key).alias("__key"), F.col("cx").alias("__x"), F.col("cy").alias("__y"), F.col("R").alias("__r"),
        (F.col("__gx") + F.col("__dx")).alias("__gx"), (F.col("__gy") + F.col("__dy")).alias("__gy"),
    )
    d, r, s = F.hypot(F.col("cx") - F.col("__x"), F.col("cy") - F.col("__y")), F.col("R"), F.col("__r")
    pairs = home.join(out, [*by, "__gx", "__gy"]).where((F.col(key) != F.col("__key")) & (d < r + s)).withColumn("__d", d)
    d = F.col("__d")
    part = lambda a, b: a * a * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (d * d + a * a - b * b) / F.nullif(2 * d * a, F.lit(0.0)))))
    kite = 0.5 * F.sqrt(F.greatest(F.lit(0.0), (-d + r + s) * (d + r - s) * (d - r + s) * (d + r + s)))
    small = F.least(r, s)
    lens = F.when(d <= F.abs(r - s), F.lit(np.pi) * small * small).otherwise(part(r, s) + part(s, r) - kite)
    best = pairs.groupBy(*by, key).agg(F.max(lens / F.nullif(F.lit(np.pi) * r * r, F.lit(0.0))).alias("overlap"))
    return nuclei.join(best, [*by, key], "left").na.fill(0.0, ["overlap"])


def limited_cells(nuclei: DataFrame, by: list[str], h: int, w: int, least: float = 0.3) -> DataFrame:
    """Regions of nuclei (``label, cx, cy, radius``) of 1.8 radii each; only those covered by more than ``least`` shrink to 0.6 of the nearest."""
    wide = overlaps(nuclei.withColumn("R", SCALE * F.col("radius")), by)
    top = nuclei.groupBy(*by).agg(F.greatest(F.max("radius") * (SCALE / NEAREST), F.lit(1.0)).alias("__reach"))
    near = nearest_neighbour(wide.join(top, by), by, "label", F.col("__reach")).drop("__reach")
    shrunk = near.withColumn("R", F.when(F.col("overlap") > least, F.least("R", NEAREST * F.coalesce("nearest", F.col("R") / NEAREST))).otherwise(F.col("R")))
    return assign_pixels(shrunk.withColumn("ord", F.col("label")), by, h, w)


def drop_fragments(cells: DataFrame, least: int = 20, small: int = 50) -> tuple[DataFrame, DataFrame]:
    """Cells of ``least`` pixels or more, and the share of those below ``small``."""
    kept = cells.where(F.col("area") >= least)
    return kept, kept.agg(F.avg((F.col("area") < small).cast("double")).alias("fragment_ratio"))
