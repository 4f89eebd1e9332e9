"""Touching nuclei, distances, areas, and cells that tile borders cut."""

import time
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import segment
from lamella.plans import flows


def slow_areas(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def test_areas_and_distances_equal_plain_ones():
    rng = np.random.default_rng(0)
    for shape, share in (((1, 1), 1), ((7, 9), 0), ((30, 41), 0.6), ((25, 25), 0.95), ((1, 40), 0.5), ((12, 12), 1)):
        mask = rng.random(shape) < share
        assert (segment.areas(mask) == slow_areas(mask)).all()
        y, x = np.nonzero(~mask)
        if len(y):
            a, b = np.mgrid[: shape[0], : shape[1]]
            want = ((a[..., None] - y) ** 2 + (b[..., None] - x) ** 2).min(axis=2)
            assert (segment.squared_distance(mask) == want).all()
    spiral = np.zeros((41, 41), bool)  # one long path
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = True
        spiral[k + 2 : 41 - k, k] = True
    assert (segment.areas(spiral) == slow_areas(spiral)).all()


def ellipses(seed, shape=(160, 160)):
    """Touching pairs of ellipses and lone ones with noise, and their true labels."""
    rng = np.random.default_rng(seed)
    truth, n = np.zeros(shape, int), 0
    y, x = np.mgrid[: shape[0], : shape[1]]
    for cy in range(25, shape[0] - 20, 45):
        for cx in range(25, shape[1] - 20, 45):
            r, angle = rng.uniform(7, 9), rng.uniform(0, np.pi)
            for k in (-1, 1) if rng.random() < 0.6 else (0,):
                n += 1
                dy, dx = y - cy - k * 0.85 * r * np.sin(angle), x - cx - k * 0.85 * r * np.cos(angle)
                inside = (dy / r) ** 2 + (dx / (r * rng.uniform(0.9, 1.1))) ** 2 <= 1
                truth[inside & (truth == 0)] = n
    return truth, np.where(truth > 0, 100.0, 10.0) + rng.normal(0, 4, shape)


@pytest.mark.parametrize("seed", range(4))
def test_touching_nuclei_come_apart(seed):
    truth, image = ellipses(seed)
    got = segment.watershed_segmenter(image, smallest=20)
    assert len(np.unique(got)) == len(np.unique(truth)) and len(np.unique(segment.threshold_segmenter(image))) < len(np.unique(truth))
    for i in range(1, truth.max() + 1):
        mine = np.bincount(got[truth == i]).argmax()
        iou = ((got == mine) & (truth == i)).sum() / ((got == mine) | (truth == i)).sum()
        assert mine > 0 and iou > 0.7
    first = [np.flatnonzero(got.ravel() == i)[0] for i in range(1, got.max() + 1)]
    assert first == sorted(first)


def test_empty_full_and_flat_tiles():
    assert not segment.watershed_segmenter(np.zeros((20, 30))).any() and not segment.watershed_segmenter(np.full((5, 5), 7.0)).any()
    full = np.full((24, 24), 9.0)
    full[0, 0] = 0
    assert np.unique(segment.watershed_segmenter(full)).tolist() == [0, 1]
    assert segment.watershed_segmenter(np.zeros((0, 0))).shape == (0, 0)
    assert segment.watershed_segmenter(np.eye(9) * 50, rise=5.0).max() == 9  # areas without a top of that height are whole


@pytest.mark.parametrize("segmenter", ["fixed", "watershed"])
def test_cells_across_borders_are_one(spark, tmp_path, segmenter):
    truth, image = ellipses(7, (150, 170))
    np.save(tmp_path / "s.npy", np.stack([np.where(truth > 0, 100.0, 10.0) if segmenter == "fixed" else image, image * 2]).astype(np.float32))

    def fixed(x):
        return segment.areas(x > 50)

    f = fixed if segmenter == "fixed" else partial(segment.watershed_segmenter, least=50.0, smallest=10)
    got = {}
    for tile, halo in ((32, 12), (64, 20), (512, 0)):
        tiles = flows.read(spark, str(tmp_path), layout="stack", tile=str(tile), halo=str(halo))
        rows = segment.merged_cells(segment.segment(tiles, f, 1), tile, halo).collect()
        got[tile] = sorted((r["area"], round(r["global_y"], 3), round(r["global_x"], 3), round(r["sums"][1])) for r in rows)
    if segmenter == "fixed":
        assert got[32] == got[64] == got[512] and sum(a for a, *_ in got[32]) == (truth > 0).sum()
    else:  # tiles part at levels of their own: the same cells, and nearly the same pixels
        assert len(got[64]) == len(got[512]) == truth.max()
        assert abs(sum(a for a, *_ in got[64]) / sum(a for a, *_ in got[512]) - 1) < 0.03


def test_nearest_of_odd_points(spark):
    """Places of several keys, keys of several places, nulls, no numbers, all scales, groups of one."""
    rng = np.random.default_rng(3)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 40, (120, 2)))]
    rows += [("a", 200 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(-7, 1e-7, (60, 2)))]
    rows += [("a", 300, 1.0, 1.0), ("a", 301, 1.0, 1.0), ("a", 301, 55.0, -3.0), ("a", 301, 55.0, -3.1), ("a", 302, -0.0, 0.0), ("a", 303, 0.0, -0.0)]
    rows += [("b", 1, 5.0, 5.0), ("b", 1, 5.0, 6.0), ("c", 1, 0.0, 0.0), ("c", 2, 10.0, 0.0), ("c", 3, 0.0, 10.5), ("c", 4, 1e18, 0.0), ("c", 5, 1e18, 3.0)]
    rows += [("a", 400, None, 1.0), ("a", None, 1.0, 1.0), (None, 1, 1.0, 1.0), ("a", 401, float("nan"), 1.0), ("a", 402, float("inf"), 1.0)]
    points = spark.createDataFrame(rows, "t string, k long, cx double, cy double")
    want = set()
    for t, k, x, y in rows:
        others = [np.hypot(u - a, v - b) for s, j, u, v in rows for q, m, a, b in rows if (q, m) == (t, k) and s == t and t is not None and None not in (j, k, u, v, a, b) and j != k]
        near = min((d for d in others if d <= 10.0), default=None)
        want.add((t, k, None if near is None else round(float(near), 9)))
    got = segment.nearest_neighbour(points, ["t"], "k", 10.0).collect()
    assert len(got) == len(rows)
    assert {(r["t"], r["k"], None if r["nearest"] is None else round(r["nearest"], 9)) for r in got} == want


def test_nearest_in_a_crowd(spark):
    """A group whose points all lie within reach of each other is not crossed with itself: 10 billion pairs took minutes."""
    began = time.monotonic()
    points = spark.range(100_000).select(F.lit(1).alias("t"), F.col("id").alias("k"), (F.col("id") % 317 * 0.25).alias("cx"), (F.floor(F.col("id") / 317) * 0.5).alias("cy"))
    got = segment.nearest_neighbour(points, ["t"], "k", 300.0).groupBy("nearest").count().collect()
    assert [tuple(r) for r in got] == [(0.25, 100_000)]
    assert time.monotonic() - began < 60


def test_disks_across_blocks_of_a_tile(spark):
    """Tiles larger than a block, ties, disks over edges and beyond them, null tiles; no row is made for a pixel on its way."""
    rng = np.random.default_rng(5)
    rows = [(t, i, i, float(x), float(y), float(r)) for t in ("a", None) for i, (x, y, r) in enumerate(zip(rng.integers(-4, 320, 150), rng.integers(-4, 620, 150), rng.random(150) * 12))]
    rows += [("c", 7, 2, 255.5, 255.5, 3.0), ("c", 8, 1, 256.5, 256.5, 3.0), ("c", 9, 3, 255.5, 255.5, 3.0), ("c", 10, 4, None, 1.0, 3.0), ("c", 11, 5, -50.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "t string, label int, ord int, cx double, cy double, R double")
    best = {}
    for t, label, order, cx, cy, r in rows:
        for y in range(600 if cx is not None else 0):
            for x in range(max(0, int(cx - r)), min(300, int(cx + r) + 2)):
                d = (y - cy) ** 2 + (x - cx) ** 2
                if d <= r * r:
                    best[t, y, x] = min(best.get((t, y, x), (np.inf,)), (d, order, label))
    out = segment.assign_pixels(df, ["t"], 600, 300)
    assert out.dtypes == [("t", "string"), ("y", "bigint"), ("x", "bigint"), ("label", "int")]
    got = out.collect()
    assert len(got) == len(best) and {(r["t"], r["y"], r["x"]): r["label"] for r in got} == {k: v[2] for k, v in best.items()}
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
