"""DBSCAN and connected components against plain versions."""

import numpy as np
import pytest

from lamella.functions.graph import components
from lamella.operators import density


def plain(ids, x, eps, least):
    """Cluster (by its smallest core point) and whether core, all pairs tried; borders go to the smallest."""
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    root = np.array(ids)
    while True:
        new = np.array([min([root[i]] + [root[j] for j in np.flatnonzero(near[i] & core)]) if core[i] else root[i] for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    out = {}
    for i, k in enumerate(ids):
        around = [root[j] for j in np.flatnonzero(near[i] & core)]
        out[k] = (bool(core[i]), int(root[i]) if core[i] else int(min(around)) if around else None)
    return out


@pytest.mark.parametrize("dimensions, eps, least, seed", [(1, 0.3, 3, 0), (2, 0.5, 4, 1), (2, 0.25, 3, 2), (3, 0.8, 5, 3), (5, 1.6, 4, 4)])
def test_clusters_equal_all_pairs(spark, dimensions, eps, least, seed):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-5, 5, (5, dimensions))
    x = np.concatenate([c + rng.standard_normal((50, dimensions)) * s for c, s in zip(centres, (0.1, 0.3, 0.5, 0.8, 2))] + [rng.uniform(-6, 6, (30, dimensions))])
    x = np.concatenate([x, np.round(x[:60] / eps) * eps, x[:10]])  # points on borders of cells, exactly eps apart, and repeated ones
    ids = rng.permutation(len(x))
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>").repartition(5)
    got = {r["id"]: (r["core"], r["cluster"]) for r in density.dbscan(points, eps, least).collect()}
    assert got == plain(ids, x, eps, least)


def test_edges_of_density(spark):
    schema = "id long, v array<double>"
    rows = [(1, None), (2, [0.0, float("nan")]), (3, [0.0, 0.0]), (4, [0.0, 0.1]), (5, [float("inf"), 0.0]), (6, [9.0, 9.0]), (7, [1.0, None])]
    got = {r["id"]: (r["core"], r["cluster"]) for r in density.dbscan(spark.createDataFrame(rows, schema), 0.2, 2).collect()}
    assert got == {i: (False, None) for i in (1, 2, 5, 6, 7)} | {3: (True, 3), 4: (True, 3)}
    assert density.dbscan(spark.createDataFrame([], schema), 1.0, 2).count() == 0
    assert {r["cluster"] for r in density.dbscan(spark.createDataFrame(rows[:1], schema), 1.0, 1).collect()} == {None}


def test_one_dense_cell_costs_its_points(spark):
    """A hundred thousand points within one radius: all core by count, none compared with each other."""
    from pyspark.sql import functions as F

    points = spark.range(100_000).select("id", F.array(F.rand(1) * 0.1, F.rand(2) * 0.1).alias("v")).union(spark.createDataFrame([(-1, [0.6, 0.05]), (-2, [5.0, 5.0])], "id long, v array<double>"))
    told = density.dbscan(points, 1.0, 10).groupBy("core", "cluster").count().collect()
    assert {tuple(r) for r in told} == {(True, -1, 100_001), (False, None, 1)}


def test_components_of_strings(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a")]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
