"""What must not get lost: channels beyond a few, vectors that are null or of other lengths, classes beyond a raster's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import cluster, export, features
from lamella.plans import flows
from lamella.sources import panels

VECTORS = "id long, v array<double>, cluster int"


def test_a_hundred_channels(spark):
    n = 100
    panel = spark.createDataFrame([("p", i, f"c{i}", "m", "", False, False) for i in range(n)], panels.SCHEMA)
    assert panels.with_channels(spark.range(3), panel).count() == 3 * n
    stats = spark.createDataFrame([(0, 0, 1, f"c{i}", *[1.0] * 4, 0.0, 0.0, 4) for i in range(n)], "tile_x long, tile_y long, label long, channel string, mean double, median double, sum double, std double, mean_bg_corr double, median_bg_corr double, n_pixels long")
    places = spark.createDataFrame([(0, 0, 1, 2.0, 3.0)], "tile_x long, tile_y long, label long, local_x double, local_y double")
    assert features.placed(stats, places, panel).select("channel_index").distinct().count() == n


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_null_vectors_do_not_count(spark, parts):
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [5.0, 2.0], 1), (3, None, None), (4, [3.0, 8.0], 1)]
    points = spark.createDataFrame(rows, VECTORS).repartition(parts)
    good = np.array([v for _, v, _ in rows if v])
    got = {r["dim"]: (r["mean"], r["std"]) for r in cluster.moments(points).collect()}
    assert np.allclose([got[i] for i in range(2)], np.column_stack([good.mean(axis=0), good.std(axis=0)]))
    scaled = {r["id"]: r["v"] for r in cluster.zscore(points).collect()}
    assert scaled[1] is None and np.allclose(scaled[2], (good[1] - good.mean(axis=0)) / good.std(axis=0))
    cov = {(r["i"], r["j"]): r["covariance"] for r in cluster.covariance(points).collect()}
    assert np.allclose([cov[0, 0], cov[0, 1], cov[1, 1]], np.cov(good.T)[[0, 0, 1], [0, 1, 1]])
    scores, shares = cluster.pca(points, 2)
    assert np.isclose(shares.sum(), 1) and {r["id"] for r in scores.where("v is not null and v[0] is not null").collect()} == {0, 2, 4}
    told, centres = cluster.kmeans(points, 2)
    assert {r["id"] for r in told.collect()} == {0, 2, 4} and len(centres) == 2
    old = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [7.0, 7.0])], "c int, centre array<double>")
    new = {r["c"]: r["centre"] for r in cluster.update(points, old).collect()}
    assert np.allclose([new[0], new[1], new[2]], [[1, 2], [4, 5], [7, 7]])


def test_dispersion_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, own = rng.standard_normal((60, 3)) * [1, 5, 0.1] + 100, rng.integers(0, 4, 60)
    points = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, own))], VECTORS).repartition(4)
    m = np.array([x[own == c].mean(axis=0) for c in range(4)])
    between = sum((own == c).sum() * ((m[c] - x.mean(axis=0)) ** 2).sum() for c in range(4))
    within = ((x - m[own]) ** 2).sum()
    assert np.isclose(cluster.calinski_harabasz(points).first()[0], between / 3 / (within / 56))


@pytest.mark.parametrize("parts", [1, 3])
def test_vectors_of_different_lengths_are_refused(spark, parts):
    points = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0], 0), (2, [1.0, 2.0, 3.0], 0)], VECTORS).repartition(parts, "id")
    for f in (cluster.moments, cluster.covariance, lambda p: cluster.sums(p, "cluster")):
        with pytest.raises(Exception, match="different lengths"):
            f(points).collect()


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    scores, shares = cluster.pca(none, 3)
    assert scores.count() == 0 and len(shares) == 0
    told, centres = cluster.kmeans(none.select("id", "v"), 3)
    assert told.count() == 0 and len(centres) == 0 and {"cluster", "confidence"} <= set(told.columns)
    assert cluster.moments(none).count() == 0 and cluster.zscore(none).count() == 0


def test_more_classes_than_a_raster_has(spark, tmp_path):
    cells = spark.range(300).select(F.col("id").cast("int").alias("cluster"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.col("id").alias("o"))
    assert export.points(cells).count() == 300 and export.classes(cells).count() == 300
    with pytest.raises(ValueError, match="255"):
        export.checked(export.encode(cells))
    with pytest.raises(ValueError, match="255"):
        export.write_map(cells.withColumn("value", F.col("cluster") + 1), str(tmp_path / "m.tif"), 64, 64, "o")


def test_artifacts_of_columns_of_any_name(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(99)] + [(99, 1e6, 1e6), (100, None, None), (101, 1e6, 1.0)]
    cells = spark.createDataFrame(rows, "id long, `a.b` double, c double")
    assert [r["id"] for r in flows.artifacts(cells, ["a.b", "c"]).where("artifact").collect()] == [99]
