"""Medians of tiles and cells, which no task gathers."""

import pytest
from pyspark.sql import functions as F

from lamella.operators import features

ROWS = [
    (1, 0, 0, "A", 3.0), (1, 0, 0, "A", 4.0), (1, 0, 0, "A", 4.0), (1, 0, 0, "A", 9.0), (1, 0, 2, "A", 1.0), (1, 0, 2, "A", 2.0),
    (1, 0, 0, "B", 5.0), (1, 0, 0, "B", None), (1, 0, 3, "B", 7.0), (1, 0, 3, "B", None), (2, 0, 1, "A", 8.0), (2, 0, 0, "B", None),
    (None, 0, 0, "A", 6.0), (None, 0, 1, "A", 2.0), (3, 0, 0, None, float("inf")), (3, 0, 0, None, float("inf")),
]


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame(ROWS, "tile_x long, tile_y long, label long, channel string, value double")


def test_background_of_all_rows(pixels):
    """A row without tile or channel has its group's background like any other; without background pixels it is 0."""
    got = features.background_of_rows(pixels).groupBy("tile_x", "channel", "background").count().collect()
    want = {(1, "A", 4.0, 6), (1, "B", 5.0, 4), (2, "A", 0.0, 1), (2, "B", 0.0, 1), (None, "A", 6.0, 2), (3, None, float("inf"), 2)}
    assert {tuple(r) for r in got} == want


def test_medians_of_cells(pixels):
    got = {(r["tile_x"], r["label"], r["channel"]): (r["median"], r["median_bg_corr"], r["n_pixels"]) for r in features.long(pixels).collect()}
    assert got == {(1, 2, "A"): (1.5, -2.5, 2), (1, 3, "B"): (7.0, 2.0, 2), (2, 1, "A"): (8.0, 8.0, 1), (None, 1, "A"): (2.0, 2.0, 1)}


def test_no_task_gathers_a_group(pixels):
    for df in (features.background(pixels), features.background_of_rows(pixels), features.long(pixels.where(F.col("tile_x") == 1))):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "median" not in plan.replace("median#", "").replace("median_bg_corr", "") and "percentile" not in plan
