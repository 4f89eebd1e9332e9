"""Files that are written whole or not at all, and a TIFF whose tiles tasks write."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import export
from lamella.sources import codecs, sinks


def rows_of(spark, n, parts=4):
    return spark.range(n, numPartitions=parts).select(F.concat(F.lit("d/f"), "id").alias("name"), F.col("id").cast("string").cast("binary").alias("data"), F.lit(None).cast("string").alias("note"))


def found(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_all_files_or_none(spark, tmp_path):
    sinks.register(spark)
    rows_of(spark, 9).write.format("files").mode("append").save(str(tmp_path))
    assert found(tmp_path) == sorted(f"d/f{i}" for i in range(9)) and (tmp_path / "d" / "f7").read_bytes() == b"7"
    bad = rows_of(spark, 20).withColumn("data", F.when(F.col("name") == "d/f19", F.raise_error(F.lit("lost"))).otherwise(F.lit(b"new").cast("binary")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("files").mode("append").save(str(tmp_path))
    assert found(tmp_path) == sorted(f"d/f{i}" for i in range(9)) and (tmp_path / "d" / "f7").read_bytes() == b"7"
    with pytest.raises(Exception, match="one name"):
        rows_of(spark, 3).union(rows_of(spark, 3)).write.format("files").mode("append").save(str(tmp_path / "twice"))
    assert found(tmp_path / "twice") == []
    for name in ("../x", "/tmp/x"):
        with pytest.raises(Exception, match="below the target"):
            rows_of(spark, 1).withColumn("name", F.lit(name)).write.format("files").mode("append").save(str(tmp_path / "out"))


def test_a_repeated_task_leaves_nothing_double(tmp_path):
    """Two attempts of one task: what the commit doesn't hear of goes with the staging folder."""
    from pyspark.sql import Row

    w = sinks.Writer(str(tmp_path))
    rows = [Row(name="a", data=b"1", note="n"), Row(name="b/c", data=b"2", note=None)]
    w.write(iter(rows))
    kept = w.write(iter(rows))
    w.commit([kept, None])
    assert found(tmp_path) == ["_notes.json", "a", "b/c"] and (tmp_path / "_notes.json").read_text() == '{"a": "n"}'


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path):
    from pyspark.sql import Row

    w = sinks.Writer(str(tmp_path))

    def rows():
        yield Row(name="a/b//c", data=b"1", note=None)
        w.abort([])
        yield Row(name="d/e", data=b"2", note=None)

    for given in (rows(), rows()):  # the second begins after the abort
        with pytest.raises(FileNotFoundError):
            w.write(given)
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("cells", [0, 1, 400])
def test_the_map_equals_its_rasters(spark, tmp_path, cells):
    rng = np.random.default_rng(cells)
    rows = [(int(i), float(x), float(y), int(v)) for i, (x, y, v) in enumerate(zip(rng.uniform(0, 300, cells), rng.uniform(0, 200, cells), rng.integers(1, 200, cells)))]
    df = spark.createDataFrame(rows, "o long, x double, y double, value int").repartition(5)
    path = str(tmp_path / "map.tif")
    for _ in range(2):  # once more over the first
        export.write_map(df, path, 200, 300, "o", cell=64, least=64)
    assert os.listdir(tmp_path) == ["map.tif"]
    stack = codecs.open_stack(path)
    assert [tuple(s) for s in stack.levels] == [(200, 300), (100, 150)]
    want = [np.zeros(s, np.uint8) for s in stack.levels]
    for r in export.raster(df, 200, 300, "o").collect():
        want[0][r["py"], r["px"]] = r["value"]
    for r in export.pyramid(df, 200, 300, "o", least=64).collect():
        want[r["level"]][r["py"], r["px"]] = r["value"]
    for i, w in enumerate(want):
        assert (stack.at_level(i).window(0, 0, 0, *w.shape) == w).all()
