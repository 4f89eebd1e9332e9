"""Operators against plain NumPy, and the golden facts of small tables."""

import json
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import cli, config, plugins
from lamella.functions import columns as C
from lamella.operators import analysis, cluster, export, features, qc, segment, tiles
from lamella.plans import flows, pipeline, registry
from lamella.sources import codecs, panels, slides, tables
from lamella.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_columns(spark):
    assert one(spark, C.sample_of(F.lit("/a/outputs/S1/outputs/f/m.csv"))) == "S1"
    assert one(spark, C.sample_of(F.lit("/a/b/c/m.csv"))) == "b"
    assert one(spark, C.file_stem(F.lit("/a/b.c/x.y.tif"))) == "x.y"
    assert [one(spark, C.tile_of_name(F.lit("roi_label_512_1024.png"), i)) for i in (1, 2)] == [512, 1024]
    assert one(spark, C.tile_of_name(F.lit("other.png"), 1)) is None
    for v in (None, float("nan"), float("inf"), float("-inf")):
        assert one(spark, C.clean(F.lit(v).cast("double"))) == 0.0
    assert one(spark, C.nearest_pixel(F.lit(2.5), 10)) == 2 and one(spark, C.nearest_pixel(F.lit(99.0), 10)) == 9
    assert one(spark, C.unit_scale(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0


def numpy_cells(nuclei, h, w):
    """Disk-limited nearest assignment, the earlier nucleus first."""
    out, best = np.zeros((h, w), int), np.full((h, w), np.inf)
    for label, cy, cx, r in nuclei:
        others = [np.hypot(cy - y, cx - x) for k, y, x, _ in nuclei if k != label]
        reach = min(1.8 * r, 0.6 * min(others)) if others else 1.8 * r
        d = (np.arange(h)[:, None] - cy) ** 2 + (np.arange(w)[None] - cx) ** 2
        hit = (d <= reach**2) & (d < best)
        out[hit], best[hit] = label, d[hit]
    return out


@pytest.mark.parametrize("n", [1, 2, 12])
def test_cell_regions(spark, n):
    rng = np.random.default_rng(n)
    nuclei = [(i + 1, float(rng.integers(0, 64)), float(rng.integers(0, 64)), float(rng.uniform(1, 5))) for i in range(n)]
    df = spark.createDataFrame([(0, *x) for x in nuclei], "t int, label long, cy double, cx double, radius double")
    got = np.zeros((64, 64), int)
    for r in segment.build_cells(df, ["t"], 64, 64).collect():
        got[r["y"], r["x"]] = r["label"]
    assert (got == numpy_cells(nuclei, 64, 64)).all()


def test_kmeans_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (40, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in cluster.kmeans(df, 3, seed=1)[0].collect()}
    draws, best = np.random.default_rng(1), (np.inf, None)
    for _ in range(5):
        c, last = x[draws.choice(len(x), size=3, replace=False)].copy(), np.zeros(len(x), int)
        for _ in range(100):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            if (own == last).all():
                break
            last = own
            c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(3)])
        cost = ((x - c[last]) ** 2).sum()
        best = min(best, (cost, last), key=lambda b: b[0])
    assert [got[i] for i in range(len(x))] == best[1].tolist()


def test_auto_k_and_pca(spark):
    assert [cluster.auto_k(n) for n in (1, 3, 19, 20, 99, 100)] == [2, 3, 4, 6, 6, 8]
    assert cluster.auto_k(5, 9) == 5 and cluster.auto_k(50, 1) == 2
    x = np.random.default_rng(0).normal(size=(200, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    scores, shares = cluster.pca(df, 3)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:3])
    got = np.array([r["v"] for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]))


def test_features_without_background_and_missing_channel(spark):
    rows = [(0, 0, 1, "a", 2.0, 0, 0), (0, 0, 1, "a", 4.0, 1, 0), (0, 0, 2, "b", 7.0, 2, 0), (0, 0, 0, "a", 1.0, 3, 0)]
    px = spark.createDataFrame(rows, "tile_x long, tile_y long, label long, channel string, value double, x long, y long")
    got = {r["cell_id"]: (r["a"], r["b"]) for r in features.matrix(features.long(px), ["a", "b"]).collect()}
    assert got == {"0_0_1": (2.0, 0.0), "0_0_2": (0.0, 7.0)}


def test_raster_last_writer_and_class_limit(spark):
    pts = spark.createDataFrame([(0, 1.0, 1.0, 1), (1, 2.0, 1.0, 2), (2, 99.0, -5.0, 3)], "o int, x double, y double, value int")
    img = np.zeros((8, 8), int)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            for _, x, y, v in [(0, 1, 1, 1), (1, 2, 1, 2), (2, 7, 0, 3)]:
                img[np.clip(y + dy, 0, 7), np.clip(x + dx, 0, 7)] = v
    got = np.zeros((8, 8), int)
    for r in export.raster(pts, 8, 8, "o").collect():
        got[r["py"], r["px"]] = r["value"]
    assert (got == img).all()
    with pytest.raises(ValueError, match="256 classes"):
        export.checked(export.encode(spark.range(256).withColumnRenamed("id", "cluster")))
    assert export.level_sizes(2048, 1500) == [(2, 1024, 750)]


def test_kernels():
    rng = np.random.default_rng(0)
    ref = rng.random((32, 32))
    assert qc.phase_drift(ref, np.roll(ref, (-3, 5), (0, 1))) == (3.0, -5.0)
    y, x = np.mgrid[:64, :64]
    spot = lambda dy, dx: np.exp(-((y - 30 - dy) ** 2 + (x - 33 - dx) ** 2) / 40)
    assert qc.phase_drift(spot(0, 0), spot(1.3, -2.6)) == (-1.3, 2.6) and qc.phase_drift(spot(0, 0), spot(1.3, -2.6), 1) == (-1.0, 3.0)
    assert qc.sharpness(np.ones((8, 8))) == 0.0
    assert (qc.top_hat(np.ones((8, 8)), 2) == 0).all()
    labels = segment.threshold_segmenter(np.array([[9, 0, 0, 9], [9, 0, 0, 9], [0, 0, 0, 0.0]]))
    assert labels.tolist() == [[1, 0, 0, 2], [1, 0, 0, 2], [0, 0, 0, 0]]
    assert qc.overlay(ref, ref).shape == (32, 32, 3)


def test_edges_and_sharpness():
    square = np.zeros((40, 40))
    square[10:30, 12:28] = 7
    e = qc.edges(square)
    assert set(np.unique(e)) == {0.0, 255.0} and 60 <= (e > 0).sum() <= 80
    found = np.argwhere(e > 0)
    assert found.min(axis=0).tolist() in ([9, 11], [10, 12], [9, 12], [10, 11]) and not e[15:25, 17:23].any() and not qc.edges(np.ones((9, 9))).any()
    both = qc.overlay(square, np.roll(square, 5, 1))
    assert both[20, 12].tolist()[2] in (0.0, 1.0) and ((both[..., 0] == 1) & (both[..., 2] == 0)).any()
    image = np.random.default_rng(1).random((20, 30))
    byte = ((image - image.min()) / (image.max() - image.min()) * 255).astype(np.uint8).astype(float)
    p = np.pad(byte, 1, mode="reflect")
    plain = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * byte
    assert np.isclose(qc.sharpness(image), plain.var())


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_top_hat_equals_a_plain_one(radius):
    a = np.random.default_rng(radius).integers(0, 50, (23, 27)).astype(float)
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]

    def sweep(v, fold):
        return np.array([[fold(v[i + y, j + x] for y, x in disk if 0 <= i + y < 23 and 0 <= j + x < 27) for j in range(27)] for i in range(23)])

    assert (qc.top_hat(a, radius) == a - sweep(sweep(a, min), max)).all()


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {(r["a"], r["b"]): r["r"] for r in qc.correlation(df, ["a", "b"]).collect()}[("a", "b")] is None


def test_panels_and_columns(spark):
    p = panels.panels(spark)
    assert panels.markers(p).where("panel = 'KidneyCancer'").count() == 6 and panels.in_stack(p, 4).count() == 8
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, 3.0)], "cell_id string, cluster int, local_x double, Opal1 double, pca_1 double")
    assert cluster.feature_columns(df) == ["Opal1"] and cluster.feature_columns(df, True) == ["local_x", "Opal1"]


def test_tables(spark, tmp_path):
    (tmp_path / "outputs/S1/t/features").mkdir(parents=True)
    (tmp_path / "outputs/S2/t/features").mkdir(parents=True)
    (tmp_path / "outputs/S1/t/features/features_matrix_mean.csv").write_text("cell_id,A\nc1,1.5\n")
    (tmp_path / "outputs/S2/t/features/features_matrix_mean.csv").write_text("cell_id,B\nc2,2.5\n")
    got = {r["cell_id"]: (r["A"], r["B"], r["s"]) for r in tables.cohort(spark, str(tmp_path)).withColumn("s", C.sample_of(F.col("source_csv"))).collect()}
    assert got == {"c1": (1.5, 0.0, "S1"), "c2": (0.0, 2.5, "S2")}
    (tmp_path / "c.csv").write_text("Tile_X,tile_y,local_x,local_y,Cluster\n0,0,1.5,2,3\n0,0,1,2,x\n")
    assert tables.clustered_cells(spark, str(tmp_path / "c.csv"), strict=False).count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.clustered_cells(spark, str(tmp_path / "c.csv")).collect()
    (tmp_path / "bad.csv").write_text("tile_x\n1\n")
    with pytest.raises(tables.MissingColumns):
        tables.clustered_cells(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "p.ppr").write_text("# note\nBandNames=a, b,c\n\nk=v=w\nk=last\n")
    r = tables.sidecars(spark, str(tmp_path / "p.ppr")).first()
    assert r["band_names"] == ["a", "b", "c"] and r["meta"]["k"] == "last"
    (tmp_path / "q.ppr").write_text("flag\nBandNames=a,, b\n")
    r = tables.sidecars(spark, str(tmp_path / "q.ppr")).first()
    assert r["meta"]["flag"] == "" and r["band_names"] == ["a", "b"]


def slide(tmp_path, name="s1"):
    rng = np.random.default_rng(5)
    stack = rng.normal(10, 0.5, (3, 96, 80)).astype(np.float32)
    for cy, cx in ((12, 12), (12, 50), (40, 20), (80, 70), (75, 30)):
        stack[:, cy - 3 : cy + 4, cx - 3 : cx + 4] += rng.uniform(50, 90, 3)[:, None, None].astype(np.float32)
    np.save(tmp_path / f"{name}.npy", stack)
    return stack


def test_slides_and_pipeline(spark, tmp_path):
    stack = slide(tmp_path)
    spark.dataSource.register(slides.Slides)
    reader = spark.read.format("slides").option("path", str(tmp_path)).option("tile", 64)
    df = reader.load()
    assert {(r["tile_y"], r["tile_x"], r["h"], r["w"]) for r in df.collect()} == {(0, 0, 64, 64), (0, 64, 64, 16), (64, 0, 32, 64), (64, 64, 32, 16)}
    assert spark.read.format("slides").options(path=str(tmp_path), metadata="true").load().first()["height"] == 96
    part = spark.read.format("slides").options(path=str(tmp_path), tile="64", channels="2", tile_y="64", tile_x="0").load().collect()
    assert len(part) == 1 and np.allclose(part[0]["pixels"], stack[1, 64:96, 0:64].ravel())
    least = partial(segment.threshold_segmenter, least=30.0)
    for source in (df, reader.option("layout", "stack").load()):
        out = pipeline.run(source, 1, {2: "A", 3: "B"}, least)
        cells = out.clustered.collect()
        assert len(cells) == 5 and all(0 <= r["confidence"] <= 1 for r in cells) and all(r["A"] > 30 for r in cells)
        assert out.counts().first()["n_cells"] == 5 and out.failed.count() == 0
        assert out.totals().first().asDict() == {"images": 1, "processed": 1, "failed": 0, "tiles": 4, "cells": 5}
        out.close()
    done = spark.createDataFrame([("s1",)], "image_id string")
    assert pipeline.run(df, 1, {2: "A"}, done=done).matrix.count() == 0

    def fails(image):
        raise ValueError("no")

    assert pipeline.run(df, 1, {2: "A"}, fails).failed.count() == 4


def test_measuring_a_tile_equals_the_relational_form(spark, tmp_path):
    """Statistics made where the tile is are those of its pixels as rows."""
    slide(tmp_path)
    out = pipeline.run(flows.read(spark, str(tmp_path), layout="stack", tile="64"), 1, {2: "A", 3: "B"}, partial(segment.threshold_segmenter, least=30.0))
    labelled = segment.segment(flows.read(spark, str(tmp_path), layout="stack", tile="64"), partial(segment.threshold_segmenter, least=30.0), 1)
    px = (
        labelled.select("tile_x", "tile_y", "w", "labels", F.posexplode("planes").alias("c", "plane"))
        .select("tile_x", "tile_y", "w", "c", F.posexplode(F.arrays_zip("labels", "plane")).alias("at", "p"))
        .select("tile_x", "tile_y", (F.col("c") + 1).alias("channel"), F.col("p.labels").cast("long").alias("label"), F.col("p.plane").cast("double").alias("value"),
                F.floor(F.col("at") / F.col("w")).alias("y"), (F.col("at") % F.col("w")).alias("x"))
    )
    panel = spark.createDataFrame([(2, "A"), (3, "B")], "index int, name string")
    named = px.where("channel > 1").withColumn("channel", F.when(F.col("channel") == 2, "A").otherwise("B"))
    want = features.placed(features.long(named), features.centroids(named), panel).toPandas().sort_values(["tile_x", "tile_y", "label", "channel_name"])
    got = out.features.drop("image_id").toPandas().sort_values(["tile_x", "tile_y", "label", "channel_name"])
    assert len(got) == 10 and got["channel_name"].tolist() == want["channel_name"].tolist()
    for c in features.LONG:
        if c != "channel_name":
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float)), c
    nuclei = {(r["tile_x"], r["tile_y"], r["label"]): (r["local_x"], r["local_y"]) for r in out.nuclei.collect()}
    assert {k: v for k, v in nuclei.items()} == {(r.tile_x, r.tile_y, r.label): (r.local_x, r.local_y) for r in got.itertuples()}
    names = [r["cell_id"] for r in out.matrix.collect()]
    assert names == sorted(names)
    written = out.write(str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(written["features_matrix_mean.csv"])
    assert back.count() == 5 and {"cell_id", "local_x", "local_y", "A", "B"} <= set(back.columns)
    assert "features_matrix_mean_cluster.csv" in written and spark.read.option("header", True).csv(written["features_long.csv"]).count() == 10
    final = {(r["tile_x"], r["tile_y"], r["label"]): r for r in flows.final_table(out, ["A"], af="B").collect()}
    raw = np.array([r["A"] for r in final.values()])
    for key, r in final.items():
        assert r["global_x"] == key[0] + r["local_x"] and np.isclose(r["z_A"], (r["A"] - raw.mean()) / raw.std()) and 0 <= r["af_norm"] <= 1
        assert r["cluster"] is not None and r["artifact"] is not None and np.isclose(r["af_bg_corr"], r["B"])
    empty = pipeline.run(flows.read(spark, str(tmp_path), layout="stack", tile="64"), 1, {2: "A"}, lambda x: np.zeros(x.shape, int))
    assert flows.final_table(empty, ["A"]).count() == 0
    assert "nuclei_centroids.csv" not in empty.write(str(tmp_path / "none"))
    clustered = flows.cluster_table(spark, written["features_matrix_mean.csv"], k=2)
    assert clustered.count() == 5 and spark.read.option("header", True).csv(export.cluster_path(written["features_matrix_mean.csv"])).count() == 5


def test_slides_of_one_name_and_broken_ones(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        slide(tmp_path / folder, "slide")
    (tmp_path / "c.npy").write_bytes(b"no stack")
    df = flows.read(spark, str(tmp_path), tile="64")
    assert [tuple(r)[:7] for r in df.where("error is not null").collect()] == [("c", *[None] * 6)]
    assert {r[0] for r in df.where("error is null").select("image_id").distinct().collect()} == {"a/slide", "b/slide"}
    assert df.where("error is null").count() == 2 * 4 * 3
    shapes = {r["image_id"]: r for r in flows.read(spark, str(tmp_path), metadata="true").collect()}
    assert shapes["a/slide"]["error"] is None and shapes["c"]["height"] is None and shapes["c"]["error"]
    out = pipeline.run(df, 1, {2: "A", 3: "B"}, partial(segment.threshold_segmenter, least=30.0))
    assert {r["image_id"]: (r["n_cells"], r["failed"]) for r in out.counts().collect()} == {"a/slide": (5, False), "b/slide": (5, False), "c": (0, True)}
    assert tuple(out.totals().first())[:4] == (3, 2, 1, 8) and [r["image_id"] for r in out.failed.collect()] == ["c"]


def test_filters_reach_the_source(spark, tmp_path):
    slide(tmp_path)
    df = flows.read(spark, str(tmp_path), tile="64").where("channel = 2 and tile_x in (0, 64) and tile_y = 64 and image_id = 's1'")
    assert {(r["tile_y"], r["tile_x"], r["channel"]) for r in df.collect()} == {(64, 0, 2), (64, 64, 2)}
    reader = slides.PrunedReader({"path": str(tmp_path), "tile": "64"})
    from pyspark.sql.datasource import EqualTo, In

    list(reader.pushFilters([EqualTo(("channel",), 2), In(("tile_x",), (0, 64)), EqualTo(("tile_x",), 64), EqualTo(("image_id",), "other")]))
    assert reader.only == {"channel": {2}, "tile_x": {64}, "image_id": {"other"}} and len(reader.partitions()) == 1


def test_source_options(spark, tmp_path):
    stack = slide(tmp_path)
    halo = flows.read(spark, str(tmp_path), tile="64", halo="8", channels="1").where("tile_y = 64 and tile_x = 64").first()
    assert (halo["h"], halo["w"]) == (40, 24) and np.allclose(halo["pixels"], stack[0, 56:96, 56:80].ravel())
    assert {r["h"] for r in flows.read(spark, str(tmp_path), tile="512", effective="true", channels="1").collect()} == {64, 32}
    assert flows.read(spark, str(tmp_path), tile="16", channels="1", max_tiles="7").count() == 6
    few = [flows.read(spark, str(tmp_path), tile="16", channels="1", sample="4", parts=p).select("tile_y", "tile_x").sort("tile_y", "tile_x").collect() for p in ("1", "5")]
    assert few[0] == few[1] and len(few[0]) == 4
    for window, (y, x, h, w) in {"90,70,50,50": (90, 70, 6, 10), "centre,40,30": (28, 25, 40, 30), "-5,3,10,10": (0, 3, 10, 10)}.items():
        r = flows.read(spark, str(tmp_path), channels="3", window=window).first()
        assert (r["tile_y"], r["tile_x"], r["h"], r["w"]) == (y, x, h, w) and np.allclose(r["pixels"], stack[2, y : y + h, x : x + w].ravel())
    np.save(tmp_path / "wide.npy", np.moveaxis(stack, 0, -1))
    shapes = {r["image_id"]: (r["n_channels"], r["height"], r["width"]) for r in flows.read(spark, str(tmp_path), metadata="true").collect()}
    assert shapes["wide"] == (3, 96, 80)
    assert codecs.oriented(np.zeros((2, 5, 6, 7)), "TYXC").shape == (7, 5, 6) and codecs.oriented(np.zeros((5, 6)), "YX").shape == (1, 5, 6)


def tiff(path, planes, order="<", compression=1, tile=None, rows=5, predictor=1):
    """A plain TIFF writer for tests: strips or tiles, a page a plane."""
    import struct
    import zlib

    with open(path, "wb") as f:
        f.write(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
        link = 4
        for p in planes:
            h, w = p.shape
            pieces = [p[i : i + rows] for i in range(0, h, rows)]
            if tile:
                pad = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), p.dtype)
                pad[:h, :w] = p
                pieces = [pad[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
            places = []
            for q in pieces:
                q = np.concatenate([q[:, :1], np.diff(q, axis=1)], axis=1) if predictor == 2 else q
                data = q.astype(p.dtype.newbyteorder(order)).tobytes()
                places.append((f.tell(), len(data) if compression == 1 else len(data := zlib.compress(data))))
                f.write(data)
            tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [p.dtype.itemsize * 8]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[p.dtype.kind]])]
            tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, [a for a, _ in places]), (325, 4, [n for _, n in places])] if tile else [(273, 4, [a for a, _ in places]), (278, 4, [rows]), (279, 4, [n for _, n in places])]
            body = b""
            for tag, kind, values in sorted(tags):
                raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
                if len(raw) > 4:
                    raw, at = struct.pack(order + "I", f.tell()), raw
                    f.write(at)
                body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
            at = f.tell()
            f.write(struct.pack(order + "H", len(tags)) + body)
            end = f.tell()
            f.write(struct.pack(order + "I", 0))
            f.seek(link)
            f.write(struct.pack(order + "I", at))
            f.seek(0, 2)
            link = end


@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
@pytest.mark.parametrize(("order", "compression", "tile"), [("<", 1, None), (">", 8, None), ("<", 8, 16), (">", 1, 16)])
def test_tiff_windows(tmp_path, kind, order, compression, tile):
    rng = np.random.default_rng(0)
    planes = [rng.integers(0, 200, (37, 45)).astype(kind) for _ in range(3)]
    tiff(tmp_path / "a.tif", [*planes, planes[0][:10, :12]], order, compression, tile)
    stack = codecs.open_stack(str(tmp_path / "a.tif"))
    assert stack.shape == (3, 37, 45)  # the small page is a reduced level
    for y, x, h, w in ((0, 0, 37, 45), (3, 7, 20, 30), (30, 40, 20, 20), (16, 16, 1, 1)):
        for c in range(3):
            assert (stack.window(c, y, x, h, w) == planes[c][y : y + h, x : x + w]).all()


def test_tiff_differences_and_slides(spark, tmp_path):
    plane = np.random.default_rng(1).integers(0, 60_000, (40, 33)).astype("u2")
    tiff(tmp_path / "d.qptiff", [plane, plane[::-1]], compression=8, predictor=2)
    got = flows.read(spark, str(tmp_path), tile="16").where("tile_y = 16 and tile_x = 32 and channel = 2").first()
    assert got["pixels"] == plane[::-1][16:32, 32:].ravel().tolist()
    (tmp_path / "bad.tif").write_bytes(b"II*\0....")
    assert flows.read(spark, str(tmp_path), metadata="true").where("error is not null").count() == 1


def test_map_as_tiff(spark, tmp_path):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y), int(v)) for i, (x, y, v) in enumerate(zip(rng.uniform(0, 1400, 300), rng.uniform(0, 1100, 300), rng.integers(1, 9, 300)))]
    cells = spark.createDataFrame(pts, "o int, x double, y double, value int")
    export.write_map(cells, str(tmp_path / "map.tif"), 1100, 1400, "o")
    pages = codecs.tiff_pages(str(tmp_path / "map.tif"))
    assert [(p.height, p.width) for p in pages] == [(1100, 1400), (550, 700)]
    whole = np.zeros((1100, 1400), int)
    for r in export.raster(cells, 1100, 1400, "o").collect():
        whole[r["py"], r["px"]] = r["value"]
    assert (pages[0].window(0, 0, 0, 1100, 1400) == whole).all()
    half = np.zeros((550, 700), int)
    for r in export.pyramid(cells, 1100, 1400, "o").collect():
        half[r["py"], r["px"]] = r["value"]
    assert (pages[1].window(0, 0, 0, 550, 700) == half).all()


def test_pngs(spark, tmp_path):
    rng = np.random.default_rng(3)
    for image in (rng.integers(0, 255, (9, 7)).astype("u1"), rng.integers(0, 60_000, (9, 7)).astype("u2"), rng.integers(0, 255, (9, 7, 3)).astype("u1")):
        assert (codecs.decode_png(codecs.encode_png(image)) == image).all()
    labels = rng.integers(0, 300, (12, 10))
    tiles_ = spark.createDataFrame([("s/1", 0, 512, 12, 10, labels.ravel().tolist())], "image_id string, tile_x long, tile_y long, h int, w int, labels array<int>")
    for name in ("labels", "mask", "colored"):
        assert export.write_pngs(tiles_, str(tmp_path), name).count() == 1
    found = tables.label_tiles(spark, str(tmp_path)).select("tile_x", "tile_y", "content")
    got = tables.labels(found).first()
    assert (got["tile_x"], got["tile_y"], got["h"], got["w"]) == (0, 512, 12, 10) and got["labels"] == labels.ravel().tolist()
    (tmp_path / "roi_label_1_2.png").write_bytes(b"x")
    assert tables.labels(tables.label_tiles(spark, str(tmp_path))).where("error is not null").count() == 1
    mask = spark.read.format("binaryFile").load(str(tmp_path / "s/1/mask_0_512.png"))
    assert tables.pictures(mask.select("content")).first()["pixels"] == np.repeat((labels.ravel() > 0) * 255, 3).tolist()
    assert export.colored(np.array([[0, 1], [2, 3]]))[0, 0].tolist() == [0, 0, 0]


def paeth_png(image):
    """The image with every filter of the format in turn, written plainly."""
    import struct
    import zlib

    rows, above = b"", np.zeros(image.shape[1], int)
    for y, line in enumerate(image.astype(int)):
        left, corner = np.r_[0, line[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        guess = [np.zeros_like(line), left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][y % 5]
        rows += bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return codecs.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_filters():
    image = np.random.default_rng(4).integers(0, 256, (15, 11)).astype("u1")
    assert (codecs.decode_png(paeth_png(image)) == image).all()


def test_quality_control(spark, tmp_path):
    """Planted drift, autofluorescence and a blurred corner, against NumPy on the whole image."""
    rng = np.random.default_rng(6)
    base = qc.blur(rng.random((160, 192)), 0.6, 2) * 1000
    glow = np.round(qc.blur(rng.random((160, 192)), 6, 18) * 3000 + (rng.random((160, 192)) > 0.98) * 200)
    stack = np.stack([base, np.roll(base, (2, -3), (0, 1)), base * 0.5 + rng.random((160, 192)) * 300, glow]).astype(np.float32)
    np.save(tmp_path / "s.npy", stack)
    (tmp_path / "broken.npy").write_bytes(b"x")
    panel = [(1, "DAPI", "-", "", True, False), (2, "Opal1", "M", "", False, False), (3, "Opal2", "N", "", False, False), (4, "AF", "AF", "", False, True)]
    out = flows.quality_control(spark, str(tmp_path), panel, tile=64, radius=4)
    drift = {r["channel"]: (r["max_px"], r["mean_px"]) for r in out["drift_summary"].collect()}
    assert drift["DAPI"] == (0.0, 0.0) and abs(drift["Opal1"][1] - np.hypot(2, 3)) < 0.2
    assert out["drift"].where("channel = 'Opal1'").first()["dy"] == -2.0
    want = np.corrcoef(stack.reshape(4, -1).astype(float))
    names = ["DAPI", "Opal1", "Opal2", "AF"]
    got = {(r["a"], r["b"]): r["r"] for r in out["correlation"].collect()}
    assert all(np.isclose(got[a, b], want[i, j]) for i, a in enumerate(names) for j, b in enumerate(names))
    assert np.isclose(out["crosstalk"].first()["mean_abs_offdiag"], np.abs(want - np.diag(np.diag(want))).mean())
    sharp = [qc.sharpness(stack[0, y : y + 64, x : x + 64].astype(float)) for y in range(0, 160, 64) for x in range(0, 192, 64)]
    q = out["quality"].first()
    assert np.isclose(q["threshold"], np.percentile(sharp, 20)) and np.isclose(q["low_quality_ratio"], np.mean(np.array(sharp) < np.percentile(sharp, 20)))
    raw = qc.unit(stack[3].astype(float))
    bent = qc.unit(qc.top_hat(raw, 4))
    af = out["af"].first()
    assert np.isclose(af["median_raw"], np.median(raw), atol=1e-6) and np.isclose(af["median_corrected"], np.median(bent), atol=1e-6)
    bins = {r["bin"]: r["n"] for r in out["af_histogram"].where("kind = 'raw'").collect()}
    assert sum(bins.values()) == raw.size and np.abs(np.array([bins.get(i, 0) for i in range(64)]) - np.histogram(raw, 64)[0]).sum() <= 20
    assert out["failed"].first()["image_id"] == "broken" and out["failed"].count() == 1
    r = out["report"].first()
    assert r["file"] == "s" and list(r["shape"]) == [4, 160, 192] and set(r["drift"]) == set(names) and r["crosstalk"]["matrix_summary"]["max"] > 0.99
    flows.write_report(out, str(tmp_path / "qc"))
    text = json.loads(spark.read.text(str(tmp_path / "qc/qc_report.json")).first()[0])
    assert set(text) == {"file", "shape", "drift", "crosstalk", "af", "quality"}
    other = flows.quality_control(spark, str(tmp_path), panel, tile=64, reference="Opal1", level="basic", max_tiles=4)
    assert {r["channel"]: r["mean_px"] for r in other["drift_summary"].collect()}["Opal1"] == 0.0 and "af" not in other and other["drift"].select("cy", "cx").distinct().count() == 3
    assert flows.quality_control(spark, str(tmp_path), panel, level="off") == {}
    edges_ = qc.overlays(flows.read(spark, str(tmp_path), layout="stack", tile="64"), 1).where("channel = 2").first()
    assert len(edges_["rgb"]) == 3 * edges_["h"] * edges_["w"]


def test_cohort_flow(spark, tmp_path):
    for name in ("s1", "s2"):
        slide(tmp_path, name)
    least = partial(segment.threshold_segmenter, least=30.0)
    counts = flows.sampled_features(spark, str(tmp_path), str(tmp_path / "out"), {2: "A", 3: "B"}, n=99, tile=64, segmenter=least)
    assert sum(r["n_cells"] for r in counts.collect()) == 10
    told = flows.cluster_cohort(spark, str(tmp_path / "out/outputs"), str(tmp_path / "all.csv"), k=2, name="*.csv")
    assert told.count() == 10 and {r["sample"] for r in told.collect()} == {"s1", "s2"} and told.select("cluster").distinct().count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "all.csv")).count() == 10
    assert export.combined_path("/r") == "/r/combined_features_cluster.csv" and export.combined_path("/r", str(tmp_path)) == f"{tmp_path}/combined_features_cluster.csv"


def test_cohort_with_empty_and_odd_files(spark, tmp_path):
    for i, text in enumerate(["cell_id,A\nc1,1.5\n", "", "cell_id,B\nc2,2.5\nc3,x\n", "cell_id,A\nc4,\n", "\n"]):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}/features_matrix_mean.csv").write_text(text)
    got = {r["cell_id"]: (r["A"], r["B"]) for r in tables.cohort(spark, str(tmp_path)).collect()}
    assert got == {"c1": (1.5, 0.0), "c2": (0.0, 2.5), "c3": (0.0, 0.0), "c4": (0.0, 0.0)}
    assert [r["path"][-27:] for r in tables.unread(spark, str(tmp_path)).collect()] == ["/4/features_matrix_mean.csv"]
    with pytest.raises(FileNotFoundError):
        tables.cohort(spark, str(tmp_path), "none.csv")


def test_lists_of_files(spark, tmp_path):
    for name in ("b.TIF", "a.qptiff", "sub/c.qptif", "n.txt", "roi_label_512_0.png", "roi_label_0_512.png", "roi_label_colored_0_0.png", "mask_0_0.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].split("/")[-1] for r in tables.images(spark, str(tmp_path)).collect()] == ["a.qptiff", "b.TIF", "c.qptif"]
    assert tables.first_image(spark, str(tmp_path)).first()["path"].endswith("a.qptiff")
    assert [(r["tile_x"], r["tile_y"]) for r in tables.label_tiles(spark, str(tmp_path)).collect()] == [(512, 0), (0, 512)]


def test_settings_and_command_line(spark, tmp_path):
    (tmp_path / "run.yaml").write_text("tile: 256\nseed: 7\nother: 1\n")
    s = config.load(str(tmp_path / "run.yaml"), {"LAMELLA_TILE": "128"}, seed=0, tile=64, k=None)
    assert (s.tile, s.seed, s.k, s.qc) == (128, 0, None, "full")
    (tmp_path / "panel.yaml").write_text("- {index: 1, name: DAPI, is_dapi: true}\n- {name: odd}\n- {index: 2, name: X, marker: M}\n")
    assert panels.config("KidneyCancer", str(tmp_path / "panel.yaml")) == [(1, "DAPI", "", "", True, False), (2, "X", "M", "", False, False)]
    assert panels.config("None") is None and len(panels.config("BladderCancer")) == 8
    (tmp_path / "in").mkdir()
    slide(tmp_path / "in")
    assert cli.main(["full", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--tile", "64", "--qc", "basic"]) == 0
    assert (tmp_path / "out/qc_report.json").exists() and (tmp_path / "out/features_long.csv").exists()
    assert cli.main(["full", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "x"), "--cancer-type", "none"]) == 2
    assert cli.main(["segmentation", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "seg"), "--tile", "64"]) == 0
    assert len(list((tmp_path / "seg/s1").glob("roi_label_*.png"))) == 4 and (tmp_path / "seg/nuclei_centroids.csv").exists()


def test_prepared_nuclei_and_overlaps(spark):
    rng = np.random.default_rng(9)
    image = rng.normal(50, 3, (80, 80)) + np.linspace(0, 60, 80)[None]
    for cy, cx in ((20, 20), (55, 60)):
        image[cy - 4 : cy + 5, cx - 4 : cx + 5] += 60
    flat = segment.prepared(image)
    assert flat.min() >= 0 and flat.max() <= 1 and flat[20, 20] > 0.9 and flat[55, 60] > 0.9 and not segment.prepared(np.ones((9, 9))).any()
    discs = [(0, 1, 10.0, 10.0, 5.0), (0, 2, 14.0, 10.0, 5.0), (0, 3, 40.0, 40.0, 5.0), (0, 4, 40.0, 41.0, 1.0)]
    df = spark.createDataFrame(discs, "t int, label long, cx double, cy double, R double")
    got = {r["label"]: r["overlap"] for r in segment.overlaps(df, ["t"]).collect()}
    d = 4.0
    lens = 2 * 25 * np.arccos(d / 10) - d / 2 * np.sqrt(100 - d * d)
    assert np.isclose(got[1], lens / (25 * np.pi)) and np.isclose(got[4], 1.0) and np.isclose(got[3], 1 / 25)
    nuclei = df.drop("R").withColumn("radius", F.lit(3.0))
    free = segment.limited_cells(nuclei.where("label <> 4"), ["t"], 60, 60)
    assert free.where("label = 3").count() == sum((y - 40) ** 2 + (x - 40) ** 2 <= 5.4**2 for y in range(60) for x in range(60))


def test_choosing_k_and_gain(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.3, (30, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows = {r["k"]: r for r in cluster.choose_k(df, range(2, 5)).collect()}
    assert max(rows, key=lambda k: rows[k]["ch_index"]) == max(rows, key=lambda k: rows[k]["silhouette"]) == 3 and rows[2]["inertia"] > rows[3]["inertia"]
    good = df.withColumn("cluster", F.floor(F.col("id") / 30))
    bad = df.withColumn("cluster", F.col("id") % 3)
    assert cluster.gain(good, bad).first()["better"] and not cluster.gain(bad, good).first()["better"]
    assert cluster.silhouette(good, 3).agg(F.avg("silhouette")).first()[0] == pytest.approx(cluster.silhouette(good).agg(F.avg("silhouette")).first()[0])


def test_autofluorescence_gain(spark):
    rng = np.random.default_rng(13)
    rows = [(i, float(rng.normal()), float(rng.normal()), float(rng.normal() + 50 * (i % 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, af double")
    r = flows.autofluorescence_gain(df, ["a", "b"], "af", k=2).first()
    assert r["ch_with"] > 0 and r["ch_without"] > 0 and r["better"] == (r["gain"] >= 0.05)


def test_plugins(spark, tmp_path):
    class Flat:
        shape = (1, 8, 8)

        def __init__(self, path):
            pass

        def window(self, c, y, x, h, w):
            return np.full((h, w), 3.0)

    plugins.register("codec", ".flat", Flat)
    assert plugins.find("codec", ".flat") is Flat and codecs.open_stack("a.flat").window(0, 0, 0, 2, 2).sum() == 12
    del codecs.CODECS[".flat"]
    plugins.register("step", "twice", lambda df: df.union(df))
    assert pipeline.chain(spark.range(3), plugins.find("step", "twice"), plugins.find("step", "twice")).count() == 12
    with pytest.raises(KeyError, match="no segmenter"):
        plugins.find("segmenter", "none")


def test_registered_components_equal_numpy(spark, sf_dir):
    v = np.array([r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)
    z = (v - v.mean(axis=0)) / v.std(axis=0)
    u, s, _ = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    share = (s**2 / (s**2).sum())[:20]
    rows = registry.QUERIES["pca_explained_variance"](spark, sf_dir).orderBy("component").collect()
    assert np.allclose([r["share"] for r in rows], share) and np.allclose([r["cumulative"] for r in rows], np.cumsum(share) / share.sum())
    x = u[:, :20] * s[:20]
    draws, best = np.random.default_rng(42), (np.inf, None, None)
    for _ in range(5):
        c, last = x[draws.choice(len(x), size=8, replace=False)].copy(), np.zeros(len(x), int)
        for _ in range(100):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            if (own == last).all():
                break
            last = own
            c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(8)])
        cost = ((x - c[last]) ** 2).sum()
        best = min(best, (cost, last, c), key=lambda b: b[0])
    got = [r["cluster"] for r in registry.QUERIES["kmeans_full"](spark, sf_dir).orderBy("id").collect()]
    assert got == best[1].tolist()


def test_rank_correlation_level(spark):
    import math

    rng = np.random.default_rng(12)
    rows = [(float(a), float(a * k + b), g) for g, k in (("weak", 0.0), ("strong", 1.0)) for a, b in zip(rng.integers(0, 20, 300), rng.integers(0, 20, 300))]
    df = spark.createDataFrame(rows, "a double, b double, g string")
    for r in analysis.spearman(df, "a", "b", ["g"]).collect():
        z = abs(r["rho"]) * math.sqrt(298 / (1 - r["rho"] ** 2))
        assert r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6) and r["notable"] == (r["g"] == "strong")


def test_artifacts(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(100)] + [(100, 99.0, 99.0), (101, 99.0, 1.0)]
    got = flows.artifacts(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"])
    assert [r["id"] for r in got.where("artifact").collect()] == [100] and got.count() == 102


def test_windowed_counts(spark, tmp_path):
    rows = [("2026-01-01 00:00:10", "a"), ("2026-01-01 00:01:00", "a"), ("2026-01-01 00:06:00", "b")]
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k").coalesce(1).write.parquet(str(src))
    counted = ingest.windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(str(src)), "t", "k")
    q = counted.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(out)).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r["k"], r["n"]) for r in spark.table("windowed").collect()) == [("a", 2), ("b", 1)]


def test_tile_rules(spark):
    img = spark.createDataFrame([("i", 100, 130)], "image_id string, height long, width long")
    g = tiles.grid(img, 64)
    assert g.count() == 6 and tiles.window(g, 70, 0, 10, 10).count() == 1
    assert one(spark, tiles.effective_size(F.lit(500), F.lit(700), 512)) == 250
    pts = spark.range(100).withColumn("g", F.col("id") % 2)
    a, b = (sorted(r["id"] for r in tiles.sample_per_group(p, ["g"], "id", 3).collect()) for p in (pts, pts.repartition(7)))
    assert a == b and len(a) == 6


def test_points_json(spark, tmp_path):
    cells = spark.createDataFrame([(1.0, 2.0, 3), (4.0, 5.0, 1)], "x double, y double, cluster int")
    export.write_points(cells, str(tmp_path / "out"))
    rows = [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    three = next(r for r in rows if r["properties"]["class_value"] == 3)
    export.write_classes(cells, str(tmp_path / "classes"))
    text = next((tmp_path / "classes").glob("part*")).read_text()
    assert text.startswith("[\n  {") and [c["value"] for c in json.loads(text)] == [1, 3]
    assert three["properties"]["note"] == "k=2" + export.NOTE
    assert export.points(cells.unionByName(spark.createDataFrame([(0.0, 0.0, None)], "x double, y double, cluster int"))).count() == 3
    assert three["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]} and three["properties"]["class_color"] == "#377EB8"


def test_ingest_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for step, name in enumerate(["a.npy", "b.npy"]):
        (folder / name).write_bytes(b"x")
        q = ingest.follow(spark, str(folder), str(tmp_path / "done"), str(tmp_path / "check"), lambda df: seen.extend(r["path"][-5:] for r in df.collect()))
        q.awaitTermination(60)
    assert seen == ["a.npy", "b.npy"]
    assert sorted((r["path"][-5:], r["batch"]) for r in ingest.manifest(spark, str(tmp_path / "done")).collect()) == [("a.npy", 0), ("b.npy", 1)]
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/part.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|corrupt|footer"):
        ingest.manifest(spark, str(tmp_path / "odd")).collect()


def test_reports(spark):
    d = spark.createDataFrame([("c1", 3.0, 4.0), ("c1", 0.0, 1.0)], "channel string, dx double, dy double")
    cross = spark.createDataFrame([(0.1, 1.0, 0.2)], "min double, max double, mean_abs_offdiag double")
    quality = spark.createDataFrame([(5.0, 0.2)], "threshold double, low_quality_ratio double")
    d, cross, quality = (x.withColumn("image_id", F.lit("i")) for x in (d, cross, quality))
    shapes = spark.createDataFrame([("i", 3, 10, 20)], "image_id string, n_channels int, height long, width long")
    r = qc.report(qc.drift_summary(d, ["image_id", "channel"]), cross, quality, shapes).first()
    assert r["drift"]["c1"]["max_px"] == 5.0 and r["crosstalk"]["matrix_summary"]["max"] == 1.0 and r["quality"]["threshold"] == 5.0


def test_silhouette_far_from_zero(spark):
    """Tight clusters far from the origin, copies, a cluster of one; blocks of any number give the same."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 1e-3, (40, 5)) for c in (1e5, 1e5 + 1, -3)])
    x[7] = x[8]
    of = [*np.repeat([0, 1, 2], 40).tolist()]
    of[5] = 9
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, of))], "id long, v array<double>, cluster int")
    d, own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.array(of)
    want = []
    for i, c in enumerate(of):
        b = min(d[i, own == k].mean() for k in {*of} - {c})
        a = d[i, own == c].sum() / max((own == c).sum() - 1, 1)
        want.append((b - a) / max(a, b) if (own == c).sum() > 1 else 0.0)
    for blocks in (None, 3):
        got = {r["id"]: r["silhouette"] for r in cluster.silhouette(df, blocks).collect()}
        assert np.allclose([got[i] for i in range(len(x))], want, rtol=0, atol=1e-8)


def test_silhouette_compares_blocks_once(spark):
    """A point is sent once to the tasks of few large blocks, not twice to one for each 2048 others (196 of them)."""
    points = spark.range(400_000).select("id", F.array(F.lit(0.0)).alias("v"), (F.col("id") % 2).alias("cluster"))
    plan = cluster.silhouette(points)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "195" not in plan
