"""Registered queries of the engine and their SQL, over the stand-in tables.

Pixels are ``lineitem`` rows: tile = supplier mod 10, label = line number - 1
(0 is background), channel = return flag, value = extended price. Feature
vectors are ``embeddings``; nuclei are ``customer`` and ``part`` rows; samples,
clusters and paths come from ``events``, ``orders`` and ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ranks import quantiles
from ..operators import analysis, cluster, density, export, features, qc, segment, tiles
from ..sources import panels, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CHANNELS = ["A", "N", "R"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("tile_x"),
        F.lit(0).cast("long").alias("tile_y"),
        (F.col("l_linenumber") - 1).cast("long").alias("label"),
        F.col("l_returnflag").alias("channel"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_partkey") % 64).alias("x"),
        (F.col("l_orderkey") % 64).alias("y"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: C.clean(x))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"), "label")


PIXELS = """px AS (
  SELECT l_suppkey % 10 AS tile_x, 0::BIGINT AS tile_y, (l_linenumber - 1)::BIGINT AS label, l_returnflag AS channel,
    l_extendedprice AS value, l_partkey % 64 AS x, l_orderkey % 64 AS y FROM lineitem
)"""
LONG = f"""WITH {PIXELS}, bg AS (
  SELECT tile_x, tile_y, channel, median(value) AS b FROM px WHERE label = 0 GROUP BY ALL
), stats AS (
  SELECT tile_x, tile_y, label, channel, avg(value) AS mean, median(value) AS median, sum(value) AS sum,
    stddev_pop(value) AS std, count(*)::BIGINT AS n_pixels FROM px WHERE label > 0 GROUP BY ALL
), long AS (
  SELECT s.*, mean - coalesce(b, 0) AS mean_bg_corr, median - coalesce(b, 0) AS median_bg_corr
  FROM stats s LEFT JOIN bg USING (tile_x, tile_y, channel)
)"""
VECTORS = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""
CELLS = f"""{VECTORS}, cells AS (
  SELECT id, label, unnest(range(len(v)))::INTEGER AS dim, unnest(v) AS x FROM v
)"""

# ---- Features


@query(f"""{LONG} SELECT tile_x, tile_y, label, channel, round(mean, 4) AS mean, round(median, 4) AS median, round(sum, 2) AS sum,
  round(std, 4) AS std, n_pixels, round(mean_bg_corr, 4) AS mean_bg_corr, round(median_bg_corr, 4) AS median_bg_corr FROM long""")
def features_long(spark, sf_dir):
    out = features.long(pixels(spark, sf_dir))
    return rounded(rounded(out, 2, "sum"), 4, "mean", "median", "std", "mean_bg_corr", "median_bg_corr")


@query(f"""{LONG} SELECT tile_x || '_' || tile_y || '_' || label AS cell_id, tile_x, tile_y, label,
  round(coalesce(max(mean_bg_corr) FILTER (channel = 'A'), 0), 4) AS "A",
  round(coalesce(max(mean_bg_corr) FILTER (channel = 'N'), 0), 4) AS "N",
  round(coalesce(max(mean_bg_corr) FILTER (channel = 'R'), 0), 4) AS "R" FROM long GROUP BY tile_x, tile_y, label""")
def features_matrix(spark, sf_dir):
    return rounded(features.matrix(features.long(pixels(spark, sf_dir)), CHANNELS))


@query(f"""WITH {PIXELS}, b AS (
  SELECT tile_x, channel, coalesce(median(value) FILTER (label = 0), 0) AS background, count(*) AS n FROM px GROUP BY ALL
) SELECT tile_x, channel, round(background, 4) AS background, n::BIGINT AS n FROM b""")
def background_median_window(spark, sf_dir):
    rows = features.background_of_rows(pixels(spark, sf_dir))
    return rounded(rows.groupBy("tile_x", "channel", "background").agg(F.count("*").alias("n")))


@query(f"""WITH {PIXELS}, spots AS (SELECT DISTINCT tile_x, tile_y, label, x, y FROM px WHERE label > 0)
SELECT tile_x, tile_y, label, round(avg(x), 4) AS local_x, round(avg(y), 4) AS local_y, count(*)::BIGINT AS area FROM spots GROUP BY ALL""")
def roi_centroid(spark, sf_dir):
    return rounded(features.centroids(pixels(spark, sf_dir)))


@query(f"""WITH {PIXELS} SELECT tile_x, label, round(avg(y), 4) AS cy, round(avg(x), 4) AS cx, count(*)::BIGINT AS area,
  round(sqrt(count(*) / pi()), 4) AS radius FROM px WHERE label > 0 GROUP BY ALL""")
def region_props(spark, sf_dir):
    return rounded(segment.regions(pixels(spark, sf_dir), ["tile_x"]))


@query(f"""WITH {PIXELS}, m AS (
  SELECT tile_x, tile_y, label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*)::BIGINT AS area,
    var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM px WHERE label > 0 GROUP BY ALL
), s AS (SELECT *, (vx + vy) / 2 AS half, sqrt(((vx - vy) / 2) ** 2 + vxy ** 2) AS spread FROM m)
SELECT tile_x, tile_y, label, x0, y0, x1, y1, area, round(sqrt(4 * area / pi()), 4) AS equivalent_diameter,
  round(4 * sqrt(half + spread), 4) AS major_axis, round(4 * sqrt(greatest(half - spread, 0)), 4) AS minor_axis FROM s""")
def morphology(spark, sf_dir):
    return rounded(features.shape(pixels(spark, sf_dir)))


@query(f"WITH {PIXELS} SELECT count(DISTINCT (tile_x, tile_y, label))::BIGINT AS n_cells FROM px WHERE label > 0")
def cell_count_distinct(spark, sf_dir):
    return features.cell_count(pixels(spark, sf_dir))


@query(f"""WITH {PIXELS}, e AS (SELECT tile_x, channel, min(value) AS lo, max(value) AS hi FROM px GROUP BY ALL)
SELECT tile_x, channel, round(sum((value - lo) / (hi - lo)), 3) AS total, sum(floor((value - lo) / (hi - lo) * 255))::BIGINT AS total8,
  count(*)::BIGINT AS n FROM px JOIN e USING (tile_x, channel) GROUP BY ALL""")
def minmax_uint8(spark, sf_dir):
    scaled = features.scaled(pixels(spark, sf_dir), ["tile_x", "channel"])
    return rounded(scaled.groupBy("tile_x", "channel").agg(F.sum("unit").alias("total"), F.sum("byte").alias("total8"), F.count("*").alias("n")), 3)


PANEL = "panel AS (SELECT * FROM (VALUES ('A', 2), ('N', 3), ('R', 4)) p(channel, channel_index))"
PLACED = f"""{LONG}, {PANEL}, spots AS (SELECT DISTINCT tile_x, tile_y, label, x, y FROM px WHERE label > 0
), place AS (SELECT tile_x, tile_y, label, avg(x) AS local_x, avg(y) AS local_y, count(*) AS area FROM spots GROUP BY ALL
), placed AS (SELECT * FROM long JOIN place USING (tile_x, tile_y, label) JOIN panel USING (channel))"""


def placed(spark, sf_dir):
    px = pixels(spark, sf_dir)
    panel = spark.createDataFrame([(i, c) for i, c in enumerate(CHANNELS, 2)], "index int, name string")
    return features.placed(features.long(px), features.centroids(px), panel)


@query(f"""{PLACED} SELECT tile_x, tile_y, label, round(local_x, 4) AS local_x, round(local_y, 4) AS local_y, channel_index, channel AS channel_name,
  round(mean, 4) AS mean, round(median, 4) AS median, round(sum, 2) AS sum, round(std, 4) AS std, round(mean_bg_corr, 4) AS mean_bg_corr,
  round(median_bg_corr, 4) AS median_bg_corr, n_pixels FROM placed""")
def features_long_table(spark, sf_dir):
    """All fourteen columns of the long table."""
    out = rounded(placed(spark, sf_dir), 2, "sum")
    return rounded(out, 4, "local_x", "local_y", "mean", "median", "std", "mean_bg_corr", "median_bg_corr")


@query(f"""{PLACED} SELECT tile_x || '_' || tile_y || '_' || label AS cell_id, tile_x, tile_y, label, round(max(local_x), 4) AS local_x, round(max(local_y), 4) AS local_y,
  round(coalesce(max(mean_bg_corr) FILTER (channel = 'A'), 0), 4) AS "A", round(coalesce(max(mean_bg_corr) FILTER (channel = 'N'), 0), 4) AS "N",
  round(coalesce(max(mean_bg_corr) FILTER (channel = 'R'), 0), 4) AS "R" FROM placed GROUP BY tile_x, tile_y, label""")
def features_matrix_table(spark, sf_dir):
    """The matrix with positions, in order of the cells' names."""
    return rounded(features.matrix(placed(spark, sf_dir), CHANNELS))


@query(f"""{PLACED} SELECT tile_x, label, round(avg(local_x) + tile_x * 512, 4) AS global_x, round(avg(local_y) + tile_y * 512, 4) AS global_y FROM placed
GROUP BY tile_x, tile_y, label""")
def nuclei_global(spark, sf_dir):
    c = features.centroids(pixels(spark, sf_dir))
    return rounded(c.select("tile_x", "label", C.to_global(F.col("tile_x") * 512, F.col("local_x")).alias("global_x"), C.to_global(F.col("tile_y") * 512, F.col("local_y")).alias("global_y")))


@query(f"""{LONG}, own AS (SELECT tile_x, tile_y, label, mean AS af_raw, mean_bg_corr AS af_bg_corr FROM long WHERE channel = 'R'), e AS (SELECT min(af_bg_corr) AS lo, max(af_bg_corr) AS hi FROM own)
SELECT tile_x, tile_y, label, round(af_raw, 4) AS af_raw, round(af_bg_corr, 4) AS af_bg_corr, round((af_bg_corr - lo) / (hi - lo), 6) AS af_norm FROM own, e""")
def autofluorescence(spark, sf_dir):
    out = features.with_autofluorescence(features.long(pixels(spark, sf_dir)), "R")
    return rounded(rounded(out, 4, "af_raw", "af_bg_corr"), 6, "af_norm")


@query(f"""{LONG}, w AS (SELECT tile_x, tile_y, label, coalesce(max(mean_bg_corr) FILTER (channel = 'A'), 0) AS "A", coalesce(max(mean_bg_corr) FILTER (channel = 'N'), 0) AS "N"
  FROM long GROUP BY ALL)
SELECT tile_x, label, round("A", 4) AS "A", round(("A" - avg("A") OVER ()) / stddev_pop("A") OVER (), 6) AS "z_A", round(("N" - avg("N") OVER ()) / stddev_pop("N") OVER (), 6) AS "z_N" FROM w""")
def raw_and_normalised(spark, sf_dir):
    z = features.with_normalised(features.matrix(features.long(pixels(spark, sf_dir)), ["A", "N"]), ["A", "N"])
    return rounded(rounded(z.select("tile_x", "label", "A", "z_A", "z_N"), 4, "A"), 6, "z_A", "z_N")


@query(f"""WITH {PIXELS}, own AS (SELECT DISTINCT tile_x, tile_y, label, y, x FROM px WHERE label > 0
), shared AS (SELECT a.tile_x, a.tile_y, a.label, count(*) AS s FROM own a JOIN own b ON a.tile_x = b.tile_x AND a.tile_y = b.tile_y AND a.label = b.label
  AND ((a.y = b.y AND a.x + 1 = b.x) OR (a.x = b.x AND a.y + 1 = b.y)) GROUP BY ALL
), area AS (SELECT tile_x, tile_y, label, count(*) AS n FROM own GROUP BY ALL)
SELECT tile_x, tile_y, label, (4 * n - 2 * coalesce(s, 0))::BIGINT AS perimeter FROM area LEFT JOIN shared USING (tile_x, tile_y, label)""")
def perimeters(spark, sf_dir):
    return features.perimeter(pixels(spark, sf_dir))


@query(f"""WITH {PIXELS}, c AS (SELECT DISTINCT tile_x, tile_y, label FROM px WHERE label > 0)
SELECT tile_x, tile_y, label, row_number() OVER (ORDER BY tile_y, tile_x, label) AS global_label FROM c""")
def global_labels(spark, sf_dir):
    cells = pixels(spark, sf_dir).where("label > 0").select(F.lit("i").alias("image_id"), "tile_x", "tile_y", "label").distinct()
    return segment.unique_labels(cells).drop("image_id")


# ---- Vectors: scaling, reduction, clustering


@query(f"""WITH {CELLS}, m AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS std FROM cells GROUP BY dim)
SELECT id, dim, round((x - mean) / std, 6) AS z FROM cells JOIN m USING (dim)""")
def zscore(spark, sf_dir):
    z = cluster.zscore(vectors(spark, sf_dir))
    return rounded(z.select("id", F.posexplode("v").alias("dim", "z")), 6)


@query(f"""WITH {CELLS} SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.x, b.x), 8) AS covariance
FROM cells a JOIN cells b ON a.id = b.id AND a.dim <= b.dim GROUP BY ALL""")
def covariance_matrix(spark, sf_dir):
    return rounded(cluster.covariance(vectors(spark, sf_dir)), 8)


@query()
def pca_explained_variance(spark, sf_dir):
    _, shares = cluster.pca(cluster.zscore(vectors(spark, sf_dir)), 20)
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "component int, share double")
    return analysis.cumulative_share(rows, "component", "share")


NEAREST = f"""{VECTORS}, cs AS (
  SELECT label AS c, list(m ORDER BY dim) AS centre FROM (
    SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM v) GROUP BY ALL
  ) GROUP BY label
), d AS (SELECT id, c, list_distance(v, centre) AS d FROM v, cs
), r AS (SELECT id, c, d, row_number() OVER (PARTITION BY id ORDER BY d, c) AS r FROM d
), n AS (SELECT a.id, a.c AS cluster, a.d AS d1, b.d AS d2 FROM r a JOIN r b ON a.id = b.id AND a.r = 1 AND b.r = 2)"""


def label_centres(spark, sf_dir):
    v = vectors(spark, sf_dir)
    empty = v.select(F.col("label").alias("c"), F.lit(None).cast("array<double>").alias("centre")).distinct()
    return cluster.update(v.withColumn("cluster", F.col("label")), empty)


@query(f"""WITH {NEAREST} SELECT id, cluster, round(d1, 6) AS d1, round(d2, 6) AS d2,
  round(1 - greatest(0, least(1, d1 / (d2 + 1e-6))), 6) AS confidence FROM n""")
def nearest_centroid(spark, sf_dir):
    near = cluster.assign(vectors(spark, sf_dir).drop("label"), label_centres(spark, sf_dir))
    return rounded(near.drop("v"), 6)


@query(f"WITH {NEAREST} SELECT round(sum(d1 * d1), 6) AS inertia FROM n")
def inertia(spark, sf_dir):
    return rounded(cluster.inertia(cluster.assign(vectors(spark, sf_dir).drop("label"), label_centres(spark, sf_dir))), 6)


@query(f"""WITH {VECTORS}, cs AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS c, v AS centre FROM v ORDER BY id LIMIT 8
), d AS (SELECT id, v, c, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, centre), c) AS r FROM v, cs
), m AS (SELECT c, unnest(range(len(v)))::INTEGER AS dim, unnest(v) AS x FROM d WHERE r = 1)
SELECT c, dim, round(avg(x), 6) AS x FROM m GROUP BY ALL""")
def lloyd_one_step(spark, sf_dir):
    """From the eight vectors of the lowest ids, as k-means takes its first centres from data rows."""
    v = vectors(spark, sf_dir).drop("label")
    first = v.orderBy("id").limit(8).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("a"))
    centres = first.select(F.posexplode("a").alias("c", "s")).select("c", F.col("s.v").alias("centre"))
    new = cluster.update(cluster.assign(v, centres), centres)
    return rounded(new.select("c", F.posexplode("centre").alias("dim", "x")), 6)


@query()
def kmeans_full(spark, sf_dir):
    """z-score, PCA to 20 components, automatic k, k-means and confidence."""
    scores, _ = cluster.pca(cluster.zscore(vectors(spark, sf_dir)), 20)
    k = cluster.auto_k(scores.count())
    return cluster.kmeans(scores, k)[0].select("id", "cluster", "confidence")


@query()
def gaussian_mixture(spark, sf_dir):
    scores, _ = cluster.pca(cluster.zscore(vectors(spark, sf_dir)), 6)
    return cluster.mixture(scores, 8).select("id", "cluster", "confidence")


SILHOUETTE = f"""WITH {VECTORS}, p AS (
  SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM v a, v b GROUP BY ALL
), s AS (
  SELECT id, own, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM p GROUP BY ALL
)"""


@query(f"{SILHOUETTE} SELECT id, own AS cluster, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s")
def silhouette_euclid(spark, sf_dir):
    return rounded(cluster.silhouette(vectors(spark, sf_dir).withColumnRenamed("label", "cluster")), 6)


@query(f"""WITH {CELLS}, o AS (SELECT label, dim, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS w FROM cells GROUP BY ALL
), g AS (SELECT dim, avg(x) AS g FROM cells GROUP BY dim
), s AS (SELECT sum(n * (m - g) ** 2) AS b, sum(w) AS w, count(DISTINCT label) AS k, sum(n) FILTER (dim = 0) AS n FROM o JOIN g USING (dim))
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS ch_index FROM s""")
def ch_index(spark, sf_dir):
    return rounded(cluster.calinski_harabasz(vectors(spark, sf_dir).withColumnRenamed("label", "cluster")), 6)


@query("""WITH c AS (SELECT event_type AS a, user_id % 5 AS b, count(*) AS n FROM events GROUP BY ALL
), t AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS ij, (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM c GROUP BY a)) AS i,
  (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM c GROUP BY b)) AS j, (SELECT sum(n) FROM c) AS al
), e AS (SELECT *, i * j / (al * (al - 1) / 2.0) AS ex FROM t)
SELECT round((ij - ex) / ((i + j) / 2 - ex), 6) AS ari FROM e""")
def ari(spark, sf_dir):
    pairs = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("other"))
    return rounded(cluster.adjusted_rand(pairs, "event_type", "other"), 6)


# ---- Regions


@query("""WITH p AS (SELECT c_nationkey AS tile, c_custkey AS k, c_acctbal AS cx, (c_custkey % 997)::DOUBLE AS cy FROM customer
), d AS (SELECT a.tile, a.k, min(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS d FROM p a JOIN p b ON a.tile = b.tile AND a.k <> b.k GROUP BY ALL)
SELECT tile, k, round(CASE WHEN d <= 300 THEN d END, 4) AS nearest FROM p LEFT JOIN d USING (tile, k)""")
def nearest_neighbour(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("tile"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("cx"), (F.col("c_custkey") % 997).cast("double").alias("cy")
    )
    return rounded(segment.nearest_neighbour(p, ["tile"], "k", 300.0).select("tile", "k", "nearest"))


@query("""WITH n AS (SELECT p_partkey // 40 AS tile, p_partkey AS label, (p_partkey * 13 % 64)::DOUBLE AS cx, p_size::DOUBLE AS cy, 1.0 + p_size % 5 AS "R" FROM part
), g AS (SELECT y, x FROM range(64) t(y), range(64) s(x)
), h AS (SELECT tile, y, x, label, (y - cy) ** 2 + (x - cx) ** 2 AS d FROM n JOIN g ON (y - cy) ** 2 + (x - cx) ** 2 <= "R" * "R")
SELECT tile, y, x, arg_min(label, (d, label)) AS label FROM h GROUP BY tile, y, x""")
def disk_assign(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 40).alias("tile"), F.col("p_partkey").alias("label"), F.col("p_partkey").alias("ord"),
        (F.col("p_partkey") * 13 % 64).cast("double").alias("cx"), F.col("p_size").cast("double").alias("cy"), (F.lit(1.0) + F.col("p_size") % 5).alias("R"),
    )
    return segment.assign_pixels(n, ["tile"], 64, 64)


@query(f"""WITH {PIXELS}, a AS (SELECT tile_x, x, y, count(*) AS area FROM px GROUP BY ALL)
SELECT round(avg((area < 12)::INTEGER), 6) AS fragment_ratio FROM a WHERE area >= 6""")
def fragments(spark, sf_dir):
    cells = pixels(spark, sf_dir).groupBy("tile_x", "x", "y").agg(F.count("*").alias("area"))
    return rounded(segment.drop_fragments(cells, 6, 12)[1], 6)


# ---- Quality control

WIDE = "w AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d FROM lineitem)"
PAIRS = f"""WITH {WIDE}, p AS ({" UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM w" for x in "abcd" for y in "abcd")})"""


def wide(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d")
    )


@query(f"{PAIRS} SELECT a, b, round(r, 6) AS r FROM p")
def crosstalk_matrix(spark, sf_dir):
    return rounded(qc.correlation(wide(spark, sf_dir), list("abcd")), 6)


@query(f"""{PAIRS} SELECT round(min(r), 6) AS min, round(max(r), 6) AS max, round(sum(CASE WHEN a <> b THEN abs(r) ELSE 0 END) / count(*), 6) AS mean_abs_offdiag,
  round(avg(abs(r)) FILTER (a <> b), 6) AS mean_abs_offdiag_strict FROM p""")
def crosstalk_summary(spark, sf_dir):
    return rounded(qc.crosstalk(qc.correlation(wide(spark, sf_dir), list("abcd"))), 6)


@query("""WITH t AS (SELECT l_suppkey, var_pop(l_extendedprice) AS s FROM lineitem GROUP BY ALL), q AS (SELECT quantile_cont(s, 0.2) AS threshold FROM t)
SELECT round(threshold, 2) AS threshold, round(avg((s < threshold)::INTEGER), 6) AS low_quality_ratio FROM t, q GROUP BY threshold""")
def percentile_quality(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.var_pop("l_extendedprice").alias("s"))
    return rounded(rounded(qc.low_quality(t, "s"), 2, "threshold"), 6, "low_quality_ratio")


@query("""WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
SELECT event_type, least(63, floor((value - lo) / (hi - lo) * 64))::INTEGER AS bin, count(*)::BIGINT AS n FROM events JOIN e USING (event_type) GROUP BY ALL""")
def histogram64(spark, sf_dir):
    return qc.histogram(read(spark, sf_dir, "events"), "value", 64, ["event_type"])


@query("""SELECT event_type, round(max(sqrt((value - 50) ** 2 + (user_id % 7) ** 2)), 6) AS max_px,
  round(avg(sqrt((value - 50) ** 2 + (user_id % 7) ** 2)), 6) AS mean_px FROM events GROUP BY event_type""")
def drift_summary(spark, sf_dir):
    fields = read(spark, sf_dir, "events").select("event_type", (F.col("value") - 50).alias("dy"), (F.col("user_id") % 7).cast("double").alias("dx"))
    return rounded(qc.drift_summary(fields, ["event_type"]), 6)


@query("""SELECT l_returnflag AS channel, round((median(l_extendedprice) - median(l_extendedprice * (1 - l_discount))) / (median(l_extendedprice) + 1e-8), 6) AS median_drop_ratio
FROM lineitem GROUP BY ALL""")
def af_drop_ratio(spark, sf_dir):
    both = F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("l_extendedprice").alias("value")), F.struct(F.lit("corrected").alias("kind"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), both.alias("x")).select("channel", "x.kind", "x.value")
    medians = quantiles(rows, "value", [0.5], ["channel", "kind"])
    m = medians.groupBy("channel").agg(*[F.max(F.when(F.col("kind") == k, F.col("q")[0])).alias(k) for k in ("raw", "corrected")])
    return rounded(m.select("channel", qc.drop_ratio(F.col("raw"), F.col("corrected")).alias("median_drop_ratio")), 6)


# ---- Analysis


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def cluster_sizes(spark, sf_dir):
    return analysis.sizes(read(spark, sf_dir, "events"), "event_type")


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_tax), 6) AS l_tax
FROM lineitem GROUP BY ALL""")
def cluster_means(spark, sf_dir):
    out = analysis.means(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "l_returnflag")
    return rounded(rounded(out, 4, "l_extendedprice"), 6, "l_quantity", "l_tax")


@query("""SELECT user_id % 20 AS sample, event_type, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id % 20), 6) AS fraction
FROM events GROUP BY user_id % 20, event_type""")
def crosstab_fraction(spark, sf_dir):
    cells = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("sample"), "event_type")
    return rounded(analysis.fractions(cells, "sample", "event_type"), 6)


@query("""SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75
FROM events GROUP BY ALL""")
def cluster_quantiles(spark, sf_dir):
    return rounded(analysis.quartiles(read(spark, sf_dir, "events"), "value", "event_type"), 6)


@query("""WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value_w FROM events, q""")
def winsorize(spark, sf_dir):
    return rounded(analysis.winsorize(read(spark, sf_dir, "events"), "value").select("event_id", "value_w"), 6)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY ALL)
SELECT event_type, round(avg((value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))::INTEGER), 6) AS outlier_ratio
FROM events JOIN q USING (event_type) GROUP BY ALL""")
def iqr_outliers(spark, sf_dir):
    return rounded(analysis.outliers(read(spark, sf_dir, "events"), "value", ["event_type"]), 6)


@query("""WITH f AS (SELECT o_orderpriority, covar_pop(epoch(o_orderdate)::DOUBLE / 86400, o_totalprice) / var_pop(epoch(o_orderdate)::DOUBLE / 86400) AS b,
  avg(epoch(o_orderdate)::DOUBLE / 86400) AS mx, avg(o_totalprice) AS my FROM orders GROUP BY ALL)
SELECT o_orderkey, round(o_totalprice - (my + b * (epoch(o_orderdate)::DOUBLE / 86400 - mx)), 3) AS residual FROM orders JOIN f USING (o_orderpriority)""")
def regress_out(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("day", F.unix_timestamp("o_orderdate").cast("double") / 86400)
    return rounded(analysis.regress_out(o, "o_totalprice", "day", ["o_orderpriority"]).select("o_orderkey", "residual"), 3)


@query("""WITH r AS (SELECT event_type, rank() OVER a + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS x,
  rank() OVER b + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS y FROM events
  WINDOW a AS (PARTITION BY event_type ORDER BY value), b AS (PARTITION BY event_type ORDER BY user_id))
SELECT event_type, round(corr(x, y), 6) AS rho, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def spearman(spark, sf_dir):
    return rounded(analysis.spearman(read(spark, sf_dir, "events"), "value", "user_id", ["event_type"]).select("event_type", "rho", "n"), 6)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(0.9 * l_quantity - 0.1 * l_tax, 6) AS l_quantity_unmixed, round(-0.2 * l_quantity + 1.1 * l_tax, 6) AS l_tax_unmixed
FROM lineitem""")
def unmixing(spark, sf_dir):
    out = analysis.unmix(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], [[0.9, -0.1], [-0.2, 1.1]])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_unmixed", "l_tax_unmixed"), 6)


@query("""WITH p AS (SELECT l_linenumber AS i, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)
SELECT i, s, round(sum(s) OVER (ORDER BY i) / sum(s) OVER (), 6) AS cumulative FROM p""")
def cumulative_variance(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("i")).agg(F.sum("l_quantity").alias("s"))
    return rounded(analysis.cumulative_share(p, "i", "s"), 6, "cumulative")


# ---- Projections, encoding, exports


@query("""SELECT event_id, ((user_id % 4) * 512 + value)::DOUBLE AS gx, (user_id % 4)::VARCHAR || '_0_' || event_id AS cell_id FROM events""")
def global_coords(spark, sf_dir):
    tile = F.col("user_id") % 4
    return read(spark, sf_dir, "events").select(
        "event_id", C.to_global(tile * 512, F.col("value")).alias("gx"), C.cell_id(tile, F.lit(0), F.col("event_id")).alias("cell_id")
    )


@query("""WITH s AS (SELECT page_id, string_split(url, '/') AS p FROM pages)
SELECT page_id, CASE WHEN list_position(p, 'en') > 0 THEN p[list_position(p, 'en') + 1] ELSE p[len(p) - 2] END AS sample FROM s""")
def sample_from_path(spark, sf_dir):
    """With ``en`` in the place of ``outputs``: the paths at hand are urls."""
    path = F.regexp_replace("url", "/en/", "/outputs/")
    return read(spark, sf_dir, "pages").select("page_id", C.sample_of(path).alias("sample"))


@query("""SELECT page_id, CASE WHEN regexp_matches(n, '_\\d+_\\d+\\.\\w+$') THEN regexp_extract(n, '_(\\d+)_(\\d+)\\.\\w+$', 1)::BIGINT ELSE -1 END AS tile_x,
  CASE WHEN regexp_matches(n, '_\\d+_\\d+\\.\\w+$') THEN regexp_extract(n, '_(\\d+)_(\\d+)\\.\\w+$', 2)::BIGINT ELSE -1 END AS tile_y
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'roi_label_' ELSE 'mask' END || '_' || page_id * 512 || '_' || page_id || CASE WHEN page_id % 5 = 0 THEN '' ELSE '.png' END AS n FROM pages)""")
def filename_xy(spark, sf_dir):
    i = F.col("page_id")
    n = F.concat(F.when(i % 3 == 0, "roi_label_").otherwise("mask"), F.lit("_"), (i * 512).cast("string"), F.lit("_"), i.cast("string"), F.when(i % 5 == 0, "").otherwise(".png"))
    at = lambda axis: F.coalesce(C.tile_of_name(n, axis), F.lit(-1).cast("long"))
    return read(spark, sf_dir, "pages").select("page_id", at(1).alias("tile_x"), at(2).alias("tile_y"))


CLASSES = f"""m AS (SELECT event_type, row_number() OVER (ORDER BY event_type)::INTEGER AS value, {list(export.PALETTE)}[((row_number() OVER (ORDER BY event_type) - 1) % 9 + 1)::INTEGER] AS color
  FROM (SELECT DISTINCT event_type FROM events))"""


@query(f"WITH {CLASSES} SELECT event_id, m.value, color FROM events e JOIN m USING (event_type)")
def dense_encode(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return e.join(F.broadcast(export.checked(export.encode(e, "event_type"))), "event_type").select("event_id", "value", "color")


@query(f"""WITH {CLASSES} SELECT event_id, user_id::DOUBLE AS x, e.value AS y, event_type AS class_name, color AS class_color,
  'k=' || (SELECT count(*) FROM m) || '{export.NOTE}' AS note FROM events e JOIN m USING (event_type)""")
def points_ndjson(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("x"), F.col("value").alias("y"))
    return export.points(e, "event_type", keep=("event_id",)).select(
        "event_id", F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"),
        F.col("properties.class_name").alias("class_name"), F.col("properties.class_color").alias("class_color"), F.col("properties.note").alias("note"),
    )


@query(f"WITH {CLASSES} SELECT event_type AS value, event_type AS name, color FROM m")
def classes_json(spark, sf_dir):
    return export.classes(read(spark, sf_dir, "events"), "event_type")


@query("SELECT (user_id % 5)::INTEGER AS pixel_value, user_id::DOUBLE AS x, value AS y FROM events")
def points_csv(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("cluster"), F.col("user_id").alias("x"), F.col("value").alias("y"))
    return export.point_rows(e)


@query("SELECT max(user_id % 7) + 1 AS n_clusters FROM events")
def cluster_number(spark, sf_dir):
    return export.n_clusters(read(spark, sf_dir, "events").withColumn("cluster", F.col("user_id") % 7))


@query("""SELECT event_type AS sample, user_id % 3 AS tile_x, user_id % 2 AS tile_y, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def cells_by_tile(spark, sf_dir):
    u = F.col("user_id")
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), (u % 3).alias("tile_x"), (u % 2).alias("tile_y"), F.col("value").alias("local_x"), F.lit(0.0).alias("local_y"), (u % 5).alias("cluster"))
    t = export.by_tile(e)
    return rounded(t.select("sample", "tile_x", "tile_y", F.size("points").cast("long").alias("n"), F.aggregate("points", F.lit(0.0), lambda s, p: s + p["local_x"]).alias("total")))


POINTS = """c AS (SELECT event_id AS o, (user_id % 300)::DOUBLE AS x, (value * 2.5) AS y, (event_id % 5 + 1)::INTEGER AS value FROM events)"""


def map_points(spark, sf_dir):
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        i.alias("o"), (F.col("user_id") % 300).cast("double").alias("x"), (F.col("value") * 2.5).alias("y"), (i % 5 + 1).cast("int").alias("value")
    )


def _pixel(c: str, size: int) -> str:
    return f"greatest(0, least({size - 1}, round_even({c}, 0)::BIGINT))"


@query(f"""WITH {POINTS}, s AS (SELECT {_pixel("y", 256)} AS gy, {_pixel("x", 256)} AS gx, o, value FROM c
), k AS (SELECT greatest(0, least(255, gy + dy)) AS py, greatest(0, least(255, gx + dx)) AS px, 3 * (dy + 1) + dx + 1 AS k, o, value
  FROM s, range(-1, 2) a(dy), range(-1, 2) b(dx))
SELECT py, px, arg_max(value, (k, o)) AS value FROM k GROUP BY py, px""")
def raster_last_writer(spark, sf_dir):
    return export.raster(map_points(spark, sf_dir), 256, 256, "o")


@query(f"""WITH {POINTS}, s AS (SELECT {_pixel("y", 256)} AS gy, {_pixel("x", 256)} AS gx, o, value FROM c)
SELECT level::INTEGER AS level, gy // (2 ** level)::BIGINT AS py, gx // (2 ** level)::BIGINT AS px, arg_max(value, o) AS value
FROM s, range(1, 3) l(level) GROUP BY ALL""")
def pyramid_level(spark, sf_dir):
    return export.pyramid(map_points(spark, sf_dir), 256, 256, "o", levels=4, least=64)


@query(f"""WITH {POINTS} SELECT value, count(*)::BIGINT AS n_nonzero FROM c WHERE value <> 0 GROUP BY ALL""")
def nonzero_counts(spark, sf_dir):
    p = map_points(spark, sf_dir).withColumnsRenamed({"y": "py", "x": "px"})
    return export.level_statistics(p, "value", "value").select("value", "n_nonzero")


@query(f"""WITH {POINTS}, s AS (SELECT {_pixel("y", 256)} AS gy, {_pixel("x", 256)} AS gx, o, value FROM c
), p AS (SELECT level::INTEGER AS level, gy // (2 ** level)::BIGINT AS py, gx // (2 ** level)::BIGINT AS px, arg_max(value, o) AS value FROM s, range(1, 3) l(level) GROUP BY ALL)
SELECT level, max(py) + 1 AS height, max(px) + 1 AS width, count(*) FILTER (value <> 0) AS n_nonzero FROM p GROUP BY level""")
def level_statistics(spark, sf_dir):
    return export.level_statistics(export.pyramid(map_points(spark, sf_dir), 256, 256, "o", levels=4, least=64))


# ---- Sets, joins, samples, panels


@query("""SELECT o_orderkey AS k, o_totalprice AS a, 0.0::DOUBLE AS b FROM orders UNION ALL SELECT c_custkey, 0.0, c_acctbal FROM customer""")
def union_by_name_fill(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"))
    return tables.united([o, c])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_anti(spark, sf_dir):
    outputs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("kind"))
    return tables.todo(read(spark, sf_dir, "customer"), outputs, ("F",), "c_custkey").select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def resume_two_outputs(spark, sf_dir):
    """Still to do: customers that lack one of two kinds of output."""
    outputs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("kind"))
    return tables.todo(read(spark, sf_dir, "customer"), outputs, ("F", "O"), "c_custkey").select("c_custkey")


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer""")
def tile_present(spark, sf_dir):
    files = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    yes, no = tables.present(read(spark, sf_dir, "customer").select("c_custkey"), files, ["c_custkey"])
    return yes.withColumn("found", F.lit(True)).unionByName(no.withColumn("found", F.lit(False)))


@query("""SELECT c_custkey, count(o_orderkey)::BIGINT AS n_tiles, CASE WHEN count(o_orderkey) > 0 THEN 'found' ELSE 'failed' END AS status
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def image_roi_left(spark, sf_dir):
    rois = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tables.folders(read(spark, sf_dir, "customer"), rois, "c_custkey").select("c_custkey", "n_tiles", "status")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE i % greatest(1, ceil(n / 3.0)::BIGINT) = 0""")
def tile_stride(spark, sf_dir):
    return tiles.every_nth(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("""SELECT s_suppkey AS image_id, y, x, least(512, 1000 + 100 * s_nationkey - y)::BIGINT AS h, least(512, 1300 + s_suppkey - x)::BIGINT AS w
FROM supplier, range(0, 1000 + 100 * s_nationkey, 512) a(y), range(0, 1300 + s_suppkey, 512) b(x)""")
def tile_grid(spark, sf_dir):
    images = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("image_id"), (F.lit(1000) + 100 * F.col("s_nationkey")).cast("long").alias("height"), (F.lit(1300) + F.col("s_suppkey")).cast("long").alias("width")
    )
    return tiles.grid(images, 512)


@query("""SELECT p_brand AS image_id, p_partkey AS channel, min(p_size) OVER w AS crop_h, (p_size - min(p_size) OVER w) // 2 AS y0 FROM part WINDOW w AS (PARTITION BY p_brand)""")
def centre_crop(spark, sf_dir):
    planes = read(spark, sf_dir, "part").select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("channel"), F.col("p_size").alias("height"), F.col("p_size").alias("width"))
    return tiles.centre_crop(planes).select("image_id", "channel", "crop_h", F.col("y0").cast("int").alias("y0"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(md5('42:' || o_orderkey), 1, 8), o_orderkey) AS r FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE r <= 5""")
def random_tiles(spark, sf_dir):
    """Five tiles of each image, the same on every run (a sampling operator)."""
    return tiles.sample_per_group(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", 5).select("o_custkey", "o_orderkey")


STAINED = "(SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'KidneyCancer' ELSE 'BladderCancer' END AS panel FROM supplier)"


def stained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of every supplier's tile."""
    even = F.col("s_nationkey") % 2 == 0
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.when(even, "KidneyCancer").otherwise("BladderCancer").alias("panel"))


@query(f"""SELECT s_suppkey, panel, i AS "index", n AS name FROM {STAINED},
  (VALUES (2, 'Opal570'), (3, 'Opal690'), (4, 'Opal480'), (5, 'Opal620'), (6, 'Opal780'), (7, 'Opal520')) c(i, n)""")
def panel_markers(spark, sf_dir):
    """Marker channels of the panel that each supplier's tile was stained with."""
    return panels.markers(panels.panels(spark)).join(stained(spark, sf_dir), "panel").select("s_suppkey", "panel", "index", "name")


@query(f"SELECT s_suppkey, panel, 0 AS dapi_plane, 7 AS af_plane FROM {STAINED}")
def panel_special_channels(spark, sf_dir):
    return panels.special_channels(panels.panels(spark)).join(stained(spark, sf_dir), "panel")


@query("""WITH b AS (SELECT page_id, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.') AS bands FROM pages)
SELECT page_id, (g.i - 1)::INTEGER AS pos, bands[g.i] AS band FROM b, LATERAL (SELECT unnest(range(1, len(bands) + 1)) AS i) g WHERE len(bands) = 4""")
def band_names(spark, sf_dir):
    """Names by position, only where there are as many as planes (four here)."""
    bands = F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")
    return tables.bands_by_position(read(spark, sf_dir, "pages").select("page_id", bands.alias("b"), F.lit(4).alias("n")), "b", "n")


@query(f"SELECT s_suppkey, panel, 2 AS reference_plane FROM {STAINED}")
def reference_plane(spark, sf_dir):
    """The reference channel by name, in place of the nuclear one."""
    return panels.reference_plane(panels.panels(spark), "Opal690").join(stained(spark, sf_dir), "panel")


@query("SELECT s_suppkey, i AS index FROM supplier, (VALUES (2), (3), (4), (5), (6), (7)) c(i)")
def tile_channels(spark, sf_dir):
    """Every tile with every marker channel."""
    marked = panels.markers(panels.panels(spark).where(F.col("panel") == panels.DEFAULT)).select("index")
    return panels.with_channels(read(spark, sf_dir, "supplier").select("s_suppkey"), marked)


@query("""SELECT c_nationkey AS image_id, arg_min(c_custkey, (abs((c_custkey % 17)::DOUBLE - 4.0), c_custkey)) AS level,
  arg_min((c_custkey % 17)::DOUBLE, (abs((c_custkey % 17)::DOUBLE - 4.0), c_custkey)) AS downsample FROM customer GROUP BY c_nationkey""")
def level_choice(spark, sf_dir):
    levels = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), F.col("c_custkey").alias("level"), (F.col("c_custkey") % 17).cast("double").alias("downsample"))
    return tiles.level_for(levels)


@query(f"""WITH {PIXELS} SELECT y - 10 AS y, x - 20 AS x, count(*)::BIGINT AS n FROM px WHERE y >= 10 AND y < 30 AND x >= 20 AND x < 35 GROUP BY y, x""")
def window_cut(spark, sf_dir):
    return tiles.cut_window(pixels(spark, sf_dir), 10, 20, 20, 15).groupBy("y", "x").agg(F.count("*").alias("n"))


@query(f"""WITH {PIXELS}, h AS (SELECT channel, CASE channel WHEN 'A' THEN 64 WHEN 'N' THEN 50 ELSE 41 END AS h FROM (VALUES ('A'), ('N'), ('R')) v(channel)
), c AS (SELECT channel, (h - min(h) OVER ()) // 2 AS o, min(h) OVER () AS m FROM h)
SELECT channel, y - o AS y, x - o AS x, count(*)::BIGINT AS n FROM px JOIN c USING (channel) WHERE y >= o AND y < o + m AND x >= o AND x < o + m GROUP BY ALL""")
def cropped_pixels(spark, sf_dir):
    """Pixels of planes of three sizes, cropped to the smallest about their middle."""
    planes = spark.createDataFrame([("i", c, h, h) for c, h in (("A", 64), ("N", 50), ("R", 41))], "image_id string, channel string, height int, width int")
    px = pixels(spark, sf_dir).withColumn("image_id", F.lit("i"))
    return features.cropped(px, tiles.centre_crop(planes)).groupBy("channel", "y", "x").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id, 1000 + page_id % 300 AS size, (page_id * 37) % 1500 AS start FROM pages)
SELECT page_id, greatest(0, least(start, size - 1024))::BIGINT AS begins, greatest(0, floor((size - 1024) / 2.0))::BIGINT AS middle,
  's_' || lpad((page_id % 100)::VARCHAR, 2, '0') || '_c.png' AS name, floor(start * (256.0 / size))::BIGINT AS thumb_x FROM p""")
def window_places(spark, sf_dir):
    i = F.col("page_id")
    size, start = F.lit(1000) + i % 300, (i * 37) % 1500
    zero, thumb = F.lit(0), F.lit(256.0)
    rect = export.thumbnail_rectangle(start, zero, zero, zero, size, size, thumb, thumb)
    return read(spark, sf_dir, "pages").select(
        "page_id", C.clamped(start, size, 1024).cast("long").alias("begins"), C.centred(size, 1024).cast("long").alias("middle"),
        C.prefixed_name(F.lit("s"), i % 100, F.lit("c")).alias("name"), rect["x0"].alias("thumb_x"),
    )


# ---- Quality control from sums and counts

@query(f"""WITH {WIDE}, p AS ({" UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM w" for x in "abc" for y in "abc")}) SELECT a, b, round(r, 6) AS r FROM p""")
def correlation_of_parts(spark, sf_dir):
    """Correlations from the sums of many parts, as tiles give them."""
    rows = wide(spark, sf_dir).withColumn("part", F.spark_partition_id() * 100 + F.floor(F.col("a")) % 7)
    sums = None
    for x in "abc":
        for y in "abc":
            one = rows.groupBy("part").agg(F.count("*").alias("n"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), (F.covar_pop(x, y) * F.count("*")).alias("c"))
            one = one.select(F.lit(x).alias("a"), F.lit(y).alias("b"), "n", "mean_a", "mean_b", "c")
            sums = one if sums is None else sums.unionByName(one)
    return rounded(qc.correlation_of_products(sums, []), 6)


COUNTS = "v AS (SELECT event_type AS image_id, floor(value)::DOUBLE AS value, count(*)::BIGINT AS n FROM events GROUP BY ALL)"


def counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("image_id"), F.floor("value").cast("double").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS image_id, min(floor(value)) AS lo, max(floor(value)) AS hi, median(floor(value)) AS median FROM events GROUP BY ALL")
def level_medians(spark, sf_dir):
    return qc.level_stats(counts(spark, sf_dir), ["image_id"])


@query(f"""WITH {COUNTS}, e AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM v GROUP BY ALL)
SELECT image_id, least(63, floor((value - lo) / (hi - lo) * 64))::INTEGER AS bin, sum(n)::BIGINT AS n FROM v JOIN e USING (image_id) GROUP BY ALL""")
def level_histogram(spark, sf_dir):
    c = counts(spark, sf_dir)
    return qc.level_histogram(c, qc.level_stats(c, ["image_id"]), ["image_id"])


@query("""WITH q AS (SELECT event_type AS image_id, quantile_cont(value, 0.2) AS threshold FROM events GROUP BY ALL)
SELECT image_id, round(threshold, 6) AS threshold, round(avg((value < threshold)::INTEGER), 6) AS low_quality_ratio FROM events JOIN q ON event_type = image_id GROUP BY ALL""")
def quality_by_image(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), F.col("value").alias("sharpness"))
    return rounded(qc.quality(e), 6)


@query("""WITH r AS (SELECT event_type AS cluster, count(*)::BIGINT AS n, round(avg(value), 6) AS value FROM events GROUP BY ALL)
SELECT cluster, n, value, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () < 0.2 AS suspicious FROM r""")
def cluster_report(spark, sf_dir):
    cells = read(spark, sf_dir, "events").withColumn("cluster", F.col("event_type"))
    return rounded(analysis.report(cells, ["value"], small=0.2), 6)


@query("""SELECT vec_id AS id FROM embeddings WHERE ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT < floor(100 / (SELECT count(*) FROM embeddings)::DOUBLE * 4294967296)::BIGINT""")
def subsample(spark, sf_dir):
    """About a hundred vectors (a sampling operator)."""
    return cluster.subsample(vectors(spark, sf_dir), "id", 100).select("id")


# ---- Kernels over embeddings as tiles of 8 x 8 pixels, and density


def embedded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile for each embedding, with its 64 values as the pixels of channel 1."""
    zero = F.lit(0).cast("long")
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("image_id"), zero.alias("tile_y"), zero.alias("tile_x"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.array(F.lit(1)).alias("channels"), F.array("embedding").alias("planes"), F.lit(None).cast("string").alias("error"),
    )


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(e) AS lo, list_max(e) AS hi FROM embeddings
), b AS (SELECT vec_id, list_transform(e, lambda v: CASE WHEN hi - lo < 1e-6 THEN 0 ELSE floor((v - lo) / (hi - lo) * 255) END) AS b FROM t
), p AS (SELECT vec_id, b, unnest(range(64)) AS i FROM b
), l AS (
  SELECT vec_id, b[abs(i // 8 - 1) * 8 + i % 8 + 1] + b[(7 - abs(i // 8 - 6)) * 8 + i % 8 + 1]
    + b[i // 8 * 8 + abs(i % 8 - 1) + 1] + b[i // 8 * 8 + 7 - abs(i % 8 - 6) + 1] - 4 * b[i + 1] AS l FROM p
)
SELECT vec_id, round(var_pop(l) + 1e-7, 4) AS sharpness FROM l GROUP BY vec_id""")
def tile_sharpness(spark, sf_dir):
    """Variance of the Laplacian of every tile."""
    got = qc.measured(embedded_tiles(spark, sf_dir), 1)
    return got.select(F.col("image_id").cast("long").alias("vec_id"), F.round(F.col("sharpness") + 1e-7, 4).alias("sharpness"))  # no ties


@query("""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)
), disk AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4
), worn AS (SELECT a.vec_id, a.y, a.x, min(b.v) AS v FROM p a, disk JOIN p b ON a.vec_id = b.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL
), opened AS (SELECT a.vec_id, a.y, a.x, max(b.v) AS v FROM worn a, disk JOIN worn b ON a.vec_id = b.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)
SELECT vec_id, round(sum(p.v - o.v), 4) AS top_hat, round(max(p.v - o.v), 4) AS most FROM p JOIN opened o USING (vec_id, y, x) GROUP BY vec_id""")
def tile_top_hat(spark, sf_dir):
    """What a white top-hat of radius 2 leaves of every tile: its sum and its greatest value."""
    return qc.top_hats(embedded_tiles(spark, sf_dir), 1, 2).select(
        F.col("image_id").cast("long").alias("vec_id"), F.round("total", 4).alias("top_hat"), F.round("most", 4).alias("most")
    )


@query("""WITH RECURSIVE p AS (SELECT c_custkey, c_acctbal / 100 AS x, c_nationkey * 3.0::DOUBLE AS y FROM customer
), near AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3.1::DOUBLE * 3.1::DOUBLE
), core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 6
), linked AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)
), reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, n.b FROM reach r JOIN linked n ON r.b = n.a
), named AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a
), edge AS (SELECT n.a AS id, min(cluster) AS cluster FROM near n JOIN named ON n.b = named.id GROUP BY n.a)
SELECT c_custkey, named.id IS NOT NULL AS core, coalesce(named.cluster, edge.cluster, -1) AS cluster
FROM p LEFT JOIN named ON named.id = c_custkey LEFT JOIN edge ON edge.id = c_custkey""")
def dbscan_clusters(spark, sf_dir):
    """Density-based clusters of customers by balance and nation; noise is -1."""
    v = F.array(F.col("c_acctbal") / 100, F.col("c_nationkey") * 3.0)
    points = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), v.alias("v"))
    told = density.dbscan(points, 3.1, 6)
    return told.select(F.col("id").alias("c_custkey"), "core", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
