"""Scaling, reduction, clustering and its evaluation over vectors (``id``, ``v`` array of double)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import clean, confidence, distance2, lot
from ..functions.ranks import ranked
from ..functions.shared import cut

#: Columns that are never features, in any case of letters; ``pca_*`` neither.
NOT_FEATURES = (
    "cell_id", "tile_x", "tile_y", "label", "local_x", "local_y", "x", "y", "centroid_x", "centroid_y", "cluster", "confidence",
    "source_csv", "__source_csv",
)
UNEQUAL = "vectors of different lengths"
#: Vectors in a block of the silhouette, at least and at most (a task compares two blocks), and sums that it returns of one at most.
BLOCK, WIDEST, RETURNED = 2048, 32_768, 1 << 22
#: Blocks that smaller tables are cut into at most, for the sake of all cores.
FEW = 8
#: Vectors compared at once, and pairs of near ones whose distance is taken from their difference.
ROWS, COLUMNS, NEAR = 512, 2048, 16_384
#: Squared distances below this share of the squared norms lose too much by products.
LOST = 1e-6


def feature_columns(df: DataFrame, with_positions: bool = False) -> list[str]:
    """Numeric columns that describe a cell; ``with_positions`` keeps local_x and local_y, as older runs did."""
    skip = set(NOT_FEATURES) - ({"local_x", "local_y"} if with_positions else set())
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds and c.lower() not in skip and not c.lower().startswith("pca_")]


def vectors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*[clean(F.col(c)) for c in columns]).alias("v"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows, without its null ones; arrays of different lengths are an error."""
    column = column.drop_null() if column.null_count else column
    n, lengths = len(column), column.value_lengths().to_numpy(zero_copy_only=False)
    if n and (lengths != lengths[0]).any():
        raise ValueError(UNEQUAL)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, lengths[0] if n else 0)


def equal(expr: Column) -> Column:
    """``expr`` of rows with a number of dimensions ``d``, all of which must have the same."""
    return F.when(F.min("d") != F.max("d"), F.raise_error(F.lit(UNEQUAL))).otherwise(expr)


def products(points: DataFrame) -> DataFrame:
    """``i, j, n, mean_i, mean_j, c`` for ``i <= j``: means and the sum of products of deviations, in one pass.

    Each task sums its own deviations from its own means and gives one row for
    each two dimensions; these add up exactly, whatever the number of rows.
    Null vectors don't count; vectors of different lengths are an error,
    wherever they lie. No vectors, no rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, c = 0, None, None
        for b in batches:
            x = matrix_of(b.column(0))
            if not len(x):
                continue
            m = x.mean(axis=0)
            own = (x - m).T @ (x - m)
            if mean is not None and len(mean) != len(m):
                raise ValueError(UNEQUAL)
            if mean is None:
                n, mean, c = len(x), m, own
            else:
                shift, total = m - mean, n + len(x)
                c += own + np.outer(shift, shift) * (n * len(x) / total)
                mean, n = mean + shift * (len(x) / total), total
        if mean is not None:
            i, j = np.triu_indices(len(mean))
            columns = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), n), mean[i], mean[j], c[i, j], np.full(len(i), len(mean))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["i", "j", "n", "a", "b", "c", "d"])

    rows = points.select("v").mapInArrow(partial, "i int, j int, n long, a double, b double, c double, d long")
    n, a, b = F.sum("n"), F.sum(F.col("n") * F.col("a")), F.sum(F.col("n") * F.col("b"))
    between = F.sum(F.col("n") * F.col("a") * F.col("b")) - a * b / n
    return rows.groupBy("i", "j").agg(equal(n).alias("n"), (a / n).alias("mean_i"), (b / n).alias("mean_j"), (F.sum("c") + between).alias("c"))


def sums(points: DataFrame, by: str | None = None) -> DataFrame:
    """``by, dim, n, mean, within``: mean and sum of squared deviations of every dimension, in each group of ``by`` or over all.

    Each task gives a row for each group and dimension that it met. Null
    vectors don't count; vectors of different lengths are an error.
    """
    group = F.col(by) if by else F.lit(0)
    rows = points.select(group.alias("g"), "v").where(F.col("v").isNotNull())
    kind = dict(rows.dtypes)["g"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            x = matrix_of(b.column(1))
            coded = b.column(0).dictionary_encode()
            groups, at = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy()
            for k in np.unique(at).tolist():
                own = x[at == k]
                m = own.mean(axis=0)
                n, mean, c = held.get(g := None if k < 0 else groups[k], (0, m, np.zeros(len(m))))
                if len(mean) != len(m):
                    raise ValueError(UNEQUAL)
                total, shift = n + len(own), m - mean
                held[g] = total, mean + shift * (len(own) / total), c + ((own - m) ** 2).sum(axis=0) + shift**2 * (n * len(own) / total)
        out = [(g, i, n, float(m), float(w), len(mean)) for g, (n, mean, c) in held.items() for i, (m, w) in enumerate(zip(mean, c))]
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = (fields[0].type, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["g", "dim", "n", "m", "w", "d"])

    fields = to_arrow_schema(rows.schema)
    told = rows.mapInArrow(partial, f"g {kind}, dim int, n long, m double, w double, d long")
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * total / n
    return told.groupBy("g", "dim").agg(equal(n).alias("n"), (total / n).alias("mean"), (F.sum("w") + between).alias("within")).withColumnRenamed("g", by or "__all")


def moments(points: DataFrame) -> DataFrame:
    """Mean and population standard deviation of every dimension (0 counts as 1): one row a dimension."""
    std = F.sqrt(F.greatest(F.col("within") / F.col("n"), F.lit(0.0)))
    return sums(points).select("dim", "mean", F.when(std == 0, 1.0).otherwise(std).alias("std"))


def zscore(points: DataFrame) -> DataFrame:
    """Standardised vectors."""
    rows = moments(points).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("m"))  # one row
    scaled = F.zip_with("v", "m", lambda x, m: (x - m["mean"]) / m["std"])
    return points.join(F.broadcast(rows)).withColumn("v", scaled).drop("m")


def covariance(points: DataFrame) -> DataFrame:
    """Sample covariance of every two dimensions ``i <= j``."""
    return products(points).select("i", "j", (F.col("c") / F.nullif(F.col("n") - 1, F.lit(0))).alias("covariance"))


def pca(points: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """Scores on the first components of centred vectors (largest loading positive) and their shares of the variance.

    The d x d products are all that reaches the driver. Null vectors have null
    scores; without any vector there are no shares.
    """
    rows = products(points).collect()
    d = max((r["j"] for r in rows), default=-1) + 1
    if not d:
        return points, np.zeros(0)
    c, mean = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["c"] / max(r["n"] - 1, 1)
        mean[r["i"]], mean[r["j"]] = r["mean_i"], r["mean_j"]
    values, axes = np.linalg.eigh(c)
    order = np.argsort(values)[::-1]
    values, axes = np.clip(values[order], 0, None), axes[:, order]
    k = max(1, min(n, d))
    axes = axes[:, :k] * np.sign(axes[np.abs(axes).argmax(axis=0)[:k], np.arange(k)])
    shift = mean @ axes
    parts = [
        F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in axes[:, i]]), lambda x, a: x * a), F.lit(0.0), lambda s, t: s + t)
        - float(shift[i])
        for i in range(k)
    ]
    return points.withColumn("v", F.array(*parts)), values[:k] / max(values.sum(), 1e-300)


def auto_k(n: int, k: int | None = None) -> int:
    if k is not None:
        return max(2, min(k, n))
    return max(2, min(4, n)) if n < 20 else 6 if n < 100 else 8


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Append ``cluster`` (nearest of ``c, centre``, ties to the lowest), ``d1``, ``d2`` and ``confidence``.

    Centres are k rows and ride along as one array.
    """
    one = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("c", "centre"))).alias("cs")))
    ranked = F.array_sort(F.transform("cs", lambda c: F.struct(F.sqrt(distance2(F.col("v"), c["centre"])).alias("d"), c["c"].alias("c"))))
    near = points.join(one).withColumn("__r", ranked).drop("cs")
    d1 = F.col("__r")[0]["d"]
    d2 = F.coalesce(F.get(F.col("__r"), F.lit(1))["d"], d1 + 1e-6)
    return near.withColumns({"cluster": F.col("__r")[0]["c"], "d1": d1, "d2": d2, "confidence": confidence(d1, d2)}).drop("__r")


def update(assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """Means of the members; an empty cluster keeps its centre."""
    means = sums(assigned, "cluster").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("__mean"))
    return centres.join(means, F.col("c") == F.col("cluster"), "left").select("c", F.coalesce("__mean", "centre").alias("centre"))


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum(F.col("d1") * F.col("d1")).alias("inertia"))


def chosen_rows(points: DataFrame, ranks: list[int]) -> dict[int, list[float]]:
    """Vectors of the points that stand at these places in the order of ids; ids alone are ranked."""
    wanted = points.sparkSession.createDataFrame([(r,) for r in ranks], "rank long")
    ids = ranked(points.select("id"), [F.col("id")]).join(F.broadcast(wanted), "rank")
    return {r["rank"]: list(r["v"]) for r in points.join(F.broadcast(ids), "id").select("rank", "v").collect()}  # starts * k rows


def kmeans(points: DataFrame, k: int, seed: int = 42, n_init: int = 5, max_iter: int = 100) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's algorithm from ``n_init`` random starts of distinct rows, by id; the labels and centres of the lowest inertia.

    A start ends when no label changes (the first assignment of all zeros counts
    as unchanged). All starts share each pass over the points, so there are
    ``max_iter`` passes at most; a pass gives k x d sums for each start, which
    Spark adds up. Ids are unique. The points are written once, so that a lost
    executor costs their reading. Null vectors are left out; without any other
    there are no centres and no rows.
    """
    spark = points.sparkSession
    points = cut(points.select("id", "v").where(F.col("v").isNotNull()))
    n = points.count()
    if not n:
        empty = points.withColumns({"cluster": F.lit(0), **{c: F.lit(0.0) for c in ("d1", "d2", "confidence")}})
        return empty, np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    draws = [rng.choice(n, size=min(k, n), replace=False) for _ in range(max(1, n_init))]
    rows = chosen_rows(points, sorted({int(i) for d in draws for i in d}))
    now = {s: np.array([rows[int(i)] for i in d]) for s, d in enumerate(draws)}
    last: dict[int, int] = {}
    ended: dict[int, tuple[float, np.ndarray]] = {}
    for step in range(max_iter):
        if not now:
            break
        held = spark.sparkContext.broadcast(now)

        def partial(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums = {s: np.zeros((len(c), c.shape[1] + 1)) for s, c in held.value.items()}
            marks, costs = dict.fromkeys(sums, 0), dict.fromkeys(sums, 0.0)
            for b in batches:
                for i in range(0, len(b), 4096):
                    part = b.slice(i, 4096)
                    x = matrix_of(part.column(1))
                    hashes = pd.util.hash_array(part.column(0).to_pandas().to_numpy())
                    for s, c in held.value.items():
                        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
                        own = d.argmin(axis=1)
                        np.add.at(sums[s], own, np.column_stack([x, np.ones(len(x))]))
                        costs[s] += float(d.min(axis=1).sum())
                        told = hashes * (own.astype(np.uint64) * np.uint64(2) + np.uint64(1))
                        marks[s] ^= int(np.bitwise_xor.reduce(told, initial=np.uint64(0)))
            out = [(s, c, d, float(sums[s][c, d])) for s in sums for c in range(len(sums[s])) for d in range(sums[s].shape[1])]
            out += [(s, -1, 0, costs[s]) for s in sums]
            signed = {s: m - (1 << 64) if m >> 63 else m for s, m in marks.items()}
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([signed[r[0]] if r[1] < 0 else 0 for r in out], pa.int64())], names=["s", "c", "d", "x", "mark"])

        got = (
            points.mapInArrow(partial, "s int, c int, d int, x double, mark long")
            .groupBy("s", "c", "d").agg(F.sum("x").alias("x"), F.expr("bit_xor(mark)").alias("mark"))
            .collect()
        )  # starts * k * d rows
        held.destroy()
        sums = {s: np.zeros((len(c), c.shape[1] + 1)) for s, c in now.items()}
        costs, marks = {}, {}
        for s, c, d, x, mark in got:
            if c < 0:
                costs[s], marks[s] = x, mark
            else:
                sums[s][c, d] = x
        for s, used in list(now.items()):
            counts = sums[s][:, -1]
            still = marks[s] == last.get(s) or (step == 0 and counts[1:].sum() == 0)
            last[s] = marks[s]
            if still or step == max_iter - 1:
                ended[s] = (costs[s], now.pop(s))
            else:
                now[s] = np.where(counts[:, None] > 0, sums[s][:, :-1] / np.maximum(counts, 1)[:, None], used)
    best = ended[0]
    for s in sorted(ended):  # the earlier of starts that differ by no more than rounding
        if ended[s][0] < best[0] * (1 - 1e-12):
            best = ended[s]
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(best[1])], "c int, centre array<double>")
    return assign(points, table), best[1]


def choose_k(points: DataFrame, ks: range = range(8, 13), seed: int = 42, most: int = 10_000) -> DataFrame:
    """``k, inertia, ch_index, silhouette`` of every ``k``; the silhouette over ``most`` points by hash (a sampling report)."""
    out = []
    for k in ks:
        told = kmeans(points, k, seed)[0]
        few = subsample(told.select("id", "v", "cluster"), "id", most, seed)
        parts = inertia(told), calinski_harabasz(told), silhouette(few).agg(F.avg("silhouette"))
        out.append((k, *[float(p.first()[0]) for p in parts]))  # one row each
    return points.sparkSession.createDataFrame(out, "k int, inertia double, ch_index double, silhouette double")


def gain(with_: DataFrame, without: DataFrame, least: float = 0.05) -> DataFrame:
    """``ch_with, ch_without, gain, better``: whether a clustering with more features (autofluorescence) is better by ``least``."""
    a = calinski_harabasz(with_).withColumnRenamed("ch_index", "ch_with")
    b = calinski_harabasz(without).withColumnRenamed("ch_index", "ch_without")
    share = F.col("ch_with") / F.nullif(F.col("ch_without"), F.lit(0.0)) - 1
    return a.join(F.broadcast(b)).withColumns({"gain": share, "better": share >= least})  # one row each


def subsample(points: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """About ``most`` rows at most, by a hash of key and seed: the same ones however the data are dealt. A sampling operator."""
    n = points.count()
    if n <= most:
        return points
    return points.where(lot(F.col(key), seed) < int(most / n * 2**32))


def mixture(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Gaussian mixture: ``cluster`` and the posterior as ``confidence``."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.withColumn("features", array_to_vector("v"))
    out = GaussianMixture(k=k, seed=seed).fit(data).transform(data)
    return out.select("id", "v", F.col("prediction").alias("cluster"), F.array_max(vector_to_array("probability")).alias("confidence"))


def summed_distances(x: np.ndarray, y: np.ndarray, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances of each of ``x`` to each run of ``y``, and of each of ``y`` to each run of ``x``; runs begin at ``begin`` and ``at``.

    Squared distances come from products of matrices; those too small for
    that, and those that are no numbers, from differences.
    """
    to_y, to_x = np.zeros((len(x), len(begin))), np.zeros((len(y), len(at)))
    whole = x[np.isfinite(x).all(axis=1)]
    middle = whole.mean(axis=0) if len(whole) else 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        u, v = x - middle, y - middle
        u2, v2 = (u * u).sum(axis=1), (v * v).sum(axis=1)
        for i in range(0, len(x), ROWS):
            for j in range(0, len(y), COLUMNS):
                a, b = slice(i, i + ROWS), slice(j, j + COLUMNS)
                d = u[a] @ (-2 * v[b].T)
                d += u2[a, None]
                d += v2[b]
                flat = d.ravel()
                near = np.flatnonzero(~(flat > LOST * (u2[a].max() + v2[b].max())))
                np.sqrt(d, out=d)
                for k in range(0, len(near), NEAR):
                    r, c = np.divmod(near[k : k + NEAR], d.shape[1])
                    flat[near[k : k + NEAR]] = np.sqrt(((x[i + r] - y[j + c]) ** 2).sum(axis=1))
                # The runs within these rows and columns.
                first, last = np.searchsorted(begin, j, "right") - 1, np.searchsorted(begin, j + d.shape[1])
                to_y[a, first:last] += np.add.reduceat(d, np.maximum(begin[first:last] - j, 0), axis=1)
                first, last = np.searchsorted(at, i, "right") - 1, np.searchsorted(at, i + len(d))
                to_x[b, first:last] += np.add.reduceat(d, np.maximum(at[first:last] - i, 0), axis=0).T
    return to_y, to_x


def silhouette(points: DataFrame, blocks: int | None = None) -> DataFrame:
    """Euclidean silhouette of every point (``id, v, cluster``); 0 for a cluster of one.

    Every two blocks of points are compared once, in a task of their own, which
    returns sums of distances by cluster, never pairs. Blocks are as large as
    memory allows, as each travels once for every other. The work is
    quadratic: take a ``subsample`` of millions.
    """
    if not blocks:
        n, kinds = points.agg(F.count("*"), F.count_distinct("cluster")).first()
        blocks = max(-(-n // max(BLOCK, min(WIDEST, RETURNED // max(kinds, 1)))), min(-(-n // BLOCK), FEW), 1)
    dealt = points.select("id", "v", "cluster", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = every.select("id", "v", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def side(part: pd.DataFrame) -> tuple:
        codes, kinds = pd.factorize(part["cluster"], use_na_sentinel=False)
        order, n = np.argsort(codes, kind="stable"), np.bincount(codes)
        return part.iloc[order], np.stack(part["v"].to_numpy()[order]), kinds, n, np.cumsum(n) - n

    def told(part: pd.DataFrame, total: np.ndarray, kinds, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "id": np.repeat(part["id"].to_numpy(), len(kinds)), "own": np.repeat(part["cluster"].to_numpy(), len(kinds)),
            "cluster": np.tile(kinds, len(part)), "total": total.ravel(), "n": np.tile(n, len(part)),
        })

    def sums(pair: pd.DataFrame) -> pd.DataFrame:
        low, high = pair["low"].iloc[0], pair["high"].iloc[0]
        both = [pair[pair["block"] == b] for b in (low, high)]
        if both[0].empty or both[1].empty:
            return pd.DataFrame({"id": [], "own": [], "cluster": [], "total": [], "n": []})
        a, x, of_x, n_x, at = side(both[0])
        b, y, of_y, n_y, begin = (a, x, of_x, n_x, at) if low == high else side(both[1])
        to_y, to_x = summed_distances(x, y, at, begin)
        one = told(a, to_y, of_y, n_y)
        return one if low == high else pd.concat([one, told(b, to_x, of_x, n_x)])

    kind, of = dict(points.dtypes)["id"], dict(points.dtypes)["cluster"]
    pairs = met.repartition(blocks * (blocks + 1) // 2, "low", "high")
    parts = pairs.groupBy("low", "high").applyInPandas(sums, f"id {kind}, own {of}, cluster {of}, total double, n long")
    means = parts.groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("cluster")
    scored = means.groupBy("id", "own").agg(
        F.max(F.when(same, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return scored.select("id", F.col("own").alias("cluster"), F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between to within dispersion of points with a ``cluster``."""
    own = cut(sums(points, "cluster"))  # clusters x dimensions
    all_ = own.groupBy("dim").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g"))
    s = own.join(all_, "dim").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("g"), 2)).alias("between"), F.sum("within").alias("within"),
        F.count_distinct("cluster").alias("k"), F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n"),
    )
    return s.select(((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("ch_index"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings beyond chance."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    joint = cells.agg(two("n").alias("ij"), F.sum("n").alias("all"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("i"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("j"))
    expected = F.col("i") * F.col("j") / (F.col("all") * (F.col("all") - 1) / 2)
    return joint.join(F.broadcast(rows)).join(F.broadcast(cols)).select(
        ((F.col("ij") - expected) / F.nullif((F.col("i") + F.col("j")) / 2 - expected, F.lit(0.0))).alias("ari")
    )  # one row each
