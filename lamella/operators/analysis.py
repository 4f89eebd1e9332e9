"""Analysis of clustered cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import average_ranks, quantiles


def sizes(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    return cells.groupBy(cluster).agg(F.count("*").alias("n")).orderBy(cluster)


def means(cells: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    return cells.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])


def fractions(cells: DataFrame, sample: str, cluster: str) -> DataFrame:
    """Share of each cluster in each sample, long: no number of clusters is too many."""
    n = cells.groupBy(sample, cluster).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy(sample)))


def quartiles(cells: DataFrame, column: str, cluster: str = "cluster") -> DataFrame:
    """Quartiles of each cluster, by ranges: a cluster of any size is no task's."""
    return quantiles(cells, column, [0.25, 0.5, 0.75], [cluster]).select(cluster, *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)])


def winsorize(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Append ``<column>_w``, clipped to two exact quantiles of the whole column."""
    cut = quantiles(df, column, [low, high]).select(F.col("q")[0].alias("__lo"), F.col("q")[1].alias("__hi"))
    return df.join(F.broadcast(cut)).withColumn(f"{column}_w", F.greatest("__lo", F.least("__hi", column))).drop("__lo", "__hi")  # one row


def outliers(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Share of values outside 1.5 interquartile ranges, for each group."""
    ends = quantiles(df, column, [0.25, 0.75], by).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col(column) < F.col("q1") - reach) | (F.col(column) > F.col("q3") + reach)
    return df.join(ends, by).groupBy(*by).agg(F.avg(out.cast("double")).alias("outlier_ratio"))


def regress_out(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Append the residual of ``y`` after its linear dependence on ``x`` in each group."""
    var = F.var_pop(x)
    slope = F.coalesce(F.covar_pop(x, y) / F.nullif(var, F.lit(0.0)), F.lit(0.0))
    fit = df.groupBy(*by).agg(slope.alias("__b"), F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    rest = F.col(y) - (F.col("__y") + F.col("__b") * (F.col(x) - F.col("__x")))
    return df.join(fit, by).withColumn("residual", rest).drop("__b", "__x", "__y")


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation in each group; null where one side is constant. ``p`` is its two-sided level, ``notable`` |rho| >= 0.3 and p < 0.01.

    ``p`` takes rho * sqrt((n - 2) / (1 - rho^2)) as normal, which it nearly is for the cells of a slide.
    """
    r = average_ranks(average_ranks(df, a, by, "__a"), b, by, "__b")
    s = F.stddev_pop("__a") * F.stddev_pop("__b")
    out = r.groupBy(*by).agg((F.covar_pop("__a", "__b") / F.nullif(s, F.lit(0.0))).alias("rho"), F.count("*").alias("n"))
    z = F.abs(F.col("rho")) * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-300)))
    out = out.withColumn("p", normal_tail(z))
    return out.withColumn("notable", (F.abs("rho") >= 0.3) & (F.col("p") < 0.01))


def normal_tail(z: Column) -> Column:
    """The two-sided tail of the normal distribution beyond ``z`` >= 0, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * series)


def unmix(df: DataFrame, channels: list[str], inverse: list[list[float]]) -> DataFrame:
    """Linear unmixing: each channel becomes a combination of all by the inverse mixing matrix."""
    out = {}
    for c, row in zip(channels, inverse):
        total = F.lit(0.0)
        for x, w in zip(channels, row):
            total = total + F.col(x) * float(w)
        out[f"{c}_unmixed"] = total
    return df.withColumns(out)


def cumulative_share(parts: DataFrame, order: str, value: str) -> DataFrame:
    """Running share of a short ranked table (components, clusters)."""
    w = W.orderBy(order)
    run = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn("cumulative", run / F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def report(cells: DataFrame, columns: list[str], cluster: str = "cluster", small: float = 0.01) -> DataFrame:
    """Each cluster's ``n, share`` and mean profile; ``suspicious`` ones hold less than ``small`` of the cells."""
    n = cells.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    share = F.col("n") / F.sum("n").over(W.partitionBy())  # a row a cluster
    return n.withColumn("share", share).withColumn("suspicious", F.col("share") < small)
