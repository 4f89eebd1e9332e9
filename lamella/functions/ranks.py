"""Ranks and exact quantiles over whole tables without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Append the place (from 0) of every row in a total order.

    Ranges of the order are numbered apart and shifted by the sizes of the
    ranges before them; one row a range meets in one task. The dealt rows are
    checkpointed, as ranges are drawn anew whenever they are computed.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    w = W.partitionBy("__range").orderBy(*order)
    return (
        dealt.withColumn("__row", F.row_number().over(w) - 1)
        .join(F.broadcast(shift), "__range")  # one row for each shuffle partition
        .withColumn(name, F.col("__row") + F.col("__shift"))
        .drop("__range", "__row", "__shift")
    )


def average_ranks(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Append the average rank (from 1) of ``column`` within each group ``by``; nulls first.

    Different values are counted with map-side combine, and only the counts are
    ranked, in ranges over all groups; a value's rows meet it in a join that
    adaptive execution splits where a value is hot.
    """
    counts = df.groupBy(*by, column).agg(F.count("*").alias("__n"))
    order = [F.col(c).asc() for c in (*by, column)]
    dealt = cut(counts.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    inside = W.partitionBy("__range", *by)
    before = F.coalesce(F.sum("__n").over(inside.orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("__range", *by).agg(F.sum("__n").alias("__all"))
    earlier = F.coalesce(F.sum("__all").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    left = dealt.withColumn("__before", before).alias("a")
    right = sizes.withColumn("__earlier", earlier).alias("b")
    on = F.col("a.__range") == F.col("b.__range")
    for c in same:
        on = on & c
    mean = F.col("a.__before") + F.col("b.__earlier") + (F.col("a.__n") + 1) / 2.0
    told = left.join(right, on).select(*[F.col(f"a.{c}").alias(f"__k{i}") for i, c in enumerate((*by, column))], mean.alias(name))
    keys = F.lit(True)
    for i, c in enumerate((*by, column)):
        keys = keys & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return df.join(told, keys).drop(*[f"__k{i}" for i in range(len(by) + 1)])


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """``q``: exact quantiles (interpolated) of ``column`` in each group, or of all rows.

    Different values are counted, ranked in ranges and picked where the
    quantiles fall: two values for each. Nulls don't count.
    """
    by = by or []
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__v"))
    counts = rows.groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    order = [F.col(c).asc() for c in (*by, "__v")]
    dealt = cut(counts.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range", *by).agg(F.sum("__n").alias("__all"))
    group, inside = W.partitionBy(*by), W.partitionBy("__range", *by)
    earlier = F.coalesce(F.sum("__all").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = sizes.withColumns({"__earlier": earlier, "__total": F.sum("__all").over(group)}).drop("__all")
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    on = F.col("a.__range") == F.col("b.__range")
    for k in keys:
        on = on & k
    upto = F.sum("__n").over(inside.orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    both = dealt.withColumn("__upto", upto).alias("a").join(told.alias("b"), on)
    last = F.col("a.__upto") + F.col("b.__earlier")
    row = both.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.__v").alias("v"), last.alias("last"), F.col("b.__total").alias("total"))
    place = lambda share: F.lit(float(share)) * (F.col("total") - 1)
    low = lambda s: F.min(F.when(F.col("last") > F.floor(place(s)), F.col("v")))
    high = lambda s: F.min(F.when(F.col("last") > F.ceil(place(s)), F.col("v")))
    part = lambda s: F.max(place(s) - F.floor(place(s)))
    # Of two equal values (infinite ones, too) it is that one.
    between = lambda s: F.when(low(s) == high(s), low(s)).otherwise(low(s) + (high(s) - low(s)) * part(s))
    return row.groupBy(*by).agg(F.array(*[between(s) for s in shares]).alias("q"))
