"""Density-based clusters (DBSCAN), exact, on a grid whose cells are no wider than the radius."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import distance2
from ..functions.graph import components
from ..functions.shared import cut

#: Dimensions by which neighbouring cells are looked up; the others are only compared.
AXES = 3
#: Slack of the grid against rounding: cells a little smaller, reach between them a little larger.
SLACK = 1e-9


def finite(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def near_cells(cells: DataFrame, eps: float, side: float, dimensions: int) -> DataFrame:
    """Pairs ``a, b`` of the cells (``cell``), each with itself too, that points within ``eps`` can lie in."""
    reach = math.isqrt(dimensions) + 1  # cells that eps spans at most
    block = F.transform(F.slice("cell", 1, min(AXES, dimensions)), lambda c: F.floor(c / reach))
    steps = F.array(*[F.array(*[F.lit(s).cast("long") for s in t]) for t in product((-1, 0, 1), repeat=min(AXES, dimensions))])
    left = cells.select(F.col("cell").alias("a"), F.explode(F.transform(steps, lambda s: F.zip_with(s, block, lambda x, y: x + y))).alias("block"))
    right = cells.select(F.col("cell").alias("b"), block.alias("block"))
    gap = F.zip_with("a", "b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double"))
    far = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) * side * side
    return left.join(right, "block").where(far <= eps * eps * (1 + SLACK)).select("a", "b")


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """``id, core, cluster`` of every point (``id, v``; unique ids): its cluster is named by its smallest core point, null for noise.

    A core point has ``min_points`` points within ``eps``, itself included;
    clusters join core points within ``eps`` of each other, and a border point
    belongs to the one of its clusters with the smallest name. Null vectors and
    those with a component that is null or not finite are noise. All vectors have one length. An
    empty table gives no rows.

    Cells have the side eps / sqrt(d): where one holds ``min_points`` points
    they all are core and in one cluster, by count alone. Only points of sparser
    cells are compared with their surroundings, and cells, not points, are the
    nodes of the graph; two of them are joined by outermost points where these are
    near enough, else by any two that are. No list of neighbours is ever made, so
    a dense cluster costs its cells.
    """
    good = points.select("id", "v").where(finite(F.col("v")))
    dimensions = good.agg(F.max(F.size("v"))).first()[0]
    if dimensions is None:
        return points.select("id", F.lit(False).alias("core"), F.col("id").alias("cluster")).withColumn("cluster", F.when(F.lit(False), F.col("cluster")))
    side = eps / math.sqrt(dimensions) * (1 - SLACK)
    own = cut(good.withColumn("cell", F.transform("v", lambda x: F.floor(x / side))))
    cells = cut(own.groupBy("cell").agg(F.count("*").alias("n")))
    pairs = cut(near_cells(cells, eps, side, dimensions))
    within = lambda v, u: distance2(F.col(v), F.col(u)) <= eps * eps
    # Core points: by count of their cell, or of the points around those of sparse cells.
    sparse = own.join(cells.where(F.col("n") < min_points).select("cell"), "cell")
    around = sparse.join(pairs, F.col("cell") == F.col("a")).select("id", "v", "b")
    met = around.join(own.select(F.col("cell").alias("b"), F.col("v").alias("u")), "b").where(within("v", "u"))
    many = met.groupBy("id").agg(F.count("*").alias("near")).where(F.col("near") >= min_points).select("id", F.lit(True).alias("__many"))
    dense = own.join(cells, "cell")
    core = F.coalesce((F.col("n") >= min_points) | F.col("__many"), F.lit(False))
    marked = cut(dense.join(many, "id", "left").select("id", "v", "cell", core.alias("core")))
    # Cells with core points, joined where two of these are near.
    cores = marked.where("core")
    axes = range(min(AXES, dimensions))
    ends = [F.max_by("v", sum((F.col("v")[i] * s for i, s in zip(axes, t)), F.lit(0.0))) for t in product((1, -1), repeat=len(axes))]
    nodes = cut(cores.groupBy("cell").agg(F.min("id").alias("node"), F.array_distinct(F.array(*ends)).alias("ends")))
    x, y = (nodes.select(F.col("cell").alias(c), F.col("node").alias(f"node_{c}"), F.col("ends").alias(f"ends_{c}")) for c in "ab")
    asked = pairs.where(F.col("a") < F.col("b")).join(x, "a").join(y, "b")
    touch = F.exists("ends_a", lambda v: F.exists("ends_b", lambda u: distance2(v, u) <= eps * eps))
    asked = cut(asked.select("a", "b", "node_a", "node_b", touch.alias("touch")))
    side_of = lambda c: cores.select(F.col("cell").alias(c), F.col("v").alias(f"v_{c}"))
    rest = asked.where(~F.col("touch")).join(side_of("a"), "a").where(box_distance("v_a", "b", side) <= eps * eps * (1 + SLACK))
    rest = rest.join(side_of("b"), "b").where(within("v_a", "v_b")).select("node_a", "node_b").distinct()
    part = components(asked.where("touch").select("node_a", "node_b").unionByName(rest), "node_a", "node_b")
    named = nodes.select("cell", "node").join(part, "node", "left").select("cell", F.coalesce("component", "node").alias("cluster"))
    named = cut(named)
    # Points that are not core lie in sparse cells: the smallest cluster around them.
    lonely = marked.where(~F.col("core")).join(pairs, F.col("cell") == F.col("a")).select("id", "v", "b")
    edge = lonely.join(cores.join(named, "cell").select(F.col("cell").alias("b"), F.col("v").alias("u"), "cluster"), "b").where(within("v", "u"))
    border = edge.groupBy("id").agg(F.min("cluster").alias("cluster"))
    inner = cores.join(named, "cell").select("id", "cluster", F.lit(True).alias("core"))
    told = inner.unionByName(border.select("id", "cluster", F.lit(False).alias("core")))
    return points.select("id").join(told, "id", "left").select("id", F.coalesce("core", F.lit(False)).alias("core"), "cluster")


def box_distance(v: str, cell: str, side: float) -> Column:
    """Squared distance of a point to a cell's box."""
    gap = F.zip_with(v, cell, lambda x, c: F.greatest(c * side - x, x - (c + 1) * side, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
