"""Near-duplicate embeddings by binary codes of randomly rotated vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, components, cut, free_of, stored

THRESHOLD = 0.98
SEED = 7
#: Standard errors of an estimate that count as possible: a pair above the threshold is missed in about 6 of 10 million cases.
EPSILON = 5.0
#: Bits of a query's coordinate.
BITS = 4
#: Vectors in a block; a task compares two blocks. Each vector goes to as many tasks as its label has blocks.
BLOCK = 4096
#: Rows of a block compared at once.
ROWS = 64


def width(dimension: int) -> int:
    return max(64, -(-dimension // 64) * 64)


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width(dimension), width(dimension))))
    return (q * np.sign(np.diag(r)))[:dimension]


def codes(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors as bits, and each vector's inner product with its code, the correction factor."""
    x = units @ turn
    factor = np.abs(x).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(x > 0, axis=1, bitorder="little").view("<u8"), factor


class Queries:
    """Rotated vectors with coordinates of ``BITS`` bits, rounded at random so that they are unbiased."""

    def __init__(self, units: np.ndarray, turn: np.ndarray):
        x = units @ turn
        self.size = x.shape[1]
        self.low = x.min(axis=1)
        self.step = np.maximum((x.max(axis=1) - self.low) / (2**BITS - 1), 1e-12)
        level = (x - self.low[:, None]) / self.step[:, None]
        self.levels = np.clip(np.floor(level + np.random.default_rng(SEED).random(x.shape)), 0, 2**BITS - 1).astype(np.uint8)
        self.planes = [np.packbits(self.levels >> i & 1, axis=1, bitorder="little").view("<u8") for i in range(BITS)]
        self.sums = self.levels.sum(axis=1, dtype=np.int64)

    def products(self, code: np.ndarray, a: int, b: int) -> np.ndarray:
        """Inner products of queries [a, b) with the unit vectors that the codes stand for."""
        dot = np.zeros((b - a, len(code)))
        for i, plane in enumerate(self.planes):
            ones = np.zeros((b - a, len(code)), np.int64)
            for word in range(code.shape[1]):
                ones += np.bitwise_count(plane[a:b, None, word] & code[None, :, word])
            dot += ones << i
        set_bits = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        step, low = self.step[a:b, None], self.low[a:b, None]
        plus = step * dot + low * set_bits[None, :]
        total = step * self.sums[a:b, None] + low * self.size
        return (2 * plus - total) / np.sqrt(self.size)


def linked(u: np.ndarray, v: np.ndarray, code: np.ndarray, factor: np.ndarray, turn: np.ndarray, threshold: float, same: bool):
    """Pairs (i of u, j of v) whose exact cosine reaches the threshold, by batches of rows of u.

    ``code`` and ``factor`` are those of v. An estimate is the query's product
    with the code over the factor, with standard error
    sqrt((1 - factor^2) / factor^2 / (size - 1)) plus that of the rounding;
    only pairs whose upper bound reaches the threshold are computed exactly.
    """
    q = Queries(u, turn)
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(q.size - 1)
    for a in range(0, len(u), ROWS):
        b = min(a + ROWS, len(u))
        estimate = q.products(code, a, b) / factor[None, :]
        bound = EPSILON * (spread[None, :] + q.step[a:b, None] / 2 / factor[None, :])
        i, j = np.nonzero(estimate + bound >= threshold)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        near = np.einsum("ij,ij->i", u[i], v[j]) >= threshold
        yield i[near], j[near]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, from links within one task."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        differ = root[i] != root[j]
        i, j = i[differ], j[differ]
    while (root[root] != root).any():
        root = root[root]
    return root


def usable(vector: Column) -> Column:
    """Not null, with finite components that aren't all zero."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """Append ``n_links, component_id, kept`` to every vector.

    Vectors of one (non-null) label and dimension link if their cosine in
    double precision reaches ``threshold``. Equal vectors of a label, told by
    128 bits of hash, are one before any comparison. What remains of a label is
    dealt into blocks of about ``BLOCK`` vectors, each pair of blocks is a task,
    and a task returns a count for each vector and links to the smallest member
    of its local component, never pairs. Codes cost a 64th of the vectors to
    compare, but the work still grows with the square of a label's different
    vectors.

    Null, zero and non-finite vectors and those without a label have no links
    and are components of their own. Repeated keys are vectors of their own:
    each row has the links of its own vector, and a component's id is the
    smallest key in it. Rows without a key link like any other; a component of
    such rows alone has no id, and they are never kept. An empty table gives no
    rows. Columns with the names of the result are replaced.
    """
    base = free_of(vectors, ["n_links", "component_id", "kept"])
    x, name = F.col(f"`{vector}`"), F.col(f"`{key}`")
    ok = usable(x) & F.col(f"`{label}`").isNotNull()
    hashes = [F.when(ok, F.xxhash64(F.lit(seed), F.col(f"`{label}`"), x)) for seed in (1, 2)]
    marked = base.withColumns({"__h1": hashes[0], "__h2": hashes[1]})
    distinct = (
        marked.where(ok)
        .groupBy(F.col(f"`{label}`").alias("label"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
        .agg(F.first(x).alias("vector"), F.min(name).alias("id"), F.count("*").alias("copies"))
        .withColumn("size", F.size("vector"))
    )

    def make():
        turns: dict[int, np.ndarray] = {}

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            code, factors = [], []
            for v in b.column(0):
                u = np.array(v.values.to_numpy(zero_copy_only=False), np.float64)
                u = u / np.abs(u).max()
                u = (u / np.linalg.norm(u))[None, :]
                if u.shape[1] not in turns:
                    turns[u.shape[1]] = rotation(u.shape[1])
                c, g = codes(u, turns[u.shape[1]])
                code.append(c.tobytes())
                factors.append(float(g[0]))
            return [pa.array(code, pa.binary()), pa.array(factors, pa.float64())]

        return f

    # Numbers of the different vectors: given once and written with them.
    coded = stored(
        add_columns(
            distinct,
            {"vector": F.col("vector")},
            [T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType())],
            make,
        ).withColumn("node", F.monotonically_increasing_id())
    )
    counts = coded.groupBy("label", "size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # a group's number of blocks: one row for each label and dimension
    placed = coded.join(counts, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiles = placed.withColumn("other", others).select(
        "label", "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "copies", "vector", "code", "factor",
    )

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("node")
        n, size, i, j = len(t), t["size"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
        v = np.array(t["vector"].combine_chunks().values.to_numpy(zero_copy_only=False), np.float64).reshape(n, size)
        v = v / np.abs(v).max(axis=1)[:, None]
        v /= np.linalg.norm(v, axis=1)[:, None]
        code = np.frombuffer(b"".join(t["code"].to_pylist()), "<u8").reshape(n, -1)
        factor, copies, block, node = t["factor"].to_numpy(), t["copies"].to_numpy(), t["block"].to_numpy(), t["node"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, root = np.zeros(n, np.int64), np.arange(n)
        for p, q in linked(v[left], v[right], code[right], factor[right], rotation(size), threshold, i == j):
            p, q = left[p], right[q]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            root = roots(n, np.concatenate([np.arange(n), p]), np.concatenate([root, q]))  # pairs are dropped with each batch
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[some]), "n": pa.array(links[some]), "root": pa.array(node[root[some]])})

    found = cut(tiles.groupBy("label", "size", "i", "j").applyInArrow(compare, "node long, n long, root long"))
    totals = found.groupBy("node").agg(F.sum("n").alias("n"))
    part = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = (
        coded.select(F.col("label").alias("__label"), "h1", "h2", "node", "id", "copies")
        .join(totals, "node", "left")
        .join(part, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    )
    least = told.groupBy("component").agg(F.min("id").alias("component_id"))
    told = told.join(least, "component").select("__label", "h1", "h2", "n_links", "component_id", F.lit(True).alias("__found"))
    same = (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2"))
    out = marked.join(told, same, "left").drop("__label", "h1", "h2", "__h1", "__h2")
    return (
        out.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
        .withColumn("component_id", F.when(F.col("__found"), F.col("component_id")).otherwise(name))
        .withColumn("kept", F.coalesce(name == F.col("component_id"), F.lit(False)))
        .drop("__found")
    )
