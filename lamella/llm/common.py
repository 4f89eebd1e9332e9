"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.shared import cut, shared_folder

#: Word separators of the contracts: space, tab, line feed to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one numpy step works on at most (a single longer text is a step of its own).
STEP_BYTES = 4 << 20
#: Tables that ``stored`` has written and nothing has removed yet.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: columnar, compressed and prunable.

    For intermediate results as large as the corpus. The files stay until
    ``scratch`` removes them, or ``remove`` those at a ``path`` of the caller's
    (from ``place``), or the cluster clears its shared folder.
    """
    at = path or place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(at)
    if path is None:
        WRITTEN.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def place(spark: SparkSession) -> str:
    """The path of a new table in the shared folder."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``stored`` wrote within; for work whose result is written elsewhere before it ends."""
    before = len(WRITTEN)
    try:
        yield
    finally:
        for path in WRITTEN[before:]:
            remove(spark, path)
        del WRITTEN[before:]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` under private column names, the private name of each column, and what gives back its own columns.

    For operators that decide on rows and keep them: no column of theirs can
    meet one of ``df``, whatever it is called.
    """
    names = {c: f"__own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names, lambda d: d.select(*[F.col(n).alias(c) for c, n in names.items()])


def row_hashes(df: DataFrame) -> dict[str, Column]:
    """``__r1, __r2``: 128 bits that stand for a whole row. Nulls count by their place, maps and the like by their JSON."""
    odd = ("map<", "variant")
    own = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        own += [F.to_json(F.struct(x)) if any(o in kind for o in odd) else x, x.isNull()]
    return {"__r1": F.xxhash64(*own), "__r2": F.xxhash64(F.lit(1), *own)}


def free_of(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (Spark ignores case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def add_columns(
    df: DataFrame,
    inputs: dict[str, Column],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """Append Arrow-computed columns to ``df`` in one narrow pass.

    ``inputs`` are computed by Spark and seen by ``make()``'s function, a batch
    at a time; ``make`` runs once in each task. All other columns pass through
    untouched. Columns of ``df`` named like a new field are replaced.
    """
    base = free_of(df, [f.name for f in fields])
    kept = len(base.columns)
    names = [f"__in_{i}" for i in range(len(inputs))]
    wide = df.select(*[df[f"`{c}`"] for c in base.columns], *[c.alias(n) for n, c in zip(names, inputs.values())])
    out = T.StructType([*base.schema.fields, *fields])
    schema = to_arrow_schema(out)
    keys = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            seen = pa.RecordBatch.from_arrays(b.columns[kept:], names=keys)
            yield pa.RecordBatch.from_arrays(
                [c.cast(t.type) for c, t in zip([*b.columns[:kept], *f(seen)], schema)], schema=schema
            )

    return wide.mapInArrow(run, out)


def buffer_of(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a binary column without nulls, and where its values begin and end."""
    n = len(column)
    if n == 0:
        return memoryview(b""), [0]
    _, ends, data = column.buffers()
    import numpy as np

    at = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + n + 1].tolist()
    return (memoryview(data) if data is not None else memoryview(b"")), at


def steps(at: list[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) whose bytes stay under ``most`` together."""
    i, n = 0, len(at) - 1
    while i < n:
        j = i + 1
        while j < n and at[j + 1] - at[i] <= most:
            j += 1
        yield i, j
        i = j


def utf8(text: Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def remainder(key: Column, of: int) -> Column:
    """crc32 of a key written as text, modulo ``of``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def lowest(keys: DataFrame, n: int, by: list[str], h: str = "h") -> DataFrame:
    """The ``n`` lowest different hashes ``h`` of each group (all of a smaller group), with few rows in any task.

    The different hashes of a group are estimated first; only hashes low enough
    for about ``4 n`` of them go on to be ranked, whatever the number of tasks
    and rows. Repeated hashes count once, so a key that many rows share is one
    of the ``n``. ``by`` are columns with few values (a row of each is broadcast).
    """
    from pyspark.sql import Window as W

    most = 4 * n + 1000
    counts = keys.groupBy(*by).agg(F.approx_count_distinct(h, 0.02).alias("__n"))
    low = F.col(h).cast("double") < (float(most) / F.col("__n") - 0.5) * 2.0**64
    some = keys.join(F.broadcast(counts), by) if by else keys.join(F.broadcast(counts))  # one row a group
    few = some.where((F.col("__n") <= most) | low).drop("__n").distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy(h))
    return few.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def running(df: DataFrame, order: list[Column], total: Column) -> DataFrame:
    """Append ``rank`` (from 0) and ``before`` (sum of ``total`` over earlier rows) in a total order.

    Ranges of the order are numbered apart and then shifted by the totals of
    the ranges before them, so no task holds all rows; only one row for each
    range meets in one task.
    """
    from pyspark.sql import Window as W

    part = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__total", total))
    ranges = part.groupBy("__range").agg(F.count("*").alias("__n"), F.sum("__total").alias("__sum"))
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    shift = ranges.select(
        "__range",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum0"),
    )
    w = W.partitionBy("__range").orderBy(*order)
    return (
        part.withColumn("__rank", F.row_number().over(w) - 1)
        .withColumn("__sum1", F.coalesce(F.sum("__total").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(shift), "__range")  # one row for each shuffle partition
        .withColumn("rank", F.col("__rank") + F.col("__n0"))
        .withColumn("before", F.col("__sum1") + F.col("__sum0"))
        .drop("__range", "__total", "__rank", "__n0", "__sum1", "__sum0")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: ``node, component`` (its smallest node) for every node with an edge to another.

    Alternates the large-star and small-star steps of map-reduce connected
    components, O(log n) rounds in practice. Each step is an aggregation with
    map-side combine and a join that Spark splits when a hub is hot. Every
    round is checkpointed; only a count and a checksum reach the driver.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        told = both.join(least, "a")
        if large:
            out = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return out.where("a > b").distinct()

    def mark(e: DataFrame):
        # xor of hashes: no overflow under ANSI, whatever the order of rows
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    seen = mark(now)
    for _ in range(rounds if seen[0] else 0):
        now = cut(step(step(now, True), False))
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


#: Bytes of a text whose runs are listed at once.
PIECE = 1 << 20


def runs(text: bytes, table: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The runs between blanks of a text after ``table`` (which makes blanks of separators), about ``most`` bytes at a time."""
    text, at = text.translate(table), 0
    while len(text) - at > most:
        end = text.rfind(b" ", at, at + most)
        if end <= at and (end := text.find(b" ", at + most)) < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def letters(keep: Callable[[int], bool]) -> bytes:
    """A table for ``runs``: bytes that ``keep`` refuses become blanks, A-Z lower case."""
    return bytes(c + 32 if 65 <= c <= 90 else c if keep(c) else 32 for c in range(256))
