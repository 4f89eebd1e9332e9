"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, free_of, renamed, row_hashes, running, stored

#: Weights by rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: Repetitions at most.
CAP = 3
#: Sources whose statistics are broadcast at most, and bytes of their names.
FEW, NAME = 10_000, 200
#: With more of them, a source's rows meet its statistics in this many groups, so that one source may hold most rows.
SALTS = 32
SEED = "mix-0"


def words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on ``seed`` and the key alone (null key: as an empty text)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target size of each source: ``source, source_size`` -> plus ``target``.

    Sources by code point, null last, weigh ``weights`` in turn. A source's
    target is min(cap * size, level * weight) with the one level that makes
    the targets add up to the total: what resharing the excess by weight ends
    in. Sources are met in order of cap * size / weight; those before the
    first that stays under the level at its place stand at their cap.
    """
    known = F.col("source").isNotNull()
    named = running(sizes, [(~known).cast("int").asc(), F.col("source").asc()], F.lit(0).cast("long")).drop("before")
    n = len(weights)
    weighed = named.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % n + 1).cast("int"))
    ).drop("rank")
    total = weighed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    ordered = running(
        weighed.withColumn("full", F.col("source_size") * cap / F.col("weight")),
        [F.col("full").asc(), (~known).cast("int").asc(), F.col("source").asc()],
        F.col("weight"),
    ).withColumnRenamed("before", "weight_before").drop("rank")
    ordered = (
        running(ordered, [F.col("full").asc(), (~known).cast("int").asc(), F.col("source").asc()], F.col("source_size"))
        .withColumnRenamed("before", "size_before")
        .drop("rank")
        .join(F.broadcast(total))  # one row
    )
    level = ordered.withColumn(
        "level",
        (F.col("all_size") - F.col("size_before") * cap) / (F.col("all_weight") - F.col("weight_before")).cast("double"),
    )
    # The level at the first uncapped source; with all at their caps (nothing to share) any level does.
    found = level.where(F.col("full") >= F.col("level")).agg(F.min_by("level", "full").alias("at"))
    return (
        level.select("source", "source_size", "weight")
        .join(F.broadcast(found))  # one row
        .select(
            "source",
            "source_size",
            F.least(
                F.col("source_size").cast("double") * cap, F.col("weight") * F.coalesce(F.col("at"), F.lit(0.0))
            ).alias("target"),
        )
    )


def rates(stats: DataFrame, cap: int = CAP) -> DataFrame:
    """``stats`` plus ``rate`` (target / size, ``cap`` at most) and its ``fraction``: the probability of a document's extra copy."""
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return stats.withColumn("rate", share).withColumn("fraction", F.col("rate") - F.floor("rate"))


def placed(df: DataFrame, source: str, key: str) -> DataFrame:
    """``df`` (with ``size``) with ``__place``: each row's place (from 0) by source (null last), size, key and row, over all sources."""
    private, names, _ = renamed(df)
    own = [F.col(names[c]) for c in ("size", key)]
    order = [F.col(names[source]).isNull(), F.col(names[source]), *own, *row_hashes(private).values()]
    ranked = running(private, [c.asc() for c in order], F.lit(0))
    return ranked.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("rank").alias("__place"))


def plan(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    size: str | None = None,
    spaced: bool = False,
) -> DataFrame:
    """Append ``size, source_size, target, rate, fraction, copies`` to every document.

    A source's rate is target / size; a document is taken floor(rate) times and
    once more with a probability equal to the fraction of the rate. By default
    each document's draw is its own, seeded by its key; rows of one key (all
    without a key, too) share it. ``spaced``, one draw, seeded by the source's
    name, serves its documents in the order of their sizes (then keys, null
    first): the extra copy goes to those at which the sum of fractions from
    that start passes a whole number. Each document's probability is the
    fraction all the same, but the number drawn is off by one at most, and
    neighbours are alike in size, so the words come near the target. Draws of
    a source then depend on each other. Either way a rerun takes the same rows.

    ``size`` names a column that has the sizes; else words are counted. Null,
    empty and wordless texts have size 0; a source of size 0 has target and
    rate 0; documents without a source are one. Columns of ``docs`` with those
    names are replaced. No row is lost, repeated rows are documents of their
    own, and zero copies are kept here; an empty table gives no rows.

    Sources hold any share of the rows: their sums have map-side combine, and
    places are given in ranges over all sources. Statistics ride along where
    sources are few (``FEW`` rows of ``NAME`` letters at most are broadcast),
    else rows meet them in ``SALTS`` groups a source; the rows are equal.
    """
    counted = F.col(f"`{size}`").cast("long") if size else words(F.col(f"`{text}`"))
    base = docs.withColumn("__size", counted)
    sized = free_of(base, ["size", "source_size", "target", "rate", "fraction", "copies"]).withColumnRenamed("__size", "size")
    name = F.col(f"`{source}`")
    sizes = cut(sized.groupBy(name.alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    first = running(sizes.select("source", "n"), [F.col("source").isNull().asc(), F.col("source").asc()], F.col("n")).select(F.col("source").alias("__from"), F.col("before").alias("__first"))
    goals = rates(targets(sizes.select("source", "source_size"), weights, cap), cap)
    stats = cut(goals.join(first, F.col("source").eqNullSafe(F.col("__from"))).drop("__from").withColumnRenamed("source", "__source"))
    n, longest = stats.agg(F.count("*"), F.coalesce(F.max(F.octet_length(F.col("__source").cast("string"))), F.lit(0))).first()
    same = name.eqNullSafe(F.col("__source"))
    told = ["__source", "source_size", "target", "rate", "fraction", "__first"]
    rows = placed(sized, source, key) if spaced else sized
    if n <= FEW and longest <= NAME:
        met = rows.join(F.broadcast(stats.select(*told)), same)
    else:
        salted = stats.select(*told, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt_to"))
        salt = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col("size")), F.lit(SALTS)).cast("int")
        met = rows.withColumn("__salt", salt).join(salted, same & (F.col("__salt") == F.col("__salt_to"))).drop("__salt", "__salt_to")
    if spaced:
        at = F.col("__place") - F.col("__first")
        upto = lambda k: F.floor(draw(name, seed) + k * F.col("fraction"))
        extra = upto(at + 1) - upto(at)
    else:
        extra = (draw(F.col(f"`{key}`"), seed) < F.col("fraction")).cast("long")
    return met.withColumn("copies", F.floor("rate") + extra).drop("__source", "__first", "__place")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: every document as often as its plan says, with the columns of ``docs`` as they are.

    Plans are made on rows without their texts; equal rows are one there, and
    take together what they take apart.
    """
    private, names, own = renamed(docs)
    hashed = private.withColumns(row_hashes(private))
    hashes = ["__r1", "__r2"]
    narrow = stored(hashed.select(*hashes, F.col(names[source]).alias("source"), F.col(names[key]).alias("key"), words(F.col(names[text])).alias("words")))
    planned = plan(narrow, source="source", key="key", size="words", **options).groupBy(*hashes).agg(F.sum("copies").alias("copies"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    taken = hashed.dropDuplicates(hashes).join(planned.where(F.col("copies") > 0), hashes)
    return own(taken.withColumn("__copy", each))
