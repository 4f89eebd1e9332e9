"""SimHash near-duplicates by meeting in the middle of Hamming balls, or by segments of wide fingerprints."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import add_columns, components, cut, renamed, row_hashes, stored, utf8
from .embeddings import roots

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted at once.
STEP = 1 << 14
#: Shingles and least similarity of the texts that ``deduplicate`` calls copies.
WORDS, SIMILARITY = 5, 0.8
#: 64-bit parts of a wide fingerprint, and the share of just similar pairs that may share no segment.
PARTS, MISSED = 8, 0.01
#: Texts after each in a segment's order that the first look compares it with, and its segments.
NEXT, EARLY = 2, 6
#: Standard deviations that a radius allows for: 1 in 4000 of the pairs just at the threshold is beyond it.
DEVIATIONS = 3.5
#: Columns of texts that meet, and texts of a segment that one task compares with each other.
MET, BLOCK = ("segment", "node", "first", "second", "size", "component"), 2048
#: Texts of segments whose pairs are looked at many segments together.
SMALL = 6
#: Candidates a text above which a segment's texts are a crowd, and texts and shingles of a crowd's block.
MANY, CROWD, SHINGLES = 2, 1024, 1 << 20
#: Pairs that share a hash, above which it is a column of a matrix.
RARE = 64
#: Kinds of findings.
PAIR, LEFT, CROWDED = 0, 1, 2


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    n = max(len(parts) - words + 1, 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    begins, width = [0, *ends], min(words, len(parts)) - 1
    count = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        h = np.array([xxh64_intdigest(joined[begins[k] : ends[k + width] - 1], SEED) for k in range(i, min(n, i + STEP))], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """Append ``fingerprint`` (long) of every whole text; null and wordless texts have 0."""

    def make():
        tokens.forget()
        def f(b: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([fingerprint(x.as_py(), words) for x in b.column(0)], pa.int64())]

        return f

    return add_columns(docs, {"bytes": utf8(F.col(f"`{text}`"))}, [T.StructField("fingerprint", T.LongType())], make)


def links(prints: DataFrame) -> DataFrame:
    """Links between different fingerprints, enough to connect all within ``RADIUS`` bits: ``a, b``.

    ``prints`` holds each ``fingerprint`` once. Each emits its 65 variants
    within half the radius; two within the radius share one. Those that share
    a variant (65 at most) are linked to the next of them in order: all are
    within the radius of each other, so the chain links what the pairs would.
    """
    x = F.col("fingerprint")
    spark = prints.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    prints = prints.select(x).repartition(wide, x)  # 8 bytes a row become 65 rows: dealt by rows, not by bytes
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    variants = prints.select(x, F.explode(flips).alias("flip")).select(x, x.bitwiseXOR(F.col("flip")).alias("variant"))
    after = F.lead("fingerprint").over(W.partitionBy("variant").orderBy("fingerprint"))
    return (
        variants.withColumn("b", after)
        .where(F.col("b").isNotNull() & (F.bit_count(x.bitwiseXOR(F.col("b"))) <= RADIUS))
        .select(x.alias("a"), "b")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """``key, fingerprint`` (long), ``component_id``: one row for each document.

    ``component_id`` is the smallest key reachable over links. Documents with
    equal fingerprints are one before any variant is emitted, so thousands of
    copies cost what one does. Null and wordless texts have fingerprint 0 and
    link with each other. Repeated keys are documents of their own. Null keys
    count only where a component has no other. An empty table gives no rows;
    other columns of ``docs`` are not kept.
    """
    marked = fingerprints(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")), "__text", words).drop("__text")
    kept = stored(marked)  # two numbers a document: texts are read and hashed once
    prints = kept.groupBy("fingerprint").agg(F.min(f"`{key}`").alias("__least"))
    part = components(links(prints.select("fingerprint")))
    named = prints.join(part, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("__print"), F.coalesce("component", "fingerprint").alias("__component"), "__least"
    )
    least = named.groupBy("__component").agg(F.min("__least").alias("component_id"))
    labels = named.join(least, "__component").select("__print", "component_id")
    return kept.join(labels, F.col("fingerprint") == F.col("__print")).drop("__print")


def shingles(text: bytes, words: int) -> set[bytes]:
    """The different shingles of a text; a shorter one is one shingle, a wordless one has none."""
    parts = text.lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(max(len(parts) - words + 1, 1))} if parts else set()


def wide(text: bytes, words: int) -> list[int] | None:
    """The number of different shingles and ``PARTS`` signed numbers of 64 bits, their majorities; None without words."""
    from xxhash import xxh64_intdigest

    h = np.array([xxh64_intdigest(x, SEED) for x in shingles(text, words)], np.uint64)
    if not len(h):
        return None
    out = [len(h)]
    for k in range(PARTS):
        if k:  # mixed again: independent bits from the same hash
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        count = np.zeros(64, np.int64)
        for i in range(0, len(h), STEP):
            count += np.unpackbits(h[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0]))
    return out


def text_hashes(text: str) -> dict[str, Column]:
    """128 bits that stand for a whole text."""
    x = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return {"h1": F.xxhash64(x), "h2": F.xxhash64(F.lit(1), x)}


def samples(n: int, similarity: float) -> tuple[int, int, Callable[..., int]]:
    """Bits of a segment, number of segments, and the radius by the number of bits compared, for ``n`` texts.

    Sets of equal size with Jaccard s have the cosine 2 s / (1 + s), other
    sizes a larger one; a bit differs with the probability angle / pi. A ball
    of that radius (about 10 of 64 bits at 0.8) is far too large to list, so
    texts meet on segments instead: samples of as many bits as make chance
    meetings rare, as many samples as leave ``MISSED`` of the pairs at the
    threshold unmet.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(max(math.ceil(math.log2(max(n, 2))), 8), 48)
    tables = max(math.ceil(math.log(MISSED) / math.log1p(-((1 - p) ** bits))), 1)
    return bits, tables, lambda size, deviations=DEVIATIONS: math.ceil(size * p + deviations * math.sqrt(size * p * (1 - p)))


def spread(prints: DataFrame, bits: int, which: range) -> DataFrame:
    """``segment, node, first, second, size, component``: each node in each of the segments ``which``, with 128 of its bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = {t: np.random.default_rng([SEED, t]).choice(64 * PARTS, bits, replace=False) for t in which}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for i in range(0, len(whole), 2048):
                b = whole.slice(i, 2048)
                node, size, component = (b.column(c).to_numpy() for c in (0, 2, 3))
                parts = np.array(b.column(1).to_pylist(), "<i8")
                ones = np.unpackbits(parts.view(np.uint8), axis=1, bitorder="little")
                for t, pick in picks.items():
                    segment = (ones[:, pick] @ weights) + (t << bits)
                    columns = (segment, node, parts[:, 0].copy(), parts[:, 1].copy(), size, component)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=list(MET))

    return prints.select("node", "parts", "size", "component").mapInArrow(make, ", ".join(f"{c} long" for c in MET))


def chains(prints: DataFrame, bits: int, radius: Callable[..., int], similarity: float) -> DataFrame:
    """Candidates from ``EARLY`` segments, each text with the ``NEXT`` after it: enough to link most of a family of copies.

    Nothing rests on what this leaves out: ``meetings`` looks at all pairs. So the
    radius is only what a pair at the threshold differs by in the mean.
    """
    near = radius(128, 0)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 5
        for b in batches:
            segment, node, first, second, size = (np.concatenate([t, c.to_numpy()]) for t, c in zip(tail, b.columns))
            old = len(tail[0])
            tail = [x[-NEXT:] for x in (segment, node, first, second, size)]
            for k in range(1, NEXT + 1):
                at = np.arange(max(old - k, 0), max(len(segment) - k, 0))
                differ = sum(np.bitwise_count((x[at] ^ x[at + k]).view(np.uint64)) for x in (first, second))
                at = at[(segment[at] == segment[at + k]) & (differ <= near) & alike(size[at], size[at + k], similarity)]
                a, b2 = node[at], node[at + k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b2)), pa.array(np.maximum(a, b2))], names=["a", "b"])

    dealt = spread(prints, bits, range(EARLY)).drop("component").repartition("segment").sortWithinPartitions("segment", "node")
    return dealt.mapInArrow(make, "a long, b long").where("a <> b").distinct()


def alike(m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have that Jaccard similarity."""
    return np.minimum(m, n) >= similarity * np.maximum(m, n)


class Side:
    """Texts that met, as columns; ``order`` is that of the columns of ``MET``."""

    def __init__(self, columns: list[np.ndarray]):
        _, self.node, self.first, self.second, self.size, self.component = columns

    def against(self, other: Side, near: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs (once each, if ``other`` is this side) of different components that bits and sizes let pass."""
        left, right = [], []
        for a in range(0, len(self.node), 256):
            part = slice(a, a + 256)
            differ = np.bitwise_count((self.first[part, None] ^ other.first[None]).view(np.uint64))
            differ += np.bitwise_count((self.second[part, None] ^ other.second[None]).view(np.uint64))
            good = (differ <= near) & (self.component[part, None] != other.component[None])
            i, j = np.nonzero(good)
            i += a
            if other is self:
                i, j = i[i < j], j[i < j]
            some = alike(self.size[i], other.size[j], similarity)
            left.append(i[some])
            right.append(j[some])
        return np.concatenate(left), np.concatenate(right)

    def blocks(self) -> np.ndarray:
        """A block number for each text: blocks of ``CROWD`` texts and ``SHINGLES`` shingles at most (a longer text is one alone)."""
        out, block, n, total = np.zeros(len(self.node), np.int64), 0, 0, 0
        for i, size in enumerate(self.size.tolist()):
            if n and (n == CROWD or total + size > SHINGLES):
                block, n, total = block + 1, 0, 0
            out[i], n, total = block, n + 1, total + size
        return out


def compared(left: Side, right: Side, name: tuple, near: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Candidates of two sides (or one with itself): as pairs where they are few, else as groups whose shingles are to be compared."""
    i, j = left.against(right, near, similarity)
    if len(i) <= MANY * (len(left.node) + len(right.node)):
        a, b = left.node[i], right.node[j]
        yield found(PAIR, np.minimum(a, b), np.maximum(a, b))
        return
    p, q = left.blocks(), right.blocks()
    for x, y in np.unique(np.column_stack([p[i], q[j]]), axis=0).tolist():
        met = (p[i] == x) & (q[j] == y)
        group = hash((*name, x, y))  # of integers: the same in every process
        for side, who, at in ((0, left, np.unique(i[met])), (1, right, np.unique(j[met]))):
            yield found(CROWDED, np.full(len(at), group), who.node[at], side=np.full(len(at), side), component=who.component[at])


def found(kind: int, a: np.ndarray, b: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    none = np.zeros(len(a), np.int64)
    columns = {"kind": np.full(len(a), kind), "a": a, "b": b, **{c: more.get(c, none) for c in ("side", "first", "second", "size", "component")}}
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in columns.values()], names=list(columns))


FOUND = "kind long, a long, b long, side long, first long, second long, size long, component long"


def meetings(prints: DataFrame, similarity: float, bits: int, tables: int, radius: Callable[..., int]) -> tuple[DataFrame, DataFrame]:
    """What all pairs of different components in all segments leave: pairs ``a, b``, and crowds ``group, side, node, component``.

    ``prints`` has ``node, parts, size, component``, each node once. A task
    compares the texts of a segment by 128 bits and their sizes. Segments of more
    than ``BLOCK`` texts are handed on in blocks, of which every two (but those
    of one and the same component) meet in another task. Where candidates are
    many, as among pages of one template, the texts go on as a group instead of
    the pairs: rows grow with the texts.
    """
    near = radius(128)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [np.zeros(0, np.int64)] * len(MET), 0  # of one segment: what its earlier blocks left

        def end(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """One segment, whole."""
            if len(rows[0]) > 1 and rows[5][0] != rows[5][-1]:  # sorted by component
                side = Side(rows)
                yield from compared(side, side, (int(rows[0][0]),), near, similarity)

        def pairs(rows: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The candidates of many small segments together: each of the rows ``at`` with the k-th after it in its segment."""
            segment, node, one, two, size, component = rows
            for k in range(1, SMALL):
                at = at[at + k < len(segment)]
                at = at[segment[at] == segment[at + k]]
                if not len(at):
                    return
                differ = sum(np.bitwise_count((x[at] ^ x[at + k]).view(np.uint64)) for x in (one, two))
                good = at[(differ <= near) & (component[at] != component[at + k]) & alike(size[at], size[at + k], similarity)]
                a, b = node[good], node[good + k]
                yield found(PAIR, np.minimum(a, b), np.maximum(a, b))

        def hand_on(rows: list[np.ndarray], number: int) -> pa.RecordBatch:
            segment, node, one, two, size, component = rows
            return found(LEFT, segment, node, side=np.full(len(node), number), first=one, second=two, size=size, component=component)

        for b in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
            bounds = np.r_[0, np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1, len(rows[0])] if len(rows[0]) else np.zeros(1, int)
            sizes = np.diff(bounds)
            few = (sizes > 1) & (sizes <= SMALL)
            few[-1:] = False  # may go on
            few[:1] &= block == 0
            if few.any():
                yield from pairs(rows, np.flatnonzero(np.repeat(few, sizes)))
            for k in np.flatnonzero((sizes > SMALL) | (np.arange(len(sizes)) == len(sizes) - 1) | ((np.arange(len(sizes)) == 0) & (block > 0))):
                part = [x[bounds[k] : bounds[k + 1]] for x in rows]
                last = k == len(sizes) - 1
                while len(part[0]) > BLOCK:
                    yield hand_on([x[:BLOCK] for x in part], block)
                    part, block = [x[BLOCK:] for x in part], block + 1
                if last:
                    held = part
                elif block:
                    yield hand_on(part, block)
                    block = 0
                else:
                    yield from end(part)
        if block:
            yield hand_on(held, block)
        else:
            yield from end(held)
        tokens.trim()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def end() -> Iterator[pa.RecordBatch]:
            sides = np.concatenate([h[0] for h in held])
            rows = [np.concatenate([h[k] for h in held]) for k in range(1, 7)]
            left, right = (Side([x[sides == s] for x in rows]) for s in (0, 1))
            yield from compared(left, right if len(right.node) else left, now, near, similarity)

        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in range(3)])
            bounds = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(b)] if len(b) else np.zeros(1, int)
            for u, v in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                key = tuple(keys[u].tolist())
                if key != now and held:
                    yield from end()
                    held = []
                now = key
                held.append([b.column(c).to_numpy()[u:v] for c in (3, 0, 4, 5, 6, 7, 8)])
        if held:
            yield from end()
        tokens.trim()

    dealt = spread(prints, bits, range(tables)).repartition("segment").sortWithinPartitions("segment", "component", "node")
    met = cut(dealt.mapInArrow(first, FOUND))
    rest = met.where(F.col("kind") == LEFT).select(F.col("a").alias("segment"), F.col("side").alias("block"), F.col("b").alias("node"), "first", "second", "size", "component")
    blocks = rest.groupBy("segment", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    i, j = (blocks.select("segment", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high")]) for x in "ij")
    apart = ~((F.col("low_i") == F.col("high_i")) & (F.col("low_j") == F.col("high_j")) & (F.col("low_i") == F.col("low_j")))
    pairs = i.join(j, "segment").where((F.col("block_i") <= F.col("block_j")) & apart).select("segment", F.col("block_i").alias("i"), F.col("block_j").alias("j"))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).cast("long").alias("side"), F.col("i").alias("block")))).otherwise(
        F.array(*[F.struct(F.lit(k).cast("long").alias("side"), F.col(c).alias("block")) for k, c in enumerate("ij")])
    )
    asked = pairs.withColumn("x", F.explode(sides)).select("segment", "i", "j", "x.side", "x.block")
    more = rest.join(asked, ["segment", "block"]).select("segment", "i", "j", "side", "node", "first", "second", "size", "component")
    more = cut(more.repartition("segment", "i", "j").sortWithinPartitions("segment", "i", "j", "side", "component").mapInArrow(second, FOUND))
    both = met.where(F.col("kind") != LEFT).unionByName(more)
    few = both.where(F.col("kind") == PAIR).select("a", "b").distinct()
    return few, both.where(F.col("kind") == CROWDED).select(F.col("a").alias("group"), "side", F.col("b").alias("node"), "component")


def closer(pairs: DataFrame, prints: DataFrame, similarity: float, radius: Callable[..., int]) -> DataFrame:
    """Those of the pairs whose sizes and whole fingerprints are within the radius."""
    own = lambda side: prints.select(F.col("node").alias(side), F.col("parts").alias(f"parts_{side}"), F.col("size").alias(f"size_{side}"))
    differ = sum((F.bit_count(F.col("parts_a")[k].bitwiseXOR(F.col("parts_b")[k])) for k in range(PARTS)), F.lit(0))
    fits = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")
    return pairs.join(own("a"), "a").join(own("b"), "b").where(fits & (differ <= radius(64 * PARTS))).select("a", "b")


def texts_of(nodes: DataFrame, prints: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``node, t``: the text of each node, once."""
    known = prints.select("h1", "h2", "node").join(nodes.distinct(), "node")
    private = docs.select(*[c.alias(n) for n, c in text_hashes(text).items()], utf8(F.col(f"`{text}`")).alias("t"))
    return private.join(known, ["h1", "h2"]).groupBy("node").agg(F.min("t").alias("t"))


def similar(pairs: DataFrame, prints: DataFrame, docs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Those of the pairs of nodes ``a, b`` whose texts' shingles have that Jaccard similarity at least, exactly."""
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), prints, docs, text)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            good, last, x = [], None, set()
            for a, s, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:
                    last, x = a, shingles(s, words)
                y = shingles(t, words)
                both = len(x & y)
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("t").alias("s"))
    right = texts.select(F.col("node").alias("b"), "t")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "s", "t").mapInArrow(check, "a long, b long")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes (different within each list entry) every two of the left and the right share."""
    n, m = len(left), len(right)
    sizes = [len(x) for x in (*left, *right)]
    every, who = np.concatenate([*left, *right]), np.repeat(np.arange(n + m), sizes)
    order = np.argsort(every, kind="stable")  # within equal hashes: the left ones first
    every, who = every[order], who[order]
    begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    of_left = np.add.reduceat((who < n).astype(np.int64), begin) if len(begin) else begin
    of_right = np.diff(np.r_[begin, len(every)]) - of_left
    out = np.zeros(n * m, np.int64)
    shared = of_left * of_right
    rare = np.flatnonzero((shared > 0) & (shared <= RARE))
    for k in range(0, len(rare), 1 << 14):  # each pair of each rare hash
        at = rare[k : k + (1 << 14)]
        times = shared[at]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        run, width = np.repeat(begin[at], times), np.repeat(of_right[at], times)
        a = who[run + inside // width]
        b = who[run + np.repeat(of_left[at], times) + inside % width] - n
        out += np.bincount(a * m + b, minlength=n * m)
    out = out.reshape(n, m)
    often = np.flatnonzero(shared > RARE)
    for k in range(0, len(often), 512):  # frequent hashes as columns of ones
        at = often[k : k + 512]
        ones = np.zeros((n + m, len(at)), np.float32)
        for c, h in enumerate(at.tolist()):
            ones[who[begin[h] : begin[h] + of_left[h] + of_right[h]], c] = 1
        out += (ones[:n] @ ones[n:].T).astype(np.int64)
    return out


def crowded(groups: DataFrame, prints: DataFrame, docs: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Links ``a, b`` that join what the exact similarities within each group (``group, side, node, component``) join."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        tokens.forget()
        now, held = None, ([], [])

        def end() -> pa.RecordBatch:
            left, right = held
            both = common([x for _, _, x in left], [x for _, _, x in right])
            (na, ca, sa), (nb, cb, sb) = ([np.array(v, np.int64) for v in ([t[0] for t in s], [t[1] for t in s], [len(t[2]) for t in s])] for s in held)
            good = (both >= similarity * (sa[:, None] + sb[None] - both)) & (ca[:, None] != cb[None])
            i, j = np.nonzero(good)
            ids, at = np.unique(np.r_[na[i], nb[j]], return_inverse=True)
            root = roots(len(ids), at[: len(i)], at[len(i) :])
            return pa.RecordBatch.from_arrays([pa.array(ids[root]), pa.array(ids)], names=["a", "b"])

        for b in batches:
            for group, side, node, component, t in zip(*(c.to_pylist() for c in b.columns)):
                if group != now and (held[0] or held[1]):
                    yield end()
                    held = ([], [])
                now = group
                held[side].append((node, component, np.array([xxh64_intdigest(x, SEED) for x in shingles(t, words)], np.uint64)))
        if held[0] or held[1]:
            yield end()
        held = ([], [])
        tokens.trim()

    texts = texts_of(groups.select("node"), prints, docs, text)
    met = groups.join(texts, "node").select("group", "side", "node", "component", "t")
    return met.repartition("group").sortWithinPartitions("group", "side").mapInArrow(check, "a long, b long").where("a <> b").distinct()


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``key, __r1, __r2, first, h1, h2, node`` of every document, and ``node, component`` of the nodes linked by similar texts.

    ``__r1`` and ``__r2`` stand for the row, ``h1`` and ``h2`` for the text (128
    bits each), ``first`` are 64 bits of the fingerprint; a node is a number
    that each different text is given, -1 for all without words (null and
    empty texts among them). So thousands of copies cost what one does, and
    repeated rows and keys are rows of their own. An empty table gives two.
    """

    def make():
        tokens.forget()

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([wide(x.as_py(), words) for x in b.column(0)], pa.list_(pa.int64()))]

        return f

    own = {**row_hashes(docs), **text_hashes(text)}
    base = docs.select(F.col(f"`{key}`").alias("key"), *[c.alias(n) for n, c in own.items()], F.col(f"`{text}`").alias("__text"))
    marked = add_columns(base, {"bytes": utf8(F.col("__text"))}, [T.StructField("parts", T.ArrayType(T.LongType()))], make).drop("__text")
    kept = stored(marked.withColumns({"size": F.col("parts")[0], "parts": F.slice("parts", 2, PARTS)}))
    prints = kept.where(F.col("parts").isNotNull()).groupBy("h1", "h2").agg(F.min("parts").alias("parts"), F.min("size").alias("size"))
    prints = stored(prints.withColumn("node", F.monotonically_increasing_id()))  # given once and written with them
    bits, tables, radius = samples(prints.count(), similarity)
    # Most of a family of copies is linked by a few segments; then all pairs of all segments that are still apart are looked at.
    alone = prints.withColumn("component", F.col("node"))
    linked = cut(similar(cut(closer(chains(alone, bits, radius, similarity), prints, similarity, radius)), prints, docs, text, words, similarity))
    part = components(linked)
    apart = stored(prints.join(part, "node", "left").withColumn("component", F.coalesce("component", "node")))
    few, crowds = meetings(apart, similarity, bits, tables, radius)
    more = similar(cut(closer(few, prints, similarity, radius)), prints, docs, text, words, similarity)
    part = components(linked.unionByName(more).unionByName(crowded(crowds, prints, docs, text, words, similarity)))
    rows = kept.join(prints.select("h1", "h2", "node"), ["h1", "h2"], "left")
    return rows.select("key", "__r1", "__r2", F.coalesce(F.col("parts")[0], F.lit(0).cast("long")).alias("first"), "h1", "h2", F.coalesce("node", F.lit(-1).cast("long")).alias("node")), part


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each component of ``copies`` one stays, whole.

    It is the row with the least key (null last), then fingerprint, text hash
    and row hash: rows that share a key, or have none, are documents of their
    own, and each component keeps exactly one. Null, empty and wordless texts
    are one component. Columns keep their names, whatever they are; an empty
    table gives an empty one.
    """
    order = F.struct(F.col("key").isNull(), "key", "first", "h1", "h2", "__r1", "__r2")
    rows, part = copies(docs, key, text, words, similarity)
    least = rows.groupBy("node").agg(F.min(order).alias("o")).join(part, "node", "left")
    stay = least.groupBy(F.coalesce("component", "node")).agg(F.min("o").alias("o")).select("o.__r1", "o.__r2")
    # Repeated rows become one in each task before any text is moved; the join (each row of it once) finds them where they are.
    private, _, own = renamed(docs)
    marked = private.withColumns(row_hashes(private)).dropDuplicates(["__r1", "__r2"])
    return own(marked.join(stay, ["__r1", "__r2"]))


def hexadecimal(x: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))
