"""Harmonic packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tokens
from .common import steps, stored

CAPACITY = 2048
END_ID = 1
#: Unused share of a sequence at most.
SLACK = 1 / 50
#: Workers whose open bins meet in one task of the second pass.
MEET = 32
#: Rows and bytes of an output batch at most.
ROWS, BYTES = 4096, 4 << 20
SECOND = 1 << 62

Piece = tuple  # key, start, length, doc_tokens, ids


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths that a document of ``n`` tokens is cut into.

    Class k holds lengths in (capacity/(k+1), capacity/k], and a bin of it
    exactly k pieces. A rest that would leave its bins emptier than ``slack``
    gives off a head of capacity/(k+1) tokens, which fills bins of class k+1.
    """
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Bins:
    """The open bins of one worker: one for each class, together less than 2 * sqrt(capacity) * capacity tokens."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.made = capacity, {}, 0

    def put(self, piece: Piece) -> list[Piece] | None:
        """Adds a piece; returns the bin if that fills it."""
        k = self.capacity // piece[2]
        if k == 1:
            return [piece]
        b = self.open.setdefault(k, [])
        b.append(piece)
        return self.open.pop(k) if len(b) == k else None

    def rest(self) -> list[Piece]:
        return [p for _, b in sorted(self.open.items()) for p in b]


def chained(pieces: Iterable[Piece], capacity: int) -> Iterator[list[Piece]]:
    """Sequences of exactly ``capacity`` tokens from pieces cut anywhere; what is left fills sequences of powers of two."""
    pieces = list(pieces)
    total = sum(p[2] for p in pieces)
    sizes = [capacity] * (total // capacity) + [
        1 << i for i in reversed(range(capacity.bit_length())) if total % capacity >> i & 1
    ]
    at, todo = 0, iter(sizes)
    room, now = next(todo, 0), []
    for key, start, length, n, ids in pieces:
        at = 0
        while at < length:
            take = min(room, length - at)
            now.append((key, start + at, take, n, ids[4 * at : 4 * (at + take)]))
            at, room = at + take, room - take
            if room == 0:
                yield now
                room, now = next(todo, 0), []


class Rows:
    """Collects result rows and gives them as batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.bytes = schema, [[] for _ in schema], 0

    def add(self, bin_: list[Piece], sequence: int | None) -> None:
        at = 0
        for p in bin_:
            for c, v in zip(self.columns, (*p, sequence, at if sequence is not None else None)):
                c.append(v)
            at += p[2]
            self.bytes += len(p[4])

    def full(self) -> bool:
        return len(self.columns[0]) >= ROWS or self.bytes >= BYTES

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return out


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple]:
    """(key, ids) of every document, the end id last."""
    tokens.trim()  # what earlier stages left in this worker
    encode, end = tokens.encoder(path), end_id.to_bytes(4, "little")
    for b in batches:
        keys, texts = b.column(0), b.column(1)
        sizes = [0]
        for n in pc.binary_length(texts).to_pylist():
            sizes.append(sizes[-1] + n)
        for i, j in steps(sizes):
            got = encode.ids(texts.slice(i, j - i).to_pylist())
            yield from zip(keys.slice(i, j - i).to_pylist(), (x + end for x in got))


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: float = SLACK,
    path: str | None = None,
) -> DataFrame:
    """Pack all documents: ``key, start, length, doc_tokens, ids, sequence_id, offset``, one row for each piece.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit
    integers. Every task packs what it reads by itself: a bin of class k is
    done with its k-th piece, so a task holds less than one bin for each class.
    The pieces of its open bins go to a second pass, where the bins of
    ``MEET`` tasks meet; what is open there too is chained and cut at the
    capacity, and a last rest into powers of two, which need no padding.

    Null text counts as empty: such a document is its end id alone. Long texts
    become pieces of the full capacity and never meet in one bin. Repeated rows
    are documents of their own. An empty table gives no rows. Other columns of
    ``docs`` are not kept.
    """
    field = docs.schema[key]
    schema = T.StructType(
        [
            T.StructField(key, field.dataType),
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")],
            T.StructField("ids", T.BinaryType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    path = path or tokens.default_path()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        bins, out = Bins(capacity), Rows(arrow)
        rests = [cuts(n, capacity, slack) for n in range(capacity)]
        for name, ids in encoded(batches, path, end_id):
            n, start = len(ids) // 4, 0
            for length in [capacity] * (n // capacity) + rests[n % capacity]:
                done = bins.put((name, start, length, n, ids[4 * start : 4 * (start + length)]))
                start += length
                if done:
                    out.add(done, base + bins.made)
                    bins.made += 1
                    if out.full():
                        yield out.batch()
        out.add(bins.rest(), None)
        yield out.batch()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = SECOND + (TaskContext.get().partitionId() << 32)
        bins, out = Bins(capacity), Rows(arrow)
        for b in batches:
            for piece in zip(*[c.to_pylist() for c in b.columns[:5]]):
                if done := bins.put(piece):
                    out.add(done, base + bins.made)
                    bins.made += 1
            if out.full():
                yield out.batch()
        for done in chained(bins.rest(), capacity):
            out.add(done, base + bins.made)
            bins.made += 1
        yield out.batch()

    table = stored(
        docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
        .mapInArrow(first, schema)
        .withColumn("__worker", F.spark_partition_id())
    )
    workers = table.agg(F.coalesce(F.max("__worker"), F.lit(0))).first()[0] + 1
    rest = (
        table.where(F.col("sequence_id").isNull())
        .repartitionByRange(-(-workers // MEET), F.floor(F.col("__worker") / MEET))  # a task for each group of workers
        .sortWithinPartitions("__worker", F.col(f"`{key}`"), "start", "length")
        .drop("__worker")
        .mapInArrow(second, schema)
    )
    return table.where(F.col("sequence_id").isNotNull()).drop("__worker").unionByName(rest)
