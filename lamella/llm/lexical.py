"""Ranked lexical search: every item of a query set against every document, by sort-based accumulation of impacts.

Documents are dealt in ranges to tasks. A task concatenates the (item,
document, impact) triples of some hundred documents, sorts them by packed keys
with a radix sort, sums each run and keeps the best of each item in a heap, so
that only ``k`` rows an item leave it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import buffer_of, cut, letters, running, runs, stored, utf8

#: Bytes of terms: ASCII digits and letters, and all beyond ASCII.
TABLE = letters(lambda c: c >= 128 or 48 <= c <= 57 or 97 <= c <= 122)
#: (item, term) pairs of a block of items, which is what a task holds of the query set at once.
BLOCK = 200_000
#: Triples that are sorted together at most (those of a single document are never parted).
STEP = 1 << 20
#: Groups that the tasks' best rows of an item meet in before the last one, so that no task gets one row for each task.
SALTS = 64
#: Key of a document without one: after all others.
LAST = (1 << 63) - 1


def radix(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys in [0, most]: least digits first, 16 bits each, which numpy sorts by counting."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, int(most).bit_length(), 16):
        digit = (keys[order] >> shift).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item, term``: the different terms of each item; rows that share an item id are one item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffer_of(b.column(1))
            which, found = [], []
            for i in range(len(b)):
                own = set().union(*runs(bytes(data[at[i] : at[i + 1]]), TABLE))
                which += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(found, pa.binary())], names=["item", "term"])

    rows = items.select(F.col(f"`{item}`").alias("item"), utf8(F.col(f"`{text}`")).alias("bytes"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(make, f"item {kind}, term binary").distinct()


def frequencies(docs: DataFrame, key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """``doc, n, terms, counts``: all terms of each whole text counted, and how often it has those of ``number`` (from 1)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        get = number.get
        for b in batches:
            data, at = buffer_of(b.column(1))
            n, ends, found, times = [], [0], [], []
            for i in range(len(b)):
                total, own = 0, Counter()
                for part in runs(bytes(data[at[i] : at[i + 1]]), TABLE):
                    total += len(part)
                    own.update(filter(None, map(get, part)))
                n.append(total)
                found += own.keys()
                times += own.values()
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), utf8(F.col(f"`{text}`")).alias("bytes"))
    return rows.mapInArrow(make, "doc long, n long, terms array<int>, counts array<int>")


class Index:
    """Items by term, with the terms' weights; small enough for every task (``BLOCK`` pairs)."""

    def __init__(self, pairs: list[tuple[int, int]], weights: np.ndarray, docs: int, total: int, items: int):
        own = np.array(sorted(pairs), np.int64).reshape(-1, 2)  # by term, then item
        self.items = own[:, 1]
        self.many = np.bincount(own[:, 0], minlength=len(weights))
        self.start = np.cumsum(self.many) - self.many
        self.weights, self.docs, self.total, self.n = weights, docs, total, items

    def scores(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and score above 0 of these documents, whose terms end at ``ends`` (from 0)."""
        width = len(n)
        doc = np.repeat(np.arange(width), np.diff(ends))
        m = 100 - 90 + 90 * n * self.docs // max(self.total, 1)
        tf = counts.astype(np.int64)
        impact = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        many = self.many[terms]
        each = np.repeat(np.arange(len(terms)), many)
        inside = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        packed = self.items[self.start[terms][each] + inside] * width + doc[each]
        order = radix(packed, self.n * width)
        packed = packed[order]
        first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
        sums = np.add.reduceat(impact[each[order]], first) if len(first) else np.zeros(0, np.int64)
        above = sums > 0
        return packed[first][above] // width, packed[first][above] % width, sums[above]


def best(found: DataFrame, index: Index, k: int) -> DataFrame:
    """``at, doc, score``: at most ``k`` rows of each item from each task of ``found`` (``frequencies``)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(index.n)]
        least = np.zeros(index.n, np.int64)  # score of each full heap's last
        for b in batches:
            doc = b.column(0).fill_null(LAST).to_numpy()
            n = b.column(1).to_numpy()
            terms, counts = (b.column(c).flatten().to_numpy() for c in (2, 3))
            ends = np.r_[0, np.cumsum(b.column(2).value_lengths().to_numpy())].astype(np.int64)
            upto = np.r_[0, np.cumsum(index.many[terms])][ends]  # triples before each document
            i = 0
            while i < len(b):
                j = max(int(np.searchsorted(upto, upto[i] + STEP, "right")) - 1, i + 1)
                part = slice(ends[i], ends[j])
                at, who, score = index.scores(n[i:j], ends[i : j + 1] - ends[i], terms[part], counts[part])
                good = score >= least[at]
                for a, d, s in zip(at[good].tolist(), doc[i:j][who[good]].tolist(), score[good].tolist()):
                    if len(heaps[a]) < k:
                        heapq.heappush(heaps[a], (s, -d))
                    else:
                        heapq.heappushpop(heaps[a], (s, -d))
                    if len(heaps[a]) == k:
                        least[a] = heaps[a][0][0]
                i = j
        rows = [(a, None if -d == LAST else -d, s) for a, h in enumerate(heaps) for s, d in h]
        columns = list(zip(*rows)) if rows else [[], [], []]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["at", "doc", "score"])

    return found.mapInArrow(make, "at int, doc long, score long")


def rank(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item.

    Equal scores come by ascending ``key`` (an integer; null last). Null, empty
    and termless texts match nothing and are no documents for the statistics;
    repeated rows and keys are documents of their own. Rows that share an item
    id (null, too) are one item with the terms of all. Items without a match,
    and empty tables, give no rows. Other columns are not looked at.

    Items go in blocks of about ``BLOCK`` terms (one of any size, for a single
    long item), each with one pass over the texts, which keeps only the counts
    of the block's terms.
    """
    spark = docs.sparkSession
    pairs = cut(item_terms(items, item, item_text))
    sizes = running(pairs.groupBy("item").agg(F.count("*").alias("size")), [F.col("item").asc()], F.col("size"))
    blocks = cut(sizes.withColumn("block", F.floor(F.col("before") / BLOCK)).select("item", "block"))
    kind = pairs.schema["item"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for block in [r["block"] for r in blocks.select("block").distinct().orderBy("block").collect()]:  # one row for BLOCK pairs
        same = pairs.join(blocks.where(F.col("block") == block).withColumnRenamed("item", "__item"), F.col("item").eqNullSafe(F.col("__item")))
        own = same.select("item", "term").collect()  # a block
        names = sorted({r["item"] for r in own}, key=lambda x: (x is not None, x))
        place = {x: i for i, x in enumerate(names)}
        number = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in own}), 1)}
        found = stored(frequencies(docs, key, text, number))
        n, total = found.where(F.col("n") > 0).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row a term
        weights = np.zeros(len(number) + 1, np.int64)
        for r in df:
            weights[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
        index = Index([(number[bytes(r["term"])], place[r["item"]]) for r in own], weights, n, total, len(names))
        few = best(found, index, k).withColumn("salt", F.spark_partition_id() % SALTS)
        order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        for by in (("at", "salt"), ("at",)):
            few = few.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        told = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"at int, item_id {kind.simpleString()}")
        ranked = few.join(F.broadcast(told), "at")  # the items of a block
        out = out.unionByName(ranked.select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    return out
