"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import add_columns, buffer_of, lowest, steps, utf8

#: Context length in bytes at most.
ORDER = 3
#: Texts per language that statistics are taken from, the first by hash; a documented bound on the training sample.
SAMPLE = 600
#: Bytes of those texts together, and of one of them, at most; bounds on the training sample, too.
SAMPLE_BYTES, LONGEST = 16 << 20, 1 << 18
UNKNOWN = "und"
#: Bits beyond those of its own bytes that the code of a text in a learned language may have.
SLACK = 128.0
#: Bytes scored at once, of one long text or of many.
BLOCK = 1 << 20


class Model:
    """Frozen context trees of all languages over one set of contexts.

    ``rows`` maps the last three byte classes to the longest context that any
    language has seen; ``bits[row, class]`` holds each language's exact code
    length of a byte there: -log2 of its count over n + t in the longest
    context where that language saw it, plus -log2(t / (n + t)) for each
    longer context of that language escaped from (n bytes, t different ones);
    8 bits where no context knows the byte. Bytes that no language has seen
    share one class, which has the same code length everywhere.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        seen = np.zeros(256, bool)
        for t in texts.values():
            for x in t:
                seen[np.unique(np.frombuffer(x, np.uint8))] = True
        m = int(seen.sum())
        self.classes = np.full(256, m, np.uint8 if m < 256 else np.int32)
        self.classes[seen] = np.arange(m)
        self.size = size = m + 1
        parts = {lang: self.coded([np.frombuffer(x, np.uint8) for x in t]) for lang, t in texts.items()}
        n = len(self.langs)
        self.rows = np.zeros(size**ORDER, np.int32)
        bits = [np.full((1, size, n), 8.0, np.float32)]
        above = {0: 0}  # the context's row in the order below; order 0 has the empty context
        done = 1
        for order in range(ORDER + 1):
            grams = {lang: np.unique(self.keys(x, order), return_counts=True) for lang, x in parts.items()}
            contexts = np.unique(np.concatenate([k // size for k, _ in grams.values()] or [np.zeros(0, np.int64)]))
            parents = (
                np.zeros(len(contexts), np.int64)
                if order == 0
                else np.array([above.get(int(c), 0) for c in contexts % size ** (order - 1)], np.int64)
            )
            table = np.concatenate(bits)[parents] if len(contexts) else np.zeros((0, size, n), np.float32)
            for j, lang in enumerate(self.langs):
                keys, counts = grams[lang]
                at, symbol = np.searchsorted(contexts, keys // size), keys % size
                total = np.bincount(at, counts, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                own = kinds > 0
                table[own, :, j] += -np.log2(kinds[own] / (total + kinds)[own])[:, None]
                table[at, symbol, j] = -np.log2(counts / (total + kinds)[at])
            above = {int(c): done + i for i, c in enumerate(contexts)}
            if order:
                # later orders overwrite: every longer context that ends like this one starts from it
                spread = self.rows.reshape([size] * ORDER)
                flat = spread.reshape(size ** (ORDER - order), -1)
                flat[:, contexts] = done + np.arange(len(contexts))
            elif len(contexts):
                self.rows[:] = done
            bits.append(table)
            done += len(contexts)
        self.bits = np.concatenate(bits)

    def coded(self, texts: list[np.ndarray]) -> np.ndarray:
        """Classes of all texts, with ``ORDER`` bytes of the unseen class before each."""
        out = np.full(sum(map(len, texts)) + ORDER * len(texts), self.size - 1, np.int64)
        at = 0
        for x in texts:
            at += ORDER
            out[at : at + len(x)] = self.classes[x]
            at += len(x)
        return out

    def keys(self, x: np.ndarray, order: int) -> np.ndarray:
        """Numbers of the (context, byte) pairs in ``x`` that hold no byte of the unseen class."""
        n = max(len(x) - order, 0)
        key, good = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(order + 1):
            part = x[i : i + n]
            key = key * self.size + part
            good &= part != self.size - 1
        return key[good]

    def lengths(self, texts: list[np.ndarray]) -> np.ndarray:
        """Code length in bits of every text (rows) under every language."""
        x, s = self.coded(texts).astype(np.int32), self.size
        flat = self.bits.reshape(-1, len(self.langs))
        ends = np.cumsum([len(t) + ORDER for t in texts]) - ORDER  # of the texts, in positions of x[ORDER:]
        begins = ends - [len(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        first = 0
        for a in range(0, len(x) - ORDER, BLOCK):
            y = x[a : a + BLOCK + ORDER]
            row = self.rows[(y[:-3] * s + y[1:-2]) * s + y[2:-1]]
            each = flat[row.astype(np.int64) * s + y[3:]]
            i = first
            while i < len(texts) and begins[i] < a + BLOCK:
                out[i] += each[max(begins[i] - a, 0) : ends[i] - a].sum(axis=0, dtype=np.float64)
                first = i if ends[i] > a + BLOCK else i + 1
                i += 1
        return out

    def __call__(self, texts: list[np.ndarray]) -> tuple[list[str], list[float], list[bool]]:
        """The language with the shortest code, its share of 2^-length, and whether that code is no longer than the text itself."""
        bits = self.lengths(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        odds = np.exp2(np.maximum(least[:, None] - bits, -1000.0))
        fits = least <= 8.0 * np.array([len(t) for t in texts]) + SLACK
        return [self.langs[i] for i in best], (1 / odds.sum(axis=1)).tolist(), fits.tolist()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Statistics of every language from ``sample`` different whole texts each (all, if it has fewer).

    The texts are those whose hash with their key is lowest, so rows that share
    a key, or have none, are told apart and repeated rows teach once. Of those,
    as many as ``SAMPLE_BYTES`` hold; texts over ``LONGEST`` bytes teach
    nothing. Rows without text or language are no training rows. Without any
    there is no model.
    """
    from pyspark.sql import Window as W

    rows = docs.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"),
    )
    size = F.octet_length("text")
    rows = rows.where(F.col("lang").isNotNull() & (size > 0) & (size <= LONGEST))
    # Only hashes are ranked; the texts of the few that remain are read by them. The languages are those of the model.
    picked = lowest(rows.select("lang", "h"), sample, ["lang"])
    few = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    held = few.withColumn("__sum", F.sum(size).over(W.partitionBy("lang").orderBy("h"))).where(F.col("__sum") <= SAMPLE_BYTES)
    texts: dict[str, list[bytes]] = {}
    for name, t in held.sort("h").select("lang", utf8(F.lower("text"))).collect():
        texts.setdefault(name, []).append(bytes(t))
    return Model(texts) if texts else None


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``score`` (the share of 2^-code length that it holds) and ``fits`` to every document.

    Whole texts, in lower case, are scored under every language; the shortest
    code wins, ties by name. ``fits`` says whether that code is no longer
    than the text's own bytes (and ``SLACK``): texts of a learned language have
    2 or 3 bits a byte, others and gibberish over 8. Null text, text without a letter,
    and any text without a model get ``und`` and score 0 and don't fit. Every row stays, repeated ones and
    those without a key too; an empty table gives none. Columns with those
    names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    lettered: Column = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False))

    def make():
        m: Model | None = held.value
        tokens.forget()

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            data, at = buffer_of(b.column(0))
            names, scores, fits = [], [], []
            for i, j in steps(at, BLOCK):
                if m is None:
                    got = ([UNKNOWN] * (j - i), [0.0] * (j - i), [False] * (j - i))
                else:
                    got = m([np.frombuffer(data[at[k] : at[k + 1]], np.uint8) for k in range(i, j)])
                names += got[0]
                scores += got[1]
                fits += got[2]
            ok = b.column(1).to_pylist()
            return [
                pa.array([n if o else UNKNOWN for n, o in zip(names, ok)], pa.string()),
                pa.array([s if o else 0.0 for s, o in zip(scores, ok)], pa.float64()),
                pa.array([x and o for x, o in zip(fits, ok)], pa.bool_()),
            ]

        return f

    return add_columns(
        docs,
        {"bytes": utf8(F.lower(F.col(f"`{text}`"))), "lettered": lettered},
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())],
        make,
    )
