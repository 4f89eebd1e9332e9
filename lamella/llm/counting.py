"""Token counts that follow edits without encoding a document anew."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import add_columns

#: Runs between white space (a few pre-tokens each) in one leaf; a leaf splits at four times that.
LEAF = 32
#: Children of a node.
FAN = 8
#: One edit: ``length`` code points from ``start`` on become ``text``; positions are those after the edits before it.
EDIT = T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("text", T.StringType())]
)
#: White space and the run that follows it.
RUN = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")


def leaves_of(text: str) -> list[str]:
    runs = RUN.findall(text)
    return ["".join(runs[i : i + LEAF]) for i in range(0, len(runs), LEAF)] or [""]


class Sums:
    """Sums over a list of numbers, kept in a tree of nodes with ``FAN`` children."""

    def __init__(self, values: list[int]):
        self.levels = [values]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([sum(below[i : i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def total(self) -> int:
        return self.levels[-1][0]

    def set(self, i: int, value: int) -> None:
        more = value - self.levels[0][i]
        for level in self.levels if more else ():
            level[i] += more
            i //= FAN

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds position ``at`` (the last one if none does), and the sum before it."""
        i, before = 0, 0
        for level in reversed(self.levels[:-1]):
            i *= FAN
            last = min(i + FAN, len(level)) - 1
            while i < last and before + level[i] <= at:
                before += level[i]
                i += 1
        return i, before


class Tree:
    """A document's leaves of whole runs, with the sums of their code points and tokens.

    Leaves begin with white space, which no pre-token spans, so a leaf has the
    tokens that it has within the whole text.
    """

    def __init__(self, text: str, chars: list[int], counts: list[int], encode: tokens.Encoder):
        self.encode, self.encoded = encode, 0
        self.leaves, at = [], 0
        for n in chars:
            self.leaves.append(text[at : at + n])
            at += n
        self.chars, self.tokens = Sums(list(chars)), Sums(list(counts))

    def counts(self, leaves: list[str]) -> list[int]:
        self.encoded += sum(map(len, leaves))
        return self.encode.counts(leaves)

    def edit(self, start: int, length: int, text: str) -> None:
        """Re-encodes the leaves that hold the edited span or the code point on either side of it."""
        size = self.chars.total
        start = min(max(start, 0), size)
        end = min(start + max(length, 0), size)
        i, before = self.chars.find(max(start - 1, 0))
        j, _ = self.chars.find(end)
        old = "".join(self.leaves[i : j + 1])
        new = old[: start - before] + text + old[end - before :]
        fresh = leaves_of(new)
        if len(fresh) <= max(4, j + 1 - i):  # the first leaf takes all, the others are empty from now on
            fresh = [new] + [""] * (j - i)
        counts = self.counts(fresh)
        self.leaves[i : j + 1] = fresh
        if len(fresh) == j + 1 - i:
            for k, (x, n) in enumerate(zip(fresh, counts), i):
                self.chars.set(k, len(x))
                self.tokens.set(k, n)
        else:  # more leaves: the sums move, nothing else is encoded
            c, t = self.chars.levels[0], self.tokens.levels[0]
            c[i : j + 1], t[i : j + 1] = map(len, fresh), counts
            self.chars, self.tokens = Sums(c), Sums(t)


NUMBERS = T.ArrayType(T.IntegerType())


def checked(path: str | None) -> str:
    """The tokenizer's path, if its pre-tokens end at white space: leaves of another kind could not be counted apart."""
    path = path or tokens.default_path()
    if not tokens.chunkable(path):
        raise ValueError(f"{path} has pre-tokens that span white space")
    return path


def plant(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Append each document's tree: ``leaf_chars``, ``leaf_tokens`` and their sum ``n_tokens``.

    Null text counts as empty, which has one empty leaf and no tokens. Repeated
    rows are documents of their own; an empty table gives no rows. Columns of
    ``docs`` with those names are replaced, all others pass through.
    """
    path = checked(path)

    def make():
        encode = tokens.encoder(path)

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            chars, counts = [], []
            for x in b.column(0):
                leaves = leaves_of(x.as_py())
                chars.append([len(v) for v in leaves])
                counts.append(encode.counts(leaves))
            return [pa.array(chars, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(map(sum, counts), pa.int64())]

        return f

    fields = [T.StructField("leaf_chars", NUMBERS), T.StructField("leaf_tokens", NUMBERS), T.StructField("n_tokens", T.LongType())]
    return add_columns(docs, {"text": F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))}, fields, make)


def apply_edits(trees: DataFrame, edits: Column, text: str = "text", path: str | None = None) -> DataFrame:
    """Apply each document's ``edits`` (an array of ``EDIT``, in order) to its text and tree.

    Replaces ``text, leaf_chars, leaf_tokens, n_tokens`` by those after the
    edits and appends ``n_edits`` and ``chars_encoded``, the code points that
    had to be encoded: the touched leaves, not the document. Spans beyond the
    text are clipped to it; null starts and lengths count as 0, null texts and
    edit lists as empty. Documents don't depend on each other: nothing is
    shuffled, and a task holds one document at a time.
    """
    path = checked(path)

    def make():
        encode = tokens.encoder(path)

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            out: list[list] = [[] for _ in range(6)]
            for old, chars, counts, changes in zip(*b.columns):
                tree = Tree(old.as_py(), chars.as_py() or [0], counts.as_py() or [0], encode)
                todo = [c for c in changes.as_py() or [] if c is not None]
                for c in todo:
                    tree.edit(c["start"] or 0, c["length"] or 0, c["text"] or "")
                row = ("".join(tree.leaves), tree.chars.levels[0], tree.tokens.levels[0], tree.tokens.total, len(todo), tree.encoded)
                for o, v in zip(out, row):
                    o.append(v)
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64())
            return [pa.array(o, k) for o, k in zip(out, kinds)]

        return f

    fields = [
        T.StructField(text, T.StringType()),
        T.StructField("leaf_chars", NUMBERS),
        T.StructField("leaf_tokens", NUMBERS),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_edits", T.LongType()),
        T.StructField("chars_encoded", T.LongType()),
    ]
    inputs = {
        "text": F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")),
        "chars": F.col("leaf_chars"),
        "tokens": F.col("leaf_tokens"),
        "edits": edits.cast(T.ArrayType(EDIT)),
    }
    return add_columns(trees, inputs, fields, make)
