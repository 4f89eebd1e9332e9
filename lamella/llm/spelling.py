"""Spelling variants: words one edit apart, found by Levenshtein automata over compact trie shards.

The vocabulary grows with the corpus, so its shards are not broadcast: each is
a bounded range of the sorted words, built into a trie by the task that holds
it, and only the words whose automaton can accept something in it are sent
there. A word of length l is sent twice: an edit after its first half leaves
that half as it is, so the neighbours lie where it points to among the words;
an edit within it leaves the second half, which points to them among the
reversed words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import buffer_of, cut, letters, runs, stored, utf8

#: Latin-1 bytes of words: A-Z and a-z, and U+00C0 to U+00FF.
TABLE = letters(lambda c: 97 <= c <= 122 or c >= 192)
#: Least code points and occurrences of a word, and how often its form occurs more than the word.
LENGTH, TIMES, RATIO = 7, 2, 10
#: One of so many (document, run) pairs loses a code point.
SLIP = 31
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Words of a shard.
SHARD = 20_000
#: Rows that a task returns at once.
ROWS = 20_000


def slipped(key: str, run: bytes, base: int) -> bytes:
    """The Latin-1 run of a document, less one code point where the hash says so; ``base`` is the crc32 of ``<key>:``."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, key: str, text: str, length: int, times: int) -> DataFrame:
    """``word, n``: the words of all whole texts with their occurrences."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            data, at = buffer_of(b.column(1))
            for i, k in enumerate(b.column(0).to_pylist()):
                own: Counter[bytes] = Counter()
                latin = bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace").encode("latin-1", "replace")  # others become ?
                for part in runs(latin, TABLE):
                    own.update(part)
                base = crc32(f"{k or ''}:".encode())
                for run, n in own.items():
                    if len(run) >= length:
                        word = slipped(k, run, base)
                        if len(word) >= length:
                            held[word] += n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        yield told()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), utf8(F.col(f"`{text}`")).alias("bytes"))
    found = rows.mapInArrow(make, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class Trie:
    """Different words as nested dictionaries by letter; a branch with one word left is that word's number, not a path."""

    def __init__(self, words: list[str]):
        self.words, self.root = words, {}
        for i, w in enumerate(words):
            node, d = self.root, 0
            while (child := node.get(w[d : d + 1])) is not None:  # "" marks an end, which different words don't share
                if isinstance(child, int):
                    child = node[w[d : d + 1]] = {self.words[child][d + 1 : d + 2]: child}
                node, d = child, d + 1
            node[w[d : d + 1]] = i

    def walk(self, node, depth: int, word: str, at: int, found: set[int]) -> None:
        """The one word, if any, that goes on from ``node`` as ``word`` goes on from ``at``."""
        while not isinstance(node, int):
            node = node.get(word[at : at + 1])
            if node is None:
                return
            depth, at = depth + 1, at + 1
        if self.words[node][depth:] == word[at:]:
            found.add(node)

    def near(self, word: str, keep: int) -> set[int]:
        """Numbers of the words that the automaton of ``word`` with exactly one edit at or after ``keep`` accepts, depth first."""
        node, i, n, found = self.root, 0, len(word), set()
        while i < keep:
            if isinstance(node, int):
                if self.words[node][:keep] == word[:keep]:
                    break
                return found
            node = node.get(word[i])
            if node is None:
                return found
            i += 1
        while not isinstance(node, int):  # the state without an edit yet; every branch off it has had its edit
            c = word[i : i + 1]
            for letter, child in node.items():
                if letter:
                    if letter != c:
                        if c:
                            self.walk(child, i + 1, word, i + 1, found)  # replaced
                        self.walk(child, i + 1, word, i, found)  # inserted
                elif i == n - 1:
                    found.add(child)  # the last letter deleted
            if not c:
                return found
            if i + 1 < n and word[i + 1] != c:
                self.walk(node, i, word, i + 1, found)  # deleted; within a run of equal letters the last stands for all
            node = node.get(c)
            if node is None:
                return found
            i += 1
        other = self.words[node]
        p, least = keep, min(n, len(other))
        while p < least and word[p] == other[p]:
            p += 1
        if other != word and abs(n - len(other)) <= 1:
            if word[p + (n >= len(other)) :] == other[p + (n <= len(other)) :]:
                found.add(node)
        return found


def neighbours(words: DataFrame, size: int, backward: bool) -> DataFrame:
    """``word, n_near, near_n, near``: how many neighbours each word has on one side, the most frequent and its occurrences.

    Forward, those that share the word's first half (its length // 2 letters);
    backward, on reversed words, those that don't. Together each once.
    """
    parts = max(-(-size // SHARD), 1)
    spelt = F.reverse("word") if backward else F.col("word")
    dealt = stored(words.select(spelt.alias("word"), "n").repartitionByRange(parts, "word").withColumn("shard", F.spark_partition_id()))
    ends = dealt.groupBy("shard").agg(F.min("word"), F.max("word")).orderBy("shard").collect()  # a row for ``SHARD`` words
    shards, firsts, lasts = ([r[i] for r in ends] for i in range(3))
    half = lambda w: len(w) - len(w) // 2 if backward else len(w) // 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, shard = [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                head = w[: half(w)]
                for s in range(bisect_left(lasts, head), bisect_right(firsts, head + "\U0010ffff")):
                    which.append(i)
                    shard.append(shards[s])
            asked = b.take(pa.array(which, pa.int64()))
            for part, at, query in ((b, b.column(2), False), (asked, pa.array(shard, pa.int32()), True)):
                yield pa.RecordBatch.from_arrays([at, pa.array([query] * len(part), pa.bool_()), part.column(0), part.column(1)], names=["shard", "query", "word", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words, counts, trie, out = None, [], [], None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n_near", "near_n", "near"])

        for b in batches:
            for s, query, w, n in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    shard, words, counts, trie = s, [], [], None
                if not query:
                    words.append(w)
                    counts.append(n)
                    continue
                trie = trie or Trie(words)
                found = trie.near(w, half(w))
                if backward and found:
                    own = w[half(w) :]
                    found = {x for x in found if words[x][-len(own) :] != own}
                if found:
                    most = max(counts[x] for x in found)
                    names = [words[x][::-1] if backward else words[x] for x in found if counts[x] == most]
                    out.append((w[::-1] if backward else w, len(found), most, min(names)))
            if len(out) > ROWS:
                yield told()
                out.clear()
        yield told()

    routed = dealt.mapInArrow(send, "shard int, query boolean, word string, n long")
    together = routed.repartition(parts, "shard").sortWithinPartitions("shard", "query", "word")
    return together.mapInArrow(meet, "word string, n_near long, near_n long, near string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to their last, twice as far each round (their counts grow tenfold a step)."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        step = cut(now.join(on, F.col("root") == F.col("__word"), "left"))
        now = step.select("word", F.coalesce("__root", "root").alias("root"))
        if step.where(F.col("__root").isNotNull()).isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the texts, how many words are one edit from it, and its form.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of
    ``length`` code points and ``times`` occurrences at least, after one of
    ``SLIP`` (document, run) pairs has lost a code point as its hash says. The
    form is the most frequent word one edit away (ties: the first by code
    points), if it occurs ``ratio`` times as often; ``root`` follows forms to
    the last. Null, empty and wordless texts have no words; a null key counts as an
    empty text in the hash; repeated rows count each; an empty table gives no
    rows; other columns are not looked at.
    """
    words = stored(counted(docs, key, text, length, times))
    size = words.count()
    sides = [neighbours(words, size, backward) for backward in (False, True)]
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = sides[0].unionByName(sides[1]).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    known = words.join(near, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    told = stored(
        known.select(
            "word",
            F.when(often, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(told.where(F.col("form").isNotNull()))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
