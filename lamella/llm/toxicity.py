"""Toxicity by a lexicon, matched by Levenshtein automata over a trie, and the context of each match."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import add_columns, cut, lowest

#: Labelled texts that the lexicon and the weights are learned from, the first by hash; a documented bound.
SAMPLE = 6000
#: A term is in this share and this many of the toxic sample texts at least, and so many times likelier there than elsewhere.
SHARE, LEAST, RATIO = 0.01, 5, 25.0
#: A stem counts in a text only if so many different words begin with it, and is in so many of those texts at least.
KINDS, STEM_LEAST = 2, 4
#: Terms at most, the most telling first: a bound on the model, not on what is scored.
TERMS = 500
#: Letters of a stem; a stem also matches the words that it begins.
STEM = (4, 9)
#: Letters from which one and two typing errors are forgiven.
ONE, TWO = 5, 9
#: Words on either side of a match that tell quotation from abuse.
WINDOW = 8
LETTERS = re.compile(r"[^\W_]+", re.UNICODE)
#: Words with signs between or before letters: looked up whole besides their parts (``*`` and ``_`` are errors, the others look-alikes).
DISGUISED = re.compile(r"(?<![^\W_])(?:[^\W_]++[@$!*_]++|[@$!]++)[^\W_]++(?:[@$!*_]++[^\W_]++)*+", re.UNICODE)
SIGN = re.compile(r"[@$!*_][^\W_]", re.UNICODE)
#: Kinds of matches, the surest first: of a disguised word and its parts the surer counts.
SURER = (0, 1, 4, 2, 3, 5)
#: Marks of quotation, and look-alikes of letters in disguised words.
QUOTES = "\"'«»„“”‘’`"
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Words of a report or a discussion of words, in the languages of the corpus; the default of a parameter.
REPORTS = frozenset("said says called quote quoted word term insult dijo dice palabra dit mot appelé sagte wort nannte".split())
FEATURES = 12
#: Automaton states, and letters of words, that a worker remembers at most; beyond that it begins anew.
STATES, LETTERS_KNOWN = 50_000, 1_500_000
#: Words with more letters are matched, but not remembered.
LONG_WORD = 64


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie.

    A state is the set of (trie node, errors so far) that the letters read may
    stand for. A term of fewer than ``ONE`` letters forgives no error, of fewer
    than ``TWO`` one, else two; nodes remember the most that a term below them
    forgives. Deterministic states are made when first reached and kept, so a
    word costs a lookup for each letter until it can't match any more, or until
    nothing but a stem that has been read is left.
    """

    WON = -1  # the node of a stem that has been read: the rest of the word is free

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.bound, self.ends, self.stems = [0], set(), set()
        for terms, ends in ((words, self.ends), (stems, self.stems)):
            for term in terms:
                most, node = (len(term) >= ONE) + (len(term) >= TWO), 0
                self.bound[0] = max(self.bound[0], most)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.bound.append(0)
                    node = self.children[node][c]
                    self.bound[node] = max(self.bound[node], most)
                ends.add((node, most))
        self.letters = frozenset(c for d in self.children for c in d)
        self.states: dict[frozenset, tuple[dict, tuple[int, bool]]] = {}
        self.start = self.closed({0: 0})

    def closed(self, at: dict[int, int]) -> tuple[dict, tuple[int, bool]] | None:
        """The state of the nodes in ``at`` and those reached by leaving out letters of terms; None if there are none."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if node == self.WON or at.get(node, 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.bound[child] and e + 1 < at.get(child, 9):
                    at[child] = e + 1
                    todo.append((child, e + 1))
        for node, most in self.stems:
            if at.get(node, 9) <= most:
                at[self.WON] = min(at.get(self.WON, 9), at[node])
        if not at:
            return None
        key = frozenset(at.items())
        if key not in self.states:
            good = [(at[n], False) for n, most in self.ends if at.get(n, 9) <= most]
            self.states[key] = ({"": at}, min([*good, (at.get(self.WON, 9), True)]))
        return self.states[key]

    def next(self, state: tuple[dict, tuple[int, bool]], c: str) -> tuple[dict, tuple[int, bool]] | None:
        at: dict[int, int] = {}
        for node, e in state[0][""].items():
            if node == self.WON:
                moves = [(node, e)]
            else:
                moves = [(child, e + (x != c)) for x, child in self.children[node].items()] + [(node, e + 1)]
            for n, cost in moves:
                if cost <= (9 if n == self.WON else self.bound[n]) and cost < at.get(n, 9):
                    at[n] = cost
        return self.closed(at)

    def find(self, word: str) -> tuple[int, bool] | None:
        """The fewest errors with which ``word`` is a term or (True, if no term has as few) goes on from a stem."""
        if len(self.states) > STATES:
            self.states.clear()
            self.start = self.closed({0: 0})
        state = self.start
        for c in word:
            c = c if c in self.letters else "?"
            go = state[0]
            if c not in go:
                go[c] = self.next(state, c)
            state = go[c]
            if state is None:
                return None
            if len(go[""]) == 1 and self.WON in go[""]:
                break  # a stem has been read and nothing else is left: no further letter matters
        return state[1] if state[1][0] < 9 else None


class Lexicon:
    """Matches of words, remembered as corpora repeat their words."""

    def __init__(self, words: list[str], stems: list[str], reports: Iterable[str] = REPORTS):
        self.automaton = Automaton(words, stems)
        self.empty = not words and not stems
        self.reports = frozenset(reports)
        self.known: dict[str, int] = {}
        self.letters = 0

    def match(self, word: str) -> int:
        """0 for no match, 1 for an exact one, 2 or 3 for one or two errors or look-alikes of letters, 4 for a stem as it is, 5 for one with those."""
        if self.empty or len(word) < 3:
            return 0
        plain = word.translate(LOOKALIKES)
        errors, stem = self.automaton.find(plain) or (9, True)
        if stem:
            return 0 if errors == 9 else 4 if errors == 0 and plain == word else 5
        return max(errors + 1, 1 if plain == word else 2)

    def kinds(self, words: set[str]) -> dict[str, int]:
        """The words among ``words`` that match."""
        known = self.known
        if self.letters > LETTERS_KNOWN:
            known.clear()
            self.letters = 0
        out = {}
        for w in words:
            kind = known.get(w)
            if kind is None:
                kind = self.match(w)
                if len(w) <= LONG_WORD:
                    known[w] = kind
                    self.letters += len(w)
            if kind:
                out[w] = kind
        return out


def unmasked(low: str, spans: list[tuple[int, re.Match]], whole: list[re.Match], hits: dict[str, int]) -> list[tuple[int, re.Match]]:
    """The matches ``spans`` (number of the word, place) with those of disguised words in place of less sure ones of their parts."""
    out, at = [], 0
    begins = [m.start() for m in LETTERS.finditer(low)]
    for m in whole:
        while at < len(spans) and spans[at][1].start() < m.start():
            out.append(spans[at])
            at += 1
        parts = at
        while at < len(spans) and spans[at][1].start() < m.end():
            at += 1
        inside = spans[parts:at]
        if all(SURER.index(hits[m.group()]) < SURER.index(hits[p.group()]) for _, p in inside):
            out.append((bisect_left(begins, m.start()), m))
        else:
            out += inside
    return out + spans[at:]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Counts and shares of exact and of misspelled terms, each apart for quotation and abuse, and the text's size."""
    low = text.lower()
    words = LETTERS.findall(low)
    disguised = list(DISGUISED.finditer(low)) if SIGN.search(low) else []
    hits = lexicon.kinds({*words, *(m.group() for m in disguised)})
    n = max(len(words), 1)
    kinds = [0, 0, 0, 0, 0]  # exact, one error, two errors, stems, quoted
    bent = 0  # stems with errors or look-alikes
    distinct: set[str] = set()
    if hits:
        spans = [(i, m) for i, m in enumerate(LETTERS.finditer(low)) if m.group() in hits]
        whole = [m for m in disguised if m.group() in hits]
        spans = unmasked(low, spans, whole, hits) if whole else spans
        for i, m in spans:
            near = low[max(m.start() - 2, 0) : m.start()], low[m.end() : m.end() + 2]
            told = lexicon.reports.intersection(words[max(i - WINDOW, 0) : i + WINDOW])
            if all(any(q in side for q in QUOTES) for side in near) or told:
                kinds[4] += 1
            elif hits[m.group()] == 5:
                bent += 1
            else:
                kinds[hits[m.group()] - 1] += 1
            distinct.add(m.group())
    sure = kinds[0] + kinds[1] + kinds[2]
    return [
        *np.log1p(kinds), float(kinds[0] > 0), float(kinds[1] + kinds[2] > 0), np.log1p(len(distinct)),
        np.log1p(1000 * sure / n), np.log1p(1000 * kinds[3] / n), np.log1p(n), np.log1p(bent),
    ]


class Model:
    """A lexicon and logistic weights over ``features``."""

    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray | None = None, reports: Iterable[str] = REPORTS):
        self.words, self.stems, self.weights, self.reports = words, stems, weights, frozenset(reports)
        self.lexicon = Lexicon(words, stems, self.reports)

    def __reduce__(self):
        return Model, (self.words, self.stems, self.weights, self.reports)

    def fit(self, x: np.ndarray, toxic: np.ndarray) -> None:
        x = np.column_stack([x, np.ones(len(x))])
        w = np.zeros(FEATURES + 1)
        for _ in range(30):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (p - toxic) + 0.5 * w)
        self.weights = w

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        x = float(np.dot(self.weights[:-1], features(text, self.lexicon)) + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def terms_of(text: str) -> set[str]:
    """Every word of a text, and every stem that begins ``KINDS`` of its words."""
    words = set(LETTERS.findall(text.lower()))
    begin = Counter(w[:n] for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1))
    return words | {f"{s}+" for s, n in begin.items() if n >= KINDS}


def lexicon_of(texts: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that tell toxic texts from others (``text``, ``toxic``), with the counting done on Spark."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = pa.array(sorted(terms_of(text)), pa.string())
                yield pa.RecordBatch.from_arrays([got, pa.array([toxic] * len(got), pa.int32())], names=["term", "toxic"])

    sizes = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    yes, no = int(sizes[1]), int(sizes[0]) - int(sizes[1])
    if not yes or not no:
        return [], []
    counted = (
        texts.select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(split, "term string, toxic int")
        .groupBy("term")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    )
    told = (
        counted.where(F.col("a") >= F.when(F.col("term").endswith("+"), max(STEM_LEAST, SHARE * yes)).otherwise(max(LEAST, SHARE * yes)))
        .withColumn("ratio", ((F.col("a") + 0.5) / yes) / ((F.col("b") + 0.5) / no))
        .where(F.col("ratio") >= RATIO)
        .orderBy(F.desc("a"), F.desc("ratio"), "term")
        .limit(4 * TERMS)
        .collect()
    )
    # A stem stands for the words and longer stems that add little to it.
    stems: list[tuple[str, int]] = []
    for r in sorted((r for r in told if r[0].endswith("+")), key=lambda r: (len(r[0]), r[0])):
        stem = r[0][:-1]
        if not any(stem.startswith(s) and r[1] < n * 1.01 for s, n in stems):
            stems.append((stem, r[1]))
    begins = tuple(s for s, _ in stems)
    # Words that begin with a stem stay, as they forgive errors anywhere.
    words = [r[0] for r in told if not r[0].endswith("+")]
    return words[:TERMS], list(begins)[:TERMS]


def without_copies(texts: DataFrame) -> DataFrame:
    """One text of those with the same least hash of three words in a row: copies would make terms of all their words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        tokens.forget()
        for b in batches:
            least = []
            for text in b.column(0).to_pylist():
                w = text.lower().split()
                least.append(min(xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(len(w) - 2, 1))) >> 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=["text", "toxic", "least"])

    marked = texts.select("text", "toxic").mapInArrow(mark, "text string, toxic int, least long")
    return marked.groupBy("least").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("least")


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    sample: int = SAMPLE,
    reports: Iterable[str] = REPORTS,
) -> Model:
    """Learn from the ``sample`` labelled texts whose hashes with their keys are lowest (all, if there are fewer).

    ``reports`` are the words that tell a report of a term from its use. Rows
    without key, label or text teach nothing; a key labelled twice is toxic if
    one of them says so; repeated rows teach once. Without both kinds of labels,
    or terms that tell them apart, the lexicon is empty and every score 0.
    """
    known = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max((F.col(f"`{label}`") != 0).cast("int")).alias("toxic"))
    # Only hashes are ranked. Labels need not be of documents that exist, so the join comes first, without texts.
    own = F.col(f"`{text}`").cast("string")
    rows = docs.where(own.isNotNull()).select(F.col(f"`{key}`").alias("__key"), own.alias("text"), F.xxhash64(F.col(f"`{key}`"), own).alias("h"))
    picked = lowest(rows.select("__key", "h").join(known, "__key").select("h", "toxic"), sample, [])
    chosen = cut(rows.select("text", "h").join(F.broadcast(picked), "h").groupBy("h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    model = Model(*lexicon_of(without_copies(chosen)), reports=reports)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value.lexicon
        for b in batches:
            x = [[float(v) for v in features(t, lexicon)] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    # ``sample`` rows of a few numbers; sorted, so that sums don't depend on the order of tasks
    rows = sorted((list(r[0]), r[1]) for r in chosen.select("text", "toxic").mapInArrow(seen, "x array<double>, toxic int").collect())
    if len({y for _, y in rows}) == 2 and not model.lexicon.empty:
        model.fit(np.array([x for x, _ in rows]), np.array([y for _, y in rows]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every document.

    Whole texts are scored, one at a time, words of any length included; null
    text counts as empty, and an empty or wordless text gets the score of no
    match. Every row stays, repeated ones and those without a key too; an empty
    table gives none. Columns with those names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: Model = held.value
        tokens.forget()

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            got = [m.score(x.as_py()) for x in b.column(0)]
            return [pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())]

        return f

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return add_columns(docs, {"text": F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))}, fields, make)
