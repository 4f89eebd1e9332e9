"""A gated recurrent language model with a class-factored output, trained by truncated backpropagation in numpy.

Frequent words are units of their own, in classes of equal size; all others
are units by their first two bytes. A step predicts the next word's class, then
a frequent word within its class by a second softmax, or any other word within
its class by its share of the class in the training tokens. Those shares, and
the number of classes' words, come from counts of the whole corpus.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import buffer_of, cut, stored, utf8

#: Blanks between words, and A-Z in lower case.
TABLE = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The token after every text; no word holds a blank.
END = b"\n"
#: Words whose counts every task holds at most; the first of them, in classes, are units of the model.
TOP, UNITS, CLASS = 200_000, 512, 64
#: Classes of other words, by their first bytes; the last is for those of all other beginnings.
HEAD, OTHERS = 2, 40
#: Width of the state, and steps of a window: gradients end there, losses are taken of every step.
WIDTH, WINDOW = 16, 16
#: Texts side by side in training: one for so many tokens of a shard, within bounds; few make more steps of a small shard.
PER_LANE, LANES = 2048, (16, 512)
#: Step length of Adagrad, and what its sums of squares begin with.
RATE, FIRST = 0.08, 1e-5
#: Each training text is met once, in one of so many rounds; between rounds the models of all shards are averaged.
ROUNDS = 4
#: Tokens of a shard in a round.
SHARD = 1_000_000
#: Tokens scored together, texts side by side in that, and steps of a window.
SCORED, SIDE, SPAN = 3_000_000, 512, 16
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Bytes whose words are told apart at once.
BLOCK = 4 << 20
#: Logits end here, so that none overflows.
HIGH = 60.0
#: Numbers in a piece of a model.
PIECE = 16_384
SEED = 11


# ---- The model, in numpy


class Model:
    """Parameters by name, and Adagrad's sums of squares beside them."""

    def __init__(self, values: dict[str, np.ndarray], squares: dict[str, np.ndarray]):
        self.values, self.squares = values, squares

    @classmethod
    def new(cls, mass: np.ndarray, words: np.ndarray, units: int, width: int) -> Model:
        """``mass`` of each class and ``words`` (classes of frequent words x ``CLASS``) are training counts: the start is their distribution."""
        rng = np.random.default_rng(SEED)
        some = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        log = lambda x: np.log(np.maximum(x, 0.5) / max(x.sum(), 1)).astype(np.float32)
        inner = np.where(words > 0, np.log(np.maximum(words, 1) / np.maximum(words.sum(axis=1, keepdims=True), 1)), -30.0)
        values = {
            "input": some(units, 3 * width, s=0.1),
            "state": some(width, 3 * width, s=width**-0.5),
            "class": some(width, len(mass), s=0.05),
            "class_bias": log(mass),
            "word": some(len(words), width, CLASS, s=0.05),
            "word_bias": inner.astype(np.float32),
        }
        return cls(values, {k: np.full(v.shape, FIRST, np.float32) for k, v in values.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for part in (self.values, self.squares) for x in part.values()])

    def like(self, flat: np.ndarray) -> Model:
        """The model of this shape whose ``flat`` is that."""
        at, out = 0, []
        for part in (self.values, self.squares):
            out.append({})
            for k, v in part.items():
                out[-1][k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
        return Model(*out)

    def forward(self, units: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each of the units (steps x lanes), from ``h``; ``keep`` is 0 where a text begins. Also what ``backward`` needs."""
        w = h.shape[1]
        # Each gate is an array of its own, lanes x width without gaps; gates come from exp, which may overflow.
        table, state = (np.ascontiguousarray(self.values[k].reshape(-1, 3, w).transpose(1, 0, 2)) for k in ("input", "state"))
        table[:2] *= -1
        state[:2] *= -1
        given = np.take(table, units, axis=1)
        begun = keep == 0
        some = begun.any(axis=1).tolist()
        # r, z and n's part from the state; n; the states before and after each step.
        parts = np.empty((len(units), 3, *h.shape), given.dtype)
        inner, before, after = (np.empty((*units.shape, w), given.dtype) for _ in range(3))
        with np.errstate(over="ignore"):
            for t, (g, n, new) in enumerate(zip(parts, inner, after)):
                before[t] = h
                h = before[t]
                if some[t]:
                    h[begun[t]] = 0
                np.matmul(h, state, out=g, casting="same_kind")
                gates = g[:2]
                gates += given[:2, t]
                np.exp(gates, out=gates)
                gates += 1
                np.divide(1, gates, out=gates)
                np.multiply(gates[0], g[2], out=n)
                n += given[2, t]
                np.tanh(n, out=n)
                np.subtract(h, n, out=new)
                new *= gates[1]
                new += n
                h = new
        return after, (parts, inner, before)

    def backward(self, kept: tuple, keep: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of what each step was given and of the state's weights, from those of the states; none leaves the window."""
        (steps, lanes, w), state = grads.shape, self.values["state"]
        parts, n, before = kept
        r, z, gn = (parts[:, k] for k in range(3))
        # What a state's gradient is multiplied by, side by side: n's for the state's weights, r's, z's, and n's for the unit. The rest waits for no step.
        slopes = np.empty((steps, lanes, 4, w), parts.dtype)
        rest = 1 - z
        slope = n * n
        np.subtract(1, slope, out=slope)
        slope *= rest
        slopes[:, :, 3] = slope
        slope *= r
        slopes[:, :, 0] = slope
        slope *= gn
        np.multiply(slope, 1 - r, out=slopes[:, :, 1])
        rest *= z
        np.multiply(rest, before - n, out=slopes[:, :, 2])
        turned = np.ascontiguousarray(np.roll(state, w, axis=1).T)
        begun = keep == 0
        some = begun.any(axis=1).tolist()
        carry = np.zeros((lanes, w), np.result_type(grads, parts))
        for t in range(steps - 1, -1, -1):
            d = grads[t] + carry
            slopes[t] *= d[:, None]
            carry = slopes[t].reshape(lanes, -1)[:, : 3 * w] @ turned
            d *= z[t]
            carry += d
            if some[t]:
                carry[begun[t]] = 0
        own = slopes.reshape(steps, lanes, -1)
        weights = before.reshape(-1, w).T @ own.reshape(-1, 4 * w)[:, : 3 * w]
        return own[:, :, w:], np.roll(weights, -w, axis=1)

    def output(self, states: np.ndarray, units: np.ndarray, learn: int = 0) -> tuple[np.ndarray, dict, np.ndarray | None]:
        """Natural log of the probability of each unit after its state; with ``learn`` also the gradients of their sum, divided by it."""
        v, w = self.values, states.shape[1]
        groups, frequent = len(v["word"]), len(v["word"]) * CLASS
        classes = np.where(units < frequent, units // CLASS, units - frequent + groups)
        # Biases are the weights of a 1 beside the state.
        whole = np.ones((len(states), w + 1), states.dtype)
        whole[:, :w] = states

        def told_of(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
            """The log of each row's softmax at its place; ``raw`` becomes its gradients if they are asked for."""
            if raw.size and raw.max() > HIGH:
                np.minimum(raw, HIGH, out=raw)
            at = np.arange(0, raw.size, raw.shape[1]) + places
            flat = raw.reshape(-1)
            told = flat[at]
            np.exp(raw, out=raw)
            sums = raw @ np.ones(raw.shape[1], raw.dtype)
            if learn:
                raw *= (1 / (learn * sums))[:, None]
                flat[at] -= 1 / learn
            return told - np.log(sums)

        raw = whole @ np.concatenate([v["class"], v["class_bias"][None]])
        told = told_of(raw, classes)
        grads, back = {}, None
        if learn:
            own = whole.T @ raw
            grads = {"class": own[:w], "class_bias": own[w], "word": np.zeros_like(v["word"]), "word_bias": np.zeros_like(v["word_bias"])}
            back = raw @ v["class"].T
        # The frequent words lie class by class.
        order = np.argsort(classes.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(classes, minlength=groups)[:groups]).tolist()
        parts = [(c, slice(a, b)) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
        if parts:
            at = order[: ends[-1]]
            own = whole[at]
            x = np.empty((len(at), CLASS), raw.dtype)
            both = np.concatenate([v["word"], v["word_bias"][:, None]], axis=1)
            for c, part in parts:
                np.matmul(own[part], both[c], out=x[part])
            told[at] += told_of(x, units[at] % CLASS)
            if learn:
                more, inner = np.empty((len(at), w), x.dtype), np.zeros(both.shape, x.dtype)
                for c, part in parts:
                    np.matmul(own[part].T, x[part], out=inner[c])
                    np.matmul(x[part], v["word"][c].T, out=more[part])
                grads["word"], grads["word_bias"] = inner[:, :w], inner[:, w]
                back[at] += more
        return told, grads, back

    def adapt(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.squares[name][rows] += grad * grad
        self.values[name][rows] -= RATE * grad / np.sqrt(self.squares[name][rows])


def side_by_side(texts: list[np.ndarray], lanes: int, longest_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another in lanes of about equal length: all lanes' units behind each other, the number of each unit's text, where lanes begin and end.

    Lanes come by falling length, so those that still have units are the first.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i])) if longest_first else range(len(texts))
    free = [(0, k) for k in range(min(lanes, len(texts)))]
    own: list[list[int]] = [[] for _ in free]
    for i in order:
        size, k = heapq.heappop(free)
        own[k].append(i)
        heapq.heappush(free, (size + len(texts[i]), k))
    ranked = sorted(free, reverse=True)
    laid = [i for _, k in ranked for i in own[k]]
    units = np.concatenate([np.zeros(0, np.uint16), *[texts[i] for i in laid]]).astype(np.int32)
    which = np.repeat(np.array(laid, np.int32), [len(texts[i]) for i in laid])
    ends = np.cumsum([s for s, _ in ranked], dtype=np.int64)
    return units, which, np.r_[0, ends[:-1]] if len(ends) else ends, ends


def windows(units: np.ndarray, which: np.ndarray, starts: np.ndarray, ends: np.ndarray, end: int, span: int) -> Iterator[tuple]:
    """Windows of lanes that still have units: what each step is given, what it is to tell, its text, where texts go on and what is real."""
    given, going = np.full_like(units, end), np.zeros(len(units), np.float32)
    going[1:] = which[1:] == which[:-1]
    np.copyto(given[1:], units[:-1], where=going[1:] > 0)
    sizes = ends - starts
    for t in range(0, int(sizes.max(initial=0)), span):
        n = int((sizes > t).sum())
        at = starts[:n] + np.arange(t, min(t + span, int(sizes[0])))[:, None]
        real = at < ends[:n]
        if not real.all():
            at = np.minimum(at, ends[:n] - 1)
        yield given[at], units[at], which[at], going[at], real


def learn(model: Model, texts: list[np.ndarray], end: int) -> None:
    """One pass over the texts, with states carried across windows, gradients cut at them and the loss of every step."""
    lanes = min(max(sum(map(len, texts)) // PER_LANE, LANES[0]), LANES[1])
    h = np.zeros((lanes, len(model.values["state"])), np.float32)
    for given, units, _, going, real in windows(*side_by_side(texts, lanes, False), end, WINDOW):
        states, kept = model.forward(given, going, h[: given.shape[1]])
        h, real = states[-1], real.ravel()
        flat, told = states.reshape(-1, states.shape[2]), units.ravel()
        whole = real.all()
        _, grads, back = model.output(flat if whole else flat[real], told if whole else told[real], lanes * WINDOW)  # whatever is left in the last windows
        if not whole:
            back, some = np.zeros_like(flat), back
            back[real] = some
        own, grads["state"] = model.backward(kept, going, back.reshape(states.shape))
        ids = given.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        model.adapt("input", np.add.reduceat(own.reshape(len(ids), -1)[order], first), ids[order[first]])
        for name, grad in grads.items():
            model.adapt(name, grad)


def log_likelihood(model: Model, texts: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log of the probability of each whole text's units, in double precision."""
    out = np.zeros(len(texts))
    h = np.zeros((SIDE, len(model.values["state"])), np.float32)
    for given, units, which, going, real in windows(*side_by_side(texts, SIDE, True), end, SPAN):
        states, _ = model.forward(given, going, h[: given.shape[1]])
        h, real = states[-1], real.ravel()
        told, _, _ = model.output(states.reshape(-1, states.shape[2])[real], units.ravel()[real])
        out += np.bincount(which.ravel()[real], told.astype(np.float64), len(texts))
    return out


# ---- The corpus, in Spark


def blocks(texts: pa.Array) -> Iterator[bytes]:
    """The texts' bytes after ``TABLE``, each followed by ``END`` between blanks, about ``BLOCK`` at a time; no word is cut."""
    data, at = buffer_of(texts)
    held, size = [], 0
    for i in range(len(texts)):
        text, k = bytes(data[at[i] : at[i + 1]]).translate(TABLE), 0
        while len(text) - k > BLOCK:
            end = text.rfind(b" ", k, k + BLOCK)
            if end <= k and (end := text.find(b" ", k + BLOCK)) < 0:
                break
            yield b"".join([*held, text[k:end]])
            held, size, k = [], 0, end
        held += text[k:], b" ", END, b" "
        size += len(text) - k
        if size > BLOCK:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def words_of(block: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words between blanks, and the first two bytes of each as a number (65536 and the byte for a word of one)."""
    seen = np.frombuffer(block + b" ", np.uint8)
    inside = seen != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    first = seen[starts].astype(np.int32)
    heads = np.where(sizes > 1, first * 256 + seen[starts + 1], 65536 + first)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(seen[inside])]), heads


def counted(docs: DataFrame, text: str) -> DataFrame:
    """``word, c``: tokens of all whole texts, ``END`` among them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for b in batches:
            for block in blocks(b.column(0)):
                found = pc.value_counts(words_of(block)[0])
                held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
                if sum(map(len, held)) > 2 * HELD:
                    held = [merged()]
                    if len(held[0]) > HELD:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    found = docs.select(utf8(F.col(f"`{text}`")).alias("bytes")).mapInArrow(make, "word binary, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


class Words:
    """What tasks know of the words: the counts of the most frequent, their units, and the classes of the others."""

    def __init__(self, counts: DataFrame):
        level = F.floor(F.log2("c") * 32).cast("int")  # 2000 levels at most
        levels = counts.groupBy(level.alias("level")).agg(F.count("*"), F.sum("c")).orderBy(F.col("level").desc()).collect()
        self.distinct, self.total = sum(r[1] for r in levels), sum(r[2] for r in levels)
        least, held = None, 0
        for r in levels:
            held += r[1]
            if held > TOP:
                break
            least = r["level"]
        top = counts.where(level >= least).collect() if least is not None else []  # ``TOP`` at most
        ranked = sorted(((r["c"], bytes(r["word"])) for r in top), key=lambda x: (-x[0], x[1]))
        self.count = {w: c for c, w in ranked}
        # The end is a unit even where no text was learned from.
        own = [END, *[w for _, w in ranked if w != END][: UNITS - 1]]
        self.unit = {w: i for i, w in enumerate(own)}
        self.frequent = -(-len(own) // CLASS) * CLASS
        words = np.zeros(self.frequent)
        words[: len(own)] = [self.count.get(w, 1) for w in own]
        self.words = words.reshape(-1, CLASS)
        heads = {bytes(r["head"]): [r[1], r[2]] for r in counts.groupBy(F.substring("word", 1, HEAD).alias("head")).agg(F.sum("c"), F.count("*")).collect()}  # 65,792 at most
        for w in own:
            if w[:HEAD] in heads and w in self.count:
                heads[w[:HEAD]][0] -= self.count[w]
                heads[w[:HEAD]][1] -= 1
        kept = sorted((h for h in heads if heads[h][1]), key=lambda h: (-heads[h][0], h))[: OTHERS - 1]
        self.head = {h: self.frequent + i for i, h in enumerate(kept)}
        self.rest = self.frequent + OTHERS - 1
        mass = np.zeros((OTHERS, 2))
        for h, (c, n) in heads.items():
            mass[self.head.get(h, self.rest) - self.frequent] += c, n
        #: Tokens and different words of each class of others, and of the classes of frequent words.
        self.others, self.mass = mass, np.r_[self.words.sum(axis=1), mass[:, 0]]

    def below(self) -> np.ndarray:
        """log10 of what c + 0.5 is divided by, for each unit's word: 1 (0) for frequent words, which the model tells itself."""
        return np.r_[np.zeros(self.frequent), np.log10(self.others[:, 0] + 0.5 * (self.others[:, 1] + 1))]


def marked(docs: DataFrame, key: str, text: str, train: Column, words: Words) -> DataFrame:
    """Each text as units, with the log10 counts of its words known here and the list of all others.

    ``row, train, mix, key, units, n_tokens, n_top, top_log, top_rare_log, rare, times``.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        place = {w: i for i, w in enumerate(words.count)}
        top = pa.array(place, pa.binary())
        # No other word begins like the end, which is a unit even where no text was learned from.
        number = lambda w: w[0] * 256 + w[1] if len(w) > 1 else 65536 + w[0]
        by_head = np.full(65536 + 256, words.rest, np.uint16)
        for w, unit in [*words.head.items(), (END, words.unit[END])]:
            by_head[number(w)] = unit
        # What lies behind the last word is for words that aren't known here.
        units, logs = np.zeros(len(place) + 1, np.uint16), np.zeros(len(place) + 1)
        units[:-1] = by_head[np.fromiter(map(number, place), np.int32, len(place))]
        for w, unit in words.unit.items():
            if w in place:
                units[place[w]] = unit
        logs[:-1] = np.log10(np.fromiter(words.count.values(), np.float64, len(place)) + 0.5)
        rare_logs = logs * (units >= words.frequent)
        # The end is a unit all the same, whose probability the model tells.
        ends = 0.0 if END in place else -math.log10(0.5)
        for b in batches:
            n, told, done = len(b), [], 0
            size, known, log, rare_log = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.full(n, ends)
            strange = [pa.table({"doc": pa.array([], pa.int64()), "word": pa.array([], pa.binary())})]
            for block in blocks(b.column(b.num_columns - 1)):
                own, heads = words_of(block)
                index = pc.fill_null(pc.index_in(own, value_set=top), -1).to_numpy()
                last = np.cumsum(heads == number(END))
                doc = done + np.r_[0, last[:-1]]
                done += int(last[-1]) if len(last) else 0
                unit, missing = units[index], np.flatnonzero(index < 0)
                unit[missing] = by_head[heads[missing]]
                told.append(unit)
                every = np.bincount(doc, minlength=n)
                size += every
                known += every - np.bincount(doc[missing], minlength=n)
                log += np.bincount(doc, logs[index], n)
                rare_log += np.bincount(doc, rare_logs[index], n)
                strange.append(pa.table({"doc": doc[missing], "word": own.take(pa.array(missing))}))
            found = pa.concat_tables(strange).group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
            at = pa.array(np.searchsorted(found["doc"].to_numpy(), np.arange(n + 1)), pa.int32())
            rare, times = (pa.ListArray.from_arrays(at, found[c].combine_chunks()) for c in ("word", "count_all"))
            ranges = pa.py_buffer(np.cumsum(np.r_[0, 2 * size], dtype=np.int32))
            flat = pa.Array.from_buffers(pa.binary(), n, [None, ranges, pa.py_buffer(np.concatenate(told, dtype="<u2") if told else b"")])
            columns = [flat, *map(pa.array, (size, known, log, rare_log)), rare, times]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], "units", "n_tokens", "n_top", "top_log", "top_rare_log", "rare", "times"])

    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), train.alias("train"), F.xxhash64(k, t).alias("mix"), k.alias("key"), utf8(t).alias("bytes")
    )
    kind = docs.select(k.alias("key")).schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        make,
        f"row long, train boolean, mix long, key {kind}, units binary, n_tokens long, n_top long, top_log double, top_rare_log double, rare array<binary>, times array<long>",
    )


def train(texts: DataFrame, words: Words) -> Model:
    """The model of ``texts`` (``mix, units, n_tokens``): each text is learned from once, in one round and shard.

    Shards of a round begin with the mean of the last round's and are dealt by
    a hash, so any part of the corpus is in all; a lost task is done again and
    gives the same. Only the model, of fixed size, reaches the driver.
    """
    spark = texts.sparkSession
    model = Model.new(words.mass, words.words, words.frequent + OTHERS, WIDTH)
    size = texts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(round(size / ROUNDS / SHARD), 1)
    dealt = texts.select("mix", "units", F.pmod(F.xxhash64("mix", F.lit(1)), F.lit(shards)).alias("shard"), F.pmod("mix", F.lit(ROUNDS)).alias("round"))
    for r in range(ROUNDS if size else 0):
        shared = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, weight, now, own = None, 0, None, []

            def finish() -> None:
                nonlocal total, weight
                start = shared.value
                mine = start.like(start.flat())
                learn(mine, own, 0)
                n = sum(map(len, own))
                total = mine.flat().astype(np.float64) * n + (0 if total is None else total)
                weight += n

            for b in batches:
                for shard, units in zip(*(c.to_pylist() for c in b.columns)):
                    if shard != now and own:
                        finish()
                        own = []
                    now = shard
                    own.append(np.frombuffer(units, "<u2"))
            if own:
                finish()
            pieces = [] if total is None else [total[i : i + PIECE].astype("<f8").tobytes() for i in range(0, len(total), PIECE)]
            columns = [pa.array(range(len(pieces)), pa.int32()), pa.array([weight] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "weight", "numbers"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for piece, weight, numbers in zip(*(c.to_pylist() for c in b.columns)):
                    old = sums.get(piece, (0, 0.0))
                    sums[piece] = (old[0] + weight, old[1] + np.frombuffer(numbers, "<f8"))
            told = [(p, (x / w).astype("<f4").tobytes()) for p, (w, x) in sums.items()]
            columns = list(zip(*told)) if told else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], names=["piece", "numbers"])

        own = dealt.where(F.col("round") == r).repartition(shards, "shard").sortWithinPartitions("shard", "mix")
        models = own.select("shard", "units").mapInArrow(work, "piece int, weight long, numbers binary")
        got = sorted(models.repartition("piece").mapInArrow(mean, "piece int, numbers binary").collect())  # one model
        if got:
            model = model.like(np.concatenate([np.frombuffer(x["numbers"], "<f4") for x in got]))
        shared.unpersist()
    return model


def score(docs: DataFrame, train_on: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Words (A-Z in lower case) and one ``END`` are the tokens. ``base_score`` is
    the log10 probability under the smoothed counts of the rows where
    ``train_on`` holds, ``score`` that of the model, which learns from the same
    rows; words that these don't have share one place in each class. Null and
    empty texts are their end alone. Repeated rows and keys, and rows without
    a key, are texts of their own. Without any row to learn from all tokens
    are unknown. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    learned = F.coalesce(train_on, F.lit(False))
    counts = stored(counted(docs.where(learned), text))
    words = Words(counts)
    texts = stored(marked(docs, key, text, learned, words))
    shared = spark.sparkContext.broadcast((train(texts.where("train"), words), words.below()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, below = shared.value

        def told(own: list) -> pa.RecordBatch:
            arrays = [np.frombuffer(x, "<u2") for _, x in own]
            score = log_likelihood(model, arrays, 0) / math.log(10)
            score -= np.array([below[x].sum() for x in arrays])
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in own], pa.int64()), pa.array(score, pa.float64())], names=["row", "told"])

        own, size = [], 0
        for b in batches:
            for row, units in zip(*(c.to_pylist() for c in b.columns)):
                own.append((row, units))
                size += len(units) // 2
                if size > SCORED:
                    yield told(own)
                    own, size = [], 0
        if own:
            yield told(own)

    likely = texts.select("row", "units").mapInArrow(make, "row long, told double")
    # Words that no task knows meet their counts; a row of each text and word.
    each = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    log = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    found = each.join(counts, "word", "left").groupBy("row").agg(F.sum(log).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    whole = texts.drop("units", "rare", "times", "mix").join(likely, "row").join(found, "row", "left")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    below = math.log10(words.total + 0.5 * (words.distinct + 1))
    return whole.select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_top") + rare_known).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("top_log") + rare_log - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("told") + F.col("top_rare_log") + rare_log).alias("score"),
    )
